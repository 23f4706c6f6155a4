"""Decisions about a sync: its mode, its scope, its batches, its confirmation. No rows are read here."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

SKIP, FULL, ROWLEVEL, ERROR, CREATE, DROP, STATE = "SKIP", "FULL", "ROWLEVEL", "ERROR", "CREATE", "DROP", "STATE"
SKIPPED, PLANNED, APPLIED, FAILED = "SKIPPED", "PLANNED", "APPLIED", "FAILED"
#: Statement limits of the wire protocol, and what one check of unique tuples covers.
MOST_PARAMETERS, MOST_TUPLES = 60_000, 10_000


@dataclass(frozen=True)
class Facts:
    """What the decision depends on besides the comparison."""

    src_keyed: bool = True
    dst_keyed: bool = True
    src_unique: bool = True
    dst_unique: bool = True
    keys_agree: bool = True
    order_compatible: bool = True
    addressable: bool = True


@dataclass
class Plan:
    mode: str
    reason: str = ""
    error: str = ""
    argument: bool = False
    chunks: list[int] = field(default_factory=list)


def decide(status: str, error: str, facts: Facts, where: str = "", chunks: Sequence[int] = ()) -> Plan:
    """How to make a table equal. Under a filter a whole-table reload is never an answer, so whatever
    would need one is an argument error; row counts play no part."""
    if status == "OK":
        return Plan(SKIP, "identical")
    if status == "ERROR":
        return Plan(ERROR, error=error)
    keyed = facts.src_keyed and facts.dst_keyed
    obstacles = [
        (not keyed, "no usable key on both sides", True),
        (not (facts.src_unique and facts.dst_unique), "the key is not unique on both sides", False),
        (not facts.keys_agree, "the sides' keys differ", True),
        (not facts.order_compatible, "the sides order the key differently", None),
        (not facts.addressable, "the key has an ENUM or SET column: no key ranges", True),
    ]
    for met, why, reload in obstacles:
        if not met:
            continue
        if where:
            return Plan(ERROR, error=f"{why}: a filtered sync is not possible", argument=True)
        if reload is None:
            return Plan(ERROR, error=f"{why}: row-level sync is refused; align the key's family and collation")
        if reload:
            return Plan(FULL, f"{why}: truncate and reload")
    return Plan(ROWLEVEL, "row-level sync", chunks=sorted(chunks))


@dataclass(frozen=True)
class Scope:
    """What a confirmed plan may destroy."""

    full: bool = False
    rewrites: frozenset[str] = frozenset()
    deletes_source_empty: bool = False
    ddl: bool = False


def within_scope(confirmed: Scope, now: Scope) -> str:
    """Empty if ``now`` destroys nothing that was not confirmed; fewer is fine, other is not."""
    if now.full and not confirmed.full:
        return "the table now needs a full reload, which was not confirmed"
    if now.deletes_source_empty and not (confirmed.deletes_source_empty or confirmed.full):
        return "the source is now empty, and deleting all rows was not confirmed"
    if now.ddl and not confirmed.ddl:
        return "a destructive structure change was not confirmed"
    new = now.rewrites - confirmed.rewrites
    return f"{len(new)} groups would be rewritten that were not confirmed" if new and not confirmed.full else ""


@dataclass(frozen=True)
class AutoIncrement:
    src: int
    dst: int
    exact: bool = True


def state_check(found: AutoIncrement | None, where: str = "") -> tuple[str, str]:
    """(action, note) for the auto-increment counter: raise it, or say why not."""
    if found is None or where or found.src == found.dst:
        return "", ""
    if found.dst > found.src:
        return "", f"destination counter {found.dst} is ahead of the source's {found.src}; left as it is"
    if not found.exact and found.src - found.dst <= 10_000:
        return "", "counters are approximate here and close enough"
    return f"AUTO_INCREMENT = {found.src}", ""


# -- table sets ------------------------------------------------------------------------------------


def common_tables(src: Iterable[str], dst: Iterable[str], only: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """Tables of both sides, less the excluded; those asked for by name must be there."""
    both, gone = set(src) & set(dst), set(exclude)
    missing = [t for t in only if t not in both]
    if missing:
        raise ValueError(f"table {missing[0]} is not on both sides")
    return sorted((set(only) if only else both) - gone)


def sync_tables(src: Iterable[str], dst: Iterable[str], only: Sequence[str] = (), exclude: Sequence[str] = (), where: str = "") -> tuple[list[str], list[str]]:
    """(tables to sync, tables to drop): only a sync of everything, without a filter, drops."""
    gone = set(exclude)
    wanted = sorted((set(only) if only else set(src)) - gone)
    drops = [] if only or where else sorted(set(dst) - set(src) - gone)
    return wanted, drops


# -- statements ------------------------------------------------------------------------------------


def batches(sizes: Iterable[int], most_rows: int, most_bytes: int, parameters_per_row: int) -> Iterator[range]:
    """Ranges of rows that fit one statement; a row over the byte budget is an error."""
    most = max(1, min(most_rows, MOST_PARAMETERS // max(parameters_per_row, 1)))
    start = total = at = 0
    for at, size in enumerate(sizes):
        if size > most_bytes:
            raise ValueError(f"row {at} takes {size} bytes; a statement holds {most_bytes}")
        if at > start and (total + size > most_bytes or at - start >= most):
            yield range(start, at)
            start, total = at, 0
        total += size
    if total or at > start or start == at == 0 and total:
        yield range(start, at + 1)


def delete_cap(key_columns: int, batch: int) -> int:
    return max(1, min(batch, MOST_PARAMETERS // max(key_columns, 1)))


def groups_of(n: int, size: int) -> list[range]:
    return [range(a, min(n, a + size)) for a in range(0, n, size)]


def needs_confirmation(plans: Iterable[Plan], yes: bool, answer: str | None) -> bool:
    """Whether the apply may go on: nothing to do, a standing yes, or an answer of yes."""
    if all(p.mode == SKIP for p in plans) or yes:
        return False
    return (answer or "").strip().lower() not in ("y", "yes")


def exit_code(statuses: Iterable[str], argument_error: bool = False) -> int:
    """0 the same, 1 different or planned, 2 an error, 3 an argument error."""
    found = set(statuses)
    if argument_error:
        return 3
    if found & {"ERROR", FAILED}:
        return 2
    return 1 if found & {"DIFFERENT", PLANNED} else 0
