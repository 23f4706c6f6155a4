"""Reports of comparisons and syncs, as text and as JSON."""

from __future__ import annotations

import json

from ..operators.diff import TableResult
from . import structure
from .sync import TableSync

#: Report fields that stand for what is shown of a sync plan.
SYNC_FIELDS = ("name", "mode", "src_rows", "dst_rows", "inserts", "updates", "deletes", "status", "error", "verified")


#: Differing chunks that a report lists; their number is reported beside.
MOST_CHUNKS = 1000


def _chunks(result: TableResult) -> tuple[list[dict], int]:
    """The first differing chunks, with their bounds and both sides' digests, and how many there are."""
    if result.diff_chunks is None:
        return [], 0
    found = result.diff_chunks.orderBy("chunk_id").limit(MOST_CHUNKS).collect()  # bounded
    listed = [{"id": r["chunk_id"], "lo": r["lo"], "hi": r["hi"], "src": r["src_digest"], "dst": r["dst_digest"], "src_rows": r["src_n"], "dst_rows": r["dst_n"]} for r in found]
    return listed, len(listed) if len(listed) < MOST_CHUNKS else result.diff_chunks.count()


def _rows(result: TableResult) -> list[dict]:
    return [r.asDict() for r in result.rows.collect()] if result.rows is not None else []  # limited by the spec


def diff_json(results: list[TableResult]) -> str:
    tables = []
    for r in results:
        chunks, n = _chunks(r)
        plain = {k: getattr(r, k) for k in ("name", "src_rows", "dst_rows", "status", "error", "chunks", "src_fp", "dst_fp", "truncated", "warnings")}
        tables.append(plain | {"diff_chunks": chunks, "diff_chunk_count": n, "rows": _rows(r)})
    same = sum(r.status == "OK" for r in results)
    return json.dumps({"ok": same == len(results), "summary": {"total": len(results), "ok": same}, "tables": tables}, indent=2, default=str)


def diff_text(results: list[TableResult]) -> str:
    lines = []
    for r in results:
        lines.append(f"{r.status:<10} {r.name}: {r.src_rows} rows, {r.dst_rows} on the destination" + f" ({r.error})" * bool(r.error))
        lines += [f"  warning: {w}" for w in r.warnings]
        chunks, n = _chunks(r)
        lines += [f"  chunk {c['id']} [{c['lo']}, {c['hi']}]: {c['src_rows']} rows, {c['dst_rows']} on the destination" for c in chunks]
        lines += [f"  and {n - len(chunks)} more chunks"] * (n > len(chunks))
        lines += [f"  {x['kind']} {x['key']}: {x['src']} / {x['dst']}" for x in _rows(r)]
    same = sum(r.status == "OK" for r in results)
    return "\n".join([*lines, f"{same} of {len(results)} tables are the same"])


def sync_json(plans: list[TableSync], applied: bool) -> str:
    tables = [{k: getattr(p, k) for k in SYNC_FIELDS} | {"schema_changed": bool(p.schema_sql), "schema_sql": p.schema_sql, "destructive_sql": [x for x in p.schema_sql if structure.destructive(x)], "state_verified": p.state_verified, "state_changed": bool(p.state_sql), "state_sql": p.state_sql, "state_note": p.state_note, "sample_sql": sample_sql(p)} for p in plans]
    return json.dumps({"ok": all(p.status != "FAILED" for p in plans), "applied": applied, "summary": {"total": len(plans)}, "tables": tables}, indent=2, default=str)


def sample_sql(plan: TableSync) -> list[str]:
    """The sampled changes as statements, for reading."""
    if plan.sample is None:
        return []
    out = []
    show = lambda d: {k: str(v) for k, v in d.asDict().items()} if d is not None else {}
    for r in plan.sample.collect():  # limited by the options
        row, address = show(r["row"]), show(r["address"])
        where = " AND ".join(f"{k} = {v!r}" for k, v in address.items())
        if r["op"] == "insert":
            out.append(f"INSERT INTO {plan.name} ({', '.join(row)}) VALUES ({', '.join(map(repr, row.values()))})")
        elif r["op"] == "update":
            out.append(f"UPDATE {plan.name} SET {', '.join(f'{k} = {v!r}' for k, v in row.items() if k not in address)} WHERE {where}")
        else:
            out.append(f"DELETE FROM {plan.name} WHERE {where}")
    return out


def sync_text(plans: list[TableSync]) -> str:
    lines = []
    for p in plans:
        lines.append(f"{p.mode:<8} {p.name}: {p.inserts} inserts, {p.updates} updates, {p.deletes} deletes, {p.status}" + f" ({p.error})" * bool(p.error))
        lines += [f"  {s}" for s in [*p.schema_sql, *p.state_sql, *sample_sql(p)]]
    return "\n".join(lines)


#: What a plan does to a table, by its mode.
WORK = {"FULL": "truncated and reloaded", "ROWLEVEL": "changed row by row", "CREATE": "created", "DROP": "dropped", "STATE": "counter raised"}


def confirm_text(plans: list[TableSync], allow_structure_truncate: bool = False) -> str:
    """What there is to confirm: tables by what is done to them, then by themselves whatever can't be undone."""
    works = [p for p in plans if p.mode in WORK and not (p.mode == "STATE" and not p.state_sql)]
    lines = [f"{len(works)} of {len(plans)} tables would be changed; {sum(p.status == 'FAILED' for p in plans)} failed"]
    for mode, work in WORK.items():
        names = [p.name + " (structure first)" * bool(p.schema_sql and mode in ("FULL", "ROWLEVEL")) for p in works if p.mode == mode]
        lines += [f"  {work}: {', '.join(names)}"] * bool(names)
    lines += [f"  {p.name}: {p.state_note}" for p in plans if p.state_note]
    destructive = [s for p in plans for s in p.schema_sql if structure.destructive(s)]
    emptied = [p.name for p in plans if p.scope.deletes_source_empty]
    rewritten = [f"{p.name} ({len(p.scope.rewrites)} groups)" for p in plans if p.scope.rewrites]
    for what, listed in (("statements that can't be undone", destructive), ("emptied, as the source is empty", emptied), ("rows deleted and inserted again to free unique values", rewritten)):
        lines += [f"DESTRUCTIVE, {what}:", *[f"  {x}" for x in listed]] if listed else []
    if allow_structure_truncate:
        lines.append("a table whose structure can't be changed in place may be truncated")
    return "\n".join(lines)
