"""Structure differences and the DDL that removes them."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from ..functions import families as fam
from ..functions.canonical import quote_identifier
from .schema import Column, Index, PlanError, TableSchema

ADD_COLUMN, MODIFY_COLUMN, DROP_COLUMN, ADD_INDEX, DROP_INDEX = "ADD_COLUMN", "MODIFY_COLUMN", "DROP_COLUMN", "ADD_INDEX", "DROP_INDEX"


@dataclass(frozen=True)
class Change:
    kind: str
    column: Column | None = None
    index: Index | None = None
    after: str = ""  # the column before an added one; empty: first


def _type_of(column: Column) -> str:
    """A type as it counts for drift: integer display widths don't, nor does DATETIME against TIMESTAMP."""
    raw = " ".join(column.raw_type.lower().split())
    if column.family in (fam.INT, fam.UINT):
        name = raw.split("(")[0].split()[0]
        return f"{'int' if name == 'integer' else name}{' unsigned' if column.family == fam.UINT else ''}"
    if column.family in (fam.DATETIME, fam.TIMESTAMP):
        return f"datetime({column.info.scale})"
    return raw


def drifted(src: Column, dst: Column, src_default: str = "", dst_default: str = "") -> list[str]:
    """In what two definitions of a column differ; comments don't count, nor do two default collations."""
    both_default = src.collation == src_default and dst.collation == dst_default and src_default != ""
    facts = [
        ("type", _type_of(src) != _type_of(dst)),
        ("nullability", src.nullable != dst.nullable),
        ("default", (src.default, src.default_is_expression) != (dst.default, dst.default_is_expression)),
        ("auto_increment", src.auto_increment != dst.auto_increment),
        ("on update", src.on_update.lower() != dst.on_update.lower()),
        ("collation", src.collation != dst.collation and not both_default),
        ("charset", src.charset != dst.charset and not both_default),
        ("generated", (src.generated, src.stored) != (dst.generated, dst.stored) or bool(src.generated or dst.generated) and not (src.generated_readable and dst.generated_readable)),
    ]
    return [name for name, differs in facts if differs]


def _reproducible(column: Column) -> Column:
    if column.generated:
        raise PlanError(f"column {column.name} is generated: its expression is not reproduced")
    if column.default_is_expression:
        raise PlanError(f"column {column.name} has an expression default, which is not reproduced")
    return column


def diff_structure(src: TableSchema, dst: TableSchema) -> list[Change]:
    """Changes that give ``dst`` the structure of ``src``. Indexes are what they cover, not their names; a
    renamed column is one dropped and one added."""
    ours, theirs = {c.name: c for c in src.columns}, {c.name: c for c in dst.columns}
    out: list[Change] = []
    before = ""
    for name, column in ours.items():
        if name not in theirs:
            out.append(Change(ADD_COLUMN, _reproducible(column), after=before))
        elif drifted(column, theirs[name], src.default_collation, dst.default_collation):
            if (column.generated or theirs[name].generated) and not (column.generated_readable and theirs[name].generated_readable):
                raise PlanError(f"column {name}: a generation expression can't be read, so equality can't be shown")
            out.append(Change(MODIFY_COLUMN, _reproducible(column)))
        before = name
    out += [Change(DROP_COLUMN, c) for name, c in theirs.items() if name not in ours]
    covered = lambda s: {(i.columns, i.primary): i for i in s.indexes if i.unique}
    mine, other = covered(src), covered(dst)
    out += [Change(DROP_INDEX, index=i) for k, i in other.items() if k not in mine]
    out += [Change(ADD_INDEX, index=i) for k, i in mine.items() if k not in other]
    return out


def without(schema: TableSchema, ignored: list[str]) -> TableSchema:
    """A schema without ignored columns and the indexes that touch them."""
    gone = {n.lower() for n in ignored}
    columns = tuple(c for c in schema.columns if c.name.lower() not in gone)
    return replace(schema, columns=columns, indexes=tuple(i for i in schema.indexes if not gone & {c.lower() for c in i.columns}))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "''") + "'"


def column_ddl(c: Column) -> str:
    parts = [quote_identifier(c.name), c.raw_type]
    if c.charset:
        parts.append(f"CHARACTER SET {c.charset}")
    if c.collation:
        parts.append(f"COLLATE {c.collation}")
    parts.append("NULL" if c.nullable else "NOT NULL")
    if c.default is not None:
        parts.append(f"DEFAULT {c.default if c.default.upper().startswith('CURRENT_TIMESTAMP') else _quoted(c.default)}")
    if c.on_update:
        parts.append(f"ON UPDATE {c.on_update}")
    if c.auto_increment:
        parts.append("AUTO_INCREMENT")
    if c.comment:
        parts.append(f"COMMENT {_quoted(c.comment)}")
    return " ".join(parts)


def _names(columns: tuple[str, ...]) -> str:
    return ", ".join(map(quote_identifier, columns))


def _index_ddl(i: Index) -> str:
    return f"PRIMARY KEY ({_names(i.columns)})" if i.primary else f"UNIQUE KEY {quote_identifier(i.name)} ({_names(i.columns)})"


def render_ddl(table: str, changes: list[Change]) -> list[str]:
    """One ALTER with everything in order: indexes dropped, columns dropped, redefined, added, indexes
    added. Index work on columns that the same ALTER defines follows in a second one; indexes of dropped
    columns go with them."""
    defined = {c.column.name for c in changes if c.kind in (ADD_COLUMN, MODIFY_COLUMN)}
    dropped = {c.column.name for c in changes if c.kind == DROP_COLUMN}
    clauses: dict[str, list[str]] = {k: [] for k in (DROP_INDEX, DROP_COLUMN, MODIFY_COLUMN, ADD_COLUMN, ADD_INDEX, "later")}
    for c in changes:
        if c.kind in (DROP_INDEX, ADD_INDEX):
            if set(c.index.columns) & dropped:
                continue
            drop = "DROP PRIMARY KEY" if c.index.primary else f"DROP INDEX {quote_identifier(c.index.name)}"
            text = drop if c.kind == DROP_INDEX else f"ADD {_index_ddl(c.index)}"
            clauses["later" if set(c.index.columns) & defined else c.kind].append(text)
        elif c.kind == DROP_COLUMN:
            clauses[c.kind].append(f"DROP COLUMN {quote_identifier(c.column.name)}")
        elif c.kind == MODIFY_COLUMN:
            clauses[c.kind].append(f"MODIFY COLUMN {column_ddl(c.column)}")
        else:
            place = f"AFTER {quote_identifier(c.after)}" if c.after else "FIRST"
            clauses[c.kind].append(f"ADD COLUMN {column_ddl(c.column)} {place}")
    later = clauses.pop("later")
    return [f"ALTER TABLE {quote_identifier(table)} {', '.join(x)}" for x in ([c for k in clauses.values() for c in k], later) if x]


def render_create(schema: TableSchema) -> str:
    for c in schema.columns:
        _reproducible(c)
    lines = [column_ddl(c) for c in schema.columns] + [_index_ddl(i) for i in schema.indexes if i.unique]
    counter = f" AUTO_INCREMENT={schema.auto_increment_counter}" if schema.auto_increment_counter else ""
    return f"CREATE TABLE {quote_identifier(schema.table)} ({', '.join(lines)}) ENGINE={schema.engine}{counter}"


def destructive(statement: str) -> bool:
    upper = statement.upper()
    return any(x in upper for x in ("DROP TABLE", "DROP COLUMN", "DROP PRIMARY KEY", "DROP INDEX"))


def counter_of(create: str) -> int | None:
    """The auto-increment counter of a CREATE TABLE statement's table options; None where there is none.
    Quoted texts don't count, so a comment can't pass for one."""
    plain = re.sub(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`""", "''", create, flags=re.S)
    found = re.search(r"\bAUTO_INCREMENT\s*=\s*([0-9]+)", plain[plain.rfind(")") :], re.I)
    return int(found[1]) if found else None
