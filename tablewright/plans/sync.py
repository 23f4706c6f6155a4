"""From a comparison to a plan, and from a confirmed plan to a changed destination.

A dry run writes nothing. An apply decides everything anew, refuses whatever the confirmed plan did not
show, writes each table as one new version, and compares again.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import families as fam
from ..operators import changes as ops
from ..operators import chunking, diff
from ..sources.shared import fixed
from ..sources.jdbc import JdbcSide, JdbcWriter
from ..sources.tables import Side, Writer
from . import decide, schema as schemas, structure
from .schema import PlanError, TableSchema


#: Rewritten groups that a plan names each by its fingerprint; with more, the plan is a reload.
MOST_REWRITES = 100_000


@dataclass(frozen=True)
class SyncOptions:
    spec: diff.Spec = diff.Spec()
    sync_schema: bool = True
    allow_row_rewrite: bool = False
    allow_structure_truncate: bool = False
    batch_size: int = 1000
    sample_limit: int = 5
    parallel: int = 1


@dataclass
class TableSync:
    name: str
    mode: str = decide.SKIP
    status: str = decide.SKIPPED
    error: str = ""
    argument: bool = False
    src_rows: int = 0
    dst_rows: int = 0
    inserts: int = 0
    updates: int = 0
    deletes: int = 0
    verified: bool = False
    schema_sql: list[str] = field(default_factory=list)
    state_sql: list[str] = field(default_factory=list)
    state_note: str = ""
    state_verified: bool = False
    sample: DataFrame | None = None
    changes: DataFrame | None = None
    scope: decide.Scope = decide.Scope()
    warnings: list[str] = field(default_factory=list)


def _facts(a: TableSchema, b: TableSchema) -> decide.Facts:
    return decide.Facts(bool(a.key), bool(b.key), a.key_unique, b.key_unique, schemas.keys_agree(a, b), schemas.key_order_compatible(a, b)[0], schemas.range_addressable(a, b)[0])


def _keyed(a: TableSchema, b: TableSchema, spec: diff.Spec) -> tuple[TableSchema, TableSchema]:
    if spec.key:
        return schemas.explicit_key(a, list(spec.key))[0], schemas.explicit_key(b, list(spec.key))[0]
    return a, b


def plan_table(src: Side, dst: Side, table: str, options: SyncOptions = SyncOptions()) -> TableSync:
    """The plan of one table; nothing is written but intermediate tables."""
    spec, out = options.spec, TableSync(table)
    try:
        if not dst.has(table):
            if not options.sync_schema or spec.where:
                raise PlanError(f"table {table} is missing on the destination")
            a = src.schema(table)
            out.mode, out.status, out.src_rows = decide.CREATE, decide.PLANNED, src.read(table).count()
            out.schema_sql, out.inserts = [structure.render_create(a)], out.src_rows
            return out
        a, b = src.schema(table), dst.schema(table)
        ours, theirs = structure.without(a, list(spec.ignore)), structure.without(b, list(spec.ignore))
        drift = structure.diff_structure(ours, theirs) if options.sync_schema else []
        if drift:
            if spec.where:
                raise PlanError("the structure differs: a filtered sync is not possible", argument=True)
            out.schema_sql, out.status = structure.render_ddl(table, drift), decide.PLANNED
            listed = any(a.column(k).family in (fam.ENUM, fam.SET) for k in a.key)
            out.mode = decide.ROWLEVEL if a.key and not listed else decide.FULL
            out.scope = decide.Scope(full=out.mode == decide.FULL, ddl=any(map(structure.destructive, out.schema_sql)))
            out.src_rows, out.dst_rows = src.read(table).count(), dst.read(table).count()
            return out
        return _plan_rows(src.read(table), dst.read(table), a, b, options, out)
    except PlanError as error:
        out.mode, out.status, out.error, out.argument = decide.ERROR, decide.FAILED, str(error), error.argument
        return out


def _plan_rows(src: DataFrame, dst: DataFrame, a: TableSchema, b: TableSchema, options: SyncOptions, out: TableSync) -> TableSync:
    spec = options.spec
    result = diff.compare(out.name, src, dst, a, b, replace(spec, chunks_always=True, drill=False))
    out.src_rows, out.dst_rows, out.warnings = result.src_rows, result.dst_rows, result.warnings
    a, b = _keyed(a, b, spec)
    plan = decide.decide(result.status, result.error, _facts(a, b), spec.where)
    out.mode, out.error, out.argument = plan.mode, plan.error, plan.argument
    if plan.mode != decide.ERROR:
        out.state_sql, out.state_note = _state(src, dst, a, b, spec)
    if plan.mode == decide.SKIP:
        found = bool(out.state_sql or out.state_note)  # a counter ahead has no statement, but is reported
        out.mode, out.status = (decide.STATE, decide.PLANNED) if found else (decide.SKIP, decide.SKIPPED)
    elif plan.mode == decide.ERROR:
        out.status = decide.FAILED
    elif plan.mode == decide.FULL:
        out.status, out.inserts, out.deletes, out.scope = decide.PLANNED, out.src_rows, out.dst_rows, decide.Scope(full=True)
    else:
        _plan_row_level(src, dst, a, b, options, out, result)
    return out


def _plan_row_level(src: DataFrame, dst: DataFrame, a: TableSchema, b: TableSchema, options: SyncOptions, out: TableSync, result: diff.TableResult) -> None:
    """Row work on the differing chunks only: the comparison of the same rows just before has proved the others
    equal. Plan and comparison are one pass over one version, so no planned chunk can be stale; an apply decides
    anew and refuses what goes beyond the confirmed scope."""
    spec = options.spec
    src, dst, a, b, _, _ = diff.prepare(src, dst, a, b, spec)
    key = list(a.key)
    some = [x.drop("chunk_id") for x in result.some] if result.some else [src, dst]
    out.changes = fixed(ops.change_set(*some, a, b, key, spec.options))
    n = {r["op"]: r["n"] for r in ops.op_counts(out.changes).collect()}
    out.inserts, out.updates, out.deletes, out.status = n.get(ops.INSERT, 0), n.get(ops.UPDATE, 0), n.get(ops.DELETE, 0), decide.PLANNED
    empty = out.src_rows == 0 and out.dst_rows > 0
    rewrites: set[str] = set()
    for columns in [c for c in b.constraints if c != tuple(key) and set(c) <= set(a.names)]:
        if not ops.source_duplicates(src, a, columns, spec.options).isEmpty():
            raise PlanError(f"the source holds equal values of ({', '.join(columns)}), which the destination keeps unique")
        verdicts = fixed(_conflicts(src, dst, a, b, key, columns, out.changes, spec))
        n = {r["verdict"]: r["count"] for r in verdicts.groupBy("verdict").count().collect()}
        if n.get("duplicate"):
            raise PlanError(f"a value of ({', '.join(columns)}) stands twice in the source")
        if n.get("conflict"):
            if not options.allow_row_rewrite:
                raise PlanError(f"{n['conflict']} values of ({', '.join(columns)}) are held elsewhere: rows would have to be rewritten, which is not allowed")
            if spec.where:
                raise PlanError("rewriting rows beyond the filter is not possible", argument=True)
            out.mode, out.inserts, out.updates, out.deletes, out.scope = decide.FULL, out.src_rows, 0, out.dst_rows, decide.Scope(full=True)
            return
        if n.get("rewrite"):
            if not options.allow_row_rewrite:
                raise PlanError(f"{n['rewrite']} values of ({', '.join(columns)}) change places: rows would have to be rewritten, which is not allowed")
            prints = verdicts.where("verdict = 'rewrite'").select("chunk_id", F.to_json(F.struct("key")).cast("binary").alias("key_bytes"))
            found = ops.rewrite_fingerprint(prints, columns).select("fingerprint").limit(MOST_REWRITES + 1).collect()  # bounded
            rewrites |= {r["fingerprint"] for r in found}
            if len(rewrites) > MOST_REWRITES:  # too many to confirm one by one: the table as a whole is
                out.mode, out.inserts, out.updates, out.deletes, out.scope = decide.FULL, out.src_rows, 0, out.dst_rows, decide.Scope(full=True)
                return
    out.scope = decide.Scope(rewrites=frozenset(rewrites), deletes_source_empty=empty)
    out.sample = ops.sample(out.changes, [F.coalesce("address", F.struct(*[F.col(f"row.`{k}`").alias(k) for k in key]))], options.sample_limit)


def _conflicts(src: DataFrame, dst: DataFrame, a: TableSchema, b: TableSchema, key: list[str], columns: tuple[str, ...], changes: DataFrame, spec: diff.Spec) -> DataFrame:
    left, right, _ = diff.chunked(src, dst, a, spec)
    written = changes.where(F.col("row").isNotNull()).select("row.*")
    match = lambda x, y: [x[k].eqNullSafe(y[f"__{k}"]) for k in key]
    touched = changes.where(F.col("address").isNotNull()).select(*[F.col(f"address.`{k}`").alias(f"__{k}") for k in key]).distinct().withColumn("__touched", F.lit(True))
    held = right.join(touched, match(right, touched), "left").withColumn("addressed", F.coalesce("__touched", F.lit(False)))
    ours = written.select(*[F.col(f"`{k}`").alias(f"__{k}") for k in key]).distinct()
    rows = left.join(ours, match(left, ours), "left_semi")
    return ops.conflicts(rows, held, src, a, b, key, columns, not spec.where, spec.options)


def _state(src: DataFrame, dst: DataFrame, a: TableSchema, b: TableSchema, spec: diff.Spec) -> tuple[list[str], str]:
    auto = [c.name for c in a.columns if c.auto_increment]
    if not auto or spec.where or auto[0] not in [c.name for c in b.columns if c.auto_increment]:
        return [], ""  # a destination without the column is a difference of structure
    value = lambda df, s: schemas.auto_increment_next(df, auto[0], s.auto_increment_counter).first()["next_value"]
    action, note = decide.state_check(decide.AutoIncrement(value(src, a), value(dst, b)), spec.where)
    return [f"ALTER TABLE {structure.quote_identifier(a.table)} {action}"] if action else [], note


def apply_table(src: Side, writer: Writer, confirmed: TableSync, options: SyncOptions = SyncOptions()) -> TableSync:
    """Applies what was confirmed and nothing that goes beyond it."""
    dst, table = writer.side, confirmed.name
    now = plan_table(src, dst, table, options)
    if now.status != decide.PLANNED:
        return now
    refusal = "" if confirmed.status == decide.PLANNED else "the table was not part of the confirmed plan"
    refusal = refusal or decide.within_scope(confirmed.scope, now.scope)
    if refusal:
        now.status, now.error = decide.FAILED, refusal
        return now
    a = src.schema(table)
    if now.mode == decide.CREATE:
        writer.put(table, src.read(table), a)
    elif now.schema_sql:
        _apply_structure(src, writer, table, a, now.schema_sql, options)
        after = plan_table(src, dst, table, options)
        if after.status == decide.PLANNED:
            if decide.within_scope(confirmed.scope, after.scope) and after.mode == decide.FULL and not options.allow_structure_truncate:
                after.status, after.error = decide.FAILED, "after the structure change a full reload is needed, which was not confirmed"
                return after
            after = _write_rows(src, writer, after, a, options)
        now.inserts, now.updates, now.deletes = after.inserts, after.updates, after.deletes
    else:
        _write_rows(src, writer, now, a, options)
    if now.mode == decide.STATE and not now.state_sql:
        now.status = decide.SKIPPED  # nothing to write: a counter can only be raised
        return now
    _apply_state(src, writer, now, options)
    again = diff.compare(table, src.read(table), dst.read(table), src.schema(table), dst.schema(table), options.spec)
    now.verified = again.status == "OK"
    now.status = decide.APPLIED if now.verified else decide.FAILED
    now.error = "" if now.verified else again.error or "the tables still differ"
    return now


def _apply_state(src: Side, writer: Writer, now: TableSync, options: SyncOptions) -> None:
    """Raises the destination's counter to the source's, by what both hold after the rows are written."""
    dst, table = writer.side, now.name
    a, b, rows = src.schema(table), dst.schema(table), src.read(table)
    done, note = _state(rows, dst.read(table), a, b, options.spec)
    now.state_note = note
    if done:
        auto = next(c.name for c in a.columns if c.auto_increment)
        counter = schemas.auto_increment_next(rows, auto, a.auto_increment_counter).first()["next_value"]
        writer.put_schema(table, replace(b, auto_increment_counter=counter))
        now.state_sql = done
    now.state_verified = not _state(rows, dst.read(table), a, dst.schema(table), options.spec)[0]


def _apply_structure(src: Side, writer: Writer, table: str, a: TableSchema, statements: list[str], options: SyncOptions) -> None:
    """Rewrites the destination with the source's columns; added ones are null until rows are synced. A database
    runs the statements."""
    if isinstance(writer, JdbcWriter):
        writer.alter(statements)
        return
    ours, theirs = src.read(table), writer.side.read(table)
    ignored = {n.lower() for n in options.spec.ignore}
    keep = [c for c in theirs.columns if c.lower() in ignored and c not in ours.columns]
    columns = [(F.col(f"`{f.name}`") if f.name in theirs.columns else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in ours.schema.fields]
    writer.put(table, theirs.select(*columns, *keep), replace(a, auto_increment_counter=writer.side.schema(table).auto_increment_counter))


def _write_rows(src: Side, writer: Writer, now: TableSync, a: TableSchema, options: SyncOptions) -> TableSync:
    dst, table = writer.side, now.name
    theirs = dst.schema(table)
    if now.mode == decide.FULL:
        current, rows = dst.read(table), src.read(table)
        ignored = {n.lower() for n in options.spec.ignore}
        own = lambda f: F.lit(theirs.column(f.name).default).cast(f.dataType).alias(f.name)
        writer.put(table, rows.select(*[F.col(f"`{f.name}`") if f.name in rows.columns and f.name.lower() not in ignored else own(f) for f in current.schema.fields]), theirs)
    elif now.changes is not None and isinstance(writer, JdbcWriter):
        writer.apply_changes(table, now.changes, list(_keyed(a, theirs, options.spec)[0].key), options.batch_size, bool(now.scope.rewrites))
    elif now.changes is not None:
        key, names = list(_keyed(a, theirs, options.spec)[0].key), [f.name for f in now.changes.schema["row"].dataType.fields]

        def made(current: DataFrame) -> DataFrame:
            rest = [c for c in current.columns if c not in names]
            out = ops.apply_changes(current.select(*names), now.changes, key)
            if rest:  # columns that are not compared keep their values
                kept = current.select(*[F.col(k).alias(f"__{k}") for k in key], *rest)
                out = out.join(kept, [out[k].eqNullSafe(kept[f"__{k}"]) for k in key], "left")
            return out.select(*current.columns)

        gone = now.changes.where(F.col("address").isNotNull()).select("address.*").distinct()
        writer.change(table, gone, made, theirs)
    return now


def each(side: Side, items: list, parallel: int, work: Callable[[int, object], object]) -> list:
    """``work`` on each item (its number from 1, and itself), up to ``parallel`` at a time, results in order."""
    if parallel <= 1 or len(items) <= 1:
        return [work(i, x) for i, x in enumerate(items, 1)]
    with ThreadPoolExecutor(min(parallel, len(items))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(side.spark)(work), i, x) for i, x in enumerate(items, 1)]]


def plan_sync(src: Side, dst: Side, only: list[str] | None = None, exclude: list[str] | None = None, options: SyncOptions = SyncOptions()) -> list[TableSync]:
    """Plans of all tables; tables that only the destination has are dropped in a sync of everything."""
    wanted, drops = decide.sync_tables(src.tables(), dst.tables(), only or [], exclude or [], options.spec.where)

    def plan(i: int, t: str) -> TableSync:
        progress(src, f"plan {t} ({i} of {len(wanted)})")
        return plan_table(src, dst, t, options)

    out = each(src, wanted, options.parallel, plan)
    if options.sync_schema:
        out += [TableSync(t, decide.DROP, decide.PLANNED, dst_rows=dst.read(t).count(), schema_sql=[f"DROP TABLE {structure.quote_identifier(t)}"], scope=decide.Scope(ddl=True)) for t in drops]
    return out


def apply_sync(src: Side, dst: Side, plans: list[TableSync], options: SyncOptions = SyncOptions()) -> list[TableSync]:
    """Applies confirmed plans; a drop checks both sides once more just before."""
    writer, out = (JdbcWriter if isinstance(dst, JdbcSide) else Writer)(dst, confirmed=True), []
    for plan in plans:
        if plan.status != decide.PLANNED:
            out.append(plan)
        elif plan.mode == decide.DROP:
            if src.has(plan.name) or not dst.has(plan.name):
                plan.status, plan.error = decide.FAILED, "the table is no longer only on the destination"
            else:
                writer.drop(plan.name)
                plan.status, plan.verified = decide.APPLIED, not dst.has(plan.name)
            out.append(plan)
        else:
            out.append(apply_table(src, writer, plan, options))
    return out


def compare_sides(src: Side, dst: Side, only: list[str] | None = None, exclude: list[str] | None = None, spec: diff.Spec = diff.Spec(), parallel: int = 1) -> list[diff.TableResult]:
    """Compares the tables that both sides have, ``parallel`` of them at a time."""
    names = decide.common_tables(src.tables(), dst.tables(), only or [], exclude or [])

    def one(i: int, t: str) -> diff.TableResult:
        progress(src, f"diff {t} ({i} of {len(names)})")
        return diff.compare(t, src.read(t), dst.read(t), src.schema(t), dst.schema(t), spec)

    return each(src, names, parallel, one)


def progress(side: Side, text: str) -> None:
    """What is under way, on stderr and on Spark's job pages."""
    side.spark.sparkContext.setJobDescription(text)
    print(text, file=sys.stderr)


__all__ = ["SyncOptions", "TableSync", "apply_sync", "apply_table", "chunking", "compare_sides", "plan_sync", "plan_table"]
