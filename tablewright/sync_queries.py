"""Queries of whole comparisons, plans and applies over the test tables, with their SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import changes, chunking, diff
from .plans import decide, schema as schemas, structure, sync
from .queries import CHANGES, CHUNK, DST_LINES, DST_ORDERS, ORDERS, PAIRED, STEPS, SWAP, lines_pair, orders_pair, query, swapped, table
from .sources.shared import fixed, shared_dir
from .sources.tables import Side, Writer, with_indexes

#: The tables of a test folder.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LISTED = ", ".join(f"'{t}'" for t in TABLES)


# -- comparisons -----------------------------------------------------------------------------------

SPEC = diff.Spec(chunk_size=CHUNK, chunks_always=True)
OF_KEY = "CAST(greatest(0, least(chunks - 1, (coalesce(sk, dk) - lo) // step)) AS BIGINT)"
DIFFERING = f"""{PAIRED}, {STEPS}, touched AS (
  SELECT {OF_KEY} AS chunk_id, CAST(count(sk) AS BIGINT) AS src_n, CAST(count(dk) AS BIGINT) AS dst_n
  FROM paired, plan GROUP BY 1 HAVING bool_or(sk IS NULL OR dk IS NULL OR differs)
)"""


@query(f"{DIFFERING} SELECT chunk_id, CAST(lo + chunk_id * step AS VARCHAR) AS lo, CAST(least(hi, lo + (chunk_id + 1) * step - 1) AS VARCHAR) AS hi, src_n, dst_n FROM touched, plan")
def compare_chunks(spark, d):
    """Differing chunks of a whole comparison, by the engine's own hash, with their bounds."""
    src, dst, s = orders_pair(spark, d)
    return diff.compare("orders", src, dst, s, s, SPEC).diff_chunks.select("chunk_id", "lo", "hi", "src_n", "dst_n")


@query(f"""{DIFFERING} SELECT CASE WHEN dk IS NULL THEN 'insert' WHEN sk IS NULL THEN 'delete' ELSE 'update' END AS op, coalesce(sk, dk) AS key, {OF_KEY} AS chunk_id
FROM paired, plan WHERE (sk IS NULL OR dk IS NULL OR differs) AND {OF_KEY} IN (SELECT chunk_id FROM touched)""")
def row_work_of_chunks(spark, d):
    """Row operations from the rows of differing chunks alone."""
    src, dst, s = orders_pair(spark, d)
    result = diff.compare("orders", src, dst, s, s, SPEC)
    plan = diff.chunk_plan(src, s, SPEC)
    found = changes.change_set(*[x.drop("chunk_id") for x in result.some], s, s, ["o_orderkey"])
    named = found.select("op", F.coalesce("address.o_orderkey", "row.o_orderkey").alias("o_orderkey"))
    return named.select("op", F.col("o_orderkey").alias("key"), plan.chunk_id().alias("chunk_id"))


@query(f"""{DIFFERING}, read AS (SELECT * FROM (SELECT 'src' AS side, o_orderkey FROM orders UNION ALL SELECT 'dst', o_orderkey FROM dst), plan)
SELECT side, count(*) AS n FROM read WHERE CAST(greatest(0, least(chunks - 1, (o_orderkey - lo) // step)) AS BIGINT) IN (SELECT chunk_id FROM touched) GROUP BY side""")
def rows_read_again(spark, d):
    """How many rows the row work reads: those of differing chunks."""
    src, dst, s = orders_pair(spark, d)
    return diff.counts(*diff.compare("orders", src, dst, s, s, SPEC).some)


@query(f"""WITH {DST_ORDERS}, keys AS (SELECT c_mktsegment, c_name, count(*) AS n FROM customer GROUP BY ALL),
placed AS (SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY c_mktsegment, c_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 200 AS BIGINT) AS chunk_id FROM keys),
bounds AS (SELECT chunk_id, arg_min({{literal}}, (c_mktsegment, c_name)) AS lo, arg_max({{literal}}, (c_mktsegment, c_name)) AS hi, bool_or(c_name LIKE '%7') AS hit FROM placed GROUP BY 1)
SELECT chunk_id, lo, hi FROM bounds WHERE hit""".replace("{literal}", "'''' || c_mktsegment || ''',''' || c_name || ''''"))
def compare_chunks_ranked(spark, d):
    """Differing chunks of a comparison by a composite text key, with their bounds as literals."""
    src = table(spark, d, "customer")
    dst = src.withColumn("c_acctbal", F.when(F.col("c_name").endswith("7"), F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    s = with_indexes(schemas.introspect(src, "customer"), PRIMARY=("c_mktsegment", "c_name"))
    return diff.compare("customer", src, dst, s, s, replace(SPEC, chunk_size=200)).diff_chunks.select("chunk_id", "lo", "hi")


def _verdict_sql(name: str, src: str, dst: str) -> str:
    counts = f"(SELECT count(*) FROM {src}), (SELECT count(*) FROM {dst})"
    same = f"NOT EXISTS (SELECT * FROM {src} EXCEPT ALL SELECT * FROM {dst}) AND NOT EXISTS (SELECT * FROM {dst} EXCEPT ALL SELECT * FROM {src})"
    return f"SELECT '{name}' AS name, CASE WHEN {same} THEN 'OK' ELSE 'DIFFERENT' END AS status, {counts.replace(', (', ' AS src_rows, (')} AS dst_rows, (SELECT count(*) FROM {src}) <> (SELECT count(*) FROM {dst}) AS counts_only"


@query(f"""WITH {DST_ORDERS}, {DST_LINES.replace('dst AS', 'dst_lines AS')}, shifted AS (SELECT * REPLACE (s_acctbal + 1 AS s_acctbal) FROM supplier)
{_verdict_sql('orders, drifted', '(SELECT ' + ORDERS + ' FROM orders)', 'dst')} UNION ALL {_verdict_sql('lines, drifted', 'lineitem', 'dst_lines')}
UNION ALL {_verdict_sql('lines, reordered', 'lineitem', 'lineitem')} UNION ALL {_verdict_sql('supplier, shifted', 'supplier', 'shifted')}""")
def compare_verdicts(spark, d):
    """Verdicts and counts of whole comparisons; where counts differ, no row is read."""
    orders, dst_orders, s = orders_pair(spark, d)
    lines, dst_lines, t = lines_pair(spark, d)
    supplier = table(spark, d, "supplier")
    u = with_indexes(schemas.introspect(supplier, "supplier"), PRIMARY=("s_suppkey",))
    pairs = [("orders, drifted", orders, dst_orders, s), ("lines, drifted", lines, dst_lines, t), ("lines, reordered", lines, lines.repartition(7, "l_partkey"), t), ("supplier, shifted", supplier, supplier.withColumn("s_acctbal", F.col("s_acctbal") + 1), u)]
    found = [diff.compare(name, a, b, x, x) for name, a, b, x in pairs]
    return spark.createDataFrame([(r.name, r.status, r.src_rows, r.dst_rows, r.src_fp == "") for r in found], "name string, status string, src_rows long, dst_rows long, counts_only boolean")


SHOWN = "concat_ws(' | ', {t}.s_suppkey, {t}.s_name, {t}.s_nationkey, regexp_replace(CAST({t}.s_acctbal AS VARCHAR), '^$', ''))"


@query(f"""WITH dst AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 1 THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 4 <> 2), differ AS (
SELECT CASE WHEN t.s_suppkey IS NULL THEN 'MISSING_IN_DST' ELSE 'CHANGED' END AS kind, CAST(s.s_suppkey AS VARCHAR) AS key,
  {SHOWN.format(t='s')} AS src, CASE WHEN t.s_suppkey IS NOT NULL THEN {SHOWN.format(t='t')} END AS dst
FROM supplier s LEFT JOIN dst t USING (s_suppkey) WHERE t.s_suppkey IS NULL OR s.s_nationkey <> t.s_nationkey)
SELECT *, (SELECT count(*) FROM differ) > 7 AS truncated FROM differ ORDER BY key LIMIT 7""")
def drill_rows(spark, d):
    """The first differing rows as a report shows them, and that there are more."""
    src = table(spark, d, "supplier")
    moved = F.when(F.col("s_suppkey") % 3 == 1, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey"))
    dst = src.where("s_suppkey % 4 <> 2").withColumn("s_nationkey", moved)
    s = with_indexes(schemas.introspect(src, "supplier"), PRIMARY=("s_suppkey",))
    result = diff.compare("supplier", src, dst, s, s, diff.Spec(drill=True, drill_limit=7, chunk_size=10))
    return result.rows.withColumn("truncated", F.lit(result.truncated))


# -- plans and applies -----------------------------------------------------------------------------


def _sides(spark: SparkSession, name: str, src: DataFrame, dst: DataFrame, a: schemas.TableSchema, b: schemas.TableSchema) -> tuple[Side, Side]:
    """Two folders in the shared one, with a versioned table each."""
    root = f"{shared_dir(spark)}/tablewright/sides-{uuid.uuid4().hex}"
    sides = Side(spark, f"{root}/src"), Side(spark, f"{root}/dst")
    for side, rows, schema in zip(sides, (src, dst), (a, b)):
        Writer(side, confirmed=True).put(name, rows, replace(schema, table=name))
    return sides


def _applied(spark: SparkSession, name: str, src: DataFrame, dst: DataFrame, a: schemas.TableSchema, options: sync.SyncOptions = sync.SyncOptions()) -> tuple[sync.TableSync, DataFrame]:
    ours, theirs = _sides(spark, name, src, dst, a, a)
    done = sync.apply_table(ours, Writer(theirs, confirmed=True), sync.plan_table(ours, theirs, name, options), options)
    return done, theirs.read(name)


@query(f"SELECT {ORDERS} FROM orders")
def full_resync(spark, d):
    """A table without a key, reloaded and read back."""
    src, dst, _ = orders_pair(spark, d)
    return _applied(spark, "orders", src, dst, schemas.introspect(src, "orders"))[1]


@query(f"""{PAIRED} SELECT s.o_orderkey, s.o_custkey, s.o_orderstatus, s.o_totalprice, s.o_orderdate,
  CASE WHEN p.dk IS NOT NULL AND NOT p.differs THEN d.o_orderpriority ELSE s.o_orderpriority END AS o_orderpriority
FROM orders s JOIN paired p ON p.sk = s.o_orderkey LEFT JOIN dst d ON d.o_orderkey = s.o_orderkey""")
def sync_written_rows(spark, d):
    """The destination after a row-level sync, read back: rows that count as equal are as they were."""
    src, dst, s = orders_pair(spark, d)
    return _applied(spark, "orders", src, dst, s)[1]


@query(f"""{CHANGES}, o AS (SELECT count(*) FILTER (WHERE op = 'insert') AS i, count(*) FILTER (WHERE op = 'update') AS u, count(*) FILTER (WHERE op = 'delete') AS d FROM ops)
SELECT 'orders' AS name, CASE WHEN i + u + d = 0 THEN 'SKIP' ELSE 'ROWLEVEL' END AS mode, 'APPLIED' AS status, CAST(i AS BIGINT) AS inserts, CAST(u AS BIGINT) AS updates, CAST(d AS BIGINT) AS deletes, true AS verified FROM o
UNION ALL SELECT 'lineitem', 'FULL', 'APPLIED', (SELECT count(*) FROM lineitem), 0, (SELECT count(*) FROM (WITH {DST_LINES} SELECT * FROM dst)), true
UNION ALL SELECT 'same', CASE WHEN EXISTS (SELECT * FROM nation EXCEPT ALL SELECT * FROM nation) THEN 'FULL' ELSE 'SKIP' END, 'SKIPPED', 0, 0, 0, false""")
def sync_reports(spark, d):
    """What a sync reports of three tables: row by row, reloaded, left alone."""
    orders, dst_orders, s = orders_pair(spark, d)
    lines, dst_lines, t = lines_pair(spark, d)
    nation = table(spark, d, "nation")
    made = [_applied(spark, "orders", orders, dst_orders, s), _applied(spark, "lineitem", lines, dst_lines, t), _applied(spark, "same", nation, nation, schemas.introspect(nation))]
    return spark.createDataFrame([(r.name, r.mode, r.status, r.inserts, r.updates, r.deletes, r.verified) for r, _ in made], "name string, mode string, status string, inserts long, updates long, deletes long, verified boolean")


@query(f"""WITH {DST_ORDERS}, n AS (SELECT (SELECT max(o_orderkey) + 1 FROM orders) AS s, (SELECT max(o_orderkey) + 1 FROM dst) AS t, (SELECT max(s_suppkey) + 1 FROM supplier) AS u, (SELECT max(s_suppkey) + 1 FROM supplier WHERE s_suppkey % 5 = 1) AS v)
SELECT 'orders' AS name, CASE WHEN s > t THEN 'AUTO_INCREMENT = ' || s ELSE '' END AS action, t > s AS ahead FROM n
UNION ALL SELECT 'supplier', CASE WHEN u > v THEN 'AUTO_INCREMENT = ' || u ELSE '' END, v > u FROM n""")
def counter_states(spark, d):
    """Whether the destination's counter has to be raised, or is ahead."""
    src, dst, _ = orders_pair(spark, d)
    supplier = table(spark, d, "supplier")
    rows = []
    for name, a, b, column in (("orders", src, dst, "o_orderkey"), ("supplier", supplier, supplier.where("s_suppkey % 5 = 1"), "s_suppkey")):
        ours, theirs = (schemas.auto_increment_next(x, column).first()["next_value"] for x in (a, b))
        action, note = decide.state_check(decide.AutoIncrement(ours, theirs))
        rows.append((name, action, bool(note)))
    return spark.createDataFrame(rows, "name string, action string, ahead boolean")


@query(f"""WITH {DST_ORDERS}, k AS (SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS place FROM dst WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders))
SELECT o_orderkey AS key, CAST(place // 25 AS BIGINT) AS batch FROM k""")
def delete_batches(spark, d):
    """Keys to delete, in statements of 25."""
    src, dst, s = orders_pair(spark, d)
    gone = changes.change_set(src, dst, s, s, ["o_orderkey"]).where("op = 'delete'").select(F.col("address.o_orderkey").alias("key"))
    return changes.batched(gone.withColumn("text", F.col("key").cast("string")), "text", 25).select("key", "batch")


# -- unique values ---------------------------------------------------------------------------------


def _conflicts(src: DataFrame, dst: DataFrame, s: schemas.TableSchema) -> DataFrame:
    chunk_id = lambda df: df.withColumn("chunk_id", F.floor(F.col("s_suppkey")).cast("long"))
    found = fixed(changes.change_set(src, dst, s, s, ["s_suppkey"]))
    touched = found.where("address IS NOT NULL").select(F.col("address.s_suppkey").alias("tk")).distinct()
    held = chunk_id(dst).join(touched, F.col("s_suppkey") == F.col("tk"), "left").withColumn("addressed", F.col("tk").isNotNull()).drop("tk")
    written = chunk_id(found.where("row IS NOT NULL").select("row.*"))
    return changes.conflicts(written, held, src, s, s, ["s_suppkey"], ("s_name",)).select(F.col("key.s_suppkey").alias("key"), F.col("holder_key.s_suppkey").alias("holder"), "verdict")


@query("SELECT s.s_suppkey AS key, t.s_suppkey AS holder, 'duplicate' AS verdict FROM supplier s JOIN supplier t ON t.s_suppkey = s.s_suppkey + 1 WHERE s.s_suppkey % 10 = 4")
def holder_duplicates(spark, d):
    """Values that the source itself holds twice: the holder keeps what another row is to take."""
    dst = table(spark, d, "supplier").select("s_suppkey", "s_name")
    following = dst.select((F.col("s_suppkey") - 1).alias("before"), F.col("s_name").alias("other"))
    src = dst.join(following, (F.col("s_suppkey") == F.col("before")) & (F.col("s_suppkey") % 10 == 4), "left").select("s_suppkey", F.coalesce("other", "s_name").alias("s_name"))
    return _conflicts(src, dst, with_indexes(schemas.introspect(dst, "supplier"), PRIMARY=("s_suppkey",), by_name=("s_name",)))


@query("SELECT s_suppkey AS key, s_suppkey + 10000000 AS holder, 'safe' AS verdict FROM supplier WHERE s_suppkey % 7 = 3")
def holder_outside(spark, d):
    """Values held by rows outside the source's keys, which are deleted first."""
    src = table(spark, d, "supplier").select("s_suppkey", "s_name")
    mine = F.col("s_suppkey") % 7 == 3
    dst = src.withColumn("s_name", F.when(mine, F.concat(F.lit("old "), "s_name")).otherwise(F.col("s_name"))).unionByName(src.where(mine).withColumn("s_suppkey", F.col("s_suppkey") + 10_000_000))
    return _conflicts(src, dst, with_indexes(schemas.introspect(src, "supplier"), PRIMARY=("s_suppkey",), by_name=("s_name",)))


@query(f"""WITH {SWAP}, touched AS (SELECT s.s_suppkey // 20 AS chunk_id, upper(hex(encode(CAST(s.s_suppkey AS VARCHAR)))) AS k FROM src s JOIN dst d USING (s_suppkey) WHERE s.s_name <> d.s_name)
SELECT chunk_id, sha256('s_name:' || string_agg(DISTINCT k, ',' ORDER BY k)) AS fingerprint FROM touched GROUP BY 1""")
def rewrite_fingerprints(spark, d):
    """Identities of the groups that a rewrite touches."""
    src, dst, s = swapped(spark, d)
    found = changes.change_set(src, dst, s, s, ["s_suppkey"]).where("address IS NOT NULL").select(F.col("address.s_suppkey").alias("k"))
    keys = found.select(F.floor(F.col("k") / 20).cast("long").alias("chunk_id"), F.col("k").cast("string").cast("binary").alias("key_bytes"))
    return changes.rewrite_fingerprint(keys, ("s_name",))


# -- schemas ---------------------------------------------------------------------------------------

FAMILY = """CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT', 'BOOLEAN') THEN 'INT' WHEN data_type = 'DOUBLE' THEN 'DOUBLE' WHEN data_type = 'FLOAT' THEN 'FLOAT'
  WHEN data_type = 'VARCHAR' THEN 'STR' WHEN data_type = 'DATE' THEN 'DATE' WHEN data_type LIKE 'TIMESTAMP%' THEN 'DATETIME' WHEN data_type LIKE '%[]' THEN 'JSON' END"""
COLUMNS = f"columns_of AS (SELECT table_name, column_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY ordinal_position) - 1 AS INTEGER) AS place, {FAMILY} AS family FROM information_schema.columns WHERE table_name IN ({LISTED}))"


@query(f"WITH {COLUMNS} SELECT table_name, column_name, place, family FROM columns_of")
def introspected_columns(spark, d):
    """Every column of every table of a side, with the family that decides how it is compared."""
    side = Side(spark, d)
    rows = [(t, c.name, i, c.family) for t in side.tables() for i, c in enumerate(side.schema(t).columns)]
    return spark.createDataFrame(rows, "table_name string, column_name string, place int, family string")


@query(f"SELECT DISTINCT table_name AS name FROM information_schema.tables WHERE table_name IN ({LISTED}) AND table_name NOT IN ('labels', 'embeddings')")
def common_tables(spark, d):
    """Tables of both sides but for excluded ones, from the folders."""
    sides = [Side(spark, d).tables() for _ in range(2)]
    return spark.createDataFrame([(t,) for t in decide.common_tables(*sides, exclude=["labels", "embeddings"])], "name string")


SAME_ORDER = "a.family = b.family AND a.family <> 'JSON'"


@query(f"WITH {COLUMNS} SELECT a.column_name AS ours, b.column_name AS theirs, coalesce({SAME_ORDER}, false) AS alike FROM columns_of a, columns_of b WHERE a.table_name = 'orders' AND b.table_name = 'events'")
def key_order_pairs(spark, d):
    """Whether two columns, each the key of a side, sort rows alike."""
    a, b = (Side(spark, d).schema(t) for t in ("orders", "events"))
    rows = []
    for c in a.columns:
        for e in b.columns:
            ours, theirs = (replace(s, columns=(replace(x, name="k"),), key=("k",)) for s, x in ((a, c), (b, e)))
            rows.append((c.name, e.name, schemas.key_order_compatible(ours, theirs)[0]))
    return spark.createDataFrame(rows, "ours string, theirs string, alike boolean")


@query(f"""WITH {COLUMNS}, a AS (SELECT * FROM columns_of WHERE table_name = 'orders'), b AS (SELECT * FROM columns_of WHERE table_name = 'events')
SELECT a.column_name AS ours, b.column_name AS theirs, CASE WHEN a.family = b.family THEN 'same' WHEN a.family IN ('INT', 'DOUBLE', 'FLOAT') AND b.family IN ('INT', 'DOUBLE', 'FLOAT') THEN 'warned' ELSE 'refused' END AS verdict FROM a, b""")
def comparable_pairs(spark, d):
    """Whether two columns can be compared: as they are, after normalization, or not."""
    a, b = (Side(spark, d).schema(t) for t in ("orders", "events"))

    def verdict(c: schemas.Column, e: schemas.Column) -> str:
        try:
            return "warned" if schemas.compatible(replace(a, columns=(replace(c, name="k"),)), replace(b, columns=(replace(e, name="k"),))) else "same"
        except schemas.PlanError:
            return "refused"

    return spark.createDataFrame([(c.name, e.name, verdict(c, e)) for c in a.columns for e in b.columns], "ours string, theirs string, verdict string")


def _bare(s: schemas.TableSchema) -> schemas.TableSchema:
    """A schema whose columns have lost the letters of their table."""
    return replace(s, table="t", columns=tuple(replace(c, name=c.name[2:]) for c in s.columns), indexes=())


BARE = f"""WITH {COLUMNS}, c AS (SELECT substr(column_name, 3) AS name, place, family FROM columns_of WHERE table_name = 'customer'), s AS (SELECT substr(column_name, 3) AS name, place, family FROM columns_of WHERE table_name = 'supplier')"""


@query(f"""{BARE} SELECT CASE WHEN s.name IS NULL THEN 'ADD_COLUMN' WHEN c.name IS NULL THEN 'DROP_COLUMN' ELSE 'MODIFY_COLUMN' END AS kind, coalesce(c.name, s.name) AS name
FROM c FULL JOIN s ON c.name = s.name WHERE c.name IS NULL OR s.name IS NULL OR c.family <> s.family""")
def schema_diff(spark, d):
    """What gives one table's structure to another."""
    side = Side(spark, d)
    found = structure.diff_structure(_bare(side.schema("customer")), _bare(side.schema("supplier")))
    return spark.createDataFrame([(c.kind, c.column.name) for c in found], "kind string, name string")


TYPE_SQL = "CASE family WHEN 'INT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' ELSE 'text' END"


@query(f"""{BARE}, gone AS (SELECT string_agg('DROP COLUMN `' || name || '`', ', ' ORDER BY place) AS x FROM s WHERE name NOT IN (SELECT name FROM c)),
placed AS (SELECT *, lag(name) OVER (ORDER BY place) AS before FROM c),
come AS (SELECT string_agg('ADD COLUMN `' || name || '` ' || {TYPE_SQL} || ' NULL' || CASE WHEN before IS NULL THEN ' FIRST' ELSE ' AFTER `' || before || '`' END, ', ' ORDER BY place) AS x FROM placed WHERE name NOT IN (SELECT name FROM s))
SELECT 0 AS place, 'ALTER TABLE `t` ' || gone.x || ', ' || come.x AS statement FROM gone, come""")
def ddl_plan(spark, d):
    """The statement that does it."""
    side = Side(spark, d)
    made = structure.render_ddl("t", structure.diff_structure(_bare(side.schema("customer")), _bare(side.schema("supplier"))))
    return spark.createDataFrame(list(enumerate(made)), "place int, statement string")


@query(f"""WITH {COLUMNS}, c AS (SELECT * FROM columns_of WHERE table_name = 'supplier')
SELECT 'CREATE TABLE `supplier` (' || string_agg('`' || column_name || '` ' || {TYPE_SQL} || ' NULL', ', ' ORDER BY place) || ', PRIMARY KEY (`s_suppkey`)) ENGINE=parquet AUTO_INCREMENT=' || (SELECT max(s_suppkey) + 1 FROM supplier) AS statement FROM c""")
def create_statement(spark, d):
    """The statement that makes a missing table, with its counter."""
    rows = table(spark, d, "supplier")
    counter = schemas.auto_increment_next(rows, "s_suppkey").first()["next_value"]
    s = with_indexes(replace(schemas.introspect(rows, "supplier"), auto_increment_counter=counter), PRIMARY=("s_suppkey",))
    return spark.createDataFrame([(structure.render_create(s),)], "statement string")


@query(f"""WITH {DST_ORDERS}, {DST_LINES.replace('dst AS', 'dst_lines AS')},
o AS (SELECT EXISTS (SELECT {ORDERS} FROM orders EXCEPT ALL SELECT * FROM dst) AS d), l AS (SELECT EXISTS (SELECT * FROM lineitem EXCEPT ALL SELECT * FROM dst_lines) OR EXISTS (SELECT * FROM dst_lines EXCEPT ALL SELECT * FROM lineitem) AS d)
SELECT 'keyed' AS situation, CASE WHEN d THEN 'ROWLEVEL' ELSE 'SKIP' END AS mode FROM o UNION ALL SELECT 'keyed, filtered', CASE WHEN d THEN 'ROWLEVEL' ELSE 'SKIP' END FROM o
UNION ALL SELECT 'keyless', CASE WHEN d THEN 'FULL' ELSE 'SKIP' END FROM l UNION ALL SELECT 'keyless, filtered', CASE WHEN d THEN 'ERROR' ELSE 'SKIP' END FROM l
UNION ALL SELECT 'one side keyed', CASE WHEN d THEN 'FULL' ELSE 'SKIP' END FROM o UNION ALL SELECT 'identical', 'SKIP' UNION ALL SELECT 'grouped key', CASE WHEN d THEN 'ROWLEVEL' ELSE 'SKIP' END FROM l""")
def plan_decision(spark, d):
    """Modes of whole plans over real pairs."""
    orders, dst_orders, s = orders_pair(spark, d)
    lines, dst_lines, t = lines_pair(spark, d)
    bare = schemas.introspect(orders, "orders")
    grouped = diff.Spec(key=("l_orderkey", "l_linenumber"))
    cases = [
        ("keyed", orders, dst_orders, s, s, diff.Spec()), ("keyed, filtered", orders, dst_orders, s, s, diff.Spec(where="o_orderkey % 2 = 0")),
        ("keyless", lines, dst_lines, t, t, diff.Spec()), ("keyless, filtered", lines, dst_lines, t, t, diff.Spec(where="l_orderkey % 2 = 0")),
        ("one side keyed", orders, dst_orders, s, bare, diff.Spec()), ("identical", orders, orders, s, s, diff.Spec()), ("grouped key", lines, dst_lines, t, t, grouped),
    ]
    rows = []
    for name, src, dst, a, b, spec in cases:
        ours, theirs = _sides(spark, "t", src, dst, a, b)
        rows.append((name, sync.plan_table(ours, theirs, "t", sync.SyncOptions(spec=spec, sync_schema=False)).mode))
    return spark.createDataFrame(rows, "situation string, mode string")


@query("SELECT c_mktsegment, c_custkey FROM customer WHERE c_mktsegment > 'BUILDING' AND c_mktsegment <= 'HOUSEHOLD' ORDER BY c_mktsegment, c_custkey LIMIT 20")
def key_sample(spark, d):
    """The first keys of a key range, from the key columns alone."""
    src = table(spark, d, "customer")
    some = src.where(chunking.inside(["c_mktsegment"], ("BUILDING",), ("HOUSEHOLD",)))
    return chunking.key_sample(some, ["c_mktsegment", "c_custkey"], 20)
