"""Queries of the reconciliation engine over the test tables, with their SQL.

The destination of each pair is a drifted copy of a table: a pure function of its rows, said once as a
DataFrame and once as SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import canonical, families as fam
from .functions.canonical import Options
from .operators import changes, chunking, diff, digest
from .plans import schema as schemas
from .plans.schema import TableSchema
from .sources.shared import fixed
from .sources.tables import with_indexes

ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
CHUNK = 500


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        ALL[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- pairs -----------------------------------------------------------------------------------------

ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
DST_ORDERS = f"""dst AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 97 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate,
         CASE WHEN o_orderkey % 83 = 5 THEN NULL WHEN o_orderkey % 79 = 7 THEN o_orderpriority || '  '
              WHEN o_orderkey % 73 = 11 THEN lower(o_orderpriority) ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderkey % 101 <> 0
  UNION ALL
  SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 89 = 13
)"""


def orders_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, TableSchema]:
    src = table(spark, sf_dir, "orders").select(*ORDERS.split(", "))
    k, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    changed = F.when(k % 83 == 5, None).when(k % 79 == 7, F.concat(priority, F.lit("  "))).when(k % 73 == 11, F.lower(priority)).otherwise(priority)
    price = F.when(k % 97 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    dst = src.where(k % 101 != 0).withColumns({"o_totalprice": price, "o_orderpriority": changed})
    dst = dst.unionByName(src.where(k % 89 == 13).withColumn("o_orderkey", k + 10_000_000))
    return src, dst, with_indexes(schemas.introspect(src, "orders"), PRIMARY=("o_orderkey",))


DST_LINES = """dst AS (
  SELECT * FROM lineitem WHERE NOT (l_orderkey % 101 = 0 AND l_linenumber = 1)
  UNION ALL SELECT * FROM lineitem WHERE l_partkey % 97 = 3
)"""


def lines_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, TableSchema]:
    src = table(spark, sf_dir, "lineitem")
    dst = src.where(~((F.col("l_orderkey") % 101 == 0) & (F.col("l_linenumber") == 1))).unionByName(src.where("l_partkey % 97 = 3"))
    return src, dst, schemas.introspect(src, "lineitem")


# Source's and destination's rows side by side, compared as the default options do (spaces at the end off).
PAIRED = f"""WITH {DST_ORDERS}, paired AS (
  SELECT s.o_orderkey AS sk, d.o_orderkey AS dk,
         (s.o_custkey, s.o_orderstatus, s.o_totalprice, s.o_orderdate) IS DISTINCT FROM (d.o_custkey, d.o_orderstatus, d.o_totalprice, d.o_orderdate)
         OR rtrim(s.o_orderpriority) IS DISTINCT FROM rtrim(d.o_orderpriority) AS differs
  FROM orders s FULL JOIN dst d ON s.o_orderkey = d.o_orderkey
)"""


# -- counts and rows -------------------------------------------------------------------------------


@query(f"WITH {DST_ORDERS} SELECT 'src' AS side, count(*) AS n FROM orders UNION ALL SELECT 'dst', count(*) FROM dst")
def diff_counts(spark, d):
    return diff.counts(*orders_pair(spark, d)[:2])


@query(f"""{PAIRED}
SELECT CASE WHEN dk IS NULL THEN 'MISSING_IN_DST' WHEN sk IS NULL THEN 'MISSING_IN_SRC' ELSE 'CHANGED' END AS kind,
       CAST(coalesce(sk, dk) AS VARCHAR) AS key
FROM paired WHERE sk IS NULL OR dk IS NULL OR differs""")
def row_diff_keyed(spark, d):
    src, dst, s = orders_pair(spark, d)
    return diff.row_diff(src, dst, s, s, ["o_orderkey"]).select("kind", "key")


def _row_diff_of(kind: str):
    def run(spark, d):
        src, dst, s = orders_pair(spark, d)
        return diff.row_diff(src, dst, s, s, ["o_orderkey"]).where(F.col("kind") == kind).select("key")

    return run


ALL["row_diff_missing_dst"] = (_row_diff_of(diff.MISSING_DST), f"{PAIRED} SELECT CAST(sk AS VARCHAR) AS key FROM paired WHERE dk IS NULL")
ALL["row_diff_missing_src"] = (_row_diff_of(diff.MISSING_SRC), f"{PAIRED} SELECT CAST(dk AS VARCHAR) AS key FROM paired WHERE sk IS NULL")
ALL["row_diff_changed"] = (_row_diff_of(diff.CHANGED), f"{PAIRED} SELECT CAST(sk AS VARCHAR) AS key FROM paired WHERE sk = dk AND differs")


@query("""WITH dst AS (
  SELECT conv_id, turn, role, CASE WHEN turn % 7 = 3 THEN upper(text) ELSE text END AS text FROM conversations WHERE conv_id % 13 <> 5
)
SELECT CASE WHEN d.conv_id IS NULL THEN 'MISSING_IN_DST' ELSE 'CHANGED' END AS kind, s.conv_id || ' | ' || s.turn AS key
FROM conversations s LEFT JOIN dst d ON s.conv_id = d.conv_id AND s.turn = d.turn
WHERE d.conv_id IS NULL OR s.text IS DISTINCT FROM d.text""")
def row_diff_composite_key(spark, d):
    src = table(spark, d, "conversations")
    dst = src.where("conv_id % 13 <> 5").withColumn("text", F.when(F.col("turn") % 7 == 3, F.upper("text")).otherwise(F.col("text")))
    s = schemas.introspect(src, "conversations")
    return diff.row_diff(src, dst, s, s, ["conv_id", "turn"]).select("kind", "key")


NULL_KEY = "CASE WHEN s_suppkey = 1 THEN NULL ELSE s_suppkey END AS s_suppkey, s_name, s_nationkey"


@query(f"""WITH src AS (SELECT {NULL_KEY} FROM supplier),
dst AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey IS NULL OR s_suppkey % 5 = 2 THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey FROM src)
SELECT 'CHANGED' AS kind, coalesce(CAST(s.s_suppkey AS VARCHAR), 'NULL') AS key
FROM src s JOIN dst d ON s.s_suppkey IS NOT DISTINCT FROM d.s_suppkey WHERE s.s_nationkey <> d.s_nationkey""")
def row_diff_null_key(spark, d):
    src = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") != 1, F.col("s_suppkey")).alias("s_suppkey"), "s_name", "s_nationkey")
    moved = F.col("s_suppkey").isNull() | (F.col("s_suppkey") % 5 == 2)
    dst = src.withColumn("s_nationkey", F.when(moved, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")))
    s = schemas.introspect(src, "supplier")
    return diff.row_diff(src, dst, s, s, ["s_suppkey"]).select("kind", "key")


def _number(column: str) -> str:
    return rf"regexp_replace(CAST({column} AS VARCHAR), '\.0$', '')"


LINE = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


@query(f"""WITH {DST_LINES}, counted AS (
  SELECT {', '.join(LINE)}, sum(s) AS src_n, sum(t) AS dst_n
  FROM (SELECT {', '.join(LINE)}, 1 AS s, 0 AS t FROM lineitem UNION ALL SELECT {', '.join(LINE)}, 0, 1 FROM dst) GROUP BY ALL
)
SELECT CASE WHEN dst_n = 0 THEN 'MISSING_IN_DST' WHEN src_n = 0 THEN 'MISSING_IN_SRC' ELSE 'COUNT_DIFF' END AS kind,
       CAST(src_n AS BIGINT) AS src_n, CAST(dst_n AS BIGINT) AS dst_n, concat_ws(' | ', {', '.join(_number(c) for c in LINE)}) AS row
FROM counted WHERE src_n <> dst_n""")
def multiset_diff(spark, d):
    src, dst, s = lines_pair(spark, d)
    return diff.multiset_diff(src.select(*LINE), dst.select(*LINE), *[schemas.introspect(src.select(*LINE))] * 2)


@query("SELECT true AS same")
def multiset_equal_reordered(spark, d):
    src = table(spark, d, "lineitem")
    s = schemas.introspect(src)
    prints = [digest.table_fingerprint(digest.chunk_digests(diff.hashed(x, s).withColumn("chunk_id", F.col("l_orderkey") % n))) for x, n in ((src, 3), (src.repartition(7, "l_partkey"), 11))]
    return prints[0].join(prints[1].select(F.col("n").alias("n2"), F.col("fingerprint").alias("f2"))).select(((F.col("n") == F.col("n2")) & (F.col("fingerprint") == F.col("f2"))).alias("same"))


@query(f"""WITH {DST_ORDERS}
SELECT CASE WHEN d.o_orderkey IS NULL THEN 'MISSING_IN_DST' WHEN s.o_orderkey IS NULL THEN 'MISSING_IN_SRC' ELSE 'CHANGED' END AS kind,
       CAST(coalesce(s.o_orderkey, d.o_orderkey) AS VARCHAR) AS key
FROM orders s FULL JOIN dst d ON s.o_orderkey = d.o_orderkey
WHERE s.o_orderkey IS NULL OR d.o_orderkey IS NULL OR s.o_totalprice IS DISTINCT FROM d.o_totalprice""")
def ignore_columns(spark, d):
    src, dst, s = orders_pair(spark, d)
    spec = diff.Spec(ignore=("o_orderpriority", "o_orderstatus"))
    left, right, a, b, _, _ = diff.prepare(src, dst, s, s, spec)
    return diff.row_diff(left, right, a, b, ["o_orderkey"]).select("kind", "key")


@query(f"""{PAIRED}
SELECT CASE WHEN dk IS NULL THEN 'MISSING_IN_DST' WHEN sk IS NULL THEN 'MISSING_IN_SRC' ELSE 'CHANGED' END AS kind,
       CAST(coalesce(sk, dk) AS VARCHAR) AS key
FROM paired WHERE (sk IS NULL OR dk IS NULL OR differs) AND coalesce(sk, dk) % 2 = 0""")
def where_filter(spark, d):
    src, dst, s = orders_pair(spark, d)
    left, right, a, b, _, _ = diff.prepare(src, dst, s, s, diff.Spec(where="o_orderkey % 2 = 0"))
    return diff.row_diff(left, right, a, b, ["o_orderkey"]).select("kind", "key")


@query(f"""WITH {DST_ORDERS}
SELECT CAST(s.o_orderkey AS VARCHAR) AS key FROM orders s JOIN dst d USING (o_orderkey)
WHERE s.o_totalprice <> d.o_totalprice OR lower(rtrim(s.o_orderpriority)) IS DISTINCT FROM lower(rtrim(d.o_orderpriority))""")
def fold_case_diff(spark, d):
    src, dst, s = orders_pair(spark, d)
    return diff.row_diff(src, dst, s, s, ["o_orderkey"], Options(fold_case=True)).where("kind = 'CHANGED'").select("key")


@query(f"""WITH {DST_ORDERS}
SELECT CAST(s.o_orderkey AS VARCHAR) AS key FROM orders s JOIN dst d USING (o_orderkey)
WHERE s.o_totalprice <> d.o_totalprice OR s.o_orderpriority IS DISTINCT FROM d.o_orderpriority""")
def no_trim_diff(spark, d):
    src, dst, s = orders_pair(spark, d)
    return diff.row_diff(src, dst, s, s, ["o_orderkey"], Options(trim_trailing=False)).where("kind = 'CHANGED'").select("key")


# -- chunks ----------------------------------------------------------------------------------------

STEPS = f"""facts AS (
  SELECT min(o_orderkey)::HUGEINT AS lo, max(o_orderkey)::HUGEINT AS hi, least(CAST(ceil(count(*) / {CHUNK}.0) AS HUGEINT), max(o_orderkey)::HUGEINT - min(o_orderkey) + 1) AS want FROM orders
), plan AS (
  SELECT lo, hi, (hi - lo + want) // want AS step, (hi - lo + (hi - lo + want) // want) // ((hi - lo + want) // want) AS chunks FROM facts
)"""


@query(f"WITH {STEPS} SELECT CAST(k AS BIGINT) AS chunk_id, CAST(lo + k * step AS BIGINT) AS lo, CAST(least(hi, lo + (k + 1) * step - 1) AS BIGINT) AS hi FROM plan, unnest(range(CAST(chunks AS BIGINT))) AS t(k)")
def chunk_plan_int(spark, d):
    plan = chunking.plan_integer(table(spark, d, "orders"), "o_orderkey", CHUNK)
    return plan.bounds(spark)


IDS = "CAST(greatest(0, least(chunks - 1, (o_orderkey - lo) // step)) AS BIGINT) AS chunk_id"


@query(f"WITH {DST_ORDERS}, {STEPS} SELECT chunk_id, count(*) AS n FROM (SELECT {IDS} FROM dst, plan) GROUP BY chunk_id")
def chunk_rows_dst(spark, d):
    src, dst, _ = orders_pair(spark, d)
    plan = chunking.plan_integer(src, "o_orderkey", CHUNK)
    return dst.groupBy(plan.chunk_id().alias("chunk_id")).agg(F.count("*").alias("n"))


@query("""WITH facts AS (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi, CAST(ceil(count(*) / 5000.0) AS BIGINT) AS want FROM lineitem),
plan AS (SELECT lo, (hi - lo + want) // want AS step FROM facts)
SELECT (l_orderkey - lo) // step AS chunk_id, count(*) AS n FROM lineitem, plan GROUP BY ALL""")
def chunk_plan_lead_prefix(spark, d):
    src = table(spark, d, "lineitem")
    plan = chunking.plan_integer(src, "l_orderkey", 5000)
    return src.groupBy(plan.chunk_id().alias("chunk_id")).agg(F.count("*").alias("n"))


@query("""WITH keys AS (SELECT c_mktsegment, c_name, count(*) AS n FROM customer GROUP BY ALL),
placed AS (SELECT *, coalesce(sum(n) OVER (ORDER BY c_mktsegment, c_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keys)
SELECT CAST(before // 200 AS BIGINT) AS chunk_id, arg_min(c_name, (c_mktsegment, c_name)) AS lo, arg_max(c_name, (c_mktsegment, c_name)) AS hi, CAST(sum(n) AS BIGINT) AS n_rows
FROM placed GROUP BY 1""")
def chunk_plan_rank(spark, d):
    found = chunking.plan_ranked(table(spark, d, "customer"), ["c_mktsegment", "c_name"], 200)
    return found.select("chunk_id", F.col("lo.c_name").alias("lo"), F.col("hi.c_name").alias("hi"), "n_rows")


@query("""WITH placed AS (SELECT c_name, (row_number() OVER (ORDER BY c_name) - 1) // 200 AS chunk_id FROM customer)
SELECT chunk_id, count(*) AS n FROM placed GROUP BY 1""")
def chunk_rows_ranked(spark, d):
    src, key = table(spark, d, "customer"), ["c_name", "c_custkey"]  # customers of one name have ranks of their own
    bounds = fixed(chunking.plan_ranked(src, key, 200))
    return chunking.ranked_chunk_id(src, key, bounds).groupBy("chunk_id").agg(F.count("*").alias("n"))


@query("SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
def key_extremes(spark, d):
    return chunking.key_extremes(table(spark, d, "orders"), ["o_orderkey"]).select("lo.*", "hi").select(F.col("o_orderkey").alias("lo"), F.col("hi.o_orderkey").alias("hi"))


@query("""SELECT c_mktsegment, c_custkey FROM customer 
WHERE (c_mktsegment > 'BUILDING' OR c_mktsegment = 'BUILDING' AND c_custkey > 100) AND (c_mktsegment < 'HOUSEHOLD' OR c_mktsegment = 'HOUSEHOLD' AND c_custkey <= 50)""")
def chunk_interval_composite(spark, d):
    src = table(spark, d, "customer")
    return src.where(chunking.inside(["c_mktsegment", "c_custkey"], ("BUILDING", 100), ("HOUSEHOLD", 50))).select("c_mktsegment", "c_custkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 700")
def split_point(spark, d):
    return chunking.split_point(table(spark, d, "orders"), ["o_orderkey"], 700)


@query("SELECT c_nationkey, c_custkey FROM customer WHERE c_nationkey > 7 OR c_nationkey = 7 AND c_custkey > 100 ORDER BY c_nationkey, c_custkey LIMIT 50")
def keyset_page(spark, d):
    return chunking.after(table(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey", "c_custkey"], (7, 100), 50)


# -- digests ---------------------------------------------------------------------------------------


def _tlv(tag: int, text: str, column: str) -> str:
    full = f"unhex('{tag:02X}') || unhex(lpad(to_hex(octet_length(encode({text}))), 16, '0')) || encode({text})"
    return f"CASE WHEN {column} IS NULL THEN unhex('00') ELSE {full} END"


def _orders_row() -> str:
    return " || ".join([_tlv(1, _number("o_orderkey"), "o_orderkey"), _tlv(1, _number("o_custkey"), "o_custkey"), _tlv(13, "rtrim(o_orderstatus)", "o_orderstatus"), _tlv(1, _number("o_totalprice"), "o_totalprice"), _tlv(8, "CAST(o_orderdate AS VARCHAR)", "o_orderdate"), _tlv(13, "rtrim(o_orderpriority)", "o_orderpriority")])


def _hashed_sql(name: str) -> str:
    return f"SELECT *, CAST('0x' || substr(md5({_orders_row()}), 1, 16) AS UBIGINT) AS h FROM {name}"


def _hex_sql(side: str) -> str:
    shown = " || ':' || ".join(f"lpad(lower(to_hex(CAST({side}.{c} AS UBIGINT))), 16, '0')" for c in ("n", "sum_h", "xor_h", "sumsq_h"))
    return f"CASE WHEN {side}.n IS NULL THEN 'missing' ELSE {shown} END"


SQUARE = "((h & 4294967295)::UHUGEINT * (h & 4294967295) + ((((h >> 32)::UHUGEINT * (h & 4294967295) * 2) % 4294967296) * 4294967296)) % 18446744073709551616"
STATISTICS = f"count(*) AS n, CAST(sum(h::HUGEINT) % 18446744073709551616 AS VARCHAR) AS sum_h, CAST(bit_xor(h) AS VARCHAR) AS xor_h, CAST(sum(CAST({SQUARE} AS HUGEINT)) % 18446744073709551616 AS VARCHAR) AS sumsq_h"


def _digests(spark, d):
    src, dst, s = orders_pair(spark, d)
    plan = chunking.plan_integer(src, "o_orderkey", CHUNK)
    made = [diff.hashed(x.withColumn("chunk_id", plan.chunk_id()), s, kind="md5") for x in (src, dst)]
    return made, [digest.chunk_digests(x) for x in made]


@query(f"WITH {STEPS}, hashed AS ({_hashed_sql('orders')}) SELECT {IDS}, {STATISTICS} FROM hashed, plan GROUP BY 1")
def chunk_digest_unordered(spark, d):
    return _digests(spark, d)[1][0].select("chunk_id", "n", *[F.col(c).cast("string").alias(c) for c in ("sum_h", "xor_h", "sumsq_h")])


@query(f"""WITH {DST_ORDERS}, {STEPS}, s AS (SELECT {IDS}, {STATISTICS} FROM ({_hashed_sql('orders')}), plan GROUP BY 1), t AS (SELECT {IDS}, {STATISTICS} FROM ({_hashed_sql('dst')}), plan GROUP BY 1)
SELECT coalesce(s.chunk_id, t.chunk_id) AS chunk_id, coalesce(s.n, 0) AS src_n, coalesce(t.n, 0) AS dst_n, {_hex_sql('s')} AS src_digest, {_hex_sql('t')} AS dst_digest
FROM s FULL JOIN t ON s.chunk_id = t.chunk_id WHERE (s.n, s.sum_h, s.xor_h, s.sumsq_h) IS DISTINCT FROM (t.n, t.sum_h, t.xor_h, t.sumsq_h)""")
def differing_chunks(spark, d):
    return digest.differing(*_digests(spark, d)[1])


@query(f"""WITH hashed AS ({_hashed_sql('orders')}), folded AS (SELECT {STATISTICS} FROM hashed)
SELECT n, substr(md5(n || ':' || sum_h || ':' || xor_h || ':' || sumsq_h), 1, 16) AS fingerprint FROM folded""")
def table_fingerprint_unordered(spark, d):
    return digest.table_fingerprint(_digests(spark, d)[1][0])


@query(f"""WITH hashed AS ({_hashed_sql('orders')}), folded AS (SELECT {STATISTICS} FROM hashed)
SELECT n, md5(n || ':' || sum_h || ':' || xor_h || ':' || sumsq_h) AS fingerprint FROM folded""")
def table_fingerprint_secure(spark, d):
    return digest.table_fingerprint(_digests(spark, d)[1][0], secure=True)


SIGNED = "CASE WHEN h >= 9223372036854775808 THEN CAST(h::HUGEINT - 18446744073709551616 AS VARCHAR) ELSE CAST(h AS VARCHAR) END"


def _tree_sql(name: str, group: str) -> str:
    """CTEs that fold (group, place, n, text) of ``name`` to the table ``name``_3."""
    level = lambda k: f"{name}_{k + 1} AS (SELECT {group}, place // {digest.BLOCK} AS place, sum(n) AS n, md5(string_agg(text, ',' ORDER BY place)) AS text FROM {name}_{k} GROUP BY ALL)"
    return ", ".join(level(k) for k in range(digest.LEVELS))


ORDERED = f"""WITH {STEPS}, hashed AS ({_hashed_sql('orders')}),
  r_0 AS (SELECT {IDS}, row_number() OVER (PARTITION BY greatest(0, least(chunks - 1, (o_orderkey - lo) // step)) ORDER BY o_orderkey) - 1 AS place, 1 AS n, {SIGNED} AS text FROM hashed, plan),
  {_tree_sql('r', 'chunk_id')}, chunked AS (SELECT chunk_id, CAST(sum(n) AS BIGINT) AS n, md5(string_agg(text, ',' ORDER BY place)) AS digest FROM r_3 GROUP BY 1)"""


@query(f"{ORDERED} SELECT chunk_id, n, digest FROM chunked")
def chunk_digest_ordered(spark, d):
    return digest.ordered_digests(_digests(spark, d)[0][0], ["o_orderkey"])


@query(f"""{ORDERED}, c_0 AS (SELECT 0 AS one, chunk_id AS place, n, n || ':' || digest AS text FROM chunked), {_tree_sql('c', 'one')}
SELECT CAST(sum(n) AS BIGINT) AS n, substr(md5(string_agg(text, ',' ORDER BY place)), 1, 16) AS fingerprint FROM c_3""")
def table_fingerprint_ordered(spark, d):
    return digest.ordered_fingerprint(digest.ordered_digests(_digests(spark, d)[0][0], ["o_orderkey"]))


# -- canonical values ------------------------------------------------------------------------------


@query(rf"SELECT o_orderkey, {_number('o_totalprice')} AS canon FROM orders")
def canon_double(spark, d):
    return table(spark, d, "orders").select("o_orderkey", canonical.canonical_float(F.col("o_totalprice")).alias("canon"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(12,4)) AS VARCHAR), '0+$', ''), '\.$', '') AS canon FROM part""")
def canon_decimal(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(12,4)").alias("x"))
    return df.select("p_partkey", canonical.canonical_decimal(F.col("x"), df.schema["x"].dataType).alias("canon"))


@query(r"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '1e+' || (21 + p_partkey % 300) WHEN 1 THEN '-1.5e-' || (30 + p_partkey % 300)
            WHEN 2 THEN '-' || (p_partkey + 1) WHEN 3 THEN '0.00' || (p_partkey * 10 + 1) ELSE CAST(p_partkey * 10 + 7 AS VARCHAR) || '.5' END AS canon FROM part""")
def canon_number_grammar(spark, d):
    k = F.col("p_partkey")
    token = (
        F.when(k % 5 == 0, F.concat(F.lit("0010.00E+"), (20 + k % 300).cast("string")))
        .when(k % 5 == 1, F.concat(F.lit("-1500e-"), (33 + k % 300).cast("string")))
        .when(k % 5 == 2, F.concat(F.lit("-000"), (k + 1).cast("string"), F.lit(".000")))
        .when(k % 5 == 3, F.concat(F.lit("+.00"), (k * 10 + 1).cast("string"), F.lit("000")))
        .otherwise(F.concat(((k * 10 + 7) * 10 + 5).cast("string"), F.lit("e-1")))
    )
    return table(spark, d, "part").select("p_partkey", canonical.canonical_number(token).alias("canon"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / 0.5) * 0.5 AS canon FROM lineitem")
def canon_tolerance(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", canonical.on_grid(F.col("l_extendedprice"), 0.5).alias("canon"))


@query("SELECT p_partkey, lower(p_name) AS canon FROM part")
def canon_text(spark, d):
    spaced = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " \t　\n").otherwise(""))
    return table(spark, d, "part").select("p_partkey", canonical.canonical_text(spaced, Options(fold_case=True)).alias("canon"))


@query("SELECT event_id, regexp_replace(regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0+$', ''), '\\.$', '') AS canon FROM events")
def canon_datetime(spark, d):
    return table(spark, d, "events").select("event_id", canonical.canonical_datetime(F.col("ts")).alias("canon"))


@query(r"""WITH t AS (SELECT event_id, (user_id * 7919 + event_id) % 3020399 AS s, event_id % 4 AS f, event_id % 3 = 1 AS neg FROM events)
SELECT event_id, CASE WHEN neg AND (s > 0 OR f > 0) THEN '-' ELSE '' END || (s // 3600) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')
       || CASE f WHEN 1 THEN '.1' WHEN 2 THEN '.01' WHEN 3 THEN '.000001' ELSE '' END AS canon FROM t""")
def canon_time(spark, d):
    e = table(spark, d, "events").select("event_id", ((F.col("user_id") * 7919 + F.col("event_id")) % 3020399).alias("s"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    whole = lambda n: F.floor(F.col("s") / F.lit(n)).cast("long")
    f = F.col("event_id") % 4
    text = F.concat(F.when(F.col("event_id") % 3 == 1, "-").otherwise(""), whole(3600).cast("string"), F.lit(":"), two(whole(60) % 60), F.lit(":"), two(F.col("s") % 60), F.when(f == 1, ".100").when(f == 2, ".01").when(f == 3, ".000001").otherwise(""))
    return e.select("event_id", canonical.canonical_time(canonical.time_micros(text)).alias("canon"))


@query("SELECT p_partkey, ltrim(bin(p_partkey * 37), '0') || CASE WHEN p_partkey = 0 THEN '0' ELSE '' END AS canon FROM part")
def canon_bits(spark, d):
    value = F.unhex(F.lpad(F.hex(F.col("p_partkey") * 37), 16, "0"))
    return table(spark, d, "part").select("p_partkey", canonical.canonical_bits(value).alias("canon"))


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS canon FROM events""")
def canon_json(spark, d):
    return table(spark, d, "events").select("event_id", canonical.canonical_json(F.col("props")).alias("canon"))


@query(f"SELECT n_nationkey, lower(hex({_tlv(1, 'CAST(n_nationkey AS VARCHAR)', 'n_nationkey')} || {_tlv(13, 'n_name', 'n_name')} || {_tlv(1, 'CAST(n_regionkey AS VARCHAR)', 'n_regionkey')})) AS canon FROM nation")
def tlv_row(spark, d):
    df = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return df.select("n_nationkey", F.lower(F.hex(diff.canonical_of(df, schemas.introspect(df), Options()))).alias("canon"))


@query(f"{PAIRED} SELECT CAST(sum(CASE WHEN d.o_orderpriority IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls FROM dst d")
def canon_null_tags(spark, d):
    _, dst, s = orders_pair(spark, d)
    info = s.column("o_orderpriority").info
    bytes_ = canonical.tlv(F.col("o_orderpriority"), info, dst.schema["o_orderpriority"].dataType)
    return dst.agg(F.sum((bytes_ == F.lit(b"\x00")).cast("long")).alias("nulls"))


@query("SELECT n_name, 'X''' || hex(encode(n_name)) || '''' AS bytes_literal, '''' || n_name || '''' AS text_literal FROM nation")
def literals(spark, d):
    df = table(spark, d, "nation").select("n_name", F.col("n_name").cast("binary").alias("b"))
    kind = lambda c: df.schema[c].dataType
    return df.select("n_name", canonical.literal(F.col("b"), fam.TypeInfo(fam.BYTES), kind("b")).alias("bytes_literal"), canonical.literal(F.col("n_name"), fam.TypeInfo(fam.STR), kind("n_name")).alias("text_literal"))


# -- changes ---------------------------------------------------------------------------------------

OUTSIDE = f"WITH {DST_ORDERS} SELECT d.o_orderkey FROM dst d WHERE d.o_orderkey < (SELECT min(o_orderkey) FROM orders) OR d.o_orderkey > (SELECT max(o_orderkey) FROM orders)"


@query(OUTSIDE)
def out_of_range_rows(spark, d):
    src, dst, _ = orders_pair(spark, d)
    return chunking.out_of_range(dst, src, ["o_orderkey"]).select("o_orderkey")


@query(f"SELECT count(*) AS n FROM ({OUTSIDE})")
def out_of_range_count(spark, d):
    src, dst, _ = orders_pair(spark, d)
    return chunking.out_of_range(dst, src, ["o_orderkey"]).agg(F.count("*").alias("n"))


CHANGES = f"{PAIRED}, ops AS (SELECT CASE WHEN dk IS NULL THEN 'insert' WHEN sk IS NULL THEN 'delete' ELSE 'update' END AS op, coalesce(sk, dk) AS key FROM paired WHERE sk IS NULL OR dk IS NULL OR differs)"


def _orders_changes(spark, d):
    src, dst, s = orders_pair(spark, d)
    return src, dst, s, changes.change_set(src, dst, s, s, ["o_orderkey"])


@query(f"{CHANGES} SELECT op, CASE WHEN op = 'delete' THEN 1 ELSE 2 END AS phase, key FROM ops")
def changeset_unique_key(spark, d):
    return _orders_changes(spark, d)[3].select("op", "phase", F.coalesce("address.o_orderkey", "row.o_orderkey").alias("key"))


@query(f"{CHANGES} SELECT op, count(*) AS n FROM ops GROUP BY op")
def op_counts(spark, d):
    return changes.op_counts(_orders_changes(spark, d)[3])


@query(f"""WITH {DST_LINES}, both_sides AS (
  SELECT l_orderkey, l_linenumber, list_sort(list(md5(r)) FILTER (WHERE side = 's')) AS s, list_sort(list(md5(r)) FILTER (WHERE side = 'd')) AS t
  FROM (SELECT l_orderkey, l_linenumber, 's' AS side, concat_ws('|', {', '.join(LINE)}) AS r FROM lineitem
        UNION ALL SELECT l_orderkey, l_linenumber, 'd', concat_ws('|', {', '.join(LINE)}) FROM dst) GROUP BY 1, 2
), changed AS (SELECT l_orderkey, l_linenumber, coalesce(len(s), 0) AS s, coalesce(len(t), 0) AS t FROM both_sides WHERE s IS DISTINCT FROM t)
SELECT 'insert' AS op, l_orderkey, l_linenumber, CAST(s AS BIGINT) AS n FROM changed WHERE s > 0
UNION ALL SELECT 'delete', l_orderkey, l_linenumber, CAST(t AS BIGINT) FROM changed WHERE t > 0""")
def changeset_group_replace(spark, d):
    src, dst, s = lines_pair(spark, d)
    key = ["l_orderkey", "l_linenumber"]
    found = changes.change_set(src, dst, s, s, key)
    at = [F.coalesce(F.col(f"address.{k}"), F.col(f"row.{k}")).alias(k) for k in key]
    return found.groupBy("op", *at).agg(F.count("*").alias("n"))


@query("SELECT 'delete' AS op, count(*) AS n FROM orders")
def empty_source_deletes(spark, d):
    src, _, s = orders_pair(spark, d)
    return changes.op_counts(changes.change_set(src.limit(0), src, s, s, ["o_orderkey"]))


APPLIED = f"""{PAIRED} SELECT s.o_orderkey, s.o_custkey, s.o_orderstatus, s.o_totalprice, s.o_orderdate,
  CASE WHEN p.dk IS NOT NULL AND NOT p.differs THEN d.o_orderpriority ELSE s.o_orderpriority END AS o_orderpriority
FROM orders s JOIN paired p ON p.sk = s.o_orderkey LEFT JOIN dst d ON d.o_orderkey = s.o_orderkey"""


@query(APPLIED)
def apply_rowlevel_result(spark, d):
    _, dst, _, found = _orders_changes(spark, d)
    return changes.apply_changes(dst, fixed(found), ["o_orderkey"])


SWAP = """src AS (SELECT s_suppkey, s_name FROM supplier),
dst AS (SELECT a.s_suppkey, CASE WHEN a.s_suppkey % 10 IN (2, 3) AND b.s_name IS NOT NULL THEN b.s_name ELSE a.s_name END AS s_name
        FROM supplier a LEFT JOIN supplier b ON b.s_suppkey = CASE a.s_suppkey % 10 WHEN 2 THEN a.s_suppkey + 1 WHEN 3 THEN a.s_suppkey - 1 END)"""


def swapped(spark, d):
    src = table(spark, d, "supplier").select("s_suppkey", "s_name")
    k = F.col("s_suppkey")
    other = src.select(F.col("s_suppkey").alias("ok"), F.col("s_name").alias("oname"))
    partner = F.when(k % 10 == 2, k + 1).when(k % 10 == 3, k - 1)
    dst = src.join(other, partner == F.col("ok"), "left").select("s_suppkey", F.coalesce("oname", "s_name").alias("s_name"))
    return src, dst, with_indexes(schemas.introspect(src, "supplier"), PRIMARY=("s_suppkey",), by_name=("s_name",))


def _verdicts(spark, d, chunk: int):
    src, dst, s = swapped(spark, d)
    chunk_id = lambda df: df.withColumn("chunk_id", F.floor(F.col("s_suppkey") / F.lit(chunk)).cast("long"))
    found = fixed(changes.change_set(src, dst, s, s, ["s_suppkey"]))
    touched = found.where("address IS NOT NULL").select(F.col("address.s_suppkey").alias("tk")).distinct()
    held = chunk_id(dst).join(touched, F.col("s_suppkey") == F.col("tk"), "left").withColumn("addressed", F.col("tk").isNotNull()).drop("tk")
    written = chunk_id(found.where("row IS NOT NULL").select("row.*"))
    return changes.conflicts(written, held, src, s, s, ["s_suppkey"], ("s_name",)).select(F.col("key.s_suppkey").alias("key"), F.col("holder_key.s_suppkey").alias("holder"), "verdict")


CONFLICTS = "WITH {swap}, written AS (SELECT s.* FROM src s JOIN dst d USING (s_suppkey) WHERE s.s_name <> d.s_name) SELECT w.s_suppkey AS key, h.s_suppkey AS holder, {verdict} AS verdict FROM written w JOIN dst h ON w.s_name = h.s_name AND w.s_suppkey <> h.s_suppkey"


@query(CONFLICTS.format(swap=SWAP, verdict="'rewrite'"))
def unique_swap_conflicts(spark, d):
    return _verdicts(spark, d, 1000)


@query(CONFLICTS.format(swap=SWAP, verdict="CASE WHEN h.s_suppkey < w.s_suppkey THEN 'safe' ELSE 'conflict' END"))
def holder_cross_chunk(spark, d):
    return _verdicts(spark, d, 1)


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def source_duplicate_tuples(spark, d):
    src = table(spark, d, "customer").select("c_nationkey", "c_mktsegment")
    s = schemas.introspect(src)
    slots = changes.source_duplicates(src, s, ("c_nationkey", "c_mktsegment"))
    named = src.select("*", changes.tuple_bytes(src, s, ("c_nationkey", "c_mktsegment")).alias("slot")).distinct()
    return named.join(slots, "slot").select("c_nationkey", "c_mktsegment", "n")


@query(f"""{CHANGES}, placed AS (SELECT op, key, row_number() OVER (PARTITION BY op ORDER BY key) - 1 AS place FROM ops)
SELECT op, key FROM placed ORDER BY place > 0, op, place LIMIT 5""")
def sample_one_per_op(spark, d):
    found = _orders_changes(spark, d)[3].withColumn("key", F.coalesce("address.o_orderkey", "row.o_orderkey"))
    return changes.sample(found, [F.col("key")], 5).select("op", "key")


@query("SELECT max(o_orderkey) + 1 AS next_value FROM orders")
def auto_increment_next(spark, d):
    return schemas.auto_increment_next(table(spark, d, "orders"), "o_orderkey")


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from . import sync_queries  # noqa: F401  registers its queries

    return ALL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
