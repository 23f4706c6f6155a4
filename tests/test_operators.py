import random

import pytest
from pyspark.sql import functions as F

from tablewright.functions.canonical import Options
from tablewright.operators import changes, chunking, diff, digest
from tablewright.plans import schema as schemas
from tablewright.sources.tables import with_indexes


def keyed(df, *key, **unique):
    return with_indexes(schemas.introspect(df, "t"), PRIMARY=tuple(key), **unique)


@pytest.mark.parametrize("values", [[-(2**63), -(2**63) + 1, 1, 2**63 - 2, 2**63 - 1], list(range(100)), [5], [1, 1, 1, 2]])
def test_integer_chunks_cover_every_row_once(spark, values):
    df = spark.createDataFrame([(v,) for v in values + [None]], "k long")
    if max(values) - min(values) >= 2**64 - 1:
        with pytest.raises(ValueError):
            chunking.plan_integer(df, "k", 10)
        return
    plan = chunking.plan_integer(df, "k", 10)
    rows = df.withColumn("c", plan.chunk_id()).collect()
    bounds = {i: (lo, hi) for i, lo, hi in plan.bounds(spark).collect()}
    assert all(bounds[r["c"]][0] <= r["k"] <= bounds[r["c"]][1] for r in rows if r["k"] is not None)
    assert [r["c"] for r in rows if r["k"] is None] == [0]
    assert max(r["c"] for r in rows) == plan.chunks - 1 or len(set(values)) < plan.chunks


def test_ranked_chunks_keep_equal_keys_together(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abcdef"), rng.randint(0, 30) if rng.random() < 0.9 else None, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a string, b int, v int")
    bounds = chunking.plan_ranked(df, ["a", "b"], 50)
    placed = chunking.ranked_chunk_id(df, ["a", "b"], bounds).collect()
    assert len(placed) == 1000
    by_key = {}
    for r in placed:
        by_key.setdefault((r["a"], -1 if r["b"] is None else r["b"]), set()).add(r["chunk_id"])
    assert all(len(c) == 1 for c in by_key.values())
    ordered = [min(by_key[k]) for k in sorted(by_key)]
    assert ordered == sorted(ordered) and len(set(ordered)) == bounds.count()
    sizes = {r["chunk_id"]: r["n_rows"] for r in bounds.collect()}
    counted = {}
    for r in placed:
        counted[r["chunk_id"]] = counted.get(r["chunk_id"], 0) + 1
    assert counted == sizes
    beyond = spark.createDataFrame([("zzz", 1, 1), (None, None, 2)], "a string, b int, v int")
    assert sorted(r["chunk_id"] for r in chunking.ranked_chunk_id(beyond, ["a", "b"], bounds).collect()) == [0, max(sizes)]


def test_three_column_keys_compare_as_a_whole(spark):
    df = spark.createDataFrame([(3, 5, 4), (2, 5, 4), (2, 5, 6), (1, 9, 9)], "a int, b int, c int")
    src = spark.createDataFrame([(2, 5, 5), (3, 9, 9)], "a int, b int, c int")
    found = {tuple(r) for r in chunking.out_of_range(df, src, ["a", "b", "c"]).collect()}
    assert found == {(2, 5, 4), (1, 9, 9)}
    assert chunking.out_of_range(df, src.limit(0), ["a", "b", "c"]).count() == 0


def test_digests_are_exact_and_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    hashes = [rng.getrandbits(64) - 2**63 for _ in range(500)] + [0, -1, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(h, i % 3) for i, h in enumerate(hashes)], "h long, chunk_id long")
    u = [h % 2**64 for h in hashes]
    xor = 0
    for h in u:
        xor ^= h
    got = df.agg(*digest.statistics(F.col("h"))).first()
    assert (got["n"], int(got["sum_h"]), int(got["xor_h"]), int(got["sumsq_h"])) == (len(u), sum(u) % 2**64, xor, sum(h * h for h in u) % 2**64)
    prints = {tuple(digest.table_fingerprint(digest.chunk_digests(d)).first()) for d in (df, df.repartition(7), df.withColumn("chunk_id", F.lit(0)))}
    assert len(prints) == 1
    assert digest.table_fingerprint(digest.chunk_digests(df.where("h <> 0"))).first() != prints.pop()
    empty = digest.table_fingerprint(digest.chunk_digests(df.limit(0)), secure=True).first()
    assert empty["n"] == 0 and len(empty["fingerprint"]) == 32


def test_ordered_digests_see_the_order(spark):
    df = spark.createDataFrame([(0, 1, 10), (0, 2, 20)], "chunk_id long, k long, h long")
    swapped = spark.createDataFrame([(0, 1, 20), (0, 2, 10)], "chunk_id long, k long, h long")
    one = lambda d: digest.ordered_digests(d, ["k"]).first()["digest"]
    assert one(df) == one(df.repartition(2)) != one(swapped)


def test_compare_finds_and_drills(spark):
    src = spark.createDataFrame([(i, f"v{i}", i / 2) for i in range(200)], "id long, v string, x double")
    dst = src.where("id <> 7").withColumn("v", F.when(F.col("id") == 150, "other").otherwise(F.concat("v", F.lit(" ")))).unionByName(spark.createDataFrame([(500, "new", 1.0)], "id long, v string, x double"))
    s = keyed(src, "id")
    spec = diff.Spec(chunk_size=20, drill=True)
    assert diff.compare("t", src, src, s, s, spec).status == "OK"
    found = diff.compare("t", src, dst, s, s, spec)
    assert found.status == "DIFFERENT" and found.chunks == 10 and found.src_fp != found.dst_fp
    assert {(r["kind"], r["key"]) for r in found.rows.collect()} == {("CHANGED", "150"), ("MISSING_IN_DST", "7"), ("MISSING_IN_SRC", "500")}
    shorter = diff.compare("t", src, dst.where("id < 100"), s, s)
    assert shorter.status == "DIFFERENT" and shorter.diff_chunks is None  # counts differ: nothing is scanned
    assert diff.compare("t", src, dst, s, s, diff.Spec(where="id between 10 and 140")).status == "OK"
    assert diff.compare("t", src, dst.drop("x"), s, schemas.introspect(dst.drop("x"))).status == "ERROR"


def test_keyless_tables_are_multisets(spark):
    src = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), (None, None)], "v string, x double")
    s = schemas.introspect(src)
    assert diff.compare("t", src, src.orderBy(F.desc("v")).repartition(3), s, s).status == "OK"
    dst = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0), ("c", 1.0)], "v string, x double")
    rows = {(r["kind"], r["row"], r["src_n"], r["dst_n"]) for r in diff.multiset_diff(src, dst, s, s).collect()}
    assert rows == {("COUNT_DIFF", "a | 1", 2, 1), ("COUNT_DIFF", "b | 2", 1, 2), ("MISSING_IN_DST", "NULL | NULL", 1, 0), ("MISSING_IN_SRC", "c | 1", 0, 1)}
    assert diff.compare("t", src, dst, s, s, diff.Spec(drill=True)).rows.count() == 4


def random_table(spark, rng, n, unique):
    keys = rng.sample(range(n * 2), n) if unique else [rng.randrange(n // 3) for _ in range(n)]
    return spark.createDataFrame([(k if rng.random() < 0.97 or unique else None, rng.choice("abc"), rng.randint(0, 3)) for k in keys], "id long, v string, w int")


@pytest.mark.parametrize("unique", [True, False])
def test_applied_changes_make_tables_equal(spark, unique):
    rng = random.Random(5)
    src, dst = random_table(spark, rng, 120, unique), random_table(spark, rng, 110, unique)
    s = keyed(src, "id") if unique else schemas.introspect(src)
    found = changes.change_set(src, dst, s, s, ["id"])
    made = changes.apply_changes(dst, found, ["id"])
    assert diff.multiset_diff(src, made, s, s).count() == 0
    again = changes.change_set(src, made, s, s, ["id"])
    assert again.count() == 0
    if unique:
        assert {r["op"] for r in found.select("op").distinct().collect()} == {"insert", "update", "delete"}


def test_sample_has_one_of_every_kind(spark):
    src = spark.createDataFrame([(i, "x") for i in range(50)], "id long, v string")
    dst = spark.createDataFrame([(i, "y" if i == 3 else "x") for i in range(4)] + [(99, "z")], "id long, v string")
    s = keyed(src, "id")
    found = changes.change_set(src, dst, s, s, ["id"]).withColumn("key", F.coalesce("address.id", "row.id"))
    rows = [(r["op"], r["key"]) for r in changes.sample(found, [F.col("key")], 5).collect()]
    assert rows[:3] == [("delete", 99), ("insert", 4), ("update", 3)] and rows[3:] == [("insert", 5), ("insert", 6)]
    assert changes.sample(found, [F.col("key")], 0).count() == 0


def verdicts(spark, src, dst, chunk, columns=("u",)):
    a = spark.createDataFrame(src, "id long, u string, w string")
    b = spark.createDataFrame(dst, "id long, u string, w string")
    s = keyed(a, "id", u=columns)
    at = lambda d: d.withColumn("chunk_id", F.floor(F.col("id") / F.lit(chunk)).cast("long"))
    found = changes.change_set(a, b, s, s, ["id"])
    touched = {r["address"]["id"] for r in found.collect() if r["address"]}
    held = at(b).withColumn("addressed", F.col("id").isin(list(touched)) if touched else F.lit(False))
    written = at(found.where("row IS NOT NULL").select("row.*"))
    return sorted((r["key"]["id"], r["holder_key"]["id"], r["verdict"]) for r in changes.conflicts(written, held, a, s, s, ["id"], columns).collect()), a, s


def test_unique_conflicts(spark):
    swap = verdicts(spark, [(1, "b", ""), (2, "a", "")], [(1, "a", ""), (2, "b", "")], 10)[0]
    assert swap == [(1, 2, "rewrite"), (2, 1, "rewrite")]
    apart = verdicts(spark, [(1, "b", ""), (2, "a", "")], [(1, "a", ""), (2, "b", "")], 2)[0]
    assert apart == [(1, 2, "conflict"), (2, 1, "safe")]
    none = verdicts(spark, [(1, None, "x"), (2, "a", "")], [(1, None, ""), (2, "a", ""), (3, None, "")], 10)[0]
    assert none == []  # null holds no slot
    per_tuple = verdicts(spark, [(1, "a", "x"), (2, "a", "y")], [(1, "a", "z"), (2, "a", "y")], 10, ("u", "w"))[0]
    assert per_tuple == []
    outside = verdicts(spark, [(5, "a", ""), (6, "b", "")], [(5, "z", ""), (6, "b", ""), (99, "a", "")], 3)[0]
    assert outside == [(5, 99, "safe")]
    _, src, s = verdicts(spark, [(1, "a", ""), (2, "a", "")], [(1, "a", "")], 10)
    assert [r["n"] for r in changes.source_duplicates(src, s, ("u",)).collect()] == [2]


def test_options_change_what_is_equal(spark):
    src = spark.createDataFrame([(1, "Ab", 1.0, '{"a":1}')], "id long, v string, x double, j string")
    dst = spark.createDataFrame([(1, "aB ", 1.0 + 1e-12, '{"a": 1.0}')], "id long, v string, x double, j string")
    from pyspark.sql import types as T

    meta = lambda d: d.withMetadata("j", {"raw_type": "json"})
    src, dst = meta(src), meta(dst)
    s = keyed(src, "id")
    assert isinstance(src.schema["j"].dataType, T.StringType)
    everything = Options(tolerance=1e-9, fold_case=True, normalize_json=True)
    assert diff.row_diff(src, dst, s, s, ["id"], everything).count() == 0
    for weaker in (Options(fold_case=True, normalize_json=True), Options(tolerance=1e-9, normalize_json=True), Options(tolerance=1e-9, fold_case=True)):
        assert diff.row_diff(src, dst, s, s, ["id"], weaker).count() == 1


def test_ranks_split_points_and_batches(spark):
    rng = random.Random(8)
    values = [rng.randrange(300) for _ in range(2000)] + [7] * 900
    df = spark.createDataFrame([(v,) for v in values], "k long").repartition(6)
    order = sorted(values)
    for offset in (0, 1, 500, 2899):
        assert [r["k"] for r in chunking.split_point(df, ["k"], offset).collect()] == [order[offset]]
    assert chunking.split_point(df, ["k"], 2900).count() == 0
    numbered = changes.batched(spark.range(95).withColumnRenamed("id", "n").repartition(5), "n", 10).collect()
    assert sorted((r["n"], r["batch"]) for r in numbered) == [(i, i // 10) for i in range(95)]


def test_ranked_chunks_are_numbered_without_gaps(spark):
    values = [1] * 5 + [2] * 400 + list(range(3, 60))
    df = spark.createDataFrame([(v,) for v in values], "k long")
    bounds = sorted((r["chunk_id"], r["lo"]["k"], r["hi"]["k"], r["n_rows"]) for r in chunking.plan_ranked(df, ["k"], 20).collect())
    assert [b[0] for b in bounds] == list(range(len(bounds))) and sum(b[3] for b in bounds) == len(values)
    assert all(a[2] < b[1] for a, b in zip(bounds, bounds[1:]))


@pytest.mark.parametrize("many", [False, True])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_rows_of_differing_chunks(spark, monkeypatch, kind, many):
    """What is read again are the rows of differing chunks, keys outside the source's range and without a value too."""
    monkeypatch.setattr(diff, "MOST_RANGES", 1 if many else 200)
    src = spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    dst = src.withColumn("v", F.when(F.col("k").isin(105, 305, 306), "y").otherwise(F.col("v"))).unionByName(spark.createDataFrame([(None, "n"), (5000, "z"), (-4, "z")], "k long, v string"))
    cast = F.col("k") if kind == "long" else F.lpad(F.col("k").cast("string"), 5, "0")
    src, dst = (x.withColumn("k", cast) for x in (src, dst))
    s = keyed(src, "k")
    result = diff.compare("t", src, dst, s, s, diff.Spec(chunk_size=10, chunks_always=True))
    ids = [r["chunk_id"] for r in result.diff_chunks.collect()]
    plan = diff.chunk_plan(src, s, diff.Spec(chunk_size=10))
    for df, some in zip((src, dst), result.some):
        wanted = diff.with_chunk(df, plan).where(F.col("chunk_id").isin(ids)).select("k", "v", "chunk_id")
        assert sorted(map(str, some.select("k", "v", "chunk_id").collect())) == sorted(map(str, wanted.collect()))
    whole, part = (changes.change_set(a, b, s, s, ["k"]).count() for a, b in ((src, dst), [x.drop("chunk_id") for x in result.some]))
    assert whole == part == 6


def test_key_ranges_reach_the_scan(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("v")).write.parquet(f"{tmp_path}/t")
    src = spark.read.parquet(f"{tmp_path}/t")
    dst = src.withColumn("v", F.when(F.col("k") == 505, "y").otherwise(F.col("v")))
    s = keyed(src, "k")
    result = diff.compare("t", src, dst, s, s, diff.Spec(chunk_size=10))
    plan = result.some[0]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,500)" in plan and "LessThan(k,510)" in plan


def test_ordered_digests_of_large_chunks(spark, monkeypatch):
    monkeypatch.setattr(digest, "BLOCK", 4)
    df = spark.range(1000).select(F.lit(0).alias("chunk_id"), F.col("id").alias("k"), F.xxhash64("id").alias("h"))
    one = digest.ordered_digests(df.repartition(1), ["k"]).collect()
    many = digest.ordered_digests(df.repartition(7), ["k"]).collect()
    other = digest.ordered_digests(df.withColumn("k", F.when(F.col("k") < 2, 1 - F.col("k")).otherwise(F.col("k"))), ["k"]).collect()
    assert one == many and one[0]["digest"] != other[0]["digest"] and one[0]["n"] == 1000


def test_multisets_meet_only_rows_that_differ(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(20), rng.choice(["a", "a ", None])) for _ in range(600)]
    src, dst = spark.createDataFrame(rows, "k long, v string"), spark.createDataFrame(rows[5:] + [(99, "new"), (99, "new")], "k long, v string")
    s = schemas.introspect(src)
    found = {r["row"]: (r["src_n"], r["dst_n"]) for r in diff.multiset_diff(src, dst, s, s).collect()}
    counts = [{}, {}]
    for side, listed in enumerate((rows, rows[5:] + [(99, "new"), (99, "new")])):
        for k, v in listed:
            name = f"{k} | {'NULL' if v is None else v.rstrip()}"
            counts[side][name] = counts[side].get(name, 0) + 1
    assert found == {n: (counts[0].get(n, 0), counts[1].get(n, 0)) for n in {*counts[0], *counts[1]} if counts[0].get(n, 0) != counts[1].get(n, 0)}
