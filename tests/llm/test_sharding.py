from collections import Counter

import numpy as np

from tablewright.llm import sharding


def test_matrix_has_exact_margins():
    counts, bins = np.array([5, 0, 17, 3, 8]), np.array([11, 11, 11])
    rows = np.array([sharding.matrix_row(counts, bins, p, seed=3) for p in range(len(counts))])
    assert (rows >= 0).all() and (rows.sum(axis=1) == counts).all() and (rows.sum(axis=0) == bins).all()


def test_draws_follow_the_law():
    rng = np.random.default_rng(1)
    drawn = np.array([sharding.hypergeometric(30, 70, 20, rng) for _ in range(20000)])
    assert abs(drawn.mean() - 6) < 0.05 and abs(drawn.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.15
    big = np.array([sharding.hypergeometric(10**11, 3 * 10**11, 10**10, rng) for _ in range(50)])
    assert abs(big.mean() / 2.5e9 - 1) < 1e-4
    assert sharding.hypergeometric(0, 5, 3, rng) == 0 and sharding.hypergeometric(5, 0, 3, rng) == 3


def test_shards_are_exact_and_gapless(spark):
    docs = [(i, None if i % 7 == 0 else "é" * (i % 5), i % 3) for i in range(1003)] + [(5, "same", 0), (5, "same", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, slot int").repartition(9)
    rows = sharding.digest(df).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d[0] for d in docs)
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    by = {r["doc_id"]: r for r in rows}
    assert by[7]["size"] == 1 and by[7]["text_crc32"] == 0 and by[8]["size"] == 7


def test_places_look_uniform(spark):
    df = spark.createDataFrame([(i, "x") for i in range(4000)], "doc_id long, text string").repartition(4, "doc_id")
    rows = sharding.shard_rows(df).collect()
    at = np.array([[r["doc_id"], r["shard"], r["slot"]] for r in rows])
    assert abs(np.corrcoef(at[:, 0], at[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(at[:, 0], at[:, 2])[0, 1]) < 0.06
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_rows(df).collect()}
    assert again == {tuple(x) for x in at.tolist()}


def test_empty_and_tiny_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.digest(empty).count() == 0
    one = sharding.digest(spark.createDataFrame([(None, "a")], "doc_id long, text string")).collect()
    assert [(r["shard"], r["slot"]) for r in one] == [(0, 0)]


def test_ids_and_columns_come_back_as_they_were(spark):
    rows = [(2**60 + 1, "a"), (2**60 + 3, "b"), (None, "c"), (None, None)]
    columns = "doc_id long, text string, __bin long, __ord long, bin int, `ord` int, row string, `a.b` long, shard int"
    df = spark.createDataFrame([(*r, None if i else 2**60 + 5, 1, 2, 3, "r", None if i else 2**61 + 1, 9) for i, r in enumerate(rows)], columns).coalesce(1)
    out = sharding.shard_rows(df)
    assert out.columns == [*df.columns[:-1], "shard", "slot"]
    found = out.collect()
    assert {r["doc_id"] for r in found} == {d for d, _ in rows} and {r["__bin"] for r in found} == {None, 2**60 + 5}
    assert {r["a.b"] for r in found} == {None, 2**61 + 1}


def test_bins_are_bounded_in_bytes_and_slots_stay_gapless(spark):
    df = spark.createDataFrame([(i, "x" * 1000) for i in range(500)], "doc_id long, text string").repartition(3)
    rows = sharding.shard_rows(df, n_shards=3, bytes_per_bin=10_000).collect()
    for shard in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots))) and len(slots) in (166, 167)


def test_against_labels_dealt_in_one_place(spark):
    """Every row gets the label that the matrix and the permutations give it, by brute force over partitions."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id")
    n = df.count()
    per_shard, sizes = sharding.LEAST_BINS_PER_SHARD, sharding.even_sizes(n, 8)
    bins = np.concatenate([sharding.even_sizes(int(s), per_shard) for s in sizes])
    from pyspark.sql import functions as F

    placed = [(r["p"], r["doc_id"]) for r in df.select(F.spark_partition_id().alias("p"), "doc_id").collect()]
    counts = np.bincount([p for p, _ in placed])
    expected = {}
    for p in range(len(counts)):
        labels = np.repeat(np.arange(len(bins)), sharding.matrix_row(counts, bins, p, 7))
        np.random.default_rng([7, p, 1 << 20]).shuffle(labels)
        expected.update({d: int(b) // per_shard for (_, d), b in zip([x for x in placed if x[0] == p], labels)})
    assert {r["doc_id"]: r["shard"] for r in sharding.shard_rows(df).collect()} == expected
