"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Law ``rows``: shard sizes differ by at most one. The rows of each scan partition are counted, then
row p of the matrix says how many rows of partition p go to each bin: a multivariate hypergeometric
draw, so that all assignments of rows to bins of the given sizes are equally likely. The matrix is never
held: every task redraws its own row by walking a binary tree over partitions, seeded per tree node, so
the driver keeps one count a partition. Each task permutes its labels, rows are exchanged by bin, each bin to
its own reducer, and a sort on a seeded hash permutes every bin again. Python sees ordinals and gives labels;
rows stay in the JVM and are exchanged once.

A shard is made of several bins of bounded rows and bytes, so no task ever holds a whole shard. Counting and
dealing are two reads that must see the same partitions; an input with an exchange of its own, where they could
differ, is written first.

Defined cases: null texts have size 1; repeated rows are separate rows; an empty table gives no rows;
other columns are carried along (columns named shard or slot are replaced).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

ROWS_PER_BIN, BYTES_PER_BIN = 65_536, 64_000_000
LEAST_BINS_PER_SHARD = 8
#: Fixed value: bits of the ordinal in monotonically_increasing_id; the partition is above them.
ORDINAL_BITS = 33


def even_sizes(total: int, parts: int) -> np.ndarray:
    """``parts`` sizes that sum to ``total`` and differ by at most one."""
    return np.array([total // parts + (i < total % parts) for i in range(parts)], dtype=np.int64)


def hypergeometric(good: int, bad: int, drawn: int, rng: np.random.Generator) -> int:
    """How many of ``drawn`` rows are among the ``good``: inverse transform over all values within
    fourteen deviations of the mean (beyond them lies less than 1e-40), at any population size."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    n = good + bad
    mean = drawn * good / n
    spread = 14 * math.sqrt(max(mean * (bad / n) * (n - drawn) / max(n - 1, 1), 1)) + 20
    a, b = max(low, int(mean - spread)), min(high, int(mean + spread) + 1)
    k = np.arange(a, b, dtype=np.float64)
    ratio = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(weights, rng.random() * weights[-1], side="right").clip(0, b - a))


def draw_row(sizes: np.ndarray, drawn: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``drawn`` rows come from each of the groups in ``sizes``."""
    out, left = np.zeros(len(sizes), dtype=np.int64), int(sizes.sum())
    for i, s in enumerate(sizes):
        left -= int(s)
        out[i] = hypergeometric(int(s), left, drawn, rng)
        drawn -= int(out[i])
    return out


def matrix_row(counts: np.ndarray, bins: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row ``p`` of the communication matrix: at each node of a binary tree over the partitions, the
    left half's share of the bins is drawn with the node's own seed."""
    prefix = np.concatenate([[0], np.cumsum(counts)])
    low, high, have = 0, len(counts), bins.copy()
    while high - low > 1:
        mid = (low + high) // 2
        left = draw_row(have, int(prefix[mid] - prefix[low]), np.random.default_rng([seed, low, high]))
        low, high, have = (low, mid, left) if p < mid else (mid, high, have - left)
    return have


def _bytes(docs: DataFrame) -> Column:
    """About the size of a row: 16 bytes and its texts."""
    texts = [F.coalesce(F.octet_length(docs[f"`{f.name}`"]), F.lit(0)).cast("long") for f in docs.schema.fields if f.dataType.typeName() in ("string", "binary")]
    return sum(texts, F.lit(16).cast("long"))


def _first_slot(bin_: Column, total: int, n_shards: int, per_shard: int) -> Column:
    """Slots before a bin in its shard: those of even_sizes, as arithmetic."""
    shard, place = F.floor(bin_ / per_shard), bin_ % per_shard
    size = F.lit(total // n_shards) + F.when(shard < total % n_shards, 1).otherwise(0)
    return place * F.floor(size / per_shard) + F.least(place, size % per_shard)


def shard_rows(docs: DataFrame, n_shards: int = 8, seed: int = 7, rows_per_bin: int = ROWS_PER_BIN, bytes_per_bin: int = BYTES_PER_BIN) -> DataFrame:
    """``docs`` with shard (0 to n_shards - 1) and slot (gapless from 0 within a shard)."""
    docs = docs.drop("shard", "slot")
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = settle(docs, "dealt")
    sized = docs.select(F.spark_partition_id().alias("p"), _bytes(docs).alias("bytes"))
    seen = sized.groupBy("p").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()  # two numbers a partition
    counts = np.zeros(max([r["p"] for r in seen], default=0) + 1, dtype=np.int64)
    for r in seen:
        counts[r["p"]] = r["n"]
    total = int(counts.sum())
    wanted = max(total / rows_per_bin, sum(r["bytes"] for r in seen) / bytes_per_bin)
    per_shard = max(LEAST_BINS_PER_SHARD, math.ceil(wanted / n_shards))
    bins = np.concatenate([even_sizes(int(s), per_shard) for s in even_sizes(total, n_shards)])
    shared = docs.sparkSession.sparkContext.broadcast((counts, bins))

    @F.arrow_udf("int")
    def deal(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        (counts, bins), labels, p = shared.value, None, 0
        for some in ids:
            some = some.to_numpy(zero_copy_only=False)
            if labels is None and len(some):
                p = int(some[0] >> ORDINAL_BITS)
                labels = np.repeat(np.arange(len(bins), dtype=np.int32), matrix_row(counts, bins, p, seed))
                np.random.default_rng([seed, p, 1 << 20]).shuffle(labels)
            at = some & ((1 << ORDINAL_BITS) - 1)
            if len(at) and at[-1] >= len(labels):
                raise RuntimeError(f"partition {p} has more than the {len(labels)} rows that were counted")
            yield pa.array(labels[at] if len(at) else [], pa.int32())

    rows = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("ord"))
    dealt = rows.withColumn("bin", deal("ord")).repartitionById(len(bins), "bin")
    within = Window.partitionBy("bin").orderBy(F.xxhash64(F.lit(seed), "ord"), "ord")
    slot = F.row_number().over(within) - 1 + _first_slot(F.col("bin"), total, n_shards, per_shard)
    return dealt.select("row", slot.cast("long").alias("slot"), F.floor(F.col("bin") / per_shard).cast("int").alias("shard")).select("row.*", "shard", "slot")


def digest(docs: DataFrame) -> DataFrame:
    out = shard_rows(docs.select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
