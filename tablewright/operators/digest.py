"""Chunk digests and table fingerprints.

Unordered digests are sums modulo 2^64 over row hashes, so they combine map-side and do not depend on
partitions. Ordered ones are trees of hashes: row hashes in key order, in blocks of BLOCK, then the blocks' hashes,
so that no list is longer than a block however many rows a chunk has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, LEVELS = 1024, 3
TWO_32, TWO_64 = 1 << 32, 1 << 64


def _big(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def unsigned(h: Column) -> Column:
    """A long's 64 bits as a number from 0."""
    return F.pmod(h.cast("decimal(38,0)"), _big(TWO_64)).cast("decimal(20,0)")


def square(h: Column) -> Column:
    """The square of 64 bits modulo 2^64, as a long's bits: halves and quarters keep every product and sum
    within a long, so there is neither overflow nor a decimal a row."""
    low32, low16 = F.lit(TWO_32 - 1), F.lit(0xFFFF).cast("long")
    a, b = h.bitwiseAND(low32), F.shiftrightunsigned(h, 32)
    a0, a1 = a.bitwiseAND(low16), F.shiftrightunsigned(a, 16)
    middle = a0 * a1 * 2
    low = a0 * a0 + F.shiftleft(middle.bitwiseAND(low16), 16)
    cross = (a0 * b + F.shiftleft((a1 * b).bitwiseAND(low16), 16)) * 2
    high = (F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(middle, 16) + a1 * a1 + cross).bitwiseAND(low32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(low32))


def modular_sum(bits: Column) -> Column:
    """The sum modulo 2^64 of longs' bits. They are added in pieces of 24 bits, which a long holds for
    2^39 rows a group, and put together once a group."""
    low24 = F.lit((1 << 24) - 1).cast("long")
    pieces = [F.sum(F.shiftrightunsigned(bits, 24 * k).bitwiseAND(low24)).cast("decimal(20,0)") for k in range(3)]
    total = pieces[0].cast("decimal(38,0)")
    for k in (1, 2):
        total = total + (pieces[k] * F.lit(str(1 << 24 * k)).cast("decimal(18,0)")).cast("decimal(38,0)")
    return F.pmod(total, _big(TWO_64)).cast("decimal(20,0)")


def statistics(h: Column) -> list[Column]:
    """Count, sum, exclusive or and sum of squares of row hashes."""
    return [F.count("*").alias("n"), modular_sum(h).alias("sum_h"), unsigned(F.bit_xor(h)).alias("xor_h"), modular_sum(square(h)).alias("sumsq_h")]


def chunk_digests(hashed: DataFrame) -> DataFrame:
    """(chunk_id, n, sum_h, xor_h, sumsq_h) from rows with chunk_id and h."""
    return hashed.groupBy("chunk_id").agg(*statistics(F.col("h")))


def _folded(rows: DataFrame, group: list[str], place: str, text: str) -> DataFrame:
    """(group, place, n, text): texts of one block of places joined in order and hashed."""
    block = F.floor(F.col(place) / F.lit(BLOCK)).cast("long").alias(place)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(place, text))), lambda x: x[text])
    return rows.groupBy(*group, block).agg(F.sum("n").alias("n"), F.md5(F.array_join(listed, ",").cast("binary")).alias(text))


def ordered_digests(hashed: DataFrame, order: list[str]) -> DataFrame:
    """(chunk_id, n, digest) from rows with chunk_id, h and ``order``. Rows are numbered in order, equal keys in
    that of their hashes; the MD5 of a block's hashes, then of a block's MD5s, three levels high (2^30 rows a
    chunk), then of what is left."""
    ranks = Window.partitionBy("chunk_id").orderBy(*[F.col(k).asc_nulls_first() for k in order], "h")
    rows = hashed.select("chunk_id", (F.row_number().over(ranks) - 1).cast("long").alias("place"), F.lit(1).cast("long").alias("n"), F.col("h").cast("string").alias("text"))
    for _ in range(LEVELS):
        rows = _folded(rows, ["chunk_id"], "place", "text")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    return rows.groupBy("chunk_id").agg(F.sum("n").alias("n"), F.md5(F.array_join(listed, ",").cast("binary")).alias("digest"))


def table_fingerprint(digests: DataFrame, secure: bool = False) -> DataFrame:
    """(n, fingerprint) of unordered digests: the same however rows were cut into chunks."""
    folded = digests.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(modular_sum(signed(F.col("sum_h"))), F.lit(0).cast("decimal(20,0)")).alias("s"),
        F.coalesce(F.bit_xor(signed(F.col("xor_h"))), F.lit(0).cast("long")).alias("x"),
        F.coalesce(modular_sum(signed(F.col("sumsq_h"))), F.lit(0).cast("decimal(20,0)")).alias("q"),
    )
    text = F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string"), unsigned(F.col("x")).cast("string"), F.col("q").cast("string"))
    return folded.select("n", F.substring(F.md5(text.cast("binary")), 1, 32 if secure else 16).alias("fingerprint"))


def ordered_fingerprint(digests: DataFrame, secure: bool = False) -> DataFrame:
    """(n, fingerprint) of ordered digests, in order of their chunks, by the same tree over chunk ids."""
    rows = digests.select(F.lit(0).alias("all"), F.col("chunk_id").alias("place"), "n", F.concat_ws(":", F.col("n").cast("string"), "digest").alias("text"))
    for _ in range(LEVELS):
        rows = _folded(rows, ["all"], "place", "text")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"), F.substring(F.md5(F.array_join(listed, ",").cast("binary")), 1, 32 if secure else 16).alias("fingerprint"))


def signed(value: Column) -> Column:
    """Back from 0..2^64 to a long's bits."""
    return F.when(value >= _big(1 << 63), value.cast("decimal(38,0)") - _big(TWO_64)).otherwise(value.cast("decimal(38,0)")).cast("long")


def hex_digest(*parts: Column) -> Column:
    """A digest for reports: sixteen hex digits a number, joined by colons; ``missing`` where the side has no row
    in the chunk."""
    text = F.concat_ws(":", *[F.lpad(F.lower(F.hex(signed(p.cast("decimal(20,0)")))), 16, "0") for p in parts])
    return F.when(parts[0].isNull(), "missing").otherwise(text)


def differing(src: DataFrame, dst: DataFrame) -> DataFrame:
    """(chunk_id, src_n, dst_n, src_digest, dst_digest) of chunks whose digests differ or that only one side has."""
    stats = [c for c in src.columns if c != "chunk_id"]
    a = src.select(F.col("chunk_id").alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in stats])
    b = dst.select(F.col("chunk_id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in stats])
    joined = a.join(b, F.col("a_id") == F.col("b_id"), "full_outer")
    same = F.lit(True)
    for c in stats:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    text = [hex_digest(*[F.col(f"{side}_{c}") for c in stats]).alias(name) for side, name in (("a", "src_digest"), ("b", "dst_digest"))]
    return joined.where(~same).select(F.coalesce("a_id", "b_id").alias("chunk_id"), F.coalesce("a_n", F.lit(0)).alias("src_n"), F.coalesce("b_n", F.lit(0)).alias("dst_n"), *text)
