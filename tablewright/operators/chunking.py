"""Key-range chunks: planned on the source alone, applied to both sides.

Chunks partition rows exactly: the first one takes its lower bound and everything below it, each other one
the rows above the one before up to its own upper bound, the last one everything above. Keys are compared
as structs, in which nulls come first, so rows without a key value have a chunk as well. Rows of the
destination outside the source's range thus fall into the outermost chunks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import canonical
from ..plans.schema import TableSchema
from ..sources.shared import fixed

MOST_CHUNKS = 1 << 31


def key_struct(key: list[str]) -> Column:
    return F.struct(*[F.col(k) for k in key])


def key_extremes(df: DataFrame, key: list[str]) -> DataFrame:
    """One row (lo, hi): the first and the last key in key order, nulls first; null for an empty table."""
    return df.agg(F.min(key_struct(key)).alias("lo"), F.max(key_struct(key)).alias("hi"))


def chunk_count(total: int, size: int) -> int:
    if size < 10:
        raise ValueError(f"chunk size must be 10 at least, not {size}")
    return max(0, -(-total // size))


@dataclass(frozen=True)
class IntegerPlan:
    """Chunks of equal steps over an integer lead column."""

    column: str
    lo: int
    hi: int
    chunks: int

    @property
    def step(self) -> int:
        return -(-(self.hi - self.lo + 1) // self.chunks)

    def chunk_id(self) -> Column:
        """0 for keys up to the first step (and nulls), then one more a step; decimals can't overflow."""
        wide = F.col(self.column).cast("decimal(20,0)") - F.lit(self.lo).cast("decimal(20,0)")
        place = F.floor(wide / F.lit(self.step).cast("decimal(20,0)"))
        # a chunk owns (lower, upper]; its first key is lo + k x step
        return F.when(F.col(self.column).isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(self.chunks - 1), place))).cast("long")

    def span(self, chunk_id: Column) -> tuple[Column, Column]:
        """First and last key of a chunk."""
        wide = lambda n: F.lit(str(n)).cast("decimal(20,0)")
        lo = wide(self.lo) + chunk_id.cast("decimal(20,0)") * wide(self.step)
        return lo.cast("decimal(20,0)"), F.least(wide(self.hi), lo + wide(self.step) - wide(1)).cast("decimal(20,0)")

    def bounds(self, spark: SparkSession) -> DataFrame:
        """(chunk_id, lo, hi) of every chunk, made where they are used."""
        lo, hi = self.span(F.col("id"))
        return spark.range(self.chunks).select(F.col("id").alias("chunk_id"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))

    def shown(self, chunks: DataFrame) -> DataFrame:
        """``chunks`` with lo and hi as texts."""
        lo, hi = self.span(F.col("chunk_id"))
        return chunks.withColumns({"lo": lo.cast("string"), "hi": hi.cast("string")})

    def within(self, stretches: list[tuple[int, int]]) -> Column:
        """Whether a key may lie in these stretches of chunks (first, last), as plain ranges, which reach a Parquet
        scan. The outermost chunks have no bound outside, and the first one has the nulls."""
        out, column = F.lit(False), F.col(self.column)
        number = lambda n: F.lit(n) if -(1 << 63) <= n < 1 << 63 else F.lit(str(n)).cast("decimal(20,0)")
        for first, last in stretches:
            some = F.lit(True)
            if first > 0:
                some = some & (column >= number(self.lo + first * self.step))
            if last < self.chunks - 1:
                some = some & (column < number(self.lo + (last + 1) * self.step))
            out = out | (some | column.isNull() if first == 0 else some)
        return out


def plan_integer(df: DataFrame, column: str, size: int) -> IntegerPlan | None:
    """Equal steps over the lead column's range, from one aggregate; None for an empty table."""
    row = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("n")).first()
    if row["n"] == 0 or row["lo"] is None:
        return None
    lo, hi = int(row["lo"]), int(row["hi"])
    span = hi - lo + 1
    if span >= 1 << 64:
        raise ValueError("key range too wide to split")
    chunks = min(chunk_count(row["n"], size), span)
    if chunks > MOST_CHUNKS:
        raise ValueError(f"{chunks} chunks are too many; raise the chunk size")
    step = -(-span // chunks)
    return IntegerPlan(column, lo, hi, -(-span // step))


def runs(ids: list[int]) -> list[tuple[int, int]]:
    """Stretches (first, last) of neighbouring numbers."""
    out: list[list[int]] = []
    for i in sorted(ids):
        if out and i <= out[-1][1] + 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return [(a, b) for a, b in out]


def placed(df: DataFrame, order: str, weight: Column) -> DataFrame:
    """``df`` with place, the total weight of the rows before each in the order of a column of distinct values.
    Rows are range-partitioned; the driver adds up one number a partition, and no task holds the whole order."""
    ranged = fixed(df.repartitionByRange(order).withColumn("part", F.spark_partition_id()))  # two passes must see the same ranges
    totals = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.sum(weight).alias("n")).collect())  # a row a partition
    first, at = [], 0
    for part, n in totals:
        first.append((part, at))
        at += n
    firsts = F.broadcast(df.sparkSession.createDataFrame(first, "part int, first long"))
    before = F.coalesce(F.sum(weight).over(Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = ranged.withColumn("place", before).join(firsts, "part")
    return numbered.withColumn("place", (F.col("place") + F.col("first")).cast("long")).select(*df.columns, "place")


def plan_ranked(df: DataFrame, key: list[str], size: int) -> DataFrame:
    """(chunk_id, lo, hi, n_rows): bounds from ranks, as a written table. Rows of equal keys stay together, so a
    key of many rows leaves no chunk of its own behind it and chunks are numbered once they are known."""
    counted = df.groupBy(key_struct(key).alias("k")).agg(F.count("*").alias("n"))
    chunk = F.floor(F.col("place") / F.lit(size)).cast("long").alias("chunk")
    bounds = placed(counted, "k", F.col("n")).groupBy(chunk).agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum("n").alias("n_rows"))
    numbered = placed(bounds, "chunk", F.lit(1))
    return fixed(numbered.select(F.col("place").alias("chunk_id"), "lo", "hi", "n_rows"))


#: Bounds tables up to this many rows are broadcast; larger ones are joined.
BROADCAST_BOUNDS = 100_000


def ranked_chunk_id(df: DataFrame, key: list[str], bounds: DataFrame) -> DataFrame:
    """``df`` with the chunk_id of each row, its rank among the chunks' upper bounds, by a search on two
    levels: every group's last bound is in the plan, and a group's own bounds come by a join on the group. The
    driver reads the groups' last bounds, the root of the number of chunks."""
    chunks = bounds.count()
    if chunks <= 1:
        return df.withColumn("chunk_id", F.lit(0).cast("long"))
    width = math.isqrt(chunks - 1) + 1
    # bounds below a key: its first place among them. No lambda may name a key's column: Spark takes a column with the id of
    # a lambda's variable for that variable and infers a filter on the other side of a join, where there is no such column
    above = lambda uppers: F.array_position(F.sort_array(F.array_append(uppers, key_struct(key))), key_struct(key)).cast("int") - 1
    last = bounds.where((F.col("chunk_id") % width == width - 1) & (F.col("chunk_id") < chunks - 1))  # keys above the last bound belong to the last chunk
    tops = [r["hi"] for r in last.orderBy("chunk_id").select("hi").collect()]  # the root of the chunks' number
    top = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(key, u)]) for u in tops]).cast(ArrayType(bounds.schema["hi"].dataType))
    groups = bounds.groupBy(F.floor(F.col("chunk_id") / F.lit(width)).cast("int").alias("__group")).agg(F.array_sort(F.collect_list("hi")).alias("__his"), F.min("chunk_id").alias("__first"))
    if chunks <= BROADCAST_BOUNDS:
        groups = F.broadcast(groups)
    joined = df.withColumn("__group", above(top) if tops else F.lit(0)).join(groups, "__group")
    place = F.least(F.col("__first") + above(F.col("__his")), F.lit(chunks - 1).cast("long"))
    return joined.withColumn("chunk_id", place.cast("long")).select(*df.columns, "chunk_id")


@dataclass
class RankedPlan:
    """Chunks between keys of equal ranks; ``bounds`` is a written table."""

    table: DataFrame
    key: list[str]
    schema: TableSchema
    chunks: int

    def shown(self, chunks: DataFrame) -> DataFrame:
        """``chunks`` with lo and hi as texts: a key's values as literals, joined by commas."""
        fields = {f.name: f.dataType for f in self.table.schema["lo"].dataType.fields}
        text = lambda end: F.concat_ws(",", *[canonical.literal(F.col(end)[k], self.schema.column(k).info, fields[k]) for k in self.key]).alias(end)
        return chunks.join(self.table.select("chunk_id", text("lo"), text("hi")), "chunk_id")

    def within(self, stretches: list[tuple[int, int]]) -> Column:
        """Whether a key may lie in these stretches of chunks (first, last)."""
        wanted = [x for a, b in stretches for x in (a - 1, b)]
        found = {r["chunk_id"]: r["hi"] for r in self.table.where(F.col("chunk_id").isin(wanted)).select("chunk_id", "hi").collect()}  # two a stretch
        out = F.lit(False)
        for a, b in stretches:
            ends = [None if end in (-1, self.chunks - 1) else tuple(found[end]) for end in (a - 1, b)]
            out = out | inside(self.key, *ends)
        return out


def inside(key: list[str], lo: tuple | None, hi: tuple | None, first: bool = False) -> Column:
    """Whether a key lies in (lo, hi], or [lo, hi] for a first chunk; None is unbounded. The lead column's
    own range is said once more, as only plain comparisons reach a Parquet scan."""
    literal = lambda values: F.struct(*[F.lit(v).alias(k) for k, v in zip(key, values)])
    out = F.lit(True)
    if lo is not None:
        out = out & ((key_struct(key) >= literal(lo)) if first else (key_struct(key) > literal(lo)))
        if lo[0] is not None:
            out = out & (F.col(key[0]) >= F.lit(lo[0]))
    if hi is not None:
        out = out & (key_struct(key) <= literal(hi))
        if hi[0] is not None:
            out = out & (F.col(key[0]).isNull() | (F.col(key[0]) <= F.lit(hi[0])))
    return out


def out_of_range(dst: DataFrame, src: DataFrame, key: list[str]) -> DataFrame:
    """Destination rows whose key lies strictly outside the source's; none if the source is empty."""
    ends = key_extremes(src, key).first()  # one row
    if ends["lo"] is None:
        return dst.limit(0)
    literal = lambda row: F.struct(*[F.lit(row[k]).alias(k) for k in key])
    return dst.where((key_struct(key) < literal(ends["lo"])) | (key_struct(key) > literal(ends["hi"])))


def after(df: DataFrame, key: list[str], cursor: tuple, n: int) -> DataFrame:
    """The next ``n`` rows in key order strictly above ``cursor``."""
    return df.where(inside(key, cursor, None)).orderBy(*[F.col(k).asc_nulls_first() for k in key]).limit(n)


def key_sample(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """The first ``n`` keys in key order."""
    return df.select(*key).orderBy(*[F.col(k).asc_nulls_first() for k in key]).limit(n)


def split_point(df: DataFrame, key: list[str], offset: int) -> DataFrame:
    """The key at an offset of the key order, by ranks."""
    counted = df.groupBy(key_struct(key).alias("k")).agg(F.count("*").alias("n"))
    found = placed(counted, "k", F.col("n")).where((F.col("place") <= offset) & (F.col("place") + F.col("n") > offset))
    return found.select("k.*")
