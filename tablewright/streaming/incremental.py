"""Keeping a comparison current while rows arrive.

Each micro-batch of changed rows names the chunks it touches; only those chunks of both sides are digested
again, and the digests of the batch's chunks replace the ones before. Chunks come from a fixed plan, so
work follows the batch and not the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.canonical import Options
from ..operators import digest
from ..operators.chunking import IntegerPlan
from ..operators.diff import hashed
from ..plans.schema import TableSchema


def touched(batch: DataFrame, plan: IntegerPlan) -> DataFrame:
    return batch.select(plan.chunk_id().alias("chunk_id")).distinct()


def recompare(batch: DataFrame, src: DataFrame, dst: DataFrame, a: TableSchema, b: TableSchema, plan: IntegerPlan, options: Options = Options()) -> DataFrame:
    """(chunk_id, src_n, dst_n, same) of the chunks that the batch touches."""
    chunks = touched(batch, plan)
    digests = []
    for df, schema in ((src, a), (dst, b)):
        some = df.withColumn("chunk_id", plan.chunk_id()).join(chunks, "chunk_id", "left_semi")
        digests.append(digest.chunk_digests(hashed(some, schema, options)))
    different = digest.differing(*digests)
    return chunks.join(different, "chunk_id", "left").select("chunk_id", "src_n", "dst_n", F.col("src_n").isNull().alias("same"))


def watch(stream: DataFrame, sides: Callable[[], tuple[DataFrame, DataFrame]], a: TableSchema, b: TableSchema, plan: IntegerPlan, sink: Callable[[DataFrame, int], None], checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Runs ``recompare`` on every micro-batch of changed source rows; ``sink`` gets the result."""

    def each(batch: DataFrame, number: int) -> None:
        src, dst = sides()
        sink(recompare(batch, src, dst, a, b, plan, options), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
