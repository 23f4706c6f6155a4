"""Headline queries of the reconciliation engine: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright import queries as engine
from tablewright.operators import diff
from tablewright.plans import schema as schemas, sync
from tablewright.sources.shared import shared_dir
from tablewright.sources.tables import Side, Writer, with_indexes

HEADLINE = ["diff_counts", "row_diff_keyed", "multiset_diff", "differing_chunks", "table_fingerprint_unordered", "chunk_plan_rank", "changeset_unique_key", "changeset_group_replace", "row_work_of_chunks", "apply_rowlevel_result", "holder_cross_chunk"]


def identical_diff(spark: SparkSession, sf_dir: str) -> int:
    """A full diff of two identical copies of lineitem, keyless: counts, digests, fingerprints. Rows read."""
    src = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    known = schemas.introspect(src, "lineitem")
    result = diff.compare("lineitem", src, src, known, known)
    assert result.status == "OK", result
    return result.src_rows + result.dst_rows


def keyed_diff(spark: SparkSession, sf_dir: str) -> int:
    """A full diff of lineitem and a copy, in chunks of its composite key. Rows read."""
    src = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    known = with_indexes(schemas.introspect(src, "lineitem"), PRIMARY=("l_orderkey", "l_linenumber"))
    result = diff.compare("lineitem", src, src, known, known)
    assert result.status == "OK" and result.keyed, result
    return result.src_rows + result.dst_rows


def _sides(spark: SparkSession, name: str, src: DataFrame, dst: DataFrame, known: schemas.TableSchema) -> tuple[Side, Side]:
    root = f"{shared_dir(spark)}/bench-{uuid.uuid4().hex}"
    sides = Side(spark, f"{root}/src"), Side(spark, f"{root}/dst")
    for side, rows in zip(sides, (src, dst)):
        Writer(side, confirmed=True).put(name, rows, known)
    return sides


def row_level_sync(spark: SparkSession, sf_dir: str) -> tuple[Side, Side, str]:
    """Lineitem by its key, of which the destination lacks half."""
    src = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    known = with_indexes(schemas.introspect(src, "lineitem"), PRIMARY=("l_orderkey", "l_linenumber"))
    return (*_sides(spark, "lineitem", src, src.where("l_orderkey % 2 = 0"), known), "lineitem")


def full_reload(spark: SparkSession, sf_dir: str) -> tuple[Side, Side, str]:
    """Lineitem without a key, of which the destination lacks half."""
    src = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return (*_sides(spark, "lineitem", src, src.where("l_orderkey % 2 = 0"), schemas.introspect(src, "lineitem")), "lineitem")


def synced(src: Side, dst: Side, name: str) -> int:
    """Plan, apply and verify; rows written."""
    done = sync.apply_table(src, Writer(dst, confirmed=True), sync.plan_table(src, dst, name))
    assert done.verified, done
    return done.inserts + done.updates


def run(df: DataFrame) -> None:
    """Computes every row and column without bringing them to the driver."""
    df.agg(F.count("*"), F.bit_xor(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns]))).collect()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times, rates = engine.queries(), {}, {}
    for name, work in (("diff_identical", identical_diff), ("diff_keyed", keyed_diff)):
        work(spark, sf_dir)  # the first run compiles code
        began = time.time()
        rows = work(spark, sf_dir)
        times[name] = round(time.time() - began, 3)
        rates[f"{name}_rows_per_sec"] = round(rows / times[name])
    for name in HEADLINE:
        best = None
        for _ in range(2):
            began = time.time()
            run(queries[name](spark, sf_dir))
            took = time.time() - began
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    for name, made in (("sync_rowlevel", row_level_sync), ("sync_full", full_reload)):
        sides = made(spark, sf_dir)
        began = time.time()
        rows = synced(*sides)
        times[name] = round(time.time() - began, 3)
        rates[f"{name}_rows_per_sec"] = round(rows / times[name])
    print(json.dumps({"metric": "reconciliation_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, **rates, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
