import io
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tablewright import cli
from tablewright.operators import diff
from tablewright.operators.chunking import IntegerPlan
from tablewright.plans import decide, report, schema as schemas, sync
from tablewright.sources.tables import Side, Writer, with_indexes
from tablewright.streaming import incremental


@pytest.fixture
def sides(spark, tmp_path):
    src, dst = Side(spark, f"file://{tmp_path}/src"), Side(spark, f"file://{tmp_path}/dst")
    rows = spark.createDataFrame([(i, f"v{i}", f"u{i}") for i in range(60)], "id long, v string, u string")
    s = schemas.introspect(rows, "t")
    s = with_indexes(replace(s, columns=tuple(replace(c, nullable=c.name != "id") for c in s.columns)), PRIMARY=("id",), by_u=("u",))
    a, b = Writer(src, True), Writer(dst, True)
    a.put("t", rows, s)
    drifted = rows.where("id <> 3").withColumn("v", F.when(F.col("id") == 5, "other").otherwise(F.col("v"))).unionByName(spark.createDataFrame([(900, "x", "ux")], "id long, v string, u string"))
    b.put("t", drifted, s)
    a.put("only_src", rows.limit(4), replace(s, table="only_src"))
    b.put("only_dst", rows.limit(4), replace(s, table="only_dst"))
    return src, dst


def test_writers_need_confirmation(sides):
    with pytest.raises(PermissionError):
        Writer(sides[1])


def test_plan_apply_verify(sides):
    src, dst = sides
    before = dst.path("t")
    plans = {p.name: p for p in sync.plan_sync(src, dst)}
    assert dst.path("t") == before  # a dry run writes nothing
    assert (plans["t"].mode, plans["t"].inserts, plans["t"].updates, plans["t"].deletes) == ("ROWLEVEL", 1, 1, 1)
    assert plans["only_src"].mode == "CREATE" and plans["only_dst"].mode == "DROP"
    assert len(report.sample_sql(plans["t"])) == 3 and "ROWLEVEL" in report.sync_text(list(plans.values()))
    done = sync.apply_sync(src, dst, list(plans.values()))
    assert all(p.status == "APPLIED" and p.verified for p in done)
    assert dst.tables() == ["only_src", "t"]
    assert all(p.mode == "SKIP" for p in sync.plan_sync(src, dst))  # a second run has nothing to do
    assert json.loads(report.sync_json(done, True))["ok"]


def test_apply_refuses_what_was_not_confirmed(sides, spark):
    src, dst = sides
    plan = sync.plan_table(src, dst, "t")
    Writer(src, True).put("t", src.read("t").limit(0), src.schema("t"))
    after = sync.apply_table(src, Writer(dst, True), plan)
    assert after.status == "FAILED" and "not confirmed" in after.error and dst.read("t").count() == 60


def test_swaps_need_permission(sides, spark):
    src, dst = sides
    swapped = dst.read("t").withColumn("u", F.when(F.col("id") == 10, "u11").when(F.col("id") == 11, "u10").otherwise(F.col("u")))
    Writer(dst, True).put("t", swapped, dst.schema("t"))
    assert sync.plan_table(src, dst, "t").status == "FAILED"
    options = sync.SyncOptions(allow_row_rewrite=True)
    plan = sync.plan_table(src, dst, "t", options)
    assert plan.status == "PLANNED" and plan.scope.rewrites
    assert sync.apply_table(src, Writer(dst, True), plan, options).status == "APPLIED"


def test_structure_is_aligned_first(sides, spark):
    src, dst = sides
    smaller = dst.read("t").drop("v").withColumn("extra", F.lit(1))
    Writer(dst, True).put("t", smaller, with_indexes(schemas.introspect(smaller, "t"), PRIMARY=("id",)))
    plan = sync.plan_table(src, dst, "t")
    assert plan.schema_sql and plan.scope.ddl
    assert sync.plan_table(src, dst, "t", sync.SyncOptions(spec=diff.Spec(where="id > 1"))).argument
    done = sync.apply_table(src, Writer(dst, True), plan)
    assert done.status == "APPLIED" and dst.read("t").columns == ["id", "v", "u"]


def test_keyless_tables_are_reloaded(sides, spark):
    src, dst = sides
    plain = lambda df: schemas.introspect(df, "k")
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "v string")
    Writer(src, True).put("k", rows, plain(rows))
    Writer(dst, True).put("k", rows.limit(2), plain(rows))
    plan = sync.plan_table(src, dst, "k")
    assert plan.mode == decide.FULL
    assert sync.plan_table(src, dst, "k", sync.SyncOptions(spec=diff.Spec(where="v >= 'a'"))).argument
    assert sync.apply_table(src, Writer(dst, True), plan).status == "APPLIED"
    writer = Writer(dst, True)
    writer.vacuum("k", keep=1)
    assert dst.read("k").count() == 3
    writer.truncate("k")
    assert dst.read("k").count() == 0


def test_command_line(sides, spark):
    src, dst = sides

    def run(*arguments, answer="n"):
        out = io.StringIO()
        return cli.main([*arguments, "--src", src.root, "--dst", dst.root], spark, lambda _: answer, out), out.getvalue()

    assert run("tables") == (0, "t\n")
    assert run("diff")[0] == 1
    code, text = run("diff", "--json", "--drill", "--tables", "t")
    assert code == 1 and len(json.loads(text)["tables"][0]["rows"]) == 3
    assert run("diff", "--chunk-size", "5")[0] == 3
    assert run("sync")[0] == 1
    assert run("sync", "--apply")[0] == 2  # the answer was no
    assert run("sync", "--apply", "--yes", "--tables", "t")[0] == 0
    assert run("diff", "--tables", "t")[0] == 0
    assert cli.main(["version"], out=io.StringIO()) == 0


def test_stream_of_changes(spark, tmp_path):
    src = spark.createDataFrame([(i, f"v{i}") for i in range(100)], "id long, v string")
    dst = src.withColumn("v", F.when(F.col("id") == 42, "x").otherwise(F.col("v")))
    s = with_indexes(schemas.introspect(src), PRIMARY=("id",))
    plan = IntegerPlan("id", 0, 99, 10)
    spark.createDataFrame([(42, "v42"), (7, "v7")], "id long, v string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    seen = []
    incremental.watch(stream, lambda: (src, dst), s, s, plan, lambda df, _: seen.extend(df.collect()), f"{tmp_path}/checkpoint").processAllAvailable()
    assert sorted((r["chunk_id"], r["same"]) for r in seen) == [(0, True), (4, False)]


def counted(spark, tmp_path, ids, counters, keyed=True):
    """Two sides of a table with an auto-increment column; the destination holds ``ids``."""
    src, dst = Side(spark, f"file://{tmp_path}/src"), Side(spark, f"file://{tmp_path}/dst")
    for side, some, counter in ((src, range(20), counters[0]), (dst, ids, counters[1])):
        rows = spark.createDataFrame([(i, f"v{i}") for i in some], "id long, v string")
        s = schemas.introspect(rows, "t")
        s = replace(s, columns=tuple(replace(c, nullable=c.name != "id", auto_increment=c.name == "id") for c in s.columns), auto_increment_counter=counter)
        Writer(side, True).put("t", rows, with_indexes(s, PRIMARY=("id",)) if keyed else s)
    return src, dst


@pytest.mark.parametrize(("keyed", "mode"), [(True, "ROWLEVEL"), (False, "FULL")])
def test_counters_are_raised_with_rows(spark, tmp_path, keyed, mode):
    src, dst = counted(spark, tmp_path, range(5), (100, 7), keyed)
    plan = sync.plan_table(src, dst, "t")
    assert (plan.mode, plan.status, plan.state_sql) == (mode, "PLANNED", ["ALTER TABLE `t` AUTO_INCREMENT = 100"])
    done = sync.apply_table(src, Writer(dst, True), plan)
    assert (done.status, done.verified, len(done.state_sql)) == ("APPLIED", True, 1)
    assert dst.schema("t").auto_increment_counter == 100 and sync.plan_table(src, dst, "t").mode == "SKIP"


def test_counters_ahead_are_reported(spark, tmp_path):
    src, dst = counted(spark, tmp_path, range(20), (100, 200))
    plan = sync.plan_table(src, dst, "t")
    assert (plan.mode, plan.status, plan.state_sql) == ("STATE", "PLANNED", []) and "200" in plan.state_note
    assert cli.main(["sync", "--src", src.root, "--dst", dst.root], spark, lambda _: "n", io.StringIO()) == 1
    before = dst.path("t")
    done = sync.apply_table(src, Writer(dst, True), plan)
    assert done.status == "SKIPPED" and done.state_note and dst.path("t") == before and dst.schema("t").auto_increment_counter == 200


def test_counters_alone_are_raised(spark, tmp_path):
    src, dst = counted(spark, tmp_path, range(20), (100, None))
    plan = sync.plan_table(src, dst, "t")
    assert plan.mode == "STATE" and sync.apply_table(src, Writer(dst, True), plan).status == "APPLIED"
    assert dst.schema("t").auto_increment_counter == 100
    assert sync.plan_table(src, dst, "t", sync.SyncOptions(spec=diff.Spec(where="id > 3"))).mode == "SKIP"


def test_a_snapshot_keeps_its_versions(sides, spark):
    src, dst = sides
    held = Side(spark, src.root, snapshot=True)
    before = held.read("t").count()
    Writer(src, True).put("t", src.read("t").limit(1), replace(src.schema("t"), default_collation="other"))
    assert held.read("t").count() == before and held.schema("t").default_collation == ""
    assert src.read("t").count() == 1 and src.schema("t").default_collation == "other"


def test_tables_in_parallel(sides):
    src, dst = sides
    one, many = (sync.compare_sides(src, dst, parallel=n) for n in (1, 4))
    assert [(r.name, r.status) for r in one] == [(r.name, r.status) for r in many]
    assert [(p.name, p.mode) for p in sync.plan_sync(src, dst, options=sync.SyncOptions(parallel=4))] == [(p.name, p.mode) for p in sync.plan_sync(src, dst)]


def test_reports_have_bounds_digests_and_limits(sides):
    src, dst = sides
    spec = diff.Spec(drill=True, drill_limit=2, chunk_size=10)
    result = diff.compare("t", src.read("t"), dst.read("t"), src.schema("t"), dst.schema("t"), spec)
    table = json.loads(report.diff_json([result]))["tables"][0]
    assert table["truncated"] and len(table["rows"]) == 2 and any("more rows" in w for w in table["warnings"])
    first = table["diff_chunks"][0]
    assert (first["lo"], first["hi"]) == ("0", "9") and first["src"] != first["dst"] and len(first["src"].split(":")) == 4
    assert table["diff_chunk_count"] == len(table["diff_chunks"]) and "[0, 9]" in report.diff_text([result])


def test_a_reload_leaves_ignored_columns_at_their_default(spark, tmp_path):
    src, dst = Side(spark, f"file://{tmp_path}/src"), Side(spark, f"file://{tmp_path}/dst")
    for side, seen in ((src, "theirs"), (dst, "own")):
        rows = spark.createDataFrame([(i, seen) for i in range(3 if side is src else 2)], "id long, seen string")
        s = schemas.introspect(rows, "t")
        Writer(side, True).put("t", rows, replace(s, columns=tuple(replace(c, default="none") if c.name == "seen" else c for c in s.columns)))
    options = sync.SyncOptions(spec=diff.Spec(ignore=("seen",)))
    done = sync.apply_sync(src, dst, sync.plan_sync(src, dst, options=options), options)[0]
    assert (done.mode, done.status) == ("FULL", "APPLIED") and {r["seen"] for r in dst.read("t").collect()} == {"none"}


def test_a_change_keeps_the_files_it_does_not_touch(spark, tmp_path):
    src, dst = Side(spark, f"file://{tmp_path}/a b/src"), Side(spark, f"file://{tmp_path}/a b/dst")
    rows = spark.range(1000).select(F.col("id"), F.lit("x").alias("v"), F.lit("own").alias("seen"))
    s = with_indexes(schemas.introspect(rows, "t"), PRIMARY=("id",))
    for side in (src, dst):
        Writer(side, True).put("t", rows.repartitionByRange(10, "id"), s)
    Writer(src, True).put("t", rows.where("id <> 7").withColumn("v", F.when(F.col("id") == 12, "y").otherwise(F.col("v"))).withColumn("seen", F.lit("theirs")).unionByName(spark.createDataFrame([(5000, "new", "theirs")], "id long, v string, seen string")), s)
    options = sync.SyncOptions(spec=diff.Spec(ignore=("seen",), chunk_size=50))
    before = set(dst.read("t").inputFiles())
    done = sync.apply_sync(src, dst, sync.plan_sync(src, dst, options=options), options)[0]
    assert (done.mode, done.verified, done.inserts, done.updates, done.deletes) == ("ROWLEVEL", True, 1, 1, 1)
    after = set(dst.read("t").inputFiles())
    assert len(before & after) == 9 and dst.read("t").count() == 1000
    found = {r["id"]: (r["v"], r["seen"]) for r in dst.read("t").collect()}
    assert 7 not in found and found[12] == ("y", "own") and found[5000] == ("new", None) and found[999] == ("x", "own")
    Writer(dst, True).vacuum("t", keep=1)
    assert {r["id"]: (r["v"], r["seen"]) for r in dst.read("t").collect()} == found
    assert len([f for f in dst.files.names(f"{dst.root}/t/v=1") if f.endswith(".parquet")]) == 9
    assert sync.plan_sync(src, dst, options=options)[0].mode == "SKIP"


def test_confirmation_says_what_cannot_be_undone(sides):
    src, dst = sides
    plans = sync.plan_sync(src, dst)
    text = report.confirm_text(plans, allow_structure_truncate=True)
    assert "3 of 3 tables would be changed; 0 failed" in text and "DROP TABLE `only_dst`" in text.split("DESTRUCTIVE")[1]
    assert "changed row by row: t" in text and "created: only_src" in text and "may be truncated" in text
    plans[0].scope = decide.Scope(rewrites=frozenset({"x", "y"}), deletes_source_empty=True)
    assert "(2 groups)" in report.confirm_text(plans) and "source is empty" in report.confirm_text(plans)
