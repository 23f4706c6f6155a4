import io
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablewright import cli
from tablewright.operators import diff
from tablewright.plans import config as configs, decide, sync
from tablewright.plans.schema import PlanError
from tablewright.sources.jdbc import JdbcSide, JdbcWriter, raw_type


@pytest.fixture
def sides(spark):
    """Two databases in memory, with a drifted table each."""
    made = [JdbcSide(spark, f"jdbc:derby:memory:{name}{uuid.uuid4().hex};create=true") for name in ("src", "dst")]
    create = 'CREATE TABLE "t" ("id" BIGINT NOT NULL PRIMARY KEY, "v" VARCHAR(40), "u" VARCHAR(20) NOT NULL UNIQUE, "x" DECIMAL(10,2), "at" TIMESTAMP)'
    for side, drift in zip(made, (False, True)):
        rows = [(i, "NULL" if i == 4 else f"'it''s {i}'" if not (drift and i == 5) else "'other'", f"'u{i}'", f"{i}.50", f"'2024-01-01 00:00:{i % 60:02d}.5'") for i in range(50) if not (drift and i in (3, 30))]
        if drift:
            rows.append((900, "'x'", "'ux'", "1", "NULL"))
        values = ", ".join(f"({a}, {b}, {c}, {d}, {e if e == 'NULL' else f'TIMESTAMP({e})'})" for a, b, c, d, e in rows)
        JdbcWriter(side, True).run(create, f'INSERT INTO "t" VALUES {values}')
    return made


def test_introspection(sides):
    known = sides[0].schema("t")
    assert known.names == ["id", "v", "u", "x", "at"] and known.key == ("id",) and known.key_unique and ("u",) in known.constraints
    assert [c.family for c in known.columns] == ["INT", "STR", "STR", "DECIMAL", "TIMESTAMP"] and not known.column("u").nullable
    assert sides[0].tables() == ["t"] and sides[0].has("t") and not sides[0].has("s")
    assert raw_type("VARCHAR", 20, None) == "varchar(20)" and raw_type("DECIMAL", 10, 2) == "decimal(10,2)"
    with pytest.raises(PlanError):
        sides[0].schema("s")


def test_reads_in_ranges(sides, monkeypatch):
    import tablewright.sources.jdbc as jdbc

    monkeypatch.setattr(jdbc, "ROWS_PER_READ", 10)
    rows = sides[0].read("t")
    assert rows.rdd.getNumPartitions() == 5 and rows.count() == 50


@pytest.mark.parametrize("batch", [2, 1000])
def test_row_level_sync(sides, batch):
    src, dst = sides
    options = sync.SyncOptions(batch_size=batch)
    plan = sync.plan_table(src, dst, "t", options)
    assert (plan.mode, plan.inserts, plan.updates, plan.deletes) == (decide.ROWLEVEL, 2, 1, 1)
    done = sync.apply_sync(src, dst, [plan], options)[0]
    assert (done.status, done.verified, done.error) == (decide.APPLIED, True, "") and dst.tables() == ["t"]
    assert sorted(map(tuple, dst.read("t").collect())) == sorted(map(tuple, src.read("t").collect()))
    assert sync.plan_table(src, dst, "t").mode == decide.SKIP


def test_swapped_values_are_rewritten(sides):
    src, dst = sides
    JdbcWriter(dst, True).run('UPDATE "t" SET "u" = \'tmp\' WHERE "id" = 10', 'UPDATE "t" SET "u" = \'u10\' WHERE "id" = 11', 'UPDATE "t" SET "u" = \'u11\' WHERE "id" = 10')
    assert sync.plan_table(src, dst, "t").status == decide.FAILED
    options = sync.SyncOptions(allow_row_rewrite=True)
    assert sync.apply_sync(src, dst, [sync.plan_table(src, dst, "t", options)], options)[0].verified


def test_a_failed_transaction_changes_nothing(sides):
    writer = JdbcWriter(sides[1], True)
    with pytest.raises(Exception):
        writer.run('DELETE FROM "t"', 'INSERT INTO "nowhere" VALUES (1)')
    assert sides[1].read("t").count() == 49
    with pytest.raises(PermissionError):
        JdbcWriter(sides[1])


def test_reload_create_and_drop(sides, spark):
    src, dst = sides
    for side, rows in ((src, "('a'), ('a'), ('b')"), (dst, "('a')")):
        JdbcWriter(side, True).run('CREATE TABLE "k" ("v" VARCHAR(5))', f'INSERT INTO "k" VALUES {rows}')
    JdbcWriter(src, True).run('CREATE TABLE "fresh" ("n" BIGINT, "v" VARCHAR(5))', "INSERT INTO \"fresh\" VALUES (1, 'a'), (2, NULL)")
    JdbcWriter(dst, True).run('CREATE TABLE "gone" ("n" BIGINT)')
    plans = sync.plan_sync(src, dst)
    assert {p.name: p.mode for p in plans} == {"fresh": "CREATE", "gone": "DROP", "k": "FULL", "t": "ROWLEVEL"}
    assert all(p.verified for p in sync.apply_sync(src, dst, plans))
    assert dst.tables() == ["fresh", "k", "t"] and dst.read("k").count() == 3
    assert all(r.status == "OK" for r in sync.compare_sides(src, dst, parallel=2))


def test_a_folder_against_a_database(sides, spark, tmp_path):
    rows = sides[0].read("t").withColumn("v", F.upper("v"))
    rows.write.parquet(f"{tmp_path}/t.parquet")
    out = io.StringIO()
    arguments = ["--src", sides[0].url, "--dst", sides[1].url, "--tables", "t"]
    assert cli.main(["diff", *arguments], spark, out=out) == 1
    assert cli.main(["sync", "--apply", "--yes", *arguments], spark, out=out) == 0
    assert cli.main(["diff", *arguments], spark, out=out) == 0
    assert cli.main(["diff", "--snapshot", *arguments], spark, out=out) == 3
    assert cli.main(["diff", "--src", f"file://{tmp_path}", "--dst", sides[1].url], spark, out=out) in (1, 2)


def test_places(monkeypatch):
    monkeypatch.setenv("PW", "p@ss")
    assert configs.Config(src="/data").place("src") == "/data" and configs.Config(src="hdfs://a/b").place("src") == "hdfs://a/b"
    found = configs.Config(src="me:x@db:3307/shop").place("src")
    assert (found.host, found.port, found.user, found.password, found.url) == ("db", 3307, "me", "x", "jdbc:mysql://db:3307/shop")
    parts = configs.Config(dst_host="h", dst_user="u", dst_db="d", dst_password_env="PW").place("dst")
    assert (parts.port, parts.options()) == (3306, {"user": "u", "password": "p@ss"})
    with pytest.raises(PlanError):
        configs.Config().place("src")


def test_batches_of_changes(sides, spark):
    src, dst = sides
    result = diff.compare("t", src.read("t"), dst.read("t"), src.schema("t"), dst.schema("t"), diff.Spec(chunks_always=True))
    assert result.status == "DIFFERENT" and result.some[0].count() == 50
    plan = sync.plan_table(src, dst, "t")
    assert JdbcWriter(dst, True).apply_changes("t", plan.changes, ["id"], 1) == 4
    assert JdbcWriter(dst, True).apply_changes("t", plan.changes.limit(0), ["id"], 1) == 0


def test_values_as_a_database_takes_them(spark):
    from tablewright.plans.schema import Column, TableSchema
    from tablewright.sources.jdbc import bound

    rows = spark.createDataFrame([(bytearray(b"\x01\x02"), Decimal(2**64 - 1), bytearray("é".encode()), bytearray(b"\xff")), (None, None, None, None)], "c0 binary, c1 decimal(20,0), c2 binary, c3 binary")
    known = TableSchema("t", (Column("b", "bit(16)"), Column("u", "bigint unsigned"), Column("s", "varchar(9)"), Column("raw", "varbinary(9)")))
    made = bound(rows, known, [("c0", "b"), ("c1", "u"), ("c2", "s"), ("c3", "raw")])
    assert made.dtypes == [("c0", "decimal(20,0)"), ("c1", "decimal(20,0)"), ("c2", "string"), ("c3", "binary")]
    assert [tuple(r) for r in made.collect()] == [(258, 2**64 - 1, "é", bytearray(b"\xff")), (None,) * 4]
