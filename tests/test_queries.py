import ast
import os
import subprocess
import sys

import duckdb
import pytest

from tablewright import queries as engine

SF = "/root/testdata/sf0.001"
QUERIES, SQL = engine.queries(), engine.oracle_sql()


def plain(rows):
    def value(v):
        return "N" if v is None else repr(float(v)) if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.fixture(scope="module")
def connection():
    made = duckdb.connect()
    for name in os.listdir(SF):
        made.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return made


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(columns).collect()]
    if name in SQL:
        other = connection.sql(SQL[name])
        assert sorted(other.columns) == columns
        assert plain(rows) == plain(other.select(*[f'"{c}"' for c in columns]).fetchall())
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["chunk_id", "src_n", "dst_n", "src_digest", "dst_digest"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


FIRST = """
import sys
from pyspark.sql import SparkSession
from tablewright.operators import chunking
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
src = spark.read.parquet(sys.argv[1])
placed = chunking.ranked_chunk_id(src, ["c_name"], chunking.plan_ranked(src, ["c_name"], 200))
print(sorted(tuple(r) for r in placed.groupBy("chunk_id").count().collect()))
"""


def customers(folder, name):
    """Writes 1,500 customers; the rows that the SQL of chunk_rows_ranked has of them."""
    path = f"{folder}/customer.parquet"
    duckdb.sql(f"COPY (SELECT i AS c_custkey, {name} AS c_name FROM range(1500) t(i)) TO '{path}'")
    made = duckdb.connect()
    made.sql(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{path}')")
    return sorted(made.sql(SQL["chunk_rows_ranked"]).fetchall())


def test_ranked_chunks_as_the_first_query_of_a_session(tmp_path):
    """Columns have the ids from 0 then, as the variables of lambdas have them."""
    wanted = customers(tmp_path, "'Customer#' || lpad(CAST(i AS VARCHAR), 9, '0')")
    run = subprocess.run([sys.executable, "-c", FIRST, f"{tmp_path}/customer.parquet"], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert run.returncode == 0, run.stderr[-2000:]
    assert ast.literal_eval(run.stdout.splitlines()[-1]) == wanted


@pytest.mark.parametrize("name", ["'Customer#' || i % 100", "CASE WHEN i % 3 = 0 THEN 'Customer#' || i % 7 END", "CAST(NULL AS VARCHAR)"])
def test_ranked_chunks_of_repeated_and_missing_names(spark, tmp_path, name):
    wanted = customers(tmp_path, name)
    assert len(wanted) == 8
    assert sorted(tuple(r) for r in QUERIES["chunk_rows_ranked"](spark, str(tmp_path)).collect()) == wanted
