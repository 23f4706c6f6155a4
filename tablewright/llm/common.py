"""What the operators of this subpackage share: tables, the shared folder, word splitting."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed byte classes used by several contracts: ASCII white space, and A-Z to lower case.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Scripts written without spaces between words (Thai, Lao, Burmese, Khmer, kana, Han); each of
#: their letters counts as a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3021-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_PLAIN_WORD, _UNSPACED = re.compile(r"\w+"), re.compile(f"[{UNSPACED}]")
_WORD = re.compile(rf"[^\W{UNSPACED}]+|(?=\w)[{UNSPACED}]")
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def words_of(text: str | None) -> list[str]:
    """Words in lower case; a letter of a script without spaces is a word."""
    text = (text or "").lower()
    plain = text.isascii() or not _UNSPACED.search(text)
    return (_PLAIN_WORD if plain else _WORD).findall(text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxed(docs: DataFrame, *columns: str) -> DataFrame:
    """Whole rows as one struct, ``row``, beside the columns named: own columns then clash with none of the rows'."""
    return docs.select(F.struct("*").alias("row"), *[docs[c] for c in columns])


_TOOLS: dict[str, object] = {}


def worker_tool(name: str, make: Callable[[], object]) -> object:
    """The large tool (a model, an index, a memo) that a worker process holds. There is one at a time: workers live
    on from stage to stage, and the next stage's tool takes the place of the last one's."""
    if name not in _TOOLS:
        _TOOLS.clear()
        pa.default_memory_pool().release_unused()
        _TOOLS[name] = make()
    return _TOOLS[name]


def added(docs: DataFrame, columns: str, start: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]) -> DataFrame:
    """``docs`` with more ``columns`` (a DDL string), which replace those of the same names. ``start`` is called
    once a task; what it returns makes the columns of a batch of whole rows."""
    new = T.StructType.fromDDL(columns)
    rows = docs.drop(*new.names).select(F.struct("*").alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            row = batch.column("row")
            yield pa.record_batch([row, *compute(pa.RecordBatch.from_struct_array(row))], names=["row", *new.names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *new.fields])).select("row.*", *new.names)


def filtered(docs: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows of ``docs`` for which what ``start`` returns, called with a batch of whole rows, says true."""
    rows = boxed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = start()
        for batch in batches:
            yield batch.filter(pa.array(keep(pa.RecordBatch.from_struct_array(batch.column("row"))), pa.bool_()))

    return rows.mapInArrow(run, rows.schema).select("row.*")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. A session on one machine
    that has none gets a temporary one; on a cluster a missing one is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tablewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/tablewright/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # noqa: BLE001  the session may be gone by now
        pass


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor
    costs a reread instead of a recomputation. The job's shuffle files go as soon as it is done."""
    spark = df.sparkSession
    path, before = fresh_path(spark, label), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete settled tables that nothing reads any more."""
    for table in tables:
        if table is not None and hasattr(table, "settled_at"):
            _remove(table.sparkSession, table.settled_at)


def column_values(batch: pa.RecordBatch, name: str, some: int = 256) -> Iterator:
    """A column's values as Python objects, a few rows of them at a time."""
    column = batch.column(name)
    for at in range(0, len(column), some):
        yield from column.slice(at, some).to_pylist()


def grouped(batch: pa.RecordBatch, name: str, chars: int) -> Iterator[list[str]]:
    """A column's texts (null: empty) in lists that close once they hold more than ``chars`` characters."""
    group, held = [], 0
    for text in column_values(batch, name, 64):
        group.append(text or "")
        held += len(group[-1])
        if held > chars:
            yield group
            group, held = [], 0
    yield group
