"""Sides in databases, over JDBC.

Reads go through Spark's JDBC source, cut into ranges of an integer key. Rows are changed by set-based statements:
the changes are written to a staging table beside the target, numbered in batches, and each batch is one
transaction of one DELETE, one UPDATE and one INSERT against the staging table. Values travel with their types, so
none is rendered into a statement. A reload fills a staging table first and swaps its rows in by one transaction.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import families as fam
from ..operators import changes as ops
from ..plans import structure
from ..plans.schema import Column, Index, PlanError, TableSchema, select_key
from .shared import fixed

#: Rows a partition of a read, and partitions at most.
ROWS_PER_READ, MOST_READS = 500_000, 1024
STAGE = "tw_stage_"


def raw_type(name: str, size: int | None, digits: int | None) -> str:
    """A column's type from the driver's metadata."""
    plain = name.lower().replace("character varying", "varchar")
    if plain in ("char", "varchar", "binary", "varbinary") and size:
        return f"{plain}({size})"
    return f"{plain}({size},{digits or 0})" if plain in ("decimal", "numeric") else plain


def bound(rows: DataFrame, schema: TableSchema, named: list[tuple[str, str]]) -> DataFrame:
    """``rows`` with values as a database takes them for its columns; ``named`` says which column each is for. Bit
    strings are numbers, unsigned numbers past a signed 64-bit one keep all digits as decimals, texts kept as bytes are
    texts, and all others travel as they are."""

    def value(name: str, of: str) -> SparkColumn:
        family, kind, c = schema.column(of).family, rows.schema[name].dataType, F.col(f"`{name}`")
        if family == fam.BIT and isinstance(kind, T.BinaryType):
            return F.conv(F.hex(c), 16, 10).cast("decimal(20,0)").alias(name)
        if family == fam.UINT and not isinstance(kind, T.IntegralType):
            return c.cast("decimal(20,0)").alias(name)
        return c.cast("string").alias(name) if family in (fam.STR, fam.ENUM, fam.SET, fam.JSON) and isinstance(kind, T.BinaryType) else c

    targets = dict(named)
    return rows.select(*[value(n, targets[n]) if n in targets else F.col(f"`{n}`") for n in rows.columns])


@dataclass
class JdbcSide:
    """One database, opened for reading."""

    spark: SparkSession
    url: str
    options: dict[str, str] = field(default_factory=dict)
    reads: int = MOST_READS

    @property
    def root(self) -> str:
        return self.url

    @contextmanager
    def connection(self) -> Iterator:
        jvm = self.spark._jvm
        if "driver" in self.options:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.options["driver"])
        properties = jvm.java.util.Properties()
        for k, v in self.options.items():
            if k != "driver":
                properties.setProperty(k, v)
        made = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            yield made
        finally:
            made.close()

    def _rows(self, found, *names: str) -> list[tuple]:
        out = []
        while found.next():
            out.append(tuple(found.getObject(n) for n in names))
        found.close()
        return out

    def quoted(self, name: str) -> str:
        with self.connection() as c:
            mark = c.getMetaData().getIdentifierQuoteString().strip() or '"'
        return mark + name.replace(mark, mark * 2) + mark

    def tables(self) -> list[str]:
        with self.connection() as c:
            kinds = self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.String, 1)
            kinds[0] = "TABLE"
            found = self._rows(c.getMetaData().getTables(c.getCatalog(), None, "%", kinds), "TABLE_NAME", "TABLE_TYPE")
        return sorted({n for n, kind in found if kind == "TABLE" and not n.startswith(STAGE)})

    def has(self, table: str) -> bool:
        return table in self.tables()

    def schema(self, table: str) -> TableSchema:
        """Columns, primary key and unique indexes, with the key selected."""
        with self.connection() as c:
            facts = c.getMetaData()
            columns = [
                Column(n, raw_type(kind, size, digits), nullable != 0, default=None if default in (None, "NULL") else str(default).strip("'"), auto_increment=auto == "YES")
                for n, kind, size, digits, nullable, default, auto in self._rows(
                    facts.getColumns(c.getCatalog(), None, table, None), "COLUMN_NAME", "TYPE_NAME", "COLUMN_SIZE", "DECIMAL_DIGITS", "NULLABLE", "COLUMN_DEF", "IS_AUTOINCREMENT"
                )
            ]
            key = sorted((place, n) for n, place in self._rows(facts.getPrimaryKeys(c.getCatalog(), None, table), "COLUMN_NAME", "KEY_SEQ"))
            listed: dict[str, list[tuple]] = {}
            for name, n, place in self._rows(facts.getIndexInfo(c.getCatalog(), None, table, True, False), "INDEX_NAME", "COLUMN_NAME", "ORDINAL_POSITION"):
                if name is not None and n is not None:
                    listed.setdefault(name, []).append((place, n))
        if not columns:
            raise PlanError(f"table {table} not found")
        primary = tuple(n for _, n in key)
        indexes = [Index("PRIMARY", primary)] if primary else []
        indexes += [Index(name, tuple(n for _, n in sorted(x))) for name, x in sorted(listed.items()) if tuple(n for _, n in sorted(x)) != primary]
        return select_key(TableSchema(table, tuple(columns), tuple(indexes), engine="jdbc"))

    def source(self, text: str, **more: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=text, **self.options, **more).load()

    def read(self, table: str) -> DataFrame:
        """The table, in ranges of its key where that is an integer; rows without a key value are in the first."""
        known, name = self.schema(table), self.quoted(table)
        lead = known.column(known.key[0]) if known.key else None
        if lead is None or lead.family != "INT":
            return self.source(name)
        with self.connection() as c:
            column = self.quoted(lead.name)
            found = c.createStatement().executeQuery(f"SELECT min({column}) AS lo, max({column}) AS hi, count(*) AS n FROM {name}")
            found.next()
            lo, hi, n = (found.getObject(i) for i in (1, 2, 3))
        parts = min(self.reads, -(-n // ROWS_PER_READ))
        if parts < 2 or lo is None:
            return self.source(name)
        return self.source(name, partitionColumn=lead.name, lowerBound=str(lo), upperBound=str(hi + 1), numPartitions=str(parts))


class JdbcWriter:
    """Writes one database; made only once an apply is confirmed."""

    def __init__(self, side: JdbcSide, confirmed: bool = False) -> None:
        if not confirmed:
            raise PermissionError("a writer needs a confirmed plan")
        self.side = side

    def run(self, *statements: str) -> None:
        """All statements in one transaction; a failed one undoes the others and is not tried again."""
        with self.side.connection() as c:
            c.setAutoCommit(False)
            try:
                for s in statements:
                    made = c.createStatement()
                    made.executeUpdate(s)
                    made.close()
                c.commit()
            except Exception:
                c.rollback()
                raise

    def _append(self, rows: DataFrame, table: str) -> None:
        rows.write.format("jdbc").options(url=self.side.url, dbtable=table, **self.side.options).mode("append").save()

    @contextmanager
    def _staged(self, rows: DataFrame) -> Iterator[str]:
        stage = self.side.quoted(STAGE + uuid.uuid4().hex[:12])
        self._append(rows, stage)
        try:
            yield stage
        finally:
            self.run(f"DROP TABLE {stage}")

    def _value(self, stage: str, column: str, schema: TableSchema, name: str) -> str:
        """A staged value as one of the column ``name``; texts are staged as long ones, which not every database
        compares with short ones."""
        kind, value = schema.column(name).raw_type, f"{stage}.{self.side.quoted(column)}"
        short = kind.startswith(("char(", "varchar(")) and not self.side.url.startswith("jdbc:mysql")
        return f"CAST({value} AS {kind.upper()})" if short else value

    def put(self, table: str, rows: DataFrame, schema: TableSchema | None = None) -> None:
        """A new table, or all rows of one replaced by one transaction."""
        name = self.side.quoted(table)
        if not self.side.has(table):
            if self.side.url.startswith("jdbc:mysql") and schema:
                self.run(structure.render_create(replace(schema, engine="InnoDB" if schema.engine in ("parquet", "jdbc") else schema.engine)))
            self._append(rows, name)
            return
        known = self.side.schema(table)
        written = [c.name for c in known.columns if not c.generated and c.name in rows.columns]
        listed = ", ".join(map(self.side.quoted, written))
        own = [f"c{i}" for i in range(len(written))]
        plain = rows.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(written, own)])
        with self._staged(bound(plain, known, list(zip(own, written)))) as stage:
            held = ", ".join(self._value("s", c, known, n) for c, n in zip(own, written))
            self.run(f"DELETE FROM {name}", f"INSERT INTO {name} ({listed}) SELECT {held} FROM {stage} s")

    def put_schema(self, table: str, schema: TableSchema) -> None:
        if schema.auto_increment_counter:
            self.run(f"ALTER TABLE {self.side.quoted(table)} AUTO_INCREMENT = {schema.auto_increment_counter}")

    def alter(self, statements: list[str]) -> None:
        for s in statements:
            self.run(s)

    def drop(self, table: str) -> None:
        self.run(f"DROP TABLE {self.side.quoted(table)}")

    def apply_changes(self, table: str, changes: DataFrame, key: list[str], batch: int, rewrite: bool = False) -> int:
        """Applies ``changes`` in batches, deletes before the rest, and returns the number of batches. Where unique
        values change places, updates are deletes and inserts."""
        if rewrite:
            changes = ops.as_rewrites(changes)
        known, q = self.side.schema(table), self.side.quoted
        generated = {c.name for c in known.columns if c.generated}
        names = [f.name for f in changes.schema["row"].dataType.fields if f.name not in generated]
        at, own = [f"k{i}" for i in range(len(key))], [f"c{i}" for i in range(len(names))]
        code = F.when(F.col("op") == ops.DELETE, 0).when(F.col("op") == ops.UPDATE, 1).otherwise(2)
        flat = changes.select(
            code.alias("op"), "phase", *[F.col(f"address.`{k}`").alias(a) for k, a in zip(key, at)], *[F.col(f"row.`{n}`").alias(c) for n, c in zip(names, own)], F.monotonically_increasing_id().alias("id")
        )
        lead = [F.coalesce(a, own[names.index(k)]) if k in names else F.col(a) for k, a in zip(key, at)]
        placed = ops.batched(fixed(flat.withColumn("o", F.struct("phase", *lead, "id"))), "o", batch).drop("o", "phase", "id")
        rows = fixed(placed)
        most = rows.agg(F.max("batch").alias("n")).first()["n"]
        if most is None:
            return 0
        name, n = q(table), int(most) + 1
        with self._staged(bound(rows, known, [*zip(at, key), *zip(own, names)])) as stage:
            same = " AND ".join(f"({name}.{q(k)} = {self._value('s', a, known, k)} OR {name}.{q(k)} IS NULL AND s.{q(a)} IS NULL)" for k, a in zip(key, at))
            for b in range(n):
                of = lambda op: f"FROM {stage} s WHERE s.{q('batch')} = {b} AND s.{q('op')} = {op}"  # noqa: B023, E731
                sets = ", ".join(f"{q(x)} = (SELECT {self._value('s', c, known, x)} {of(1)} AND {same})" for x, c in zip(names, own) if x not in key)
                statements = [f"DELETE FROM {name} WHERE EXISTS (SELECT 1 {of(0)} AND {same})"]
                if sets:
                    statements.append(f"UPDATE {name} SET {sets} WHERE EXISTS (SELECT 1 {of(1)} AND {same})")
                columns, values = ", ".join(map(q, names)), ", ".join(self._value("s", c, known, x) for c, x in zip(own, names))
                statements.append(f"INSERT INTO {name} ({columns}) SELECT {values} {of(2)}")
                self.run(*statements)
        return n
