"""Sides: directories of Parquet tables with sidecars, and versioned tables that are replaced at once.

A plain table is ``<root>/<name>.parquet`` (a file or a folder) with an optional sidecar
``<root>/<name>.schema.json``. A versioned table is ``<root>/<name>/v=<n>``, which holds its own schema, with a
pointer file ``<root>/<name>/_current``; writing makes a new version and then swaps the pointer, so readers see
the old table and schema or the new ones and never a part. A version may keep files of earlier ones, which it
lists in ``_files.json``, so that a change of few rows writes only the files that hold them anew. A side with a
snapshot keeps the version of each table that it met first. All file access goes through Hadoop's file systems, so a side may
lie in any store that Spark reads.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schema import Index, TableSchema, introspect, select_key


class Files:
    """Small files and listings, through Hadoop."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.jvm = spark._jvm

    def _at(self, path: str):
        place = self.jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def exists(self, path: str) -> bool:
        fs, place = self._at(path)
        return fs.exists(place)

    def names(self, path: str) -> list[str]:
        fs, place = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def read(self, path: str) -> str:
        fs, place = self._at(path)
        stream = fs.open(place)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Through a second name, so that a reader never meets half a file."""
        fs, place = self._at(path)
        other = self.jvm.org.apache.hadoop.fs.Path(path + ".new")
        stream = fs.create(other, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        overwrite = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        overwrite[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration()).rename(other, place, overwrite)

    def delete(self, path: str) -> None:
        fs, place = self._at(path)
        fs.delete(place, True)


@dataclass
class Side:
    """One endpoint, opened for reading; only ``Writer`` changes one."""

    spark: SparkSession
    root: str
    snapshot: bool = False

    def __post_init__(self) -> None:
        self.files = Files(self.spark)
        self.pinned: dict[str, str] = {}
        if self.snapshot:
            for table in self.tables():
                self.path(table)

    def tables(self) -> list[str]:
        out = []
        for name in self.files.names(self.root):
            if name.endswith(".parquet"):
                out.append(name.removesuffix(".parquet"))
            elif self.files.exists(f"{self.root}/{name}/_current"):
                out.append(name)
        return sorted(set(out))

    def has(self, table: str) -> bool:
        return self.files.exists(f"{self.root}/{table}.parquet") or self.files.exists(f"{self.root}/{table}/_current")

    def path(self, table: str) -> str:
        if table in self.pinned:
            return self.pinned[table]
        pointer = f"{self.root}/{table}/_current"
        found = f"{self.root}/{table}/{self.files.read(pointer).strip()}" if self.files.exists(pointer) else f"{self.root}/{table}.parquet"
        if self.snapshot:
            self.pinned[table] = found
        return found

    def parts(self, version: str) -> list[str]:
        """What a version consists of: files kept from earlier ones, and its folder if it has files of its own."""
        listed = f"{version}/_files.json"
        if not self.files.exists(listed):
            return [version]
        kept = json.loads(self.files.read(listed))
        return kept + [version] * any(n.endswith(".parquet") for n in self.files.names(version))

    def read(self, table: str) -> DataFrame:
        """A snapshot: the version that is current now, whatever is written later."""
        return self.spark.read.parquet(*self.parts(self.path(table)))

    def schema(self, table: str) -> TableSchema:
        """The sidecar's schema, else one from the table's types; with its key selected."""
        for path in (f"{self.path(table)}/_schema.json", f"{self.root}/{table}.schema.json"):
            if self.files.exists(path):
                return select_key(TableSchema.from_json(self.files.read(path)))
        return introspect(self.read(table), table)


class Writer:
    """Writes one side; made only once an apply is confirmed."""

    def __init__(self, side: Side, confirmed: bool = False) -> None:
        if not confirmed:
            raise PermissionError("a writer needs a confirmed plan")
        self.side, self.files = side, side.files

    def _next(self, table: str) -> str:
        versions = [int(n.removeprefix("v=")) for n in self.files.names(f"{self.side.root}/{table}") if n.startswith("v=")]
        return f"v={max(versions, default=0) + 1}"

    def put(self, table: str, rows: DataFrame, schema: TableSchema | None = None) -> None:
        """Replaces a table: a new version first, the pointer last."""
        base, version = f"{self.side.root}/{table}", self._next(table)
        rows.write.parquet(f"{base}/{version}")
        if schema is not None:
            self.files.write(f"{base}/{version}/_schema.json", schema.to_json())
        self.files.write(f"{base}/_current", version)

    def change(self, table: str, keys: DataFrame, made: Callable[[DataFrame], DataFrame], schema: TableSchema) -> None:
        """A new version that keeps the files without any row of ``keys`` (its columns) and has the rows of the others
        as ``made`` makes them. Finding the files reads the key columns between the least and the greatest key."""
        spark, current = self.side.spark, self.side.read(table)
        lead = keys.columns[0]
        ends = keys.agg(F.min(lead).alias("lo"), F.max(lead).alias("hi"), F.count_if(F.col(lead).isNull()).alias("nulls")).first()
        near = F.col(lead).between(F.lit(ends["lo"]), F.lit(ends["hi"])) if ends["lo"] is not None else F.lit(False)
        some = current.where(near | F.col(lead).isNull() if ends["nulls"] else near).select(*[F.col(f"`{k}`") for k in keys.columns], F.col("_metadata.file_path").alias("file"))
        named = keys.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys.columns)])
        match = [some[f"`{k}`"].eqNullSafe(named[f"k{i}"]) for i, k in enumerate(keys.columns)]
        touched = {r["file"] for r in some.join(named, match, "left_semi").select("file").distinct().collect()}  # a row a file
        plain = lambda f: re.sub("^file:/+", "file:///", unquote(f))
        whole, gone = set(map(plain, current.inputFiles())), set(map(plain, touched))
        base, version = f"{self.side.root}/{table}", self._next(table)
        rows = spark.read.parquet(*sorted(gone)) if gone else current.limit(0)
        made(rows).write.parquet(f"{base}/{version}")
        self.files.write(f"{base}/{version}/_files.json", json.dumps(sorted(whole - gone)))
        self.files.write(f"{base}/{version}/_schema.json", schema.to_json())
        self.files.write(f"{base}/_current", version)

    def put_schema(self, table: str, schema: TableSchema) -> None:
        """Replaces what is known of a table beside its rows."""
        versioned = self.files.exists(f"{self.side.root}/{table}/_current")
        self.files.write(f"{self.side.path(table)}/_schema.json" if versioned else f"{self.side.root}/{table}.schema.json", schema.to_json())

    def truncate(self, table: str) -> None:
        self.put(table, self.side.read(table).limit(0), self.side.schema(table))

    def drop(self, table: str) -> None:
        self.files.delete(f"{self.side.root}/{table}")
        self.files.delete(f"{self.side.root}/{table}.parquet")
        self.files.delete(f"{self.side.root}/{table}.schema.json")

    def vacuum(self, table: str, keep: int = 2) -> None:
        """Deletes all but the last versions, and of older ones the files that these do not keep."""
        base = f"{self.side.root}/{table}"
        versions = sorted((int(n.removeprefix("v=")), n) for n in self.files.names(base) if n.startswith("v="))
        used = {"/".join(p.split("/")[-2:]) for _, name in versions[-keep:] for p in self.side.parts(f"{base}/{name}")}
        for _, name in versions[:-keep]:
            names = [n for n in self.files.names(f"{base}/{name}") if f"{name}/{n}" in used]
            for n in self.files.names(f"{base}/{name}") if names else []:
                if n not in names:
                    self.files.delete(f"{base}/{name}/{n}")
            if not names:
                self.files.delete(f"{base}/{name}")


def with_indexes(schema: TableSchema, **indexes: tuple[str, ...]) -> TableSchema:
    """A schema with unique indexes by name (PRIMARY for the key) and its key selected."""
    return select_key(replace(schema, indexes=tuple(Index(n, tuple(c)) for n, c in indexes.items())))
