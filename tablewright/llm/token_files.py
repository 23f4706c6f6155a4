"""Token ids in Arrow files of equal-length sequences.

Documents are range-partitioned and sorted by doc_id; each partition encodes its texts, appends the end
id to each and writes one Arrow IPC file whose batches hold two fixed-size-list columns, ids (uint16 where
the vocabulary allows, else uint32) and mask (false on the padding of a file's last sequence). Every batch
but the last has BATCH_SEQUENCES sequences, so sequence i of a file is found by division and read through
a memory map without a copy. An index table (file, doc_id, first id in the file, number of ids) lies
beside the files; a document's place in the whole corpus is the file's base plus its place in the file.

A file is written under an attempt's name and then renamed, so a retried or doubled task leaves one whole
file. Files lie in the shared folder and are opened by its URI, local or remote.

Defined cases: a null or empty text has the end id alone; a null doc_id comes first; rows that share a
doc_id are in order of their text's hash; an empty table writes no ids; other columns are not stored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_values, fresh_path, settle
from .tokens import encoder, tokenizer_path

SEQUENCE, BATCH_SEQUENCES = 1024, 256
INDEX = "file int, doc_id long, at long, n_tokens long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FileWriter:
    """Fills fixed-size-list batches from documents of any length."""

    def __init__(self, sink, dtype, sequence: int) -> None:
        self.dtype, self.sequence = dtype, sequence
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.written = 0

    def add(self, ids: np.ndarray) -> int:
        """Appends a document; its first id's place in the file."""
        at = self.written + self.held
        self.waiting.append(ids.astype(self.dtype))
        self.held += len(ids)
        if self.held >= self.sequence * BATCH_SEQUENCES:
            self._flush(self.sequence * BATCH_SEQUENCES)
        return at

    def _flush(self, unit: int, pad: bool = False) -> None:
        flat = np.concatenate([*self.waiting, np.zeros(0, self.dtype)])
        whole = len(flat) if pad else len(flat) // unit * unit
        for a in range(0, whole, self.sequence * BATCH_SEQUENCES):
            self._batch(flat[a : min(whole, a + self.sequence * BATCH_SEQUENCES)])
        self.waiting, self.held, self.written = [flat[whole:]], len(flat) - whole, self.written + whole

    def _batch(self, ids: np.ndarray) -> None:
        short = -len(ids) % self.sequence
        mask = np.concatenate([np.ones(len(ids), bool), np.zeros(short, bool)])
        ids = np.concatenate([ids, np.zeros(short, self.dtype)])
        fixed = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence)
        self.writer.write_batch(pa.record_batch([fixed(ids), fixed(mask)], schema=self.schema))

    def close(self) -> None:
        self._flush(self.sequence, pad=True)
        self.writer.close()


class FileReader:
    """Ids by place, through a memory map where the file is local."""

    def __init__(self, uri: str) -> None:
        filesystem, path = _filesystem(uri)
        source = pa.memory_map(path) if filesystem.type_name == "local" else filesystem.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.sequence = self.reader.schema.field("ids").type.list_size
        self.at, self.batch = -1, None

    def _flat(self, k: int) -> np.ndarray:
        if k != self.at:
            column = self.reader.get_batch(k).column("ids")
            self.at, self.batch = k, column.flatten().to_numpy(zero_copy_only=True)
        return self.batch

    def ids(self, at: int, n: int) -> np.ndarray:
        size, out = self.sequence * BATCH_SEQUENCES, []
        while n > 0:
            k, inside = divmod(at, size)
            out.append(self._flat(k)[inside : inside + n])
            at, n = at + len(out[-1]), n - len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate([*out, np.zeros(0, np.uint16)])


def write_tokens(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE) -> tuple[str, DataFrame]:
    """Writes ``docs`` (doc_id, text); the folder's URI and the index table."""
    spark = docs.sparkSession
    tokenizer, folder = tokenizer or tokenizer_path(), fresh_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        p, encode = task.partitionId(), encoder(tokenizer)
        dtype = np.uint16 if len(encode.opens) <= 1 << 16 else np.uint32
        filesystem, path = _filesystem(folder)
        filesystem.create_dir(path, recursive=True)
        final, temporary = f"{path}/part-{p:06d}.arrow", f"{path}/.part-{p:06d}-{task.taskAttemptId()}"
        with filesystem.open_output_stream(temporary) as sink:
            out = FileWriter(sink, dtype, sequence)
            for batch in batches:
                at, sizes = [], []
                for ids in encode.documents(column_values(batch, "text")):
                    at.append(out.add(ids))
                    sizes.append(len(ids))
                n = len(at)
                yield pa.record_batch([pa.array([p] * n, pa.int32()), batch.column("doc_id"), pa.array(at, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "doc_id", "at", "n_tokens"])
            out.close()
        filesystem.move(temporary, final)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return folder, settle(ordered.mapInArrow(write, INDEX), "token-index")


def read_tokens(folder: str, index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), each document's ids read back from the files."""
    totals = sorted((r["file"], r["n"]) for r in index.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect())  # a row a file
    files, bases, base = [f for f, _ in totals], [], 0
    for _, n in totals:
        bases.append(base)
        base += n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, reader = None, None
        for batch in batches:
            start, crc = [], []
            for f, at, n in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), batch.column("n_tokens").to_pylist()):
                if f != opened:
                    opened, reader = f, FileReader(f"{folder}/part-{f:06d}.arrow")
                start.append(bases[bisect.bisect_left(files, f)] + at)
                crc.append(zlib.crc32(reader.ids(at, n).astype("<u4").tobytes()))
            yield pa.record_batch([batch.column("doc_id"), pa.array(start, pa.int64()), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return index.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame) -> DataFrame:
    return read_tokens(*write_tokens(docs))
