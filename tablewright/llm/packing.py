"""Best-fit packing of tokenised documents into sequences of at most SEQUENCE tokens.

Pieces of more than half a sequence open one each, as no two of them share one; what is left in it is a gap.
Then bulk-synchronous rounds match waiting pieces with gaps. A round sorts pieces and gaps together, by size
from the largest, over range partitions, and sweeps every partition at once: a gap is put on a stack and a
piece takes the gap on top, its successor among the gaps that are left, so pieces that want the same gap are
served in order of their ranks. What a partition could not match meets the others' by counts: the driver adds up
two numbers a partition and says which stretch of one partition's open pieces meets which stretch of another's
open gaps, and a join on the match's number does the rest. All gaps are updated at once and the next round
begins. When nothing fits, the largest waiting pieces open as many sequences as the waiting tokens need at
least. Gaps smaller than every waiting piece are closed. Once at most LAST rows are left, one task plays all
further rounds by itself.

Defined cases: a null or empty text is the end id alone; rows that share a doc_id are packed as separate
documents, as are rows without one; an empty table gives no pieces; other columns are not carried along.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_values, discard, settle
from .tokens import encoder, tokenizer_path

SEQUENCE = 1024
LAST = 1 << 16
GAP, PIECE = 0, 1
PLACED = "id long, sequence_id long, offset long"
SWEPT = "part int, kind int, size int, id long, place long, gap int, gap_id long"


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first takes what is left over."""
    first = n % most or most
    return [(0, first)] + [(s, most) for s in range(first, n, most)]


def pieces(docs: DataFrame, tokenizer: str | None = None, most: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """One row a piece: id (of the piece), doc_id, piece, start, length, ids_crc32, and the token ids if asked for.
    Piece ids follow partitions, so write the pieces before the ids are used twice."""
    tokenizer = tokenizer or tokenizer_path()
    names = ["id", "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, own = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            owner, rows = [], []
            for d, ids in enumerate(tool.documents(column_values(batch, "text"))):
                raw = ids.astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), most)):
                    some = raw[start : start + length]
                    owner.append(d)
                    rows.append((own + len(rows), k, start, length, zlib.crc32(some.tobytes()), some)[: 5 + with_ids])
            own += len(rows)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * (5 + with_ids), kinds)]
            yield pa.record_batch([columns[0], batch.column("doc_id").take(pa.array(owner, pa.int64())), *columns[1:]], names=names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"id long, doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(encode, schema)


class Sweep:
    """One pass over pieces and gaps from the largest size down, gaps before pieces of their size."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, int]] = []  # gaps nobody took yet: size, id
        self.open_pieces = 0

    def take(self, kinds: Iterable[int], sizes: Iterable[int], ids: Iterable[int]) -> Iterator[tuple[int, int, int | None, int | None, int | None]]:
        """(size, id, place, gap, gap's id) of each piece: its place among those without a gap, or its gap."""
        stack = self.stack
        for kind, size, i in zip(kinds, sizes, ids):
            if kind == GAP:
                stack.append((size, i))
            elif stack:
                gap, gap_id = stack.pop()
                yield size, i, None, gap, gap_id
            else:
                yield size, i, self.open_pieces, None, None
                self.open_pieces += 1


def swept(state: DataFrame, parts: int) -> DataFrame:
    """SWEPT rows of ``state`` (kind, size, id): pieces with their gaps, pieces and gaps left over with their places
    in the partition, and gaps as they are after a piece went in (no place)."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, one = TaskContext.get().partitionId(), Sweep()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)]
            return pa.record_batch([pa.array(np.full(len(rows), p), pa.int32()), *columns], names=["part", "kind", "size", "id", "place", "gap", "gap_id"])

        for batch in batches:
            rows = []
            for size, i, place, gap, gap_id in one.take(*(batch.column(c).to_pylist() for c in ("kind", "size", "id"))):
                rows.append((PIECE, size, i, place, gap, gap_id))
                if gap is not None and gap > size:
                    rows.append((GAP, gap - size, gap_id, None, None, None))
            yield batch_of(rows)
        for at in range(0, len(one.stack), 10_000):
            yield batch_of([(GAP, size, i, at + k, None, None) for k, (size, i) in enumerate(one.stack[at : at + 10_000])])

    order = [F.col("size").desc(), F.col("kind"), F.col("id")]
    return state.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(sweep, SWEPT)


def stretches(open_pieces: list[int], open_gaps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(partition, kind, first place, last place, shift) of what meets across partitions: a piece's match has the
    number shift + place, a gap's shift - place. Open gaps form one stack over all partitions; a partition's
    open pieces take from its top before its own gaps are put on."""
    out: list[tuple[int, int, int, int, int]] = []
    stack: list[list[int]] = []  # partition, gaps left
    made = 0
    for p, (wanted, offered) in enumerate(zip(open_pieces, open_gaps)):
        at = 0
        while at < wanted and stack:
            q, left = stack[-1]
            n = min(wanted - at, left)
            out.append((p, PIECE, at, at + n - 1, made - at))
            out.append((q, GAP, left - n, left - 1, made + left - 1))
            made, at = made + n, at + n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
        if offered:
            stack.append([p, offered])
    return out


def rest(kinds: list[int], sizes: list[int], ids: list[int], most: int) -> Iterator[tuple[int, int, int]]:
    """(piece's id, sequence, offset) of all waiting pieces: every further round over a bounded number of rows."""
    gaps = [(s, i) for k, s, i in zip(kinds, sizes, ids) if k == GAP]
    waiting = [(s, i) for k, s, i in zip(kinds, sizes, ids) if k == PIECE]
    while waiting:
        least = min(waiting)[0]
        rows = sorted([(-s, GAP, i) for s, i in gaps if s >= least] + [(-s, PIECE, i) for s, i in waiting])
        one, waiting, after = Sweep(), [], []
        for size, i, place, gap, gap_id in one.take([k for _, k, _ in rows], [-s for s, _, _ in rows], [i for _, _, i in rows]):
            if place is not None:
                waiting.append((size, i))
            else:
                yield i, gap_id, most - gap
                after.append((gap - size, gap_id))
        gaps = one.stack + after
        if not after:
            need = -(-sum(s for s, _ in waiting) // most)
            for size, i in waiting[:need]:
                yield i, i, 0
                gaps.append((most - size, i))
            waiting = waiting[need:]


def pack(found: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """``found`` (written rows of ``pieces``) with sequence_id, which is the id of the piece that opened it, and
    offset."""
    spark = found.sparkSession
    wide = F.col("length") * 2 > most
    state = found.select(
        F.when(wide, GAP).otherwise(PIECE).alias("kind"), F.when(wide, most - F.col("length")).otherwise(F.col("length")).cast("int").alias("size"), "id"
    ).where("size > 0")
    placed = None

    def put(rows: DataFrame) -> None:
        nonlocal placed
        rows = rows.select("id", "sequence_id", F.col("offset").cast("long").alias("offset"))
        placed = rows if placed is None else placed.unionByName(rows)

    while True:
        facts = {r["kind"]: r for r in state.groupBy("kind").agg(F.count("*").alias("n"), F.min("size").alias("least"), F.sum("size").alias("tokens")).collect()}  # two rows
        if PIECE not in facts:
            break
        state = state.where((F.col("kind") == PIECE) | (F.col("size") >= facts[PIECE]["least"]))
        n = facts[PIECE]["n"] + (facts[GAP]["n"] if GAP in facts else 0)
        if n <= LAST:

            def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                columns = [[v for b in held for v in b.column(c).to_pylist()] for held in [list(batches)] for c in ("kind", "size", "id")]
                rows = list(rest(*columns, most))
                yield pa.record_batch([pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else [()] * 3)], names=["id", "sequence_id", "offset"])

            put(settle(state.repartition(1).mapInArrow(finish, PLACED), "placed"))
            break
        parts = -(-n // LAST)
        one = settle(swept(state, parts), "swept")
        seen = one.groupBy("part", "kind", F.col("place").isNotNull().alias("left")).count().collect()  # four rows a partition at most
        held = {(r["part"], r["kind"]): r["count"] for r in seen if r["left"]}
        parts = max([r["part"] for r in seen], default=0) + 1
        pieces_left, gaps_left = ([held.get((p, kind), 0) for p in range(parts)] for kind in (PIECE, GAP))
        meet = stretches(pieces_left, gaps_left)
        taken = one.where((F.col("kind") == PIECE) & F.col("place").isNull())
        waits = one.where(F.col("place").isNotNull()).select("part", "kind", "size", "id", "place")
        if meet or any(r["kind"] == PIECE and not r["left"] for r in seen):
            put(taken.select("id", F.col("gap_id").alias("sequence_id"), (F.lit(most) - F.col("gap")).alias("offset")))
            table = spark.createDataFrame(meet, "p int, k int, first long, last long, shift long")  # some rows a partition
            inside = (F.col("part") == F.col("p")) & (F.col("kind") == F.col("k")) & F.col("place").between(F.col("first"), F.col("last"))
            number = F.when(F.col("kind") == PIECE, F.col("shift") + F.col("place")).otherwise(F.col("shift") - F.col("place"))
            known = settle(waits.join(F.broadcast(table), inside, "left").select("kind", "size", "id", number.alias("match")), "matched")
            pairs = known.where((F.col("kind") == PIECE) & F.col("match").isNotNull()).select("match", "size", "id")
            pairs = pairs.join(known.where((F.col("kind") == GAP) & F.col("match").isNotNull()).select("match", F.col("size").alias("gap"), F.col("id").alias("sequence_id")), "match")
            pairs = settle(pairs, "pairs")
            put(pairs.select("id", "sequence_id", (F.lit(most) - F.col("gap")).alias("offset")))
            updated = one.where((F.col("kind") == GAP) & F.col("place").isNull()).select("kind", "size", "id")
            after = pairs.select(F.lit(GAP).alias("kind"), (F.col("gap") - F.col("size")).alias("size"), F.col("sequence_id").alias("id")).where("size > 0")
            following = updated.unionByName(after).unionByName(known.where(F.col("match").isNull()).select("kind", "size", "id"))
        else:
            need = -(-facts[PIECE]["tokens"] // most)
            before = np.concatenate([[0], np.cumsum(pieces_left)[:-1]]).tolist()
            table = spark.createDataFrame(list(enumerate(before)), "p int, before long")  # a row a partition
            opens = (F.col("kind") == PIECE) & (F.col("place") + F.col("before") < need)
            known = settle(waits.join(F.broadcast(table), F.col("part") == F.col("p")).select("kind", "size", "id", opens.alias("opens")), "opened")
            put(known.where("opens").select("id", F.col("id").alias("sequence_id"), F.lit(0).alias("offset")))
            fresh = known.where("opens").select(F.lit(GAP).alias("kind"), (F.lit(most) - F.col("size")).alias("size"), "id")
            following = fresh.unionByName(known.where("NOT opens").select("kind", "size", "id"))
        before_round, state = state, settle(following, "waiting")
        discard(before_round)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = found.where(wide).withColumns({"sequence_id": F.col("id"), "offset": F.lit(0).cast("long")}).select(columns)
    if placed is not None:
        out = out.unionByName(found.where(~wide).join(placed, "id").select(columns))
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, most: int = SEQUENCE) -> DataFrame:
    return pack(settle(pieces(docs, tokenizer, most), "pieces"), most)
