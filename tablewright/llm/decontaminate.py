"""Benchmark decontamination: item-sized windows of documents within a small edit distance of an item.

Words are compared in lower case. An item of under 2 x PIECE words is looked for in windows of its own size; a
longer one through all its disjoint pieces of PIECE words, one of which holds at most its share of the edits,
however long the item is. A window is embedded by CGK random walks: a walk of 3 x size steps emits the word it
stands on and moves on by a bit that depends on step and word, so that few edits leave most steps equal (edit
distance becomes Hamming distance). Repeated bit-sampling LSH takes SAMPLED steps of a walk, one from each of
so many equal stretches of it, as a key, TABLES keys a walk, WALKS walks; windows that share a key with an item
are candidates, and a candidate counts only if the whole item is within MOST_EDITS of its length of some
stretch of the text around it, by exact edit distance (of words).

Before a window is embedded, one necessary condition is checked for all window positions at once: an edit
destroys or pushes out at most two of an item's pairs of neighbouring words, so a window with less than
size - 1 - 2 x edits pairs of the items' cannot match and is not embedded. It loses nothing; pairs are looked
up by hash, and a collision only lets a window pass.

Items are a stated query set. Items of equal words are one: it has the least of their ids and their number,
and ``item_classes`` tells which ids it stands for. They go to the executors in blocks of at most BLOCK_ITEMS
and BLOCK_CHARS, so what is broadcast is bounded however long the benchmark is, and each block passes over the
documents once.

Defined cases: null or empty texts and items without words match nothing; items shorter than LEAST_WORDS are
looked for by all their words, unedited; letters of scripts without spaces are words; ``leaks`` reports rows
that share a doc_id together, with the best of their matches, and rows without a doc_id as one such group;
``without_leaks`` judges each row by itself, whatever its id, and carries all columns along.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_values, filtered, grouped, settle, words_of, worker_tool
from .near_dup import mix, word_hashes

MOST_EDITS = 0.1
WALKS, TABLES, SAMPLED = 8, 8, 5
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
LEAST_WORDS = 5
PIECE = 16
GROUP_CHARS = 2_400_000
_U = np.uint64


def most_edits(n: int) -> int:
    """Edits allowed to an item of ``n`` words."""
    return int(n * MOST_EDITS)


def pieces(n: int) -> tuple[int, list[int], int]:
    """Size and first words of the pieces by which an item of ``n`` words is looked for, and the edits that
    the piece with fewest holds at most."""
    if n < 2 * PIECE:
        return n, [0], most_edits(n) if n >= LEAST_WORDS else 0
    return PIECE, list(range(0, n - PIECE + 1, PIECE)), most_edits(n) // (n // PIECE)


def walk(words: np.ndarray, starts: np.ndarray, size: int, seed: int) -> np.ndarray:
    """CGK embeddings (a row a step, a column a start) of the ``size`` words from each start; past the end a walk
    emits 0."""
    at, out = starts.copy(), np.zeros((3 * size, len(starts)), dtype=_U)
    words, ends = np.append(words, np.zeros(1, dtype=_U)), np.minimum(starts + size, len(words))
    for step in range(3 * size):
        word = words[at]
        word[at >= ends] = 0
        out[step] = word
        salt = _U((seed * 1_000_003 + step) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        at += (mix(word ^ salt) >> _U(63)).astype(np.int64)
        np.minimum(at, ends, out=at)
    return out


def sampled_steps(size: int, seed: int) -> np.ndarray:
    """TABLES x SAMPLED steps of a walk, one from each of SAMPLED stretches of it."""
    rng = np.random.default_rng([size, seed])
    edges = [3 * size * k // SAMPLED for k in range(SAMPLED + 1)]
    return np.array([[rng.integers(low, max(high, low + 1)) for low, high in zip(edges, edges[1:])] for _ in range(TABLES)]).clip(0, 3 * size - 1)


def keys_of(words: np.ndarray, starts: np.ndarray, size: int, seed: int) -> np.ndarray:
    """LSH keys (a row a table, a column a start) of one walk."""
    emitted = walk(words, starts, size, seed)
    out = np.empty((TABLES, len(starts)), dtype=_U)
    for t, steps in enumerate(sampled_steps(size, seed)):
        key = np.full(len(starts), t + 1000 * seed, dtype=_U)
        for step in steps:
            key = mix(key * _U(0x9E3779B97F4A7C15) + emitted[step])
        out[t] = key
    return out


def edit_distance(item: list[str], text: list[str]) -> tuple[int, int]:
    """Least edits between all of ``item`` and any stretch of ``text``, and where that stretch ends.
    Bit-parallel: one column of the table is two integers."""
    n = len(item)
    masks: dict[str, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n, 0
    for j, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = (minus | ~(across | plus)) & full, plus & across
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        vertical = eq | minus
        plus, minus = (down | ~(vertical | up)) & full, up & vertical
        if score < best:
            best, end = score, j
    return best, end


def pairs_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of neighbouring words along the last axis; of single words where items have but one."""
    if size < 2:
        return mix(words)
    return mix(words[..., :-1] * _U(0x9E3779B97F4A7C15) + words[..., 1:])


class Items:
    """An index over one block of items: their words' numbers, and LSH tables for each window size. Words
    that no item has count as one word, as none of them equals an item's."""

    def __init__(self, rows: list[tuple]) -> None:
        """``rows``: what names an item, and its words joined by spaces."""
        self.items = [(name, words.split(" ")) for name, words in rows if words]
        self.distinct = [set(words) for _, words in self.items]
        self.number: dict[str, int] = {}
        for _, words in self.items:
            for w in words:
                self.number.setdefault(w, len(self.number))
        self.other = len(self.number)
        self.hashes = np.append(word_hashes(list(self.number)), _U(1))
        self.by_size: dict[int, dict] = {}
        sizes: dict[int, list[tuple[int, int]]] = {}
        most: dict[int, int] = {}
        for k, (_, words) in enumerate(self.items):
            size, offsets, edits = pieces(len(words))
            sizes.setdefault(size, []).extend((k, o) for o in offsets)
            most[size] = max(most.get(size, 0), edits)
        for size, members in sorted(sizes.items()):
            flat = self.hashes[np.concatenate([self.numbers(self.items[k][1][o : o + size]) for k, o in members])]
            starts = np.arange(len(members)) * size
            bits = min(24, max(14, (16 * len(flat)).bit_length()))
            known = np.zeros(1 << bits, dtype=bool)
            known[(pairs_of(flat.reshape(-1, size), size) >> _U(64 - bits)).astype(np.int64)] = True
            tables = []
            for seed in range(WALKS):
                for found in keys_of(flat, starts, size, seed):
                    order = np.argsort(found, kind="stable")
                    tables.append((found[order], order))
            self.by_size[size] = {"edits": most[size], "known": known, "bits": bits, "tables": tables, "members": np.array(members)}

    def numbers(self, words: list[str]) -> np.ndarray:
        get, other = self.number.get, self.other
        return np.array([get(w, other) for w in words], dtype=np.int64)

    def candidates(self, number: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(keys shared, start, item, the piece's first word) of windows that share keys with an item; ``number``
        are the documents' words one after another, ``ends`` is for each position its document's end."""
        words = self.hashes[number]
        known, places = np.zeros(len(number) + 1, dtype=np.int32), np.arange(len(number))
        pairs = {1: pairs_of(words, 1), 2: np.append(pairs_of(words, 2), _U(0))}
        for size, index in self.by_size.items():
            np.cumsum(index["known"][(pairs[min(size, 2)] >> _U(64 - index["bits"])).astype(np.int64)], out=known[1:])
            within = max(size - 1, 1)
            starts = np.flatnonzero(known[np.minimum(places + within, ends)] - known[:-1] >= within - 2 * index["edits"])
            members = index["members"]
            for at in range(0, len(starts), 20_000):
                some, hits = starts[at : at + 20_000], []
                for seed in range(WALKS):
                    for (keys, order), asked in zip(index["tables"][seed * TABLES :], keys_of(words, some, size, seed)):
                        low = np.searchsorted(keys, asked)
                        hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == asked)
                        if len(hit):
                            low = low[hit]
                            n = np.searchsorted(keys, asked[hit], side="right") - low
                            run = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                            hits.append(np.repeat(hit, n) * len(members) + order[run])
                if hits:
                    found, shared = np.unique(np.concatenate(hits), return_counts=True)
                    start, member = np.divmod(found, len(members))
                    yield from zip(shared.tolist(), some[start].tolist(), members[member, 0].tolist(), members[member, 1].tolist())


def matches(index: Items, texts: list[str | None]) -> list[dict]:
    """For each text, item -> (edits, first word, words) of its best match. Candidates that share most
    keys are verified first; the others of a document and item that matched without an edit are not."""
    out: list[dict] = [{} for _ in texts]
    split = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    if sizes.sum() == 0 or not index.by_size:
        return out
    number = np.concatenate([index.numbers(w) for w in split])
    ends = np.cumsum(sizes)
    found = index.candidates(number, np.repeat(ends, sizes))
    seen: set[tuple[int, int, int]] = set()
    for _, start, k, offset in sorted(found, key=lambda c: (-c[0], c)):
        d = int(np.searchsorted(ends, start, side="right"))
        at = start - int(ends[d] - sizes[d]) - offset  # where the item starts, but for edits before the piece
        if (d, k, at) in seen:
            continue
        seen.add((d, k, at))
        item, words = index.items[k]
        edits = most_edits(len(words))
        best = out[d].get(item, (edits + 1,))
        if best[0] == 0:
            continue
        first = max(0, at - edits)
        stretch = split[d][first : max(at + len(words) + edits, 0)]
        if len(index.distinct[k].difference(stretch)) > edits:
            continue  # every word that is missing costs an edit
        n, end = edit_distance(words, stretch)
        if n <= edits and len(words) >= 2 * PIECE:  # the start that belongs to this end
            at = first + end - edit_distance(words[::-1], stretch[:end][::-1])[1]
        if n <= edits and (n, at) < best[:2]:
            out[d][item] = (n, at, max(first + end - at, 0))
    return out


def item_classes(items: DataFrame) -> DataFrame:
    """(item_id, words, rep): the words of every item, joined by spaces, and the least id of the items that have
    the same."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [" ".join(words_of(t)) for t in column_values(batch, "text")]
            yield pa.record_batch([batch.column("item_id"), pa.array(words, pa.string())], names=["item_id", "words"])

    own = items.select("item_id", "text").mapInArrow(split, "item_id long, words string").where("words <> ''")
    least = own.groupBy(F.col("words").alias("w")).agg(F.min("item_id").alias("rep"))
    return own.join(least, F.col("words") == F.col("w")).select("item_id", "words", "rep")


def blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The query set in blocks of bounded size, one at a time, in order of item_id: an item's id and number of
    copies, and its words; one empty block if there are no items."""
    block: list[tuple] = []
    chars = 0
    distinct = item_classes(items).groupBy("words").agg(F.min("rep").alias("item_id"), F.count("*").alias("copies"))
    for r in distinct.orderBy("item_id", "words").toLocalIterator():
        if len(block) >= BLOCK_ITEMS or chars > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append(((r["item_id"], r["copies"]), r["words"]))
        chars += len(r["words"])
    yield block


def _index(name: str, shared: Broadcast) -> Items:
    """One index a worker process."""
    return worker_tool(name, lambda: Items(shared.value))


def _search(spark: SparkSession, docs: DataFrame, block: list[tuple]) -> DataFrame:
    shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, shared)
        for batch in batches:
            ids, rows = iter(batch.column("doc_id").to_pylist()), []
            for group in grouped(batch, "text", GROUP_CHARS):
                for found, doc in zip(matches(index, group), ids):
                    rows.extend((doc, *item, *place) for item, place in found.items())
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "copies", "edits", "first_word", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, item_id long, copies long, edits int, first_word long, n_words long")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, copies, edits, first_word, n_words): each document and distinct item that match, at their
    best; ``copies`` items have these words, of which item_id is the least."""
    found, rest = None, blocks(items)
    block = next(rest)
    while block is not None:
        following = next(rest, None)
        part = _search(docs.sparkSession, docs, block)
        if found is not None or following is not None:
            part = settle(part, "leaks")  # the next block is read only when this one is done with
        found = part if found is None else found.unionByName(part)
        block = following
    best = F.min(F.struct("edits", "first_word", "n_words")).alias("best")
    return found.groupBy("doc_id", "item_id", "copies").agg(best).select("doc_id", "item_id", "copies", "best.*")


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item."""
    kept, spark, rest = docs, docs.sparkSession, blocks(items)
    block = next(rest)
    while block is not None:
        following = next(rest, None)
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def start(shared: Broadcast = shared, name: str = name) -> Callable[[pa.RecordBatch], list[bool]]:
            index = _index(name, shared)
            return lambda batch: [not found for group in grouped(batch, "text", GROUP_CHARS) for found in matches(index, group)]

        kept = filtered(kept, start)
        if following is not None:
            kept = settle(kept, "clean")
        block = following
    return kept
