"""Near-duplicate classes by BagMinHash over multisets of five-word shingles.

Signatures: a shingle with count w owns the points of Poisson processes over the weight ranges [0, 1),
[1, 2), [2, 4), [4, 8) and so on up to w; a point has a time, a place in the signature and a position
within its range, and counts if that position lies below w. A place of the signature keeps its earliest
point, and points are drawn in order of time only until no place could improve, so a signature costs
little more than one point a shingle. Two places agree with the probability of the weighted Jaccard
similarity. Signatures are cut into bands; documents that agree on a band share a bucket.

Equal word sequences are one node. Bands are taken in a few phases: in each of its buckets a node that is
not yet in the pivot's component is compared exactly with the pivot, the bucket's least node, and links
found are merged before the next phase, so a group of many copies is soon one component and costs a
comparison or two a node. Buckets that then still hold several components are worked through. In large
ones the members outside a bucket's main component are the queries: they are searched in blocks, by an
inverted index of their shingles that gives exact overlaps, against all members of buckets that hang
together, in chunks; only links come out, not pairs. In small ones all members are compared with the pivot,
and as weighted Jaccard distance is a metric, two members whose distances to it differ by more than the
threshold's distance cannot be linked. Members that could only be linked to their own component are done;
the others meet further pivots, four times as many each round, until no bucket has open pairs. So every
pair in a bucket is compared, excluded by the triangle inequality, or already connected; no step lists a
bucket's pairs, and hot buckets, nodes and classes are split as skewed joins.

Defined cases: null, empty and blank texts form one class; other texts without words (symbols) are alike only
if equal, white space at the ends aside; texts of fewer than five words are one shingle; letters of scripts
without spaces are words; repeated rows are copies. A class is named by its least doc_id; where several
classes have the same one (texts that share a doc_id), all but the first are named by a negative hash, as are
classes without any doc_id. Rows without a doc_id are judged like others. Columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, column_values, discard, settle, words_of, worker_tool
from .components import merged

SHINGLE, SIMILARITY = 5, (4, 5)
BANDS, ROWS = 32, 5
PLACES = BANDS * ROWS
PHASES = ((0, 1), (1, 4), (4, 12), (12, BANDS))
LARGE = 64
#: A unit of the search in a large group: a chunk of members against a block of queries. Groups are cut into at
#: least SPREAD chunks (of LEAST_ROWS members and more), so that they are searched in parallel.
CHUNK_ROWS, CHUNK_BYTES, BLOCK_ROWS, BLOCK_BYTES = 16_384, 16_000_000, 4096, 8_000_000
SPREAD, LEAST_ROWS, LEAST_BYTES = 64, 256, 2_000_000
GROUP_WORDS = 200_000
MOST_KEPT = 150_000

_U = np.uint64
_WORD_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > MOST_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(worker_tool("word hashes", _Hashes).__getitem__, words), dtype=_U, count=len(words))


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit hash a window of SHINGLE words; fewer words are one window."""
    if len(hashes) == 0:
        return hashes
    if len(hashes) < SHINGLE:
        return mix((hashes * _WORD_FACTORS[: len(hashes)]).sum(keepdims=True) + _U(len(hashes)))
    n = len(hashes) - SHINGLE + 1
    total = np.zeros(n, dtype=_U)
    for k in range(SHINGLE):
        total += hashes[k : k + n] * _WORD_FACTORS[k]
    return mix(total)


def signatures_of(bags: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Signatures (a row a bag) of multisets of shingle hashes; a bag's repeats are its counts."""
    sizes = np.array([len(b) for b in bags], dtype=np.int64)
    best = np.full((len(bags), places), np.inf)
    if sizes.sum() == 0:
        return best
    keys = (np.repeat(np.arange(len(bags), dtype=_U), sizes) << _U(44)) | (np.concatenate(bags) >> _U(20))
    keys, counts = np.unique(keys, return_counts=True)
    doc, seed, weight = (keys >> _U(44)).astype(np.int64), mix(keys & _U((1 << 44) - 1)), counts
    parts, low, high = [], 0, 1
    while True:  # weight ranges [0, 1), [1, 2), [2, 4), ...
        some = weight > low
        if not some.any():
            break
        n = int(some.sum())
        parts.append((doc[some], mix(seed[some] + _U(high)), np.full(n, low), np.full(n, high - low), weight[some]))
        low, high = high, high * 2
    doc, seed, low, width, weight = (np.concatenate(x) for x in zip(*parts))
    time, flat, step = np.zeros(len(doc)), best.reshape(-1), 0
    latest = np.full(len(bags), np.inf)
    while len(doc):
        step += 1
        bits = mix(seed + _U(2 * step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        more = mix(bits + _U(0x9E3779B97F4A7C15))
        time = time - np.log(((bits >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        place = ((more >> _U(32)) * _U(places) >> _U(32)).astype(np.int64)
        inside = low + ((more & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) * width < weight
        alive = time < latest[doc]
        hit = alive & inside
        np.minimum.at(flat, doc[hit] * places + place[hit], time[hit])
        changed = np.unique(doc[hit])
        latest[changed] = best[changed].max(axis=1)
        alive &= time < latest[doc]
        doc, seed, low, width, weight, time = (x[alive] for x in (doc, seed, low, width, weight, time))
    return best


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key a band, for each signature."""
    bits = signature.view(_U).reshape(len(signature), bands, -1)
    out = np.broadcast_to(np.arange(bands, dtype=_U), bits.shape[:2]).copy()
    for k in range(bits.shape[2]):
        out = mix(out * _U(0x9E3779B97F4A7C15) + bits[:, :, k])
    return out.view(np.int64)


def text_mark(text: str) -> Column:
    """Tells texts of rows that share a doc_id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, node, keys) of every row: mark tells texts apart, node is the word sequence's hash,
    keys are its bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys, group, held = [], [], [], 0

            def close() -> None:
                nonlocal held
                for bag, row in zip(group, band_keys(signatures_of(group))):
                    keys.append(row if len(bag) else row[:0])
                group.clear()
                held = 0

            for text in column_values(batch, "text"):
                words = words_of(text)
                same = " ".join(words) or "\n" + (text or "").strip()  # no word holds a line break
                nodes.append(hashlib.blake2b(same.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                group.append(shingle_hashes(word_hashes(words)))
                held += len(words)
                if held > GROUP_WORDS:
                    close()
            if group:
                close()
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            yield pa.record_batch([batch.column("doc_id"), batch.column("mark"), pa.array(nodes, pa.binary()), lists], names=["doc_id", "mark", "node", "keys"])

    marked = docs.select("doc_id", text_mark("text").alias("mark"), "text")
    return settle(marked.mapInArrow(sign, "doc_id long, mark long, node binary, keys array<long>"), "signed")


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sizes of the multiset intersection and union of two bags (sorted hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both, int(a[1].sum() + b[1].sum()) - both


def bag_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingle_hashes(word_hashes(words_of(text))), return_counts=True)


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(p, x, distance, linked) for pairs (p, x) of nodes, from whole texts."""
    of_x = pairs.join(texts.select(F.col("node").alias("x"), F.col("text").alias("text_x")), "x")
    both = of_x.join(texts.select(F.col("node").alias("p"), F.col("text").alias("text_p")), "p")
    num, den = SIMILARITY

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bag = None, None
        for batch in batches:
            distance, linked = [], []
            for p, text_p, text_x in zip(*(column_values(batch, c, 64) for c in ("p", "text_p", "text_x"))):
                if p != last:
                    last, bag = p, bag_of(text_p)
                inter, union = overlap(bag, bag_of(text_x))
                distance.append(1 - inter / union if union else 0.0)
                linked.append(den * inter >= num * union)
            yield pa.record_batch([batch.column("p"), batch.column("x"), pa.array(distance, pa.float64()), pa.array(linked, pa.bool_())], names=["p", "x", "distance", "linked"])

    return settle(both.select("p", "x", "text_p", "text_x").mapInArrow(compare, "p binary, x binary, distance double, linked boolean"), "compared")


def _labelled(state: DataFrame, labels: DataFrame | None, node: str, comp: str) -> DataFrame:
    """``state`` with the component of ``node``; one without links is its own."""
    if labels is None:
        return state.withColumn(comp, F.col(node))
    own = labels.select(F.col("node").alias(node), F.col("comp").alias(comp))
    return state.join(own, node, "left").withColumn(comp, F.coalesce(comp, node))


def _open(state: DataFrame) -> DataFrame:
    """Members that could be linked to another component: their distance to the bucket's first pivot is
    in the same or a neighbouring step of the threshold's distance as that of a member of another one."""
    steps = range(-1, 7)
    spans = settle(state.groupBy("b").agg(*[f(F.when(F.col("step") == k, F.col("comp"))).alias(f"{n}{k + 1}") for k in steps for n, f in (("lo", F.min), ("hi", F.max))]), "spans")
    around = F.lit(False)
    for k in range(6):
        lows = F.least(*[F.col(f"lo{j + 1}") for j in (k - 1, k, k + 1)])
        highs = F.greatest(*[F.col(f"hi{j + 1}") for j in (k - 1, k, k + 1)])
        around = F.when(F.col("step") == k, lows != highs).otherwise(around)
    out = settle(state.join(spans, "b").where(around).select(*state.columns), "open")
    discard(spans)
    return out


def _links(done: DataFrame) -> DataFrame:
    return done.where("linked").select(F.col("p").alias("a"), F.col("x").alias("b"))


def search_block(group: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) between a block's queries and a chunk's members of other components, one for each query
    and component. Overlaps come from an inverted index of the queries' shingles."""
    queries, members = group[group["query"]], group[~group["query"]]
    found = [bag_of(t) for t in queries["text"]]
    sizes = np.array([c.sum() for _, c in found])
    owner = np.repeat(np.arange(len(found)), [len(h) for h, _ in found])
    hashes, counts = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(hashes, kind="stable")
    hashes, counts, owner = hashes[order], counts[order], owner[order]
    q_node, q_comp = queries["node"].to_list(), queries["comp"].to_list()
    out, seen = [], set()
    for node, comp, text in zip(members["node"], members["comp"], members["text"]):
        h, c = bag_of(text)
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        inter = np.bincount(owner[at], np.minimum(counts[at], np.repeat(c, n)), len(sizes)).astype(np.int64)
        linked = SIMILARITY[1] * inter >= SIMILARITY[0] * (sizes + int(c.sum()) - inter)
        for q in np.flatnonzero(linked).tolist():
            if q_comp[q] != comp and (q, comp) not in seen:
                seen.add((q, comp))
                out.append((q_node[q], node))
    return pd.DataFrame(out, columns=["a", "b"])


def block_links(large: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between members of different components in large buckets (b, p, x, comp)."""
    held = large.groupBy("b", "comp").agg(F.count("*").alias("k"))
    main = settle(held.groupBy("b").agg(F.max(F.struct("k", "comp")).alias("main")).select("b", "main.comp").withColumnRenamed("comp", "main"), "main")
    queries = settle(large.join(main, "b").where("comp != main").select(F.col("x").alias("node")).distinct().withColumn("query", F.lit(True)), "queries")
    hanging = merged(None, large.where("x != p").select(F.col("x").alias("a"), F.col("p").alias("b")).distinct())
    together = hanging.withColumnRenamed("comp", "g")
    comps = settle(large.select(F.col("x").alias("node"), "comp").distinct(), "comps")
    members = comps.join(together, "node").join(texts, "node").join(queries, "node", "left").withColumn("query", F.coalesce("query", F.lit(False)))
    members = settle(members, "members")
    size, asked = F.octet_length("text"), F.col("query")
    up = lambda x, y: F.ceil(x / F.lit(y)).cast("int")
    spread = F.least(F.greatest(up(F.count("*"), LEAST_ROWS), up(F.sum(size), LEAST_BYTES)), F.lit(SPREAD))
    shape = settle(members.groupBy("g").agg(
        F.greatest(up(F.count("*"), CHUNK_ROWS), up(F.sum(size), CHUNK_BYTES), spread).alias("chunks"),
        F.greatest(up(F.sum(asked.cast("long")), BLOCK_ROWS), up(F.sum(F.when(asked, size)), BLOCK_BYTES), F.lit(1)).alias("blocks"),
    ), "shape")
    shaped = members.join(shape, "g")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["g", "block", "chunk", "node", "comp", "text", "query"]
    chunked = shaped.withColumn("chunk", place("chunks")).withColumn("block", each("blocks")).withColumn("query", F.lit(False))
    asked_rows = shaped.where("query").withColumn("block", place("blocks")).withColumn("chunk", each("chunks"))
    units = chunked.select(columns).unionByName(asked_rows.select(columns))
    out = settle(units.groupBy("g", "block", "chunk").applyInPandas(_search, "a binary, b binary"), "links")
    discard(main, queries, hanging, comps, members, shape)
    return out


def _search(group: pd.DataFrame) -> pd.DataFrame:
    if group["query"].all() or not group["query"].any():
        return pd.DataFrame({"a": [], "b": []}, dtype=object)
    return search_block(group)


def labels_of(docs: DataFrame, rows: DataFrame) -> DataFrame | None:
    """(node, comp) of nodes with links; None where no bucket has two members."""
    nodes = settle(rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("rep"), F.first("keys").alias("keys")), "nodes")
    member = nodes.select(F.col("node").alias("x"), F.posexplode("keys").alias("band", "b"))
    first = settle(member.groupBy("b").agg(F.min("x").alias("p"), F.count("*").alias("n")).where("n > 1"), "pivots")
    state = settle(member.join(first, "b").where("x != p"), "members")
    if state.isEmpty():
        return None
    needed = settle(state.select(F.col("x").alias("node")).unionByName(first.select(F.col("p").alias("node"))).distinct(), "needed")
    wanted = nodes.join(needed, "node").select("node", "rep.doc_id", "rep.mark")
    all_texts = docs.select(F.col("doc_id").alias("d"), text_mark("text").alias("m"), "text")
    found = all_texts.join(wanted, all_texts["d"].eqNullSafe(wanted["doc_id"]) & (all_texts["m"] == wanted["mark"]))
    texts = settle(found.select("node", "text").dropDuplicates(["node"]), "texts")
    discard(nodes, needed)

    labels = None
    for low, high in PHASES:
        pairs = state.where((F.col("band") >= low) & (F.col("band") < high)).select("p", "x").distinct()
        apart = settle(_labelled(_labelled(pairs, labels, "x", "x_comp"), labels, "p", "p_comp").where("x_comp != p_comp").select("p", "x"), "apart")
        if not apart.isEmpty():
            done = compared(apart, texts)
            labels = merged(labels, _links(done))
            discard(done)
        discard(apart)
    whole = settle(_labelled(state.select("b", "p", "n", "x").unionByName(first.select("b", "p", "n", F.col("p").alias("x"))), labels, "x", "comp"), "whole")
    spans = settle(whole.groupBy("b").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("b"), "spans")
    large = settle(whole.where(F.col("n") > LARGE).join(spans, "b"), "large")
    left = settle(state.where(F.col("n") <= LARGE).select("b", "p", "x").join(spans, "b"), "left")
    discard(whole, spans, state, first)
    if not large.isEmpty():
        found = block_links(large, texts)
        labels = merged(labels, found)
        discard(found)
    discard(large)
    if left.isEmpty():
        return labels
    pairs = settle(left.select("p", "x").distinct(), "pairs")
    done, pivots = compared(pairs, texts), 4
    labels = merged(labels, _links(done))
    state = settle(left.join(done, ["p", "x"]).select("b", "x", F.least(F.floor(F.col("distance") * 5 + 1e-9), F.lit(5)).cast("int").alias("step"), "distance"), "state")
    discard(pairs, done, left)
    while True:
        held = _open(_labelled(state, labels, "x", "comp"))
        if held.isEmpty():
            return labels
        slot = F.pmod(F.xxhash64("x"), F.lit(pivots))
        chosen = settle(held.groupBy("b", slot.alias("slot")).agg(F.min(F.struct("x", "comp", "distance")).alias("s")).select("b", F.col("s.x").alias("p"), F.col("s.comp").alias("p_comp"), F.col("s.distance").alias("p_distance")), "chosen")
        meet = held.join(chosen, "b").where((F.col("comp") != F.col("p_comp")) & (F.abs(F.col("distance") - F.col("p_distance")) <= 0.2 + 1e-9))
        pairs = settle(meet.select("p", "x").distinct(), "pairs")
        done = compared(pairs, texts)
        labels = merged(labels, _links(done))
        rest = settle(held.drop("comp").join(chosen.select("b", F.col("p").alias("x")), ["b", "x"], "left_anti"), "state")
        discard(state, held, chosen, pairs, done)
        state, pivots = rest, pivots * 4


def members_and_least(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, comp) of every row, and (comp, doc_id, mark) of every class's least row, ids before rows
    without one."""
    docs = docs.select("doc_id", "text")
    rows = signed(docs)
    labels = labels_of(docs, rows)
    named = settle(_labelled(rows.select("doc_id", "mark", "node"), labels, "node", "comp").select("doc_id", "mark", "comp"), "named")
    discard(rows, labels)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("least")
    return named, settle(named.groupBy("comp").agg(least).select("comp", "least.doc_id", "least.mark"), "least")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every row."""
    named, found = members_and_least(docs)
    owner = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("mark").alias("owner"))
    other = F.bitwise_not(F.shiftrightunsigned(F.xxhash64("doc_id", "mark"), 1))  # below 0
    name = F.when(F.col("owner") == F.col("mark"), F.col("doc_id")).otherwise(other)
    classes = settle(found.join(owner, "doc_id", "left").select("comp", name.alias("class_id")), "classes")
    return named.join(classes, "comp").select("doc_id", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of its least doc_id and, among rows that share it, of the
    least text mark; of repeated rows one stays. In a class without any doc_id the least mark decides."""
    named, found = members_and_least(docs)
    held = named.groupBy("doc_id", "mark").agg(F.count("*").alias("copies"))
    best = found.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"))
    best = best.join(held, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark"))).select("d", "m", "copies")
    best = settle(best, "best")
    rows = boxed(docs, "doc_id", "text").select("row", "doc_id", text_mark("text").alias("mark"))
    kept = rows.join(best, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
    once = kept.where("copies = 1").select("row.*")
    many = kept.where("copies > 1").groupBy("doc_id", "mark").agg(F.first("row").alias("row")).select("row.*")
    return once.union(many)
