"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as two vectors: one of its own, for words seen in enough training documents, and the mean of
its character n-grams' vectors, which any word has. A forward and a backward gated recurrent unit read a
window of words; attention pools their states; a logistic unit scores the window. Windows of WINDOW words
overlap by half and cover the whole text; a document's score is that of its highest window.

Training knows only document labels, so it is multi-instance: after a start in which all windows of toxic
documents count as toxic, each round scores all training windows and trains on the highest of each
document. It uses a bounded sample of labelled rows: at most MOST_PER_CLASS documents a class and
MOST_TRAIN_WORDS words a class, in order of a hash of doc_id, never rows held out (crc32 of doc_id as text,
modulo 5, is 0), one row a doc_id, none of over MOST_TRAIN_BYTES: what reaches the training task is bounded
before it is shuffled. The model has a fixed size and is broadcast; scoring covers every row.

Defined cases: texts without words score 0; a null doc_id counts as held out; of rows that share a labelled
doc_id the one whose text has the least hash is learnt from; without labelled rows of both classes every score
is 0; repeated rows score alike; letters of scripts without spaces are words; other columns are carried along
by ``score`` and ``without_toxic``.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added, column_values, filtered, words_of, worker_tool
from .near_dup import mix

WINDOW, STRIDE = 24, 12
WORD_DIM = CHAR_DIM = HIDDEN = 8
NGRAMS, BUCKETS = (3, 4, 5), 1 << 15
LEAST_DOCS = 3
MOST_PER_CLASS, MOST_TRAIN_WORDS, MOST_TRAIN_BYTES = 1500, 500_000, 200_000
MOST_KEPT = 250_000
GROUP_WORDS = 100_000
_U = np.uint64


def char_ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams (with marks for start and end) of words, one after another, and
    how many each word has."""
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(_U)
    owner = np.repeat(np.arange(len(words)), sizes)
    parts, owners = [], []
    for n in NGRAMS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, dtype=_U)
        for k in range(n):
            h = h * _U(0x100000001B3) + codes[k : k + len(h)]
        same = owner[: len(h)] == owner[n - 1 :]
        parts.append((mix(h) % _U(BUCKETS))[same].astype(np.int64))
        owners.append(owner[: len(h)][same])
    owners, buckets = np.concatenate(owners), np.concatenate(parts)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.bincount(owners, minlength=len(words))


def window_starts(n: int) -> list[int]:
    """Starts of the overlapping windows that cover ``n`` words; the last ends with the text."""
    if n <= WINDOW:
        return [0]
    out = list(range(0, n - WINDOW + 1, STRIDE))
    return out if out[-1] == n - WINDOW else [*out, n - WINDOW]


@dataclass
class Model:
    """Parameters; gates lie as update, reset, candidate. Axis 0 of the recurrent ones is the direction."""

    words: dict[str, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(words: dict[str, int], seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        d = WORD_DIM + CHAR_DIM
        return Model(words, {
            "word": normal(len(words) + 1, WORD_DIM, scale=0.05), "char": normal(BUCKETS, CHAR_DIM, scale=0.3),
            "w": normal(2, d, 3 * HIDDEN, scale=d**-0.5), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "u": normal(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
            "aw": normal(2 * HIDDEN, HIDDEN, scale=(2 * HIDDEN) ** -0.5), "ab": np.zeros(HIDDEN, np.float32), "av": normal(HIDDEN, scale=0.5),
            "ow": normal(2 * HIDDEN, scale=0.5), "ob": np.full(1, -1.0, np.float32),
        })

    def char_vectors(self, buckets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sizes), CHAR_DIM), dtype=np.float32)
        some = sizes > 0
        if some.any():
            starts = (np.cumsum(sizes) - sizes)[some]
            out[some] = np.add.reduceat(self.p["char"][buckets], starts, axis=0) / sizes[some][:, None]
        return out

    def vectors(self, words: list[str]) -> np.ndarray:
        ids = np.fromiter((self.words.get(w, 0) for w in words), dtype=np.int64, count=len(words))
        return np.concatenate([self.p["word"][ids] * (ids > 0)[:, None], self.char_vectors(*char_ngrams(words))], axis=1)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of words (row, direction, gates)."""
        return (np.matmul(x[None], self.p["w"]) + self.p["b"]).transpose(1, 0, 2)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def forward(model: Model, gates: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
    """Logits of windows; ``gates`` is (step, direction, window, 3 x HIDDEN) with the backward direction
    already reversed in time, ``mask`` (step, window) is 0 on padding."""
    p, H = model.p, HIDDEN
    steps, _, n, _ = gates.shape
    h, states = np.zeros((2, n, H), np.float32), np.empty((steps, 2, n, H), np.float32)
    for t in range(steps):
        hu = np.matmul(h, p["u"])
        zr = _sigmoid(gates[t, :, :, : 2 * H] + hu[:, :, : 2 * H])
        z, r = zr[:, :, :H], zr[:, :, H:]
        c = np.tanh(gates[t, :, :, 2 * H :] + r * hu[:, :, 2 * H :])
        new = c + z * (h - c)
        if mask is not None:
            m = np.stack([mask[t], mask[steps - 1 - t]])[:, :, None]
            new = h + m * (new - h)
        if keep is not None:
            keep.append((h, z, r, c, hu[:, :, 2 * H :]))
        h = states[t] = new
    both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
    a = np.tanh(both @ p["aw"] + p["ab"])
    e = a @ p["av"]
    if mask is not None:
        e = np.where(mask > 0, e, np.float32(-1e9))
    e = np.exp(e - e.max(axis=0))
    e /= e.sum(axis=0)
    pooled = (e[:, :, None] * both).sum(axis=0)
    if keep is not None:
        keep.append((both, a, e, pooled))
    return pooled @ p["ow"] + p["ob"]


def backward(model: Model, d_logit: np.ndarray, mask: np.ndarray, kept: list) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the shared parameters and of the gate inputs."""
    p, H, g = model.p, HIDDEN, {}
    both, a, e, pooled = kept.pop()
    steps = len(kept)
    g["ow"], g["ob"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
    d_pooled = d_logit[:, None] * p["ow"]
    d_both = e[:, :, None] * d_pooled
    d_e = (both * d_pooled).sum(axis=2)
    d_score = e * (d_e - (e * d_e).sum(axis=0))
    g["av"] = np.tensordot(d_score, a, axes=([0, 1], [0, 1]))
    d_a = d_score[:, :, None] * p["av"] * (1 - a * a)
    g["ab"] = d_a.sum(axis=(0, 1))
    g["aw"] = np.tensordot(both, d_a, axes=([0, 1], [0, 1]))
    d_both = d_both + d_a @ p["aw"].T
    d_states = np.stack([d_both[:, :, :H], d_both[::-1, :, H:]], axis=1)
    d_gates = np.empty((steps, 2, both.shape[1], 3 * H), np.float32)
    g["u"], dh, ut = np.zeros_like(p["u"]), np.zeros_like(kept[0][0]), p["u"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, hc = kept[t]
        dh = dh + d_states[t]
        m = np.stack([mask[t], mask[steps - 1 - t]])[:, :, None]
        d_new, dh = dh * m, dh * (1 - m)
        d_c = d_new * (1 - z) * (1 - c * c)
        d_hu = np.concatenate([d_new * (h - c) * z * (1 - z), d_c * hc * r * (1 - r), d_c * r], axis=2)
        d_gates[t] = d_hu
        d_gates[t, :, :, 2 * H :] = d_c
        g["u"] += np.matmul(h.transpose(0, 2, 1), d_hu)
        dh = dh + d_new * z + np.matmul(d_hu, ut)
    return g, d_gates


class Trainer:
    """Windows of the training documents and the steps of Adam over them."""

    def __init__(self, docs: list[tuple[list[str], int]], seed: int = 5) -> None:
        self.rng = np.random.default_rng(seed)
        counts: dict[str, int] = {}
        for words, _ in docs:
            for w in set(words):
                counts[w] = counts.get(w, 0) + 1
        names = sorted(counts)
        self.model = Model.fresh({w: i + 1 for i, w in enumerate(w for w in names if counts[w] >= LEAST_DOCS)})
        number = {w: i for i, w in enumerate(names)}
        self.ids = np.array([0] + [self.model.words.get(w, 0) for w in names], dtype=np.int64)  # number 0 is padding
        self.buckets, self.sizes = char_ngrams(names)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes) - self.sizes])
        self.sizes = np.concatenate([[0], self.sizes])
        rows, self.doc, self.label = [], [], []
        for d, (words, label) in enumerate(docs):
            flat = [number[w] + 1 for w in words]
            for s in window_starts(len(flat)):
                rows.append(flat[s : s + WINDOW] + [0] * (WINDOW - len(flat[s : s + WINDOW])))
                self.doc.append(d)
            self.label.append(label)
        self.windows, self.doc, self.label = np.array(rows, dtype=np.int64), np.array(self.doc), np.array(self.label)
        self.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.model.p.items()}
        self.t = 0

    def _inputs(self, windows: np.ndarray, drop: float) -> tuple:
        used, back = np.unique(windows, return_inverse=True)
        sizes = self.sizes[used]
        ends = np.cumsum(sizes)
        grams = self.buckets[np.repeat(self.starts[used] - ends + sizes, sizes) + np.arange(ends[-1])]
        ids = self.ids[used]
        if drop:
            ids = np.where(self.rng.random(len(ids)) < drop, 0, ids)
        x = np.concatenate([self.model.p["word"][ids] * (ids > 0)[:, None], self.model.char_vectors(grams, sizes)], axis=1)
        gates = self.model.projected(x)[back.reshape(windows.shape)].transpose(1, 2, 0, 3)  # step, direction, window, gates
        gates = np.stack([gates[:, 0], gates[::-1, 1]], axis=1)
        return used, back.reshape(windows.shape), sizes, grams, ids, x, gates, (windows > 0).T.astype(np.float32)

    def logits(self) -> np.ndarray:
        out = []
        for a in range(0, len(self.windows), 4096):
            *_, gates, mask = self._inputs(self.windows[a : a + 4096], 0)
            out.append(forward(self.model, gates, mask))
        return np.concatenate(out)

    def step(self, some: np.ndarray, target: np.ndarray, weight: np.ndarray, rate: float) -> float:
        p, kept = self.model.p, []
        used, back, sizes, grams, ids, x, gates, mask = self._inputs(self.windows[some], 0.3)
        logit = forward(self.model, gates, mask, kept)
        prob = _sigmoid(logit)
        g, d_gates = backward(self.model, ((prob - target) * weight / weight.sum()).astype(np.float32), mask, kept)
        d_gates = np.stack([d_gates[:, 0], d_gates[::-1, 1]], axis=2).transpose(1, 0, 2, 3)  # window, step, direction, gates
        order = np.argsort(back.reshape(-1), kind="stable")
        at = np.flatnonzero(np.diff(back.reshape(-1)[order], prepend=-1))
        by_word = np.add.reduceat(d_gates.reshape(-1, 2, 3 * HIDDEN)[order], at, axis=0)
        g["b"] = by_word.sum(axis=0)[:, None, :]
        g["w"] = np.einsum("nd,nkg->kdg", x, by_word)
        dx = np.einsum("nkg,kdg->nd", by_word, p["w"])
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], ids[ids > 0], dx[ids > 0, :WORD_DIM])
        spread = np.repeat(dx[:, WORD_DIM:] / np.maximum(sizes, 1)[:, None], sizes, axis=0)
        for k in range(CHAR_DIM):
            g["char"][:, k] = np.bincount(grams, spread[:, k], BUCKETS)
        self.t += 1
        for k, v in g.items():
            m1, m2 = self.m[k]
            v = v + np.float32(1e-5) * p[k]
            m1 += 0.1 * (v - m1)
            m2 += 0.01 * (v * v - m2)
            p[k] -= (rate * (m1 / (1 - 0.9**self.t)) / (np.sqrt(m2 / (1 - 0.99**self.t)) + 1e-6)).astype(np.float32)
        return float((weight * -np.where(target > 0, np.log(prob + 1e-7), np.log(1 - prob + 1e-7))).sum() / weight.sum())

    def top(self, logits: np.ndarray, label: int, most: int) -> np.ndarray:
        """The ``most`` highest windows of each document of a label."""
        order = np.lexsort((-logits, self.doc))
        first = np.concatenate([[0], np.flatnonzero(np.diff(self.doc[order])) + 1])
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        return order[(rank < most) & (self.label[self.doc[order]] == label)]

    def train(self, start_steps: int = 150, rounds: int = 8, round_steps: int = 50, batch: int = 256) -> Model:
        toxic, clean = np.flatnonzero(self.label[self.doc] == 1), np.flatnonzero(self.label[self.doc] == 0)
        half = batch // 2
        target = np.concatenate([np.ones(half, np.float32), np.zeros(half, np.float32)])
        for _ in range(start_steps):
            self.step(np.concatenate([self.rng.choice(toxic, half), self.rng.choice(clean, half)]), target, np.ones(batch, np.float32), 0.02)
        for k in range(rounds):
            logits = self.logits()
            high, hard = self.top(logits, 1, 1), self.top(logits, 0, 2)
            for _ in range(round_steps):
                picked = np.concatenate([self.rng.choice(high, half), self.rng.choice(hard, half // 2), self.rng.choice(clean, half - half // 2)])
                self.step(picked, target, np.ones(batch, np.float32), 0.01 if k < rounds - 2 else 0.003)
        return self.model


class Scorer:
    """Scores whole texts; keeps the gate inputs of at most MOST_KEPT words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.gates = np.zeros((1, 2, 3 * HIDDEN), np.float32)  # row 0 is padding
        self.known = 1

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            found = self.model.projected(self.model.vectors(some))
            while self.known + len(some) > len(self.gates):
                self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
            self.gates[self.known : self.known + len(some)] = found
            for k, w in enumerate(some):
                self.number[w] = self.known + k
            self.known += len(some)

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.number) > MOST_KEPT:
            self._clear()
        new = list({w: None for words in texts for w in words if w not in self.number})
        self._learn(new)
        out = np.zeros(len(texts))
        windows, owners = [], []
        for d, words in enumerate(texts):
            if words:
                flat = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
                flat = np.concatenate([flat, np.zeros(max(0, WINDOW - len(flat)), np.int64)])
                starts = np.array(window_starts(len(words)))
                windows.append(flat[starts[:, None] + np.arange(WINDOW)])
                owners.append(np.full(len(starts), d))
        if not windows:
            return out
        rows, owner = np.concatenate(windows), np.concatenate(owners)
        best = np.full(len(texts), -np.inf)
        short = rows[:, -1] == 0
        for some, padded in ((np.flatnonzero(~short), False), (np.flatnonzero(short), True)):
            for a in range(0, len(some), 2048):
                own = rows[some[a : a + 2048]].T
                gates = np.stack([self.gates[own, 0], self.gates[own[::-1], 1]], axis=1)
                logit = forward(self.model, gates, (own > 0).astype(np.float32) if padded else None)
                np.maximum.at(best, owner[some[a : a + 2048]], logit)
        found = np.isfinite(best)
        out[found] = 1 / (1 + np.exp(-best[found]))
        return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, place) of the bounded sample: the first documents of each class in order of a
    hash of doc_id, which is their place."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    chosen = None
    for label in (0, 1):
        part = marked.where(F.col("toxic") == label).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_PER_CLASS)
        chosen = part if chosen is None else chosen.unionByName(part)
    short = docs.select("doc_id", "text").where(F.octet_length("text") <= MOST_TRAIN_BYTES)
    text = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    found = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(text)
    return found.withColumn("place", F.xxhash64("doc_id"))


def trained(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Trains in one task, where numerical libraries have a core each, over the bounded sample. Texts come in
    order of their places and are let go of once a class has its words."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], [0, 0]
        for batch in batches:
            for text, label in zip(column_values(batch, "text"), column_values(batch, "toxic")):
                words = words_of(text)
                if words and held[label] + len(words) <= MOST_TRAIN_WORDS:
                    rows.append((words, label))
                    held[label] += len(words)
        if len({label for _, label in rows}) == 2:
            yield pa.record_batch([pa.array([pickle.dumps(Trainer(rows).train())], pa.binary())], names=["model"])

    order = ["place", "doc_id", "toxic"]
    made = training_rows(docs, labels).repartition(1).sortWithinPartitions(*order).mapInArrow(train, "model binary").collect()  # one model, or none
    return pickle.loads(made[0]["model"]) if made else None


def _scorer(name: str, shared: Broadcast) -> Scorer:
    """One scorer a worker process: a module's function finds the module's own cache in every task."""
    return worker_tool(name, lambda: Scorer(shared.value))


def _scored(scorer: Scorer, batch: pa.RecordBatch) -> np.ndarray:
    """Scores of a batch's texts, a bounded number of words at a time."""
    out, group, held = [], [], 0
    for text in column_values(batch, "text"):
        group.append(words_of(text))
        held += len(group[-1])
        if held > GROUP_WORDS:
            out.append(scorer.scores(group))
            group, held = [], 0
    return np.concatenate([*out, scorer.scores(group)])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with held_out, score and predicted; columns of those names are replaced."""
    docs = docs.drop("held_out", "score", "predicted")
    if model is None:
        scored = docs.withColumn("score", F.lit(0.0))
    else:
        shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

        def start() -> Callable[[pa.RecordBatch], list[pa.Array]]:
            scorer = _scorer(name, shared)
            return lambda batch: [pa.array(_scored(scorer, batch))]

        scored = added(docs, "score double", start)
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"), trained(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic."""
    model = trained(docs, labels)
    if model is None:
        return docs
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def start() -> Callable[[pa.RecordBatch], list[bool]]:
        scorer = _scorer(name, shared)
        return lambda batch: (_scored(scorer, batch) < 0.5).tolist()

    return filtered(docs, start)
