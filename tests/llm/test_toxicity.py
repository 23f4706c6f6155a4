import random
import zlib

import numpy as np
import pytest

from tablewright.llm import toxicity as t


def numeric_gradient(trainer, some, target):
    weight = np.ones(len(some), np.float32)

    def loss():
        *_, gates, mask = trainer._inputs(trainer.windows[some], 0)
        logit = t.forward(trainer.model, gates, mask).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-logit)) * target + np.log1p(np.exp(logit)) * (1 - target)))

    *_, gates, mask = trainer._inputs(trainer.windows[some], 0)
    kept = []
    logit = t.forward(trainer.model, gates, mask, kept)
    g, _ = t.backward(trainer.model, ((t._sigmoid(logit) - target) / weight.sum()).astype(np.float32), mask, kept)
    rng = np.random.default_rng(1)
    for name in ("u", "aw", "av", "ow", "ob"):
        value = trainer.model.p[name]
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            before = value[at]
            value[at] = before + 1e-2
            up = loss()
            value[at] = before - 1e-2
            down = loss()
            value[at] = before
            yield g[name][at], (up - down) / 2e-2


def test_gradients():
    rng = random.Random(1)
    docs = [([rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(rng.choice([5, 40]))], k % 2) for k in range(12)]
    trainer = t.Trainer(docs)
    some = np.arange(min(12, len(trainer.windows)))
    target = (some % 2).astype(np.float32)
    for exact, approximate in numeric_gradient(trainer, some, target):
        assert exact == pytest.approx(approximate, abs=2e-4, rel=0.05)


def made(n, seed=1):
    rng = random.Random(seed)
    syllables = "an be con de er fo gi ha in ke lo ma no".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    docs = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(10, 200))]
        toxic = i % 4 == 0
        for _ in range(1 + len(words) // 60 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vileword", "zorgx" + word()]))
        docs.append((i, " ".join(words), int(toxic)))
    return docs


def test_learns_words_and_roots_and_scores_whole_texts(spark):
    docs = made(400)
    long = (1000, docs[1][1] * 60 + " vileword " + docs[2][1] * 60, 1)
    odd = [(1001, None, 0), (1002, "", 0), (1003, "!?", 0), (None, docs[1][1], 0)]
    df = spark.createDataFrame([d[:2] for d in docs + [long] + odd], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(d[0], d[2]) for d in docs] + [(None, 1), (2, None)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in t.digest(df, labels).collect()}
    assert len(rows) == 405
    for doc, row in rows.items():
        assert row["held_out"] == (doc is None or zlib.crc32(str(doc).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.5)
    held = [d for d in docs if rows[d[0]]["held_out"]]
    assert np.mean([rows[d[0]]["predicted"] == d[2] for d in held]) > 0.9
    odd = df.withColumn("odd: name", df["text"])
    kept = t.without_toxic(odd, labels)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in rows.items() if not r["predicted"]}
    assert rows[1000]["predicted"] == 1 and rows[1001]["score"] == rows[1002]["score"] == rows[1003]["score"] == 0


def test_learns_nothing_from_held_out_rows(spark):
    docs = made(60)
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(d[0], d[2]) for d in docs], "doc_id long, toxic int")
    found = {r["doc_id"] for r in t.training_rows(df, labels).collect()}
    assert found == {d[0] for d in docs if zlib.crc32(str(d[0]).encode()) % 5}


def test_without_labels_nothing_is_toxic(spark):
    df = spark.createDataFrame([(1, "a", "old")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r["score"], r["predicted"]) for r in t.digest(df, none).collect()] == [(0.0, 0)]
    assert t.without_toxic(df, none).columns == df.columns
    assert t.digest(df.limit(0), none).count() == 0


def test_windows_cover_every_word():
    for n in range(1, 200):
        starts = t.window_starts(n)
        assert {i for s in starts for i in range(s, min(n, s + t.WINDOW))} == set(range(n))
        assert all(b - a <= t.STRIDE for a, b in zip(starts, starts[1:]))


def test_scores_do_not_depend_on_the_batch():
    rng = random.Random(3)
    docs = [([rng.choice("abcdefgh") * rng.randint(2, 5) for _ in range(rng.randint(0, 90))], k % 2) for k in range(20)]
    model = t.Trainer([d for d in docs if d[0]]).model
    together = t.Scorer(model).scores([w for w, _ in docs])
    alone = [t.Scorer(model).scores([w])[0] for w, _ in docs]
    assert np.allclose(together, alone, atol=1e-6)


def test_the_sample_has_one_short_row_an_id(spark):
    docs = made(60)
    rows = [d[:2] for d in docs] + [(docs[0][0], f"again {k}") for k in range(50)] + [(docs[1][0], "x " * t.MOST_TRAIN_BYTES)]
    labels = spark.createDataFrame([(d[0], d[2]) for d in docs], "doc_id long, toxic int")
    found = t.training_rows(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(found) == len({r["doc_id"] for r in found}) and max(len(r["text"]) for r in found) <= t.MOST_TRAIN_BYTES
    assert {r["doc_id"] for r in found} == {d[0] for d in docs if zlib.crc32(str(d[0]).encode()) % 5}


def test_clashing_columns(spark):
    docs = made(80)
    df = spark.createDataFrame([(*d[:2], 1, "r", 2.0) for d in docs], "doc_id long, text string, `a.b` int, row string, score double")
    labels = spark.createDataFrame([(d[0], d[2]) for d in docs], "doc_id long, toxic int")
    kept = t.without_toxic(df, labels)
    assert kept.columns == df.columns and {(r["a.b"], r["row"], r["score"]) for r in kept.collect()} == {(1, "r", 2.0)}
    assert t.score(df, None).columns == ["doc_id", "text", "a.b", "row", "score", "held_out", "predicted"]
