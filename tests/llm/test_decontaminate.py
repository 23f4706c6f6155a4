import random

import numpy as np
import pytest

from tablewright.llm import decontaminate as d


def edits_brute(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(400):
        item, text = ([rng.choice("abcd") for _ in range(n)] for n in (rng.randint(1, 14), rng.randint(0, 25)))
        found, end = d.edit_distance(item, text)
        assert found == edits_brute(item, text)
        assert found == edits_brute(item, text[:end])


def edited(rng, words, edits, vocabulary):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.4:
            words[at] = rng.choice(vocabulary)
        elif kind < 0.7:
            del words[at]
        else:
            words.insert(at, rng.choice(vocabulary))
    return words


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(800)] + ["the", "of"] * 200
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(8, 70))]) for i in range(40)]
    docs = []
    for k in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        if k % 2:
            _, item = items[rng.randrange(40)]
            at = rng.randint(0, len(words))
            words[at:at] = edited(rng, item, rng.randint(0, d.most_edits(len(item)) + 2), vocabulary)
        docs.append((k, " ".join(words)))
    return items, docs


def test_against_brute_force(spark, corpus):
    items, docs = corpus
    df = spark.createDataFrame(docs + [(500, None), (501, "")], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, ", ".join(w).upper()) for i, w in items] + [(900, ""), (901, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in d.leaks(df, bench).collect()}
    expected = {}
    for k, text in docs:
        for i, words in items:
            e = edits_brute(words, text.split())
            if e <= d.most_edits(len(words)):
                expected[k, i] = e
    assert set(got) <= set(expected) and len(got) >= 0.97 * len(expected)
    assert {k for k, v in expected.items() if v == 0} <= set(got)
    assert sum(got[k] != expected[k] for k in got) <= 0.03 * len(got)
    kept = {r["doc_id"] for r in d.without_leaks(df, bench).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _ in got} | {500, 501}


def test_blocks_give_the_same(spark, corpus, monkeypatch):
    items, docs = corpus
    df = spark.createDataFrame(docs[:60], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = lambda: sorted((r["doc_id"], r["item_id"], r["edits"]) for r in d.leaks(df, bench).collect())
    once = found()
    monkeypatch.setattr(d, "BLOCK_ITEMS", 7)
    assert found() == once


def test_few_edits_leave_most_of_an_embedding():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 2**63, 40, dtype=np.uint64)
    changed = words.copy()
    changed[10] = 5
    other = rng.integers(1, 2**63, 40, dtype=np.uint64)

    def same(x, y, s):
        """Share of equal steps among those in which either walk is still within its window."""
        a, b = d.walk(x, np.array([0]), 40, s)[:, 0], d.walk(y, np.array([0]), 40, s)[:, 0]
        assert len(a) == 120 and set(x.tolist()) == set(a.tolist()) - {0}  # three steps a word reach the last one
        return (a == b)[(a > 0) | (b > 0)].mean()

    mean = lambda y: np.mean([same(words, y, s) for s in range(30)])
    assert mean(words) == 1 and mean(changed) > 0.6 and mean(other) < 0.1


def test_short_items_repeated_items_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma here"), (2, "alpha beta"), (None, "x alpha beta gamma"), (1, "again alpha beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Alpha beta, gamma!"), (2, "alpha beta gamma")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in d.leaks(docs, bench).collect()}
    assert found == {(1, 1), (None, 1)} and {r["copies"] for r in d.leaks(docs, bench).collect()} == {2}
    assert sorted(tuple(r) for r in d.item_classes(bench).collect()) == [(1, "alpha beta gamma", 1), (2, "alpha beta gamma", 1)]
    assert [r["doc_id"] for r in d.without_leaks(docs, bench).collect()] == [2]
    assert d.leaks(docs, bench.limit(0)).count() == 0 and d.leaks(docs.limit(0), bench).count() == 0
    assert d.without_leaks(docs, bench.limit(0)).count() == 4


def test_rows_are_judged_by_their_own_text(spark):
    leak = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(None, leak), (None, "clean text"), (7, "so " + leak), (7, "clean as well"), (8, None)]
    columns = "doc_id long, text string, __doc int, row int, `a.b` int, item_id long"
    docs = spark.createDataFrame([(*r, 0, 0, 0, None) for r in rows], columns)
    kept = d.without_leaks(docs, spark.createDataFrame([(1, leak)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, [(None, "clean text"), (7, "clean as well"), (8, None)]))


def test_scripts_without_spaces():
    item = "天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏"
    index = d.Items([(1, " ".join(d.words_of(item)))])
    found = d.matches(index, ["前" * 9 + item[:10] + "誤" + item[11:] + "後" * 9, item[:5], "x " + item])
    assert [f.get(1, (None,))[0] for f in found] == [1, None, 0]


def test_repeated_items_are_one(spark):
    bench = spark.createDataFrame([(i, "x " * 10) for i in range(25)] + [(None, "X, " * 10)], "item_id long, text string")
    assert list(d.blocks(bench)) == [[((0, 26), " ".join(["x"] * 10))]]


@pytest.mark.parametrize("n", [10, 20, 31, 40, 64, 150, 256, 400])
def test_long_items_are_found_at_the_greatest_number_of_edits(n):
    rng = random.Random(n)
    items = [[f"i{k}w{j}" for j in range(n)] for k in range(30)]
    index, texts = d.Items([(k, " ".join(w)) for k, w in enumerate(items)]), []
    for w in items:
        gone = set(rng.sample(range(n), d.most_edits(n)))
        texts.append(" ".join(["before"] * 20 + [x for j, x in enumerate(w) if j not in gone] + ["after"] * 20))
    found = d.matches(index, texts)
    assert sum(k in m for k, m in enumerate(found)) >= 29
    assert all(m[k][0] == d.most_edits(n) and 20 <= m[k][1] <= 30 for k, m in enumerate(found) if k in m and n >= 64)
