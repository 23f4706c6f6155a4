import random

import numpy as np
import pytest

from tablewright.llm import components, near_dup


def brute(docs):
    """Classes by all pairs: a number for every row."""
    bags = [near_dup.bag_of(t) for _, t in docs]
    bare = [(t or "").strip() for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            inter, union = near_dup.overlap(bags[a], bags[b])
            if 5 * inter >= 4 * union and (union or bare[a] == bare[b]):
                parent[root(a)] = root(b)
    return [root(i) for i in range(len(docs))]


def classes_of(ids, names):
    """The partition that class names say, as sorted lists of ids."""
    out = {}
    for d, c in zip(ids, names):
        out.setdefault(c, []).append(str(d))
    return sorted(sorted(x) for x in out.values())


def near_copies(rng, n, words, edits):
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.choice(edits)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        out.append(" ".join(copy))
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    texts = near_copies(rng, 150, 150, [1, 2, 4, 6, 9]) + near_copies(rng, 12, 40, [0, 1, 2]) + near_copies(rng, 30, 300, [0])
    texts += [" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [None, "", " \n", "!!!", "!!! ", "???", "漢字仮名交文。" * 9, "漢字仮名交文。" * 9 + "字", "天地玄黃宇宙洪荒日月盈昃辰宿列張", "one two", "One, two!", "one two three", "long " * 30000]
    made = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    return made + [made[3], made[3], (made[4][0], "another text of the same id that is alone"), (None, texts[0]), (None, "only here without an id at all")]


def test_classes_are_those_of_all_pairs(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = near_dup.digest(df).collect()
    ids = [d for d, _ in docs]
    assert classes_of([r["doc_id"] for r in found], [r["class_id"] for r in found]) == classes_of(ids, brute(docs))
    with_id = {r["class_id"] for r in found if r["class_id"] >= 0}
    assert with_id == {min(int(d) for d in c if d != "None") for c in classes_of(ids, brute(docs)) if c != ["None"]}


def test_one_of_each_class_stays(spark, docs):
    df = spark.createDataFrame([(d, t, i % 3, "x") for i, (d, t) in enumerate(docs)], "doc_id long, text string, comp int, mark string").repartition(5)
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    rows, found = kept.collect(), brute(docs)
    at = {(d, t): c for (d, t), c in zip(docs, found)}
    assert sorted(at[r["doc_id"], r["text"]] for r in rows) == sorted(set(found))
    assert "another text of the same id that is alone" in [r["text"] for r in rows]


def test_ids_shared_by_unlike_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b), (5, b), (6, a), (None, a), (None, "only here"), (None, "only here")]
    columns = "doc_id long, text string, __copies int, __doc int, row int, `a.b` int, d int"
    df = spark.createDataFrame([(*r, 0, 0, 0, 0, 0) for r in rows], columns)
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, [(1, a), (1, b), (None, "only here")]))
    found = near_dup.digest(df).collect()
    assert classes_of([r["doc_id"] for r in found], [r["class_id"] for r in found]) == [["1", "5"], ["1", "6", "None"], ["None", "None"]]


def test_units_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LARGE", 8)
    for name, value in (("CHUNK_ROWS", 20), ("BLOCK_ROWS", 7), ("SPREAD", 3), ("LEAST_ROWS", 5)):
        monkeypatch.setattr(near_dup, name, value)
    rng = random.Random(9)
    texts = near_copies(rng, 120, 60, [1, 2, 3, 4, 5])
    rows = list(enumerate(texts))
    found = near_dup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert classes_of([r["doc_id"] for r in found], [r["class_id"] for r in found]) == classes_of(range(len(rows)), brute(rows))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    error = []
    for share in (0.2, 0.5, 0.8, 1.0):
        for _ in range(30):
            hashes = rng.integers(0, 2**63, 200, dtype=np.uint64)
            a = rng.integers(1, 9, 200)
            b = np.where(rng.random(200) < share, a, rng.integers(0, 9, 200))
            signature = near_dup.signatures_of([np.repeat(hashes, a), np.repeat(hashes, b)])
            error.append((signature[0] == signature[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(error)) < 0.01 and np.std(error) < 0.06


def test_a_signature_does_not_depend_on_its_group():
    rng = np.random.default_rng(3)
    bags = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 0, 50, 3000)]
    together = near_dup.signatures_of(bags)
    for bag, row in zip(bags, together):
        assert (near_dup.signatures_of([bag])[0] == row).all()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.digest(empty).count() == 0 and near_dup.keep_one(empty).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 600)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    expected = {x: root(x) for x in list(parent)}
    half = len(edges) // 2
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    assert {r["node"]: r["comp"] for r in components.components(frame(edges)).collect()} == expected
    labels = components.merged(components.merged(None, frame(edges[:half])), frame(edges[half:]))
    assert {r["node"]: r["comp"] for r in labels.collect()} == expected
