import random

from pyspark.sql import functions as F

from tablewright.llm import line_dedup

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    first = {}
    for d, t in docs:
        if d is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 10:
                    first[key(line)] = min(first.get(key(line), d), d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or first.get(key(x), d) >= d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def random_docs(n):
    rng = random.Random(1)
    lines = [f"line number {i} of many" for i in range(40)] + ["short", "", "  ", "ÄÖÜ äöü zwölf Zeichen", "\u00a0\u00a0not ascii space\u00a0"]
    vary = lambda x: rng.choice([x, x.upper(), f"  {x}\t", x])
    return [(rng.randrange(n) if rng.random() < 0.1 else i, "\n".join(vary(rng.choice(lines)) for _ in range(rng.randrange(12)))) for i in range(n)]


def test_against_brute_force(spark):
    docs = random_docs(300) + [(400, None), (401, ""), (402, "\n\n"), (None, "line number 1 of many\nother line here"), (403, "word " * 20000 + "\nline number 3 of many")]
    docs += [docs[5], docs[5]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in line_dedup.dedup_lines(df).collect()]
    assert sorted(got, key=str) == sorted(brute(docs), key=str)


def test_hot_lines_are_the_same(spark):
    docs = [(i, f"a line that all share\nown line of document {i}\na line that all share") for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    dropped = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(df).collect()}
    assert dropped == {i: 2 * (i > 0) for i in range(1500)}


def test_bitmaps_hold_no_text(spark):
    df = spark.createDataFrame([(1, "first line of all\nx"), (2, "a\nfirst line of all\nb\nfirst line of all\nfirst line of all\nc")], "doc_id long, text string")
    found = line_dedup.keep_bitmaps(df).collect()
    assert [(r["doc_id"], r["runs"], r["n_dropped"]) for r in found] == [(2, [1, 1, 1, 2], 3)]


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, h1 int, pos string, n_lines int")
    assert line_dedup.dedup_lines(empty).count() == 0
    df = spark.createDataFrame([(1, "some long line", 5), (2, "some long line", 6)], "doc_id long, text string, runs int")
    out = line_dedup.dedup_lines(df).orderBy("doc_id").collect()
    assert [(r["text"], r["runs"]) for r in out] == [("some long line", 5), ("", 6)]
    assert line_dedup.digest(df.withColumn("text", F.lit(None).cast("string"))).select("n_lines").distinct().collect()[0][0] == 1


def test_clashing_columns(spark):
    rows = [(1, "a line that is long enough\nx", 1, 2, 3, 4, 5), (2, "a line that is long enough\ny", 1, 2, 3, 4, 5), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __doc int, mark int, row int, `a.b` int, n_lines int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "__doc", "mark", "row", "a.b", "n_lines", "n_dropped"]
    found = {r["doc_id"]: (r["text"], r["n_dropped"], r["n_lines"], r["mark"], r["a.b"]) for r in out.collect()}
    assert found == {1: (rows[0][1], 0, 2, 2, 4), 2: ("y", 1, 2, 2, 4), None: (None, 0, 1, None, None)}
