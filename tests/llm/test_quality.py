import math
import random
from collections import Counter

import duckdb
import pytest
import sentencepiece

from tablewright.llm import quality


def brute_repeat(words):
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 5)})


def test_repeats_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        words = [rng.choice("abc" if rng.random() < 0.7 else "abcdefgh") for _ in range(rng.randrange(60))]
        assert quality.repeated_words(words) == brute_repeat(words)


def test_base_measures():
    text = "one two\x0bthree\u00a0four\n#tag $5 50% <a>\nOne\none two\x0bthree\u00a0four\n\n  \n  "
    n, chars, symbols, dup, repeat, failed = quality.base(text)
    words = ["one", "two", "three\u00a0four", "#tag", "$5", "50%", "<a>", "One", "one", "two", "three\u00a0four"]
    assert (n, chars, symbols, dup, repeat, failed) == (11, sum(map(len, words)), 5, 1, 0, False)
    assert quality.base(None) == quality.base("") == (0, 0, 0, 0, 0, True)
    assert quality.base("a b c d e f g h i j " * 3)[-1] is True


@pytest.mark.parametrize(("text", "script"), [("plain text", "latin"), ("", "latin"), ("123 !?", "latin"), ("Привет мир", "cyrillic"), ("日本語の文", "cjk"), ("abc déf 日", "latin"), ("שלום", "hebrew"), ("ภาษาไทย", "other"), ("“–” only signs", "latin")])
def test_scripts(text, script):
    assert quality.script_of(text) == script


def test_verdicts(spark):
    rng = random.Random(2)
    syllables = "an be con de er fo gi ha in ke lo ma no or pe ra se ti un vo".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    clean = [" ".join(word() for _ in range(200)) for _ in range(5)]
    junk = ["".join(chr(rng.randrange(0x1F300, 0x1F600)) + " " for _ in range(200)), "\u200b ".join("x" * 40 for _ in range(60)), " ".join("\U0001d400\U0001d7ff" for _ in range(40))]
    docs = [(i, t, None) for i, t in enumerate(clean + junk + [None, "", "few words"])]
    df = spark.createDataFrame(docs, "doc_id long, text string, kept string")
    rows = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert all(rows[i]["kept"] for i in range(5)) and not any(rows[i]["kept"] for i in range(5, 11))
    assert quality.digest(df.limit(0)).count() == 0
    odd = quality.judge(df.withColumn("odd, name", df["kept"]))
    assert odd.count() == 11 and odd.columns[:3] == ["doc_id", "text", "odd, name"]


def test_fertility_of_bytes():
    made = quality.Fertility(quality.tokenizer_path("piece_bpe_32k.model"))
    (plain, odd, none) = list(made.measure(["the plain words of a text", "\U0001d7ff\U0001d7fe", ""]))
    assert plain[1] == 0 and odd[1] > 0.7 and none == (0.0, 0.0, 0.0) and plain[0] > odd[0]


def test_bands_of_languages():
    made = lambda lang, *m, text="plain text": quality.within(text, *m, quality.BANDS, lang)
    assert made("en", 2.6, 0.01, 0.78) and made("EN-gb", 2.6, 0.01, 0.78) and made("en", 4.6, 0.0, 0.94)
    assert not made("en", 2.2, 0.01, 0.78) and not made("en-US", 2.2, 0.01, 0.78) and made("fr", 2.2, 0.01, 0.78)
    assert not made("en", 2.6, 0.06, 0.78) and not made("en", 2.6, 0.01, 0.70)
    assert made(None, 2.2, 0.01, 0.70) and made("pl", 2.2, 0.01, 0.70) and made("en", 1.2, 0.01, 0.70, text="Привет мир")


def test_low_quality_rows_are_rejected(spark):
    path = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = [r for r in quality.digest(spark.read.parquet(f"{path}/documents.parquet")).collect() if r["doc_id"] in labels and not r["base_failed"]]
    kept = lambda label: [r["kept"] for r in rows if labels[r["doc_id"]] == label]
    assert sum(kept(0)) <= 0.3 * len(kept(0)) and sum(kept(1)) >= 0.95 * len(kept(1))


def judged_by_brute_force(text, lang):
    """All measures of a row by plain loops over characters, lines and tokens."""
    text, space = text or "", " \t\n\x0b\x0c\r"
    words = "".join(" " if c in space else c for c in text).split(" ")
    words = [w for w in words if w]
    lines = [x for x in text.split("\n") if x.strip(space)]
    repeat = brute_repeat(words)
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    model = sentencepiece.SentencePieceProcessor(model_file=quality.tokenizer_path("piece_bpe_32k.model"))
    ids = model.encode(text, num_threads=1)
    counts = Counter(ids)
    entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values())
    share = entropy / math.log2(min(len(ids), 400)) if len(ids) > 1 else 0.0
    band = quality.BANDS.get(f"latin/{lang}", quality.BANDS["latin"])
    fits = bool(ids) and band.low <= len(text) / len(ids) <= band.high and sum(map(model.is_byte, ids)) / len(ids) <= band.bytes_share and share >= band.entropy
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, failed, not failed and fits


def test_the_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = {r["doc_id"]: judged_by_brute_force(r["text"], r["lang"]) for r in docs.collect()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in quality.digest(docs).collect()} == expected


def test_base_columns_against_sql(spark):
    found = quality.digest(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    sql = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM '/root/testdata/sf0.01/documents.parquet'),
    w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d)
    SELECT doc_id, len(ws), coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')), len(ls) - len(list_distinct(ls)) FROM w"""
    expected = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    assert {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) for r in found} == expected


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(["ander", "oporse", "tiun", "voma"]) + str(rng.randrange(9)) for _ in range(400_000))
    df = spark.createDataFrame([(1, long, 1, 2), (None, None, None, None)], "doc_id long, text string, row int, `a.b` int")
    out = quality.judge(df)
    assert out.columns[:4] == df.columns
    assert {(r["doc_id"], r["n_words"], r["a.b"]) for r in out.collect()} == {(1, 400_000, 2), (None, 0, None)}
