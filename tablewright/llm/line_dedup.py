"""Line deduplication over whole corpora, in DataFrame functions only.

Lines are reduced to 128-bit hashes of their keys, written once to the shared folder, range-partitioned
on the hash and sorted by (document, position); one running window then sees the first occurrence of a
hash before all others. What comes back is one run-length coded keep bitmap per changed document, never
text; ``apply_bitmaps`` turns bitmaps into texts.

A hash that holds more than 1/HOT_PARTS of all lines would fill one range, so such hashes (fewer than
HOT_PARTS of them, whatever the corpus) are taken out by a pre-aggregated count and meet their first
document through a broadcast of that bounded list.

Defined cases: a null or empty text is one empty line; a null doc_id neither owns nor loses lines;
rows that share a doc_id are one document for ownership, so neither drops the other's lines; repeated
rows get the same bitmap; columns other than doc_id and text are carried along untouched, but n_lines and
n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, LOWER, UPPER, settle

MIN_KEY_CHARS = 10
HOT_PARTS = 1000


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_mark(text: Column) -> Column:
    """Tells apart rows that share a doc_id but not a text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """(doc_id, mark, pos, h1, h2) of each line whose key has at least ``min_chars`` code points."""
    lines = docs.where(F.col("doc_id").isNotNull()).select("doc_id", _text_mark(F.col("text")).alias("mark"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "mark", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("doc_id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """(doc_id, mark, runs) for documents that lose lines. ``runs`` is the keep bitmap as run lengths:
    lines kept, then dropped, then kept, and so on; lines after the last run are kept."""
    lines = settle(line_hashes(docs.select("doc_id", "text"), min_chars), "lines")
    counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    total = lines.count()
    hot = F.broadcast(counts.where(F.col("n") * HOT_PARTS > F.lit(total)).select("h1", "h2", "first_doc"))  # under HOT_PARTS rows
    running = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cold = lines.join(hot, ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2").withColumn("first_doc", F.first("doc_id").over(running))
    common = ["doc_id", "mark", "pos", "first_doc"]
    later = cold.select(common).unionByName(lines.join(hot, ["h1", "h2"]).select(common)).where(F.col("doc_id") > F.col("first_doc"))
    dropped = later.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    return dropped.select("doc_id", "mark", F.size("at").cast("long").alias("n_dropped"), _runs(F.col("at")).alias("runs"))


def _runs(at: Column) -> Column:
    """Run lengths (kept, dropped, kept, ...) from sorted dropped positions."""
    starts = F.filter(at, lambda p, i: F.coalesce(F.get(at, i - 1), F.lit(-2)) != p - 1)
    ends = F.transform(F.filter(at, lambda p, i: F.coalesce(F.get(at, i + 1), F.lit(-2)) != p + 1), lambda p: p + 1)
    edges = F.flatten(F.zip_with(starts, ends, lambda s, e: F.array(s, e)))
    return F.transform(edges, lambda e, i: e - F.coalesce(F.get(edges, i - 1), F.lit(0)))


def _bits(runs: Column) -> Column:
    """One byte a line, 1 kept or 0 dropped, so that a line's bit is read in constant time."""
    return F.array_join(F.transform(runs, lambda n, i: F.repeat(F.when(i % 2 == 0, "1").otherwise("0"), n)), "").cast("binary")


def _applied(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(row, text, n_lines, n_dropped): whole rows, and what their bitmaps make of their texts."""
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"], _text_mark(docs["text"]).alias("mark"))
    marks = bitmaps.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "n_dropped", _bits(F.col("runs")).alias("bits"))
    joined = rows.join(marks, (F.col("doc_id") == F.col("d")) & (F.col("mark") == F.col("m")), "left")
    lines = split_lines(F.col("row.text"))
    kept = F.filter(lines, lambda _, i: F.substring(F.col("bits"), i + 1, F.lit(1)) != F.lit(b"0"))
    text = F.when(F.col("n_dropped").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    gone = F.coalesce("n_dropped", F.lit(0).cast("long"))
    return joined.select("row", text.alias("text"), F.size(lines).cast("long").alias("n_lines"), gone.alias("n_dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines gone from text, plus n_lines and n_dropped, which replace columns of those
    names."""
    made = _applied(docs.drop("n_lines", "n_dropped"), bitmaps)
    return made.select(F.col("row").withField("text", F.col("text")).alias("row"), "n_lines", "n_dropped").select("row.*", "n_lines", "n_dropped")


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """``docs`` with texts that have lost the lines an earlier document holds; where there is a column n_chars, it
    follows the text. A document that loses all its lines stays, empty."""
    made = _applied(docs, keep_bitmaps(docs, min_chars))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return made.select(row.alias("row")).select("row.*")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars))


def digest(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key
), judged AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first_doc, false) AS gone
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
