"""URL filter: a blocked Bloom filter over listed canonical URLs, then an exact hash join.

A list entry is a host and a path prefix with a verdict; it fits its host and all subdomains. A URL's
possible entries are all of its host's suffixes with its path cut at the path lengths listed for that suffix.
Suffixes are probed in a filter of the listed hosts and cuts in one of the listed URLs, both blocked Bloom
filters (one 64-bit word a probe, K_BITS bits set in it, BITS_PER_ENTRY bits an entry), and what passes meets
the list in an exact hash join, which removes the filters' false positives. The longest rule wins: the greatest
length of host and path together. Entries of the method's own list carry no rule: where no rule fits, a URL
under a listed canonical URL is blocked and any other is allowed.

Rules meet host and path as they stand; the method's list meets the canonical URL, and its own entries are made
canonical too: the host without user, port and closing dots; the path with percent-coded unreserved characters
decoded, other codes in upper case, and empty, ``.`` and ``..`` segments resolved.

Distinct (host, path) pairs are judged once, so a host that fills a third of the table costs no more than its
distinct paths, and meet the pages again in a sort-merge join, which splits a hot URL. A filter of at most
MOST_WORDS words is broadcast (12 MB); a larger one is joined by its words.

Defined cases: a null URL or one without ``://`` has an empty host and path and is judged by the method;
repeated rows each get the verdict; entries with a null host or path fit nothing; other columns are carried
along, and those named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, boxed, settle

#: The rules of the query's contract (host, path prefix, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: The method's own list for the query: canonical URLs under which pages are blocked. Unwanted sites, under every
#: top-level domain.
UNWANTED = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED = [(f"{site}.example.{top}", "") for site in UNWANTED for top in ("com", "net", "org")]
BITS_PER_ENTRY, K_BITS, MOST_WORDS = 16, 4, 1 << 20
#: Fixed value: characters that mean the same with and without a percent code.
UNRESERVED = "[A-Za-z0-9._~-]"


def entries(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = tuple(RULES), listed: Sequence[tuple[str, str]] = tuple(LISTED)) -> DataFrame:
    """(e_host, e_path, e_verdict, is_rule) from literal lists; any DataFrame of this shape will do."""
    rows = [(h, p, v, True) for h, p, v in rules] + [(h, p, "block", False) for h, p in listed]
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if not rows:
        return spark.sql("SELECT '' AS e_host, '' AS e_path, '' AS e_verdict, true AS is_rule WHERE false")
    values = ", ".join(f"({quoted(h)}, {quoted(p)}, {quoted(v)}, {str(r).lower()})" for h, p, v, r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(e_host, e_path, e_verdict, is_rule)")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """The canonical host: without user, port and closing dots."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r"\.*(:[0-9]*)?\z", "")


def _decoded(path: Column) -> Column:
    """``path`` with the codes of unreserved characters decoded and other codes in upper case."""

    def part(x: Column, i: Column) -> Column:
        code, rest = F.upper(F.substring(x, 1, 2)), F.substring(x, 3, 1 << 30)
        char = F.char(F.conv(code, 16, 10).cast("long"))
        found = F.when(char.rlike(f"^{UNRESERVED}$"), F.concat(char, rest)).otherwise(F.concat(F.lit("%"), code, rest))
        return F.when(i == 0, x).when(x.rlike("^[0-9A-Fa-f]{2}"), found).otherwise(F.concat(F.lit("%"), x))

    return F.array_join(F.transform(F.split(path, "%", -1), part), "")


def _resolved(path: Column) -> Column:
    """``path`` without empty, ``.`` and ``..`` segments; the last one says whether it ends with a slash."""
    segments = F.split(path, "/", -1)
    last = F.element_at(segments, -1)
    none = F.array().cast("array<string>")
    step = lambda held, x: F.when(x == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).when(x.isin("", "."), held).otherwise(F.concat(held, F.array(x)))
    whole = F.concat(F.lit("/"), F.array_join(F.aggregate(segments, none, step), "/"))
    return F.when(last.isin("", ".", "..") & (whole != "/"), F.concat(whole, F.lit("/"))).otherwise(whole)


def page_of(path: Column) -> Column:
    """The canonical path."""
    plain = F.when(path.contains("%"), _decoded(path)).otherwise(path)
    return F.when(plain.rlike(r"/(\.{0,2})(/|$)"), F.when(plain == "/", plain).otherwise(_resolved(plain))).otherwise(plain)


def _word(host: str, path: str, words: int) -> Column:
    return F.pmod(F.xxhash64(host, path), F.lit(words)).cast("int")


def _mask(host: str, path: str) -> Column:
    bits = F.xxhash64(F.lit(2), host, path)
    out = F.lit(0).cast("long")
    for k in range(K_BITS):
        bit = F.pmod(F.shiftrightunsigned(bits, 6 * k), F.lit(64)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def bloom(listed: DataFrame, words: int, host: str = "e_host", path: str = "e_path") -> DataFrame:
    """(word, bits): the filter, one row a word that is not empty."""
    return listed.groupBy(_word(host, path, words).alias("word")).agg(F.bit_or(_mask(host, path)).alias("bits"))


def filter_words(n_entries: int) -> int:
    return max(64, 1 << (max(n_entries, 1) * BITS_PER_ENTRY // 64).bit_length())


def passed(probes: DataFrame, listed: DataFrame, n_entries: int, host: str, path: str) -> DataFrame:
    """The rows of ``probes`` whose (host, path) the filter over ``listed`` lets pass; both name the columns alike."""
    words = filter_words(n_entries)
    made = bloom(listed, words, host, path)
    made = F.broadcast(made) if words <= MOST_WORDS else made.hint("merge")
    probed = probes.withColumns({"word": _word(host, path, words), "mask": _mask(host, path)})
    return probed.join(made, "word").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).drop("word", "mask", "bits")


def possible_hits(places: DataFrame, listed: DataFrame) -> DataFrame:
    """Candidate entries (c_host, c_path) of each distinct (host, path) that the filters let pass, looked for as
    the pair stands (``plain``) and in its canonical form (``canonical``); most pairs are canonical."""
    listed = listed.select(F.col("e_host").alias("c_host"), F.col("e_path").alias("c_path"))
    hosts = listed.groupBy("c_host").agg(F.collect_set(F.char_length("c_path")).alias("lengths")).withColumn("no_path", F.lit(""))
    facts = listed.agg(F.count("*").alias("urls"), F.count_distinct("c_host").alias("hosts")).first()
    site, page = site_of(F.col("host")), page_of(F.col("path"))
    formed = places.select("host", "path", site.alias("site"), page.alias("page"))
    same = (F.col("site") == F.col("host")) & (F.col("page") == F.col("path"))
    form = lambda host, path, plain, canonical: F.struct(F.col(host).alias("l_host"), F.col(path).alias("l_path"), plain.alias("plain"), canonical.alias("canonical"))
    as_is = form("host", "path", F.lit(True), same)
    both = F.array(as_is, form("site", "page", F.lit(False), F.lit(True)))
    looked = formed.select("host", "path", F.explode(F.when(same, F.array(as_is)).otherwise(both)).alias("look")).select("host", "path", "look.*")
    parts = F.split("l_host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    wide = looked.select("host", "path", "l_path", "plain", "canonical", F.explode(suffixes).alias("c_host")).withColumn("no_path", F.lit(""))
    near = passed(wide, hosts, facts["hosts"], "c_host", "no_path").join(hosts.select("c_host", "lengths"), "c_host")
    fitting = F.filter("lengths", lambda n: n <= F.char_length("l_path"))
    cuts = near.select("host", "path", "l_path", "plain", "canonical", "c_host", F.explode(fitting).alias("n"))
    cuts = cuts.select("host", "path", "plain", "canonical", "c_host", F.col("l_path").substr(F.lit(1), F.col("n")).alias("c_path"))
    return passed(cuts, listed, facts["urls"], "c_host", "c_path")


def canonical(listed: DataFrame) -> DataFrame:
    """``listed`` with the entries of the method's list in canonical form."""
    own = lambda made, column: F.when(F.col("is_rule"), F.col(column)).otherwise(made(F.col(column))).alias(column)
    return listed.select(own(lambda h: F.translate(site_of(h), UPPER, LOWER), "e_host"), own(page_of, "e_path"), "e_verdict", "is_rule")


def judge(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    listed = canonical(listed)
    placed = boxed(pages.drop("host", "path", "rule", "verdict"), "url").select("row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hits = possible_hits(placed.select("host", "path").distinct(), listed)
    exact = hits.join(listed, (F.col("c_host") == F.col("e_host")) & (F.col("c_path") == F.col("e_path"))).where(F.when(F.col("is_rule"), F.col("plain")).otherwise(F.col("canonical")))
    name = F.concat("e_host", "e_path")
    best = exact.groupBy("host", "path").agg(
        F.max(F.when(F.col("is_rule"), F.struct(F.char_length(name).alias("len"), name.alias("rule"), F.col("e_verdict").alias("verdict")))).alias("best"),
        F.bool_or(~F.col("is_rule")).alias("on_list"),
    )
    judged = placed.join(settle(best, "judged").hint("merge"), ["host", "path"], "left")  # as many as distinct URLs, so never broadcast
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("on_list"), "block"), F.lit("allow"))
    return judged.select("row.*", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def digest(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url"), entries(pages.sparkSession)).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = rf"""
WITH entries(e_host, e_path, e_verdict, is_rule) AS (VALUES
  {", ".join([f"('{h}', '{p}', '{v}', true)" for h, p, v in RULES] + [f"('{h}', '{p}', 'block', false)" for h, p in LISTED])}
), cut AS (
  SELECT page_id, url, strpos(url, '://') AS mark, row_number() OVER () AS rn FROM pages
), rest AS (
  SELECT page_id, rn, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS r FROM cut
), placed AS (
  SELECT page_id, rn,
         translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), sites AS (
  SELECT *, regexp_replace(regexp_replace(host, '^.*@', '', 's'), '\.*(:[0-9]*)?\z', '') AS site FROM placed
), fits AS (
  SELECT p.rn, e.is_rule, e.e_host || e.e_path AS rule, e.e_verdict
  FROM sites p JOIN entries e
    ON CASE WHEN e.is_rule THEN (p.host = e.e_host OR suffix(p.host, '.' || e.e_host)) AND starts_with(p.path, e.e_path)
            ELSE p.site = e.e_host OR suffix(p.site, '.' || e.e_host) END
), best AS (
  SELECT rn, arg_max(rule, length(rule)) FILTER (WHERE is_rule) AS rule,
         arg_max(e_verdict, length(rule)) FILTER (WHERE is_rule) AS verdict, bool_or(NOT is_rule) AS on_list
  FROM fits GROUP BY rn
)
SELECT p.page_id, p.host, p.path, b.rule,
       coalesce(b.verdict, CASE WHEN b.on_list THEN 'block' END, 'allow') AS verdict
FROM placed p LEFT JOIN best b USING (rn)
"""
