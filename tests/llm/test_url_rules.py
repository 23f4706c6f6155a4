import itertools
import re

from pyspark.sql import functions as F

from tablewright.llm import url_rules

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url, rules, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
    fits = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p)
    found = sorted((r for r in rules if fits(r[0], r[1])), key=lambda r: len(r[0] + r[1]))
    if found:
        return host, path, found[-1][0] + found[-1][1], found[-1][2]
    host_, path_ = host, path
    host, path = re.sub(r"(?s)^.*@", "", host), path
    host = re.sub(r":[0-9]*\Z", "", host).rstrip(".")
    return host_, path_, None, "block" if any(fits(h, p) for h, p in listed) else "allow"


def test_against_brute_force(spark):
    hosts = ["example.com", "a.example.com", "EXAMPLE.net", "b.c.example.net", "x.org", "notexample.com", "com", "blog.cheap-pills.example.net", "casino-win.example.net.", ""]
    paths = ["", "/", "/en/", "/en/7", "/en/70/x?y=/de/", "/de/8#z", "/de/9", "/es/1\n/en/", "/EN/7", "/x"]
    urls = [f"http://{h}{p}" for h, p in itertools.product(hosts, paths)] + [None, "", "no scheme/en/", "://", "a://b://example.com/en/", "http://example.com/en/7", "http://example.com?/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.digest(df).collect()}
    assert got == {i: brute(u, url_rules.RULES, url_rules.LISTED) for i, u in enumerate(urls)}


def test_long_lists_empty_lists_and_extra_columns(spark):
    rules = [(f"h{i}.net", f"/p{j}/", "block" if (i + j) % 2 else "allow") for i in range(60) for j in range(10)]
    df = spark.createDataFrame([(i, f"https://www.h{i % 80}.net/p{i % 12}/page", "mine") for i in range(500)], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(df, url_rules.entries(spark, rules, [])).collect()}
    assert got == {r["page_id"]: brute(r["url"], rules, []) for r in df.collect()}
    assert {r["verdict"] for r in url_rules.judge(df, url_rules.entries(spark, [], [])).collect()} == {"allow"}
    assert url_rules.digest(df.limit(0)).count() == 0


def test_a_list_of_a_million_urls(spark, capsys):
    """No false negatives, few false positives, and every verdict exact."""
    listed = spark.range(1_000_000).select(F.format_string("h%d.net", F.col("id") % 200_000).alias("e_host"), F.format_string("/p%d/", F.floor(F.col("id") / 200_000)).alias("e_path"), F.lit("block").alias("e_verdict"), F.lit(False).alias("is_rule"))
    places = spark.range(40_000).select(F.format_string("www.h%d.net", F.col("id") * 10).alias("host"), F.format_string("/p%d/x", F.col("id") % 10).alias("path"))
    found = url_rules.possible_hits(places, listed)
    right = found.join(listed, (found["c_host"] == listed["e_host"]) & (found["c_path"] == listed["e_path"])).count()
    assert right == 10_000  # half the hosts and half the paths are listed
    missing = places.select("host", "path", F.regexp_replace("host", "^www.", "x").alias("e_host"), "path").select("e_host", F.col("path").alias("e_path"))
    let = url_rules.passed(missing, listed.select("e_host", "e_path"), 1_000_000, "e_host", "e_path").count()
    assert let / 40_000 < 0.02
    pages = places.select(F.monotonically_increasing_id().alias("page_id"), F.concat(F.lit("https://"), "host", "path").alias("url"))
    assert url_rules.judge(pages, listed).where("verdict = 'block'").count() == 10_000


def test_a_filter_too_large_to_broadcast(spark, monkeypatch):
    rules = [(f"h{i}.net", f"/p{i % 3}", "block") for i in range(300)]
    df = spark.createDataFrame([(i, f"http://a.h{i}.net/p{i % 2}/x") for i in range(600)], "page_id long, url string")
    monkeypatch.setattr(url_rules, "MOST_WORDS", 8)
    judged = url_rules.judge(df, url_rules.entries(spark, rules, []))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judged.collect()}
    assert got == {r["page_id"]: brute(r["url"], rules, []) for r in df.collect()}


def test_canonical_paths(spark):
    cases = {"": "", "/": "/", "/a/b": "/a/b", "//a": "/a", "/a/./b/": "/a/b/", "/a/../b": "/b", "/../a/..": "/", "/a/.": "/a/", "/%61%2f%7E/%zz%": "/a%2F~/%zz%", "/.hidden/..x": "/.hidden/..x", "/a//": "/a/", "/%2e%2e/a": "/a"}
    rows = spark.createDataFrame([(k,) for k in cases], "path string").select("path", url_rules.page_of(F.col("path")).alias("page")).collect()
    assert {r["path"]: r["page"] for r in rows} == cases


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://x.com/en/", 1, 2, 3, "h", 5), (None, None, None, None, None, None, None)], "page_id long, url string, best int, on_list int, `a.b` int, host string, row int")
    out = url_rules.judge(df, url_rules.entries(spark))
    assert out.columns == ["page_id", "url", "best", "on_list", "a.b", "row", "host", "path", "rule", "verdict"]
    assert {(r["page_id"], r["best"], r["row"], r["host"], r["rule"]) for r in out.collect()} == {(1, 1, 5, "x.com", "com/en/"), (None, None, None, "", None)}


def test_the_list_blocks_unwanted_sites_in_every_spelling(spark):
    sites = [f"{sub}{site}.example.{top}" for sub in ("", "www.") for site in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]
    urls = [form.format(s) for s in sites for form in ("http://{}/x", "https://{}", "http://{}:8080/x", "http://me:pw@{}/x", "http://{}./x", "http://{}.:443?q")]
    fine = ["http://example.com/x", "http://notcasino-win.example.com/x", "http://casino-win.example.com.other.org/x"]
    df = spark.createDataFrame(list(enumerate(urls + fine)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_rules.digest(df).collect()}
    assert [urls[i] for i in range(len(urls)) if got[i]["verdict"] != "block"] == []
    assert {got[len(urls) + i]["verdict"] for i in range(len(fine))} == {"allow"}
    assert got[2]["host"] == "ads-track.example.com:8080" and got[2]["path"] == "/x"  # columns stay as they are


def test_only_the_list_is_matched_canonically(spark):
    entries = url_rules.entries(spark, [("r.net", "/a/b", "block")], [("l.net", "/a/b")])
    df = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(itertools.product(["r.net", "r.net:80", "l.net", "u@l.net:80"], ["/a/b", "//a/./b/c", "/a"]))], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(df, entries).collect()}
    assert [got[i][1] for i in range(12)] == ["block"] + ["allow"] * 5 + ["block", "block", "allow"] * 2
    assert {got[i][0] for i in range(1, 12)} == {None}
