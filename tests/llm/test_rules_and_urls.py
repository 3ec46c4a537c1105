import re
from collections import Counter

from pyspark.sql import functions as F

from scoutgrid.llm import quality_rules, url_filter

CLEAN = ("The cat and the dog went to the house by the river and it was a good day for them. " * 1
         + "They saw that the water is high, and not one of the boats was on it at this time of day.")
TEXTS = [None, "", " \t\n", CLEAN, CLEAN, CLEAN + "\n" + CLEAN, "a b c d e f g h " * 5, "x " * 40, "| a | b | c # $ " * 6 + CLEAN,
         "\n".join(["the line is here"] * 5 + [CLEAN]), "été\u2003naïve \x1c x\u00a0y " + CLEAN, "q" * 70000 + " " + CLEAN, "w\x0bx\x0cy\rz " + CLEAN]


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for k in range(8)}
    lines = [s for s in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    n, rep = len(w), len(covered)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n)


def test_counts_equal_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns(
        {c: F.lit(7) for c in ("row", "t", "w", "lines", "n_words", "kept")})
    got = {r["row"]["doc_id"]: r for r in quality_rules.judged(docs).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == counts(text), i
    kept = quality_rules.keep_clean(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {3, 4, 10, 12}
    assert got[8]["failed_rules"] == ["symbols"]
    assert got[11]["failed_rules"] == ["word_length"]


def test_rules_on_an_empty_table(spark):
    assert quality_rules.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0


URLS = [None, "", "no scheme", "https://a.b.example.com/de/x?y#z", "http://EXAMPLE.com/de", "http://example.com/de/", "ftp://x.net/en/1", "http://www.example.net/en/1#t",
        "http://example.net", "http://badexample.net/en/", "https://q.org/fr/a://b/c", "http://org/fr/", "http://q.org?x=/fr/", "http:///fr/", "x://h.net/" + "d/" * 3000]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("x.net", "/en", "allow"),
         (None, "/", "block"), ("example.com", "/de/x", "allow"), ("h.net", "", "block")]


def verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def test_urls_equal_brute_force(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(3, URLS[3])], "page_id long, url string").withColumn("host", F.lit("mine")).withColumn("key", F.lit(1))
    got = sorted((r["row"]["page_id"], (r["host"], r["path"], r["rule"], r["verdict"])) for r in url_filter.judged(pages, rules).collect())
    assert got == sorted([*((i, verdict(u)) for i, u in enumerate(URLS)), (3, verdict(URLS[3]))])


def test_urls_without_rules_or_rows(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judged(pages, rules).collect()] == ["allow"]
    assert url_filter.judged(pages.limit(0), rules).count() == 0
