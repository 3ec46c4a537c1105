"""URL filters: host suffixes and path prefixes of every URL meet the rules in an equi-join on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scoutgrid.llm.text import lower_ascii, packed


def host_of(url: Column) -> Column:
    """Lower-cased text after the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    return lower_ascii(F.regexp_extract(_after(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _digest(host: Column, prefix: Column) -> Column:
    return F.sha2(F.concat(host, prefix), 256)


def _directory(path: Column) -> Column:
    """The path up to its last slash, empty if it has none."""
    return F.regexp_extract(path, r"^((?s:.*)/)?", 0)


def compiled(rules: DataFrame, hash_chars: int) -> DataFrame:
    """Rules with the short key under which URLs find them; null fields make a rule void."""
    host, path = lower_ascii(F.col("host")), F.col("path")
    return rules.where("host is not null and path is not null and verdict is not null").select(
        host.alias("rule_host"), path.alias("rule_path"), F.col("verdict").alias("rule_verdict"),
        _digest(host, _directory(path)).alias("rule_digest")).distinct().withColumn("key", F.substring("rule_digest", 1, hash_chars))


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", hash_chars: int = 8) -> DataFrame:
    """``row`` (the input row), ``host``, ``path``, ``rule`` and ``verdict`` for every input row.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains when the URL's path
    starts with the rule's; the longest fitting rule wins, among equals the one with the longer host,
    then ``block``. URLs without a fitting rule get ``default`` and a null rule. Each distinct (host, path)
    is expanded once, no deeper than the deepest rule, so that repeated URLs and very long ones cost
    little; a hot URL meets its verdict in a join that splits skewed keys. Null URLs have empty host and
    path. Empty tables of either kind are fine; repeated rows stay repeated.
    """
    split = packed(pages, host=F.coalesce(host_of(F.col(f"`{url}`").cast("string")), F.lit("")),
                   path=F.coalesce(path_of(F.col(f"`{url}`").cast("string")), F.lit("")))
    table = compiled(rules, hash_chars)
    deepest = table.agg(F.max(F.size(F.split("rule_host", r"\."))), F.max(F.size(F.split("rule_path", "/")))).first()
    labels, parts = (deepest[0] or 1), (deepest[1] or 1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(labels))),
                           lambda k: F.array_join(F.slice("labels", -k, k), "."))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size("parts") - 1, F.lit(parts))),
                           lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice("parts", F.lit(1), k), "/"), F.lit("/"))))
    seen = split.select("host", "path").distinct()
    keys = (seen.select("host", "path", F.split("host", r"\.").alias("labels"), F.split("path", "/").alias("parts"))
            .select("host", "path", prefixes.alias("prefixes"), F.explode(suffixes).alias("suffix"))
            .select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
            .select("host", "path", _digest(F.col("suffix"), F.col("prefix")).alias("digest"))
            .withColumn("key", F.substring("digest", 1, hash_chars)))
    fits = keys.join(table, "key").where((F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("path"), F.col("rule_path")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"),
        (F.col("rule_verdict") == "block").alias("blocks"), F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_verdict").alias("verdict"))).alias("best"))
    return split.join(best, ["host", "path"], "left").select(
        "row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
