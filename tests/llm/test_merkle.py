"""The manifest against a plain one, with blocks of three leaves and of the production size."""

import hashlib

import pytest
from pyspark.sql import functions as F

from scoutgrid.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def record(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """(top, [levels of siblings per node]) of a plain list of digests."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, a in enumerate(at):
            run = list(range(a // 3 * 3, min(len(level), a // 3 * 3 + 3)))
            paths[i].append(([level[j] for j in run if j < a], [level[j] for j in run if j > a]))
        level = [digest(*level[j:j + 3]) for j in range(0, len(level), 3)]
        at = [a // 3 for a in at]
    return level[0], paths


def plain(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((first(r[0]), record(r), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [sorted(sources[s], key=lambda x: x[:2]) for s in names]
    tops = [climb([leaf for _, leaf, _ in t]) for t in trees]
    root, outer = climb([top for top, _ in tops]) if tops else ("", [])
    out = []
    for tree, (top, paths), rest in zip(trees, tops, outer):
        for (_, leaf, r), path in zip(tree, paths):
            steps = path + rest
            claim = record((*r[:4], r[4].replace("\n", "") if r[4] is not None else None))
            acc = claim
            for left, right in steps:
                acc = digest(*left, acc, *right)
            out.append((r[0], r[1], leaf, claim, top, root, digest(*[x for a, b in steps for x in (*a, *b)]), acc))
    return out


ROWS = ([(i, "big", "en", 3, f"a\n{i}" if i % 2 else f"a {i}") for i in range(40)] + [(None, "big", None, None, None), (7, "big", "en", 1, "x"),
        (7, "big", "en", 1, "x"), (7, "big", "en", 1, "x\n"), (1, None, "de", 0, ""), (2, None, "de", 5, "ä\nö ü"), (3, "lone", "fr", 2, "\n\n"), (4, "", None, None, "t" * 100_000)]
        + [(i, f"s{i % 5}", "en", i, "same") for i in range(50, 62)])


def got(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr(
        "*", "1 AS rank", "'x' AS leaf", "2 AS size", "3 AS tree", "4 AS digest", "5 AS claim")
    proved = merkle.manifest(docs, claims={"text": F.translate(docs["text"], "\n", "")})
    proved = proved.withColumn("proof", merkle.path_digest(F.col("path"))).withColumn("folded", merkle.folded(F.col("claim"), F.col("path")))
    return proved.select("key", "source", "leaf", "claim", "subroot", "root", "proof", "folded").collect()


def ordered(rows):
    return sorted(map(str, map(tuple, rows)))


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_equals_the_plain_manifest(spark, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    assert ordered(got(spark, ROWS)) == ordered(plain(ROWS))


@pytest.mark.parametrize("rows", [[], ROWS[:1], ROWS[40:41], ROWS[:2], ROWS[:4]])
def test_few_rows(spark, rows):
    assert ordered(got(spark, rows)) == ordered(plain(rows))


def test_an_honest_path_leads_to_the_root_and_a_changed_text_does_not(spark):
    for r in got(spark, ROWS):
        assert (r["folded"] == r["root"]) == (r["leaf"] == r["claim"])
