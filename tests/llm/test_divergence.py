"""The audit against a plain one over all terms of all pairs, and the walk down two trees against dense sums."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from scoutgrid.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs=3, top=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in seen.items() if n >= min_docs}
        count = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        share = lambda c: (lambda t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)))
        whole = share(sum(count.values(), Counter()))
        f = lambda p, q: (p - q) ** 2 // q
        for s in count:
            p = share(count[s])
            pairs = [(o, sum(f(p(t), share(count[o])(t)) for t in kept)) for o in count if o != s]
            terms = [(t, f(p(t), whole(t))) for t in kept if count[s][t] and p(t) > whole(t)]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, n + 1) for n, (i, v) in enumerate(items) if part == "pair" or n < top]
    return sorted(out)


def corpus(seed, groups=9, docs=120):
    rng = random.Random(seed)
    words = [f"{c}{d}" for c in ("a", "Bé", "ж", "zZ") for d in "abcdefghijklmnopqrst"]
    rows = []
    for _ in range(docs):
        g = rng.randrange(groups)
        some = words[g * 4:g * 4 + 25] if g % 3 else words
        rows.append((" ".join(rng.choice(some) + rng.choice([" ", "1", "_", ",", "\n", "\x7f"]) for _ in range(rng.randrange(40))), rng.choice(["en", "de"]), f"s{g}"))
    return rows + [(None, None, None), ("", "xx", "only"), ("rare words", "yy", "a"), ("other", "yy", "b"), ("Aa ab " * 40_000, "en", "s0"), ("123 ...", "en", "silent")]


def got(spark, rows, **options):
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS doc_id", "2 AS bucket", "3 AS term", "4 AS n", "5 AS value")
    return sorted(tuple(r) for r in divergence.audited(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def test_equals_the_plain_audit(spark):
    rows = corpus(1)
    assert got(spark, rows) == plain(rows)


def test_many_blocks_and_buckets(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 3), ("BUCKET_DOCS", 17), ("SLAB", 8), ("LEAF_BATCH", 5), ("HELD_TERMS", 50), ("CHUNK_BYTES", 64)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(2)
    assert got(spark, rows, top_terms=4) == plain(rows, top=4)


def test_few_rows(spark):
    assert got(spark, []) == []
    for rows in ([("one", "en", "a")], [("one", "en", "a")] * 3 + [("one", "en", "b")], [(None, "en", "a"), (None, "en", None)]):
        assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("seed", range(4))
def test_joint_prices_equal_dense_sums(seed):
    rng = np.random.default_rng(seed)
    shape = [(1, 1, 1), (3, 9, 40), (17, 5, 300), (64, 20, 7)][seed]
    a, b = (rng.integers(0, 9, (n, shape[2])) * (rng.random((n, shape[2])) < 0.1) for n in shape[:2])
    total_a, total_b = a.sum(axis=1) + shape[2], b.sum(axis=1) + shape[2]
    value, width = divergence.joint_prices(a, b, total_a, total_b)
    zero = np.zeros(1, np.int64)
    full = value + (shape[2] - width) * divergence._distance(divergence._share(zero, total_a)[:, None], divergence._share(zero, total_b)[None, :])
    dense = divergence._distance(divergence._share(a, total_a[:, None])[:, None, :], divergence._share(b, total_b[:, None])[None, :, :]).sum(axis=2)
    assert (full == dense).all()
    if seed == 1:
        assert width.max() < shape[2]  # all-zero quadrants are not visited


def test_shares_are_exact_for_large_counts():
    count, total = 8 * 10**13, 8 * 10**13 + 977
    assert int(divergence._share(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 1) // total
