"""Fingerprints by their definition, and the trie join against all pairs."""

import random

import pytest
import xxhash

from brute import near_copies
from scoutgrid.llm import simhash


def plain_print(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    pieces = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in pieces]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def plain_components(prints, bits):
    """{print: least print reachable} by comparing all pairs."""
    label = {p: p for p in prints}

    def find(p):
        while label[p] != p:
            p = label[p]
        return p

    order = sorted(label)
    for i, p in enumerate(order):
        for q in order[:i]:
            if ((p ^ q) & (2**64 - 1)).bit_count() <= bits:
                a, b = sorted((find(p), find(q)))
                label[b] = a
    return {p: find(p) for p in order}


def plain(rows, k, bits):
    prints = [plain_print(t, k) for _, t in rows]
    group = plain_components(set(prints), bits)
    least = {}
    for (key, _), p in zip(rows, prints):
        if key is not None:
            least[group[p]] = min(key, least.get(group[p], key))
    return [(key, p, least.get(group[p])) for (key, _), p in zip(rows, prints)]


def ordered(rows):
    return sorted(tuple((x is None, x or 0) for x in r) for r in rows)


def got(spark, rows, k=3, bits=2):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS print", "3 AS label", "4 AS prefix")
    return ordered(map(tuple, simhash.near_duplicates(docs, k=k, bits=bits).collect()))


def test_texts(spark):
    rows = near_copies() + [(None, "one two three four"), (900, "one two three four"), (900, "one two three four"), (None, "alone here and now"), (901, "Äé Z\x0bZ \x1c x\x00y")]
    rows.append((902, " ".join(f"w{i % 700}" for i in range(70_000))))
    assert got(spark, rows) == ordered(plain(rows, 3, 2))


def test_empty_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(5, None), (3, " "), (None, "")]) == ordered([(5, 0, 3), (3, 0, 3), (None, 0, 3)])


def crowd(seed):
    """Fingerprints spread over all bits, in one crowded corner, and around centres up to four bits away."""
    rng = random.Random(seed)
    prints = {rng.getrandbits(64) for _ in range(150)} | {rng.getrandbits(9) for _ in range(60)} | {0, 2**64 - 1}
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
    return [p - (1 << 64) if p >> 63 else p for p in prints]


@pytest.mark.parametrize("leaf,bits", [(8, 2), (64, 3), (1, 0)])
def test_every_leaf_size_links_the_same(spark, monkeypatch, leaf, bits):
    from scoutgrid.llm.components import components
    monkeypatch.setattr(simhash, "LEAF", leaf)
    prints = crowd(leaf)
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "print long"), bits)
    found = {r["node"]: r["label"] for r in components(edges).collect()}
    want = plain_components(prints, bits)
    assert {p: found.get(p, p) for p in prints} == want


def test_a_pair_of_leaves_gives_one_row_per_fingerprint():
    import numpy as np
    a = np.arange(512, dtype=np.int64)
    u, v = simhash._near(a, a, True, 2)
    assert len(u) == 512 and (v == 0).all()
    u, v = simhash._near(a, a[:1] + 4096, False, 2)
    assert sorted(u.tolist()) == [0] + [1 << b for b in range(9)] + [4096] and (v == 0).all()
