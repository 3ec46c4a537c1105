import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import WORDS
from scoutgrid.llm import mil_quality as m
from scoutgrid.llm import ppm, toxicity
from scoutgrid.llm.shingles import WordCodes


def remainder(key, folds):
    return zlib.crc32(b"" if key is None else str(key).encode()) % folds


class PlainPpm:
    """Method C with exclusion by recursion over dictionaries; all contexts are kept."""

    def __init__(self, texts):
        self.counts = {}
        for t in texts:
            s = [ppm.START] * ppm.ORDER + list(t) + [ppm.END]
            for i in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    self.counts.setdefault(tuple(s[i - k:i]), Counter())[s[i]] += 1

    def p(self, context, symbol, excluded=frozenset()):
        left = ppm.SYMBOLS - 1 - len(excluded)
        seen = {s: n for s, n in self.counts.get(context, {}).items() if s not in excluded}
        total, distinct = sum(seen.values()), len(seen)
        if total == 0:
            return self.p(context[1:], symbol, excluded) if context else 1 / left
        whole = total + (distinct if distinct < left else 0)
        if symbol in seen:
            return seen[symbol] / whole
        wider = excluded | set(seen)
        return distinct / whole * (self.p(context[1:], symbol, wider) if context else 1 / (ppm.SYMBOLS - 1 - len(wider)))

    def score(self, text):
        s = [ppm.START] * ppm.ORDER + list(text) + [ppm.END]
        out = 0.0
        for i in range(ppm.ORDER, len(s)):
            context = tuple(s[i - ppm.ORDER:i])
            while context and context not in self.counts:
                context = context[1:]
            out += math.log10(self.p(context, s[i]))
        return out


def lm_rows():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(WORDS[:60]) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    texts += ["", None, "Été ñandú Ω", "UPPER lower", texts[0], "zzz qqq \x00 \t\n", "ab" * 3000]
    return list(enumerate(texts)) + [(None, "null key"), (3, texts[3])]


@pytest.mark.parametrize("heavy", [20, 10**9])
def test_lm_scores_equal_plain_models(spark, heavy):
    rows = lm_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(1))
    got = ppm.scored(docs, heavy_words=heavy, max_nodes=10**9).collect()
    lower = lambda t: (t or "").encode().lower()
    train = [lower(t) for k, t in rows if remainder(k, 7) != 2]
    counts = Counter(w for t in train for w in [*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    model = PlainPpm(train)
    want = []
    for k, t in rows:
        tokens = [*lower(t).split(), None]
        want.append((-1 if k is None else k, remainder(k, 7) == 2, len(tokens), sum(w in counts for w in tokens), n,
                     sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), model.score(lower(t))))
    have = sorted((-1 if r["row"] is None else r["row"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    for a, b in zip(have, sorted(want), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-6)


def test_scorer_holds_one_part_at_a_time():
    """However many texts come in one batch, what is open of them goes out part by part; the rows are those of one batch a text."""
    import pyarrow as pa
    from types import SimpleNamespace

    texts = [f"word{i} word{i * 7 % 50} \u00e9 {'x' * (i % 90)}".encode() if i % 11 else None for i in range(12_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([{"held_out": False, "at": i} for i in range(len(texts))]), pa.array(range(len(texts))), pa.array(texts, pa.binary())], ["id", "row", "text"])
    tries = ppm.built([{0: {97: 3, 120: 2, 256: 1}}])
    tries.levels, tries.log_p = [0, 0], tries.log_p[:0]
    tries.step = np.full((1, ppm.SYMBOLS), -1, np.int32)
    common = np.arange(0, dtype=np.uint64)
    model = SimpleNamespace(value=(tries, common, np.zeros(0), {b"word1": -2.0}))
    out = list(ppm._score(model)(iter([batch])))
    assert max(sum(len(texts[i] or b"") for i in b.column("row").to_pylist()) for b in out) <= ppm.PART
    alone = [r for i in (0, 1, 2, 6_001, 11_999) for b in ppm._score(model)(iter([batch.slice(i, 1)])) for r in b.to_pylist()]
    rows = pa.Table.from_batches(out).to_pylist()
    assert [r["row"] for r in rows] == list(range(len(texts)))
    assert [rows[i] for i in (0, 1, 2, 6_001, 11_999)] == alone


@pytest.mark.parametrize("limits", [{}, {"max_nodes": 40, "common_runs": 300}, {"max_nodes": 1, "common_runs": 1}])
def test_lm_scores_use_rare_contexts(spark, limits):
    rng = random.Random(5)
    rare = ["".join(rng.choice("abcdefghijk") for _ in range(30)) for _ in range(30)]
    rows = lm_rows() + [(1000 + i, t) for i, t in enumerate(rare)] + [(2000 + i, f"{t} {rare[0][:9]}") for i, t in enumerate(rare)] + [(3000, "ab" * 30000)]
    train = [(t or "").encode().lower() for k, t in rows if remainder(k, 7) != 2]
    model = PlainPpm(train)
    got = ppm.scored(spark.createDataFrame(rows, "doc_id long, text string"), **limits).collect()
    have = sorted((-1 if r["row"] is None else r["row"], r["score"]) for r in got)
    want = sorted((-1 if k is None else k, model.score((t or "").encode().lower())) for k, t in rows)
    for a, b in zip(have, want, strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-6)
    assert any(remainder(k, 7) == 2 for k, _ in rows[-90:])


def test_lm_distributions_sum_to_one_when_nodes_are_bounded(spark):
    texts = spark.createDataFrame([(t or "",) for _, t in lm_rows()], "t string")
    trie = ppm.trained(texts, "t", max_nodes=40)
    assert all(b - a <= 40 for a, b in zip(trie.levels[1:], trie.levels[2:]))
    assert np.allclose((10.0 ** trie.log_p.astype(float)).sum(axis=1), 1, atol=1e-4)
    empty = ppm.scored(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0


def labelled(spark, junk, label, n=400):
    rng = random.Random(6)
    docs, labels = [(10_000, None), (10_001, "")], [(10_000, None), (10_001, 0)]
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice(WORDS) for _ in range(rng.randrange(40, 200))]
        if bad:
            words = junk(rng, words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad == (label == "toxic"))))
    schema = f"doc_id long, {label} int"
    return (spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("label", F.lit(1)),
            spark.createDataFrame(labels, schema))


def held_out_accuracy(scored, labels, folds):
    both = {r["row"]: r for r in scored.collect()}
    truth = {r[0]: r[1] for r in labels.collect()}
    held = [k for k in both if truth.get(k) is not None and remainder(k, folds) == 1 and k < 10_000]
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (remainder(k, folds) == 1) for k, r in both.items())
    return sum(both[k]["predicted"] == truth[k] for k in held) / len(held), both


def test_toxic_texts_are_found_without_held_out_labels(spark):
    def insult(rng, words):
        for _ in range(4):
            words.insert(rng.randrange(len(words)), rng.choice(("Slurone!", "slurtwo", "slurthree")))
        return words

    docs, labels = labelled(spark, insult, "toxic")
    accuracy, all_ = held_out_accuracy(toxicity.scored(docs, labels), labels, 3)
    assert accuracy > 0.98 and len(all_) == 402
    assert all_[10_000]["score"] == all_[10_001]["score"] < 0.7
    hidden = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["row"]: r["score"] for r in toxicity.scored(docs, hidden).collect()}
    assert again == {k: r["score"] for k, r in all_.items()}
    assert {r["predicted"] for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.scored(docs.limit(0), labels).count() == 0


def test_risk_never_rewards_negative_part():
    rng = np.random.default_rng(0)
    positive = [np.unique(np.append(rng.integers(0, 500, 30), 7)).astype(np.int32) for _ in range(40)]
    plain = [np.unique(rng.integers(10, 500, 30)).astype(np.int32) for _ in range(400)]
    model = toxicity.fitted(positive, plain + positive[:20], 0.05)
    assert min(model.score(p) for p in positive) > 0.7 > max(model.score(p) for p in plain)
    assert np.isfinite(model.weights).all()


def test_quality_is_learned_from_document_labels(spark):
    docs, labels = labelled(spark, lambda rng, words: [*words[:len(words) // 2], *(w + rng.choice(("###", "%%%")) for w in words[len(words) // 2:])], "quality")
    accuracy, all_ = held_out_accuracy(m.scored(docs, labels), labels, 3)
    assert accuracy > 0.98 and len(all_) == 402 and all_[10_000]["score"] == all_[10_001]["score"]
    assert {r["score"] for r in m.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert m.scored(docs.limit(0), labels).count() == 0


def test_attention_gradients_are_exact():
    rng = np.random.default_rng(1)
    model = m.initial(5)
    bags = [rng.normal(size=(k, 5)) for k in (1, 4, 2)]
    x, begin, y = np.concatenate(bags), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])
    _, grads = model.gradients(x, begin, y)
    for name, g in grads.items():
        p = model.params[name]
        for at in list(np.ndindex(p.shape))[:6]:
            near = []
            for e in (1e-5, -1e-5):
                model.params[name] = p.copy()
                model.params[name][at] += e
                near.append(model.gradients(x, begin, y)[0])
            model.params[name] = p
            assert (near[0] - near[1]) / 2e-5 == pytest.approx(g[at], abs=1e-6)


def test_passage_features_of_odd_texts():
    codes = WordCodes()
    assert m.passages(None, codes).shape == m.passages(b" \n", codes).shape == (1, m.FEATURES)
    long = m.passages(b"word | ## X " * 5000, codes)
    assert len(long) == math.ceil(20000 / m.PASSAGE) and np.isfinite(long).all()


def plain_risk(weights, bias, positive, unlabelled, prior):
    """The two parts of the non-negative risk, text by text."""
    g = lambda at: bias + sum(weights[i] for i in at)
    loss = lambda v: math.log1p(math.exp(-v)) if v > 0 else -v + math.log1p(math.exp(v))
    mean = lambda values: sum(values) / len(values)
    return prior * mean([loss(g(t)) for t in positive]), mean([loss(-g(t)) for t in unlabelled]) - prior * mean([loss(-g(t)) for t in positive])


@pytest.mark.parametrize("bias", [-2.0, 3.0])
def test_risk_and_gradient_equal_plain_sums(bias):
    rng = np.random.default_rng(2)
    positive, unlabelled = ([np.unique(rng.integers(0, 12, rng.integers(0, 6))).astype(np.int32) for _ in range(n)] for n in (5, 9))
    column = np.arange(12)
    theta, prior = np.append(rng.normal(size=12), bias), 0.3
    part, rest, grad = toxicity.risk(theta, toxicity.Texts(positive, column), toxicity.Texts(unlabelled, column), prior)
    assert (part, rest) == pytest.approx(plain_risk(theta[:-1], theta[-1], positive, unlabelled, prior))
    for i in range(13):
        ends = []
        for e in (1e-6, -1e-6):
            near = theta.copy()
            near[i] += e
            a, b = plain_risk(near[:-1], near[-1], positive, unlabelled, prior)
            ends.append(a + b if rest >= 0 else -b)
        assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(grad[i], abs=1e-7)


def test_scores_equal_plain_sums_and_every_word_of_evidence_counts(spark):
    docs, labels = labelled(spark, lambda rng, words: [*words, f"rare{rng.randrange(60)}", "slurone"], "toxic")
    split = toxicity.sampled(docs, labels, "doc_id", "text", "toxic", 3, 1)
    model = toxicity.fitted(*split)
    codes = WordCodes()
    for r in toxicity.scored(docs, labels).collect()[:60]:
        text = docs.where(F.col("doc_id") == r["row"]).first()["text"] if r["row"] % 7 == 0 else None
        if text is not None:
            words = {w for w in text.lower().split()}
            at = {int(codes[w.encode()]) % toxicity.PLACES for w in words}
            assert r["score"] == pytest.approx(1 / (1 + math.exp(-(model.bias + sum(float(model.weights[i]) for i in at)))), abs=1e-5)
    rare = [int(codes[f"rare{i}".encode()]) % toxicity.PLACES for i in range(60)]
    assert sum(model.weights[i] > 0 for i in rare) > 20


def test_a_repeated_key_is_one_training_text(spark):
    """One key on a third of all rows, long texts, equal texts: bounded samples, equal scores."""
    docs, labels = labelled(spark, lambda rng, words: [*words, "slurone"], "toxic", 120)
    key = next(k for k in range(4, 120, 4) if remainder(k, 3) != 1)
    many = docs.where(F.col("doc_id") == key).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(60)))).drop("n")
    long = docs.limit(1).select(F.lit(777_777).cast("long").alias("doc_id"), F.repeat(F.lit("some words here "), 40_000).alias("text"), "score", "label")
    both = docs.unionByName(many).unionByName(long)
    positive, plain, _ = toxicity.sampled(both, labels, "doc_id", "text", "toxic", 3, 1)
    want = [k for k in range(120) if remainder(k, 3) != 1]
    assert len(positive) == sum(k % 4 == 0 for k in want)
    assert len(plain) == len(want) + sum(remainder(k, 3) != 1 for k in (10_000, 10_001, 777_777))
    got = toxicity.scored(both, labels).collect()
    assert len(got) == both.count() and len({r["score"] for r in got if r["row"] == key}) == 1
    quality = m.scored(both, labels.withColumnRenamed("toxic", "quality")).collect()
    assert len(quality) == both.count() and len({r["score"] for r in quality if r["row"] == key}) == 1
