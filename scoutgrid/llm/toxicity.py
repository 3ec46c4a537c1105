"""Toxicity by non-negative positive-unlabelled learning: confirmed toxic texts against unlabelled ones.

The risk of a classifier g is estimated from positives and unlabelled texts alone: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-));
where the second part turns negative, the step goes against it, as in the published non-negative estimator. g is a linear model on
the presence of words, hashed to a fixed number of places. Every place that is commoner in positives gets a weight, however rare: a place's
input is scaled by the evidence for it (its two-sample z, cubed, up to ``EVIDENCE``), so that the penalty holds down
what little evidence speaks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scoutgrid.llm.decontaminate import folded
from scoutgrid.llm.shingles import WordCodes
from scoutgrid.llm.text import hashed_sample, held_out

PLACES = 1 << 20
MAX_POSITIVE, MAX_UNLABELLED = 4000, 12000
STEPS, RATE, PENALTY, EVIDENCE, MOMENTUM = 300, 1.0, 1e-5, 4.0, 0.9


def places(text: bytes | None, codes: WordCodes) -> np.ndarray:
    """Places of a text's distinct words."""
    words = set(folded(text))
    return np.unique(codes.of(list(words)) & np.uint64(PLACES - 1)).astype(np.int32)


@dataclass
class Model:
    """Weights by place, and the bias; without training data every score is the prior."""

    weights: np.ndarray
    bias: float

    def score(self, at: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[at].sum(), -30, 30))))


class Texts:
    """Places of many texts, in the order of the texts and in the order of the places, so that sums over either are sums of stretches."""

    def __init__(self, rows: list[np.ndarray], column: np.ndarray):
        self.n = len(rows)
        size = np.array([len(r) for r in rows])
        self.at = column[np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64)]
        self.filled = np.flatnonzero(size)
        self.begin = (np.cumsum(size) - size)[self.filled]
        order = np.argsort(self.at, kind="stable")
        self.owner = np.repeat(np.arange(self.n), size)[order]
        self.used, self.first = np.unique(self.at[order], return_index=True)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.at):
            out[self.filled] = np.add.reduceat(weights[self.at], self.begin)
        return out

    def spread(self, per_text: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        if len(self.at):
            out[self.used] = np.add.reduceat(per_text[self.owner], self.first)
        return out


def risk(theta: np.ndarray, xp: Texts, xu: Texts, prior: float) -> tuple[float, float, np.ndarray]:
    """The risk of positives, the rest (negative risk of all, less the positives' share), and the gradient of the non-negative estimator."""
    sigmoid = lambda a: 1 / (1 + np.exp(-np.clip(a, -30, 30)))
    gp, gu = xp.sums(theta[:-1]) + theta[-1], xu.sums(theta[:-1]) + theta[-1]
    positive = prior * np.logaddexp(0, -gp).mean()
    rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    if rest >= 0:
        dp, du = -prior * sigmoid(-gp) / xp.n - prior * sigmoid(gp) / xp.n, sigmoid(gu) / xu.n
    else:  # the step goes against the part that turned negative
        dp, du = prior * sigmoid(gp) / xp.n, -sigmoid(gu) / xu.n
    k = len(theta) - 1
    return positive, rest, np.append(xp.spread(dp, k) + xu.spread(du, k), dp.sum() + du.sum())


def fitted(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """The model that minimises the nnPU risk over all places of the training texts, with a squared penalty on their weights."""
    weights = np.zeros(PLACES, np.float32)
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model(weights, -30.0 if prior <= 0 or not positive else 30.0)
    used = np.unique(np.concatenate([*positive, *unlabelled, np.empty(0, np.int32)]).astype(np.int64))
    column = np.zeros(PLACES, np.int64)
    column[used] = np.arange(len(used))
    xp, xu = Texts(positive, column), Texts(unlabelled, column)
    p, u = (np.bincount(x.at, minlength=len(used)) for x in (xp, xu))
    rate = (p + u + 0.5) / (xp.n + xu.n)
    z = (p / xp.n - u / xu.n) / np.sqrt(rate * np.maximum(1 - rate, 1e-9) * (1 / xp.n + 1 / xu.n))
    scale = (np.clip(z, 0, EVIDENCE) / EVIDENCE) ** 3
    theta = np.zeros(len(used) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    speed = np.zeros_like(theta)
    curve = 0.25 * (1 + max(2 * prior * xp.sums(scale ** 2).mean(), xu.sums(scale ** 2).mean()))
    for _ in range(STEPS):
        ahead = theta + MOMENTUM * speed
        grad = risk(np.append(ahead[:-1] * scale, ahead[-1]), xp, xu, prior)[2]
        grad[:-1] = grad[:-1] * scale + PENALTY * ahead[:-1]
        speed = MOMENTUM * speed - RATE / curve * grad
        theta = theta + speed
    weights[used] = theta[:-1] * scale
    return Model(weights, float(theta[-1]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = WordCodes()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([places(t.as_py(), codes) for t in b.column(1)], pa.list_(pa.int32()))],
                                         ["toxic", "places"])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for b in batches:
            scores = [model.value.score(places(t.as_py(), codes)) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], ["row", "held_out", "score"])
    return run


def sampled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, folds: int, fold: int) -> tuple[list, list, float]:
    """Words of confirmed positives and of unlabelled texts, both bounded samples by a hash of the key, and the prior among training labels.

    A key gives one text, the one with the least hash, however many rows it has: what reaches the driver is bounded in texts.
    """
    known = labels.select(labels[f"`{key}`"].alias("key"), labels[f"`{label}`"].cast("int").alias("label")).where(
        ~held_out(F.col("key"), folds, fold) & F.col("label").isNotNull())
    prior = known.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0] or 0.0
    toxic = hashed_sample(known.where("label = 1").select("key").distinct(), MAX_POSITIVE)
    rows = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].cast("string").cast("binary").alias("text"))
    rows = rows.where(~held_out(F.col("key"), folds, fold))
    plain = hashed_sample(rows.select("key").distinct(), MAX_UNLABELLED)
    both = toxic.select("key", F.lit(True).alias("toxic")).union(plain.select("key", F.lit(False).alias("toxic")))
    own = rows.join(F.broadcast(both), "key").groupBy("toxic", "key").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = own.select("toxic", "text").mapInArrow(_read, "toxic boolean, places array<int>").toArrow()
    split = {True: [], False: []}
    for toxic, own_places in zip(found["toxic"].to_pylist(), found["places"].combine_chunks()):
        split[toxic].append(own_places.values.to_numpy())
    # the order of the rows must not show in the sums
    return *(sorted(split[x], key=lambda r: r.tobytes()) for x in (True, False)), float(prior)


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, fold: int = 1,
           threshold: float = 0.7) -> DataFrame:
    """``row`` (the key), held_out, score (0 to 1) and predicted of every text; only the text is an input of its score.

    The model learns from at most MAX_POSITIVE texts labelled toxic and MAX_UNLABELLED texts whose labels are not looked at, none of them
    held out (crc32 of the key as text leaves ``fold``). Null and empty texts have no words and get the score of the bias; null
    labels are ignored; without confirmed texts all scores are near 0. Rows of a repeated key are scored each, one of them is used for training;
    texts with the same words tie. Texts are read whole, very long ones too; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(*sampled(docs, labels, key, text, label, folds, fold)))
    rows = docs.select(docs[f"`{key}`"].alias("row"), held_out(docs[f"`{key}`"], folds, fold).alias("held_out"),
                       docs[f"`{text}`"].cast("string").cast("binary").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(_score(model), f"row {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
