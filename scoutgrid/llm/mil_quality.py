"""Quality by attention-based multiple-instance learning: a document is a bag of passages, only the document has a label.

Each passage is encoded from counts over its bytes and words; gated attention (a tanh branch times a sigmoid branch) weighs
the encoded passages, and a logistic unit scores their weighted sum. Encoder, attention and unit are learned together from
document labels, by Adam on exact gradients in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scoutgrid.llm.shingles import WordCodes, mixed
from scoutgrid.llm.text import hashed_sample, held_out

PASSAGE = 64
MAX_LABELLED = 8000
HIDDEN, ATTENTION = 16, 8
STEPS, RATE, DECAY, SEED = 400, 0.02, 1e-4, 7
FEATURES = 13

# Byte classes. Bytes above 127 belong to letters.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) > 127)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_END = np.isin(np.arange(256), [ord(c) for c in ".,;:?"])
_MARK = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_ODD = ~(_SPACE | _LETTER | _DIGIT | _END | _MARK)


def passages(text: bytes | None, codes: WordCodes) -> np.ndarray:
    """A row of features per PASSAGE words of the text; a text without words is one row of zeros."""
    words = text.split() if text else []
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    b = np.frombuffer(text, np.uint8)
    inside = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside))) & inside)
    share = lambda table: np.add.reduceat(table[b].astype(np.int32), edge)  # noqa: E731  counts per word
    letters, upper, digits, marks, odd, ends = (share(t) for t in (_LETTER, _UPPER, _DIGIT, _MARK, _ODD, _END))
    size = np.add.reduceat(inside.astype(np.int32), edge)
    c = codes.of(words)
    n = len(words)
    begin = np.arange(0, n, PASSAGE)
    count = np.diff(np.append(begin, n)).astype(np.float32)

    def repeated(k: int) -> np.ndarray:
        """Words that start a run of k words met earlier in the text."""
        acc = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + c[j:j + len(acc)])
        again = np.ones(n, np.int32)
        again[len(acc):] = 0
        again[np.unique(acc, return_index=True)[1]] = 0
        return again

    per = lambda v: np.add.reduceat(v.astype(np.float32), begin) / count
    chars = np.maximum(np.add.reduceat(size.astype(np.float32), begin), 1)
    rate = lambda v: np.add.reduceat(v.astype(np.float32), begin) / chars
    return np.column_stack([
        per(size) / 10, rate(marks), per(marks > 0), per((upper > 1) & (upper == letters)), rate(odd), per(odd > 0), per(size <= 3),
        per(letters == 0), per(ends > 0), per(digits > 0), per(repeated(1)), per(repeated(4)), np.log1p(count) / 4]).astype(np.float32)


@dataclass
class Model:
    """Standardisation and the parameters of encoder (w), attention (v, u, a) and output (o)."""

    mean: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
        """Everything on the way from passages (rows of x, bags start at ``begin``) to document scores."""
        p = self.params
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["wb"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        bag = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, begin)[bag])
        alpha = e / np.add.reduceat(e, begin)[bag]
        z = np.add.reduceat(alpha[:, None] * h, begin)
        y = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["ob"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "alpha": alpha, "z": z, "y": y, "bag": bag}

    def gradients(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of the labels y and its gradients."""
        f, p = self.forward(x, begin), self.params
        loss = -np.mean(np.log(np.where(y == 1, f["y"], 1 - f["y"]) + 1e-12))
        d = (f["y"] - y) / len(y)
        dz = d[:, None] * p["o"]
        dh = f["alpha"][:, None] * dz[f["bag"]]
        d_alpha = (f["h"] * dz[f["bag"]]).sum(axis=1)
        de = f["alpha"] * (d_alpha - np.add.reduceat(f["alpha"] * d_alpha, begin)[f["bag"]])
        dt, dg = de[:, None] * p["a"] * f["g"], de[:, None] * p["a"] * f["t"]
        dt, dg = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
        dh = dh + dt @ p["v"].T + dg @ p["u"].T
        dw = dh * (1 - f["h"] ** 2)
        return float(loss), {"w": f["x"].T @ dw, "wb": dw.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ dg,
                             "a": (f["t"] * f["g"]).T @ de, "o": f["z"].T @ d, "ob": np.array(d.sum())}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        begin = np.cumsum([0, *map(len, bags)])[:-1]
        return self.forward(np.concatenate(bags), begin)["y"] if bags else np.empty(0)


def initial(features: int = FEATURES, seed: int = SEED) -> Model:
    draw = np.random.default_rng(seed)
    weight = lambda *shape: draw.normal(0, 1 / np.sqrt(shape[0]), shape)
    return Model(np.zeros(features), np.ones(features), {
        "w": weight(features, HIDDEN), "wb": np.zeros(HIDDEN), "v": weight(HIDDEN, ATTENTION), "u": weight(HIDDEN, ATTENTION),
        "a": weight(ATTENTION), "o": weight(HIDDEN), "ob": np.zeros(())})


def fitted(bags: list[np.ndarray], labels: np.ndarray, steps: int = STEPS) -> Model:
    """A model of the labelled bags; one class alone gives the constant of that class, no bags 1/2."""
    model = initial()
    if len(bags) == 0 or len(set(labels.tolist())) < 2:
        model.params["o"] *= 0
        model.params["ob"] = np.array(0.0 if len(bags) == 0 else 30.0 * (2 * labels[0] - 1))
        return model
    x, begin = np.concatenate(bags).astype(np.float64), np.cumsum([0, *map(len, bags)])[:-1]
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    mean = {k: np.zeros_like(v) for k, v in model.params.items()}
    square = {k: np.zeros_like(v) for k, v in model.params.items()}
    for step in range(1, steps + 1):
        _, grads = model.gradients(x, begin, labels)
        for k, g in grads.items():
            g = g + DECAY * model.params[k]
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g ** 2
            model.params[k] = model.params[k] - RATE * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = WordCodes()
    for b in batches:
        rows = [passages(t.as_py(), codes) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.ravel() for r in rows], pa.list_(pa.float32()))], ["label", "features"])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for b in batches:
            scores, bags = [], []
            for t in b.column(2):
                bags.append(passages(t.as_py(), codes))
                if len(bags) == 500:
                    scores, bags = [*scores, *model.value.scores(bags)], []
            scores += list(model.value.scores(bags))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], ["row", "held_out", "score"])
    return run


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 3, fold: int = 1,
           threshold: float = 0.5) -> DataFrame:
    """``row`` (the key), held_out, score (0 to 1) and predicted of every text; only the text is an input of its score.

    The model learns from the texts of at most MAX_LABELLED labelled keys, chosen by a hash, none of them held out. All passages of
    every text are read. Null and empty texts are a bag of one empty passage; null labels are ignored; labels
    of one class only give a constant, none 1/2. Rows of a repeated key are scored each, the one with the least text hash is used for
    training. Very long texts are bags of many passages; equal texts tie. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    known = labels.select(labels[f"`{key}`"].alias("key"), labels[f"`{label}`"].cast("int").alias("label")).where(
        ~held_out(F.col("key"), folds, fold) & F.col("label").isin(0, 1)).distinct()
    chosen = hashed_sample(known, MAX_LABELLED)
    rows = docs.select(docs[f"`{key}`"].alias("row"), held_out(docs[f"`{key}`"], folds, fold).alias("held_out"),
                       docs[f"`{text}`"].cast("string").cast("binary").alias("text"))
    own = rows.join(F.broadcast(chosen), rows["row"] == chosen["key"]).groupBy("key", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    read = own.select("label", "text").mapInArrow(_read, "label int, features array<float>").toArrow()
    known_labels = read["label"].to_numpy()
    bags = [f.values.to_numpy().reshape(-1, FEATURES) for f in read["features"].combine_chunks()]
    order = sorted(range(len(bags)), key=lambda i: (known_labels[i], bags[i].tobytes()))
    model = docs.sparkSession.sparkContext.broadcast(fitted([bags[i] for i in order], known_labels[order].astype(np.float64)))
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(_score(model), f"row {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
