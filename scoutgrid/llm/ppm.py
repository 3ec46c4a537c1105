"""LM scoring by prediction by partial matching over bytes, with a word unigram score beside it.

Training counts every run of ORDER + 1 symbols of the training texts (a text: start symbols, its bytes with A-Z lowered, an end
symbol). A context predicts by method C: a symbol seen n times has n / (total + distinct), the escape distinct / (total + distinct)
leads to the next shorter context, where all symbols seen before are excluded; below the root all symbols left are equally likely.

Every context counts, however rare. The probability of a symbol depends on the run that ends with it, so ``priced`` works it out once for
each distinct run of the corpus, as a table that grows with it. Three ways lead from a text to these probabilities, all to the same
model: contexts with at least 1/MAX_NODES of all symbols are nodes of a trie that goes to the tasks, other runs with at
least 1/COMMON_RUNS go there as a sorted array, and the runs of a text that are rarer than that meet the table in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from scoutgrid.llm.text import held_out
from scoutgrid.session import cut_lineage

ORDER, MAX_NODES, COMMON_RUNS = 4, 16384, 2_000_000
SYMBOLS, END, START = 258, 256, 257
BITS = np.uint64(9)
RUN_BITS = np.uint64(9 * (ORDER + 1))
CHUNK = 1_000_000
PART = 200_000
HEAVY_WORDS = 300_000


def symbols_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each with ORDER start symbols before and the end after it, and the positions where texts begin."""
    sizes = np.array([len(t) + ORDER + 1 for t in texts])
    begin = np.cumsum(sizes) - sizes
    flat = np.frombuffer((b"".join(b"\0" * ORDER + t + b"\0" for t in texts)), np.uint8).astype(np.uint16)
    for k in range(ORDER):
        flat[begin + k] = START
    flat[begin + sizes - 1] = END
    return flat, begin


def runs_at(flat: np.ndarray) -> np.ndarray:
    """Every symbol from place ORDER on with the ORDER before it as one number."""
    acc = np.zeros(len(flat) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        acc = (acc << BITS) | flat[k:len(flat) - ORDER + k].astype(np.uint64)
    return acc


def runs_of(flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The runs of all predicted symbols; start symbols are not predicted."""
    acc = runs_at(flat)
    return acc[acc & np.uint64(511) != START]


def chunked(texts: Iterator[bytes], size: int = CHUNK) -> Iterator[list[bytes]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t) + ORDER + 1
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, n) of a task's texts; runs of held-out texts come with n = 0."""
    for b in batches:
        rows = list(zip(b.column(0).to_pylist(), b.column(1)))
        for out in (False, True):
            for texts in chunked((t.as_py() or b"").lower() for held, t in rows if held == out):
                runs, n = np.unique(runs_of(*symbols_of(texts)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64)), pa.array(n * (not out))], ["run", "n"])


@dataclass
class Trie:
    """Transition and log10 probability tables; node 0 is the root, ``levels`` gives the first node of each order."""

    levels: list[int]
    step: np.ndarray
    log_p: np.ndarray

    def scores(self, texts: list[bytes], common: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text, its end included, without its rare runs, and those: text number, run and count.

        ``common`` (sorted) and ``log_p`` are runs with their log10 probabilities for contexts that are no nodes.
        """
        flat, begin = symbols_of(texts)
        node = np.zeros(len(flat), np.int32)  # the longest known context before each position, order by order
        for _ in range(ORDER):
            longer = np.full(len(flat), -1, np.int32)
            longer[1:] = self.step[node[:-1], flat[:-1]]
            node = np.where(longer >= 0, longer, len(self.step) - 1)
        whole = node < len(self.log_p)
        p = np.zeros(len(flat))
        at = np.flatnonzero(whole & (flat != START))
        p[at] = self.log_p[node[at], flat[at]]
        at = np.flatnonzero(~whole & (flat != START))
        runs = runs_at(flat)[at - ORDER]
        place = np.minimum(np.searchsorted(common, runs), max(len(common) - 1, 0))
        found = common[place] == runs if len(common) else np.zeros(len(runs), bool)
        p[at[found]] = log_p[place[found]]
        rare, n = np.unique((np.searchsorted(begin, at[~found], "right") - 1).astype(np.uint64) << RUN_BITS | runs[~found], return_counts=True)
        return np.add.reduceat(p, begin), (rare >> RUN_BITS).astype(np.int64), (rare & ((np.uint64(1) << RUN_BITS) - np.uint64(1))).astype(np.int64), n


def built(orders: list[dict[int, dict[int, int]]]) -> Trie:
    """The trie of counts per order: {context: {symbol: count}}, every context's suffix among the contexts one order lower."""
    names = [sorted(o) for o in orders]
    levels = np.cumsum([0, *map(len, names)]).tolist()
    at = [{c: levels[k] + i for i, c in enumerate(ns)} for k, ns in enumerate(names)]
    step = np.full((levels[-1] + 1, SYMBOLS), -1, np.int32)
    p = np.zeros((levels[-1], SYMBOLS), np.float64)
    below = np.zeros((1, SYMBOLS))
    count_below = np.zeros((1, SYMBOLS), np.int64)
    full_below = np.zeros((1, 1), bool)
    possible = np.ones(SYMBOLS, bool)
    possible[START] = False
    for k, ns in enumerate(names):
        n = np.zeros((len(ns), SYMBOLS), np.int64)
        for i, c in enumerate(ns):
            for s, m in orders[k][c].items():
                n[i, s] = m
            if k:
                step[at[k - 1][c >> 9], c & 511] = at[k][c]
        seen = n > 0
        if k == 0:
            left = (~seen & possible).sum(axis=1, keepdims=True)
            after = np.where(~seen & possible, 1.0 / np.maximum(left, 1), 0)
            none_left = left == 0
        else:
            parent = np.array([at[k - 1][c & ((1 << 9 * (k - 1)) - 1)] - levels[k - 1] for c in ns], int)
            up, down = count_below[parent], below[parent]
            total = np.where(seen, 0, up).sum(axis=1, keepdims=True)
            distinct = (~seen & (up > 0)).sum(axis=1, keepdims=True)
            whole = np.maximum(total + np.where(full_below[parent], 0, distinct), 1)  # no escape where nothing is left to find
            after = np.where(seen, 0, np.where(up > 0, up / whole, np.where(total > 0, distinct / whole, 1.0) * down))
            none_left = ~(~seen & possible).any(axis=1, keepdims=True)
        total, distinct = n.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
        whole = np.where(none_left, np.maximum(total, 1), np.maximum(total + distinct, 1))
        p[levels[k]:levels[k + 1]] = np.where(seen, n / whole, np.where(total > 0, distinct / whole, 1.0) * after)
        below, count_below, full_below = after, n, none_left
    with np.errstate(divide="ignore"):
        return Trie(levels, step, np.log10(p).astype(np.float32))


def counted(texts: DataFrame, text: str, held_out: Column) -> DataFrame:
    """(run, n) of all distinct runs of all rows; n counts the rows that are not held out and may be 0."""
    return cut_lineage(texts.select(held_out, F.col(text).cast("binary")).mapInArrow(_count_runs, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")))


def trie_of(runs: DataFrame, total: int, max_nodes: int) -> Trie:
    """The trie of the contexts that hold at least 1/max_nodes of ``total``; what reaches the driver is at most ORDER * max_nodes nodes."""
    orders: list[dict[int, dict[int, int]]] = []
    for k in range(ORDER + 1):
        context = F.shiftright("run", 9).bitwiseAND((1 << 9 * k) - 1)
        rows = runs.where("n > 0").groupBy(context.alias("context"), F.col("run").bitwiseAND(511).alias("symbol")).agg(F.sum("n").alias("n"))
        if k:
            kept = rows.groupBy("context").agg(F.sum("n").alias("m")).where(F.col("m") * max_nodes >= total).select("context")
            rows = rows.join(kept, "context")
        level: dict[int, dict[int, int]] = {} if k else {0: {}}
        for c, s, n in rows.collect():
            level.setdefault(c, {})[s] = n
        orders.append(level)
    return built(orders)


def trained(texts: DataFrame, text: str, max_nodes: int = MAX_NODES) -> Trie:
    """The trie of all rows of ``texts``."""
    runs = counted(texts, text, F.lit(False))
    return trie_of(runs, runs.agg(F.sum("n")).first()[0] or 0, max_nodes)


def priced(runs: DataFrame) -> DataFrame:
    """(run, n, m, log_p) of all ``runs``: m is what the context holds, log_p the log10 probability of the last symbol.

    Order by order, a row is a distinct symbol with the k before it. What is seen after a context is seen after its suffix as well, so
    the suffix without the symbols of the longer context has ``m`` less their counts there and ``d`` less their number; ``rest`` is the symbol's
    probability at the suffix, given that. A key has at most SYMBOLS rows in every join and window.
    """
    left, lg = SYMBOLS - 1, F.log10  # symbols that can be predicted
    out = None
    for k in range(ORDER + 1):
        rows = runs.groupBy(F.col("run").bitwiseAND((1 << 9 * (k + 1)) - 1).alias("run")).agg(F.sum("n").alias("n"))
        if k:
            shorter = out.select(F.col("run").alias("suffix"), *[F.col(c).alias(f"{c}_") for c in ("n", "m", "d", "rest", "log_p")])
            rows = rows.withColumn("suffix", F.col("run").bitwiseAND((1 << 9 * k) - 1)).join(shorter, "suffix")
        w = Window.partitionBy(F.shiftright("run", 9))
        rows = rows.withColumns({"m": F.sum("n").over(w), "d": F.count_if(F.col("n") > 0).over(w)})
        if k:
            rows = rows.withColumn("x", F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n_"))).over(w), F.lit(0)))
            m, d = F.col("m_") - F.col("x"), F.col("d_") - F.col("d")
            whole = lg(m + F.when(d < left - F.col("d"), d).otherwise(0))  # no escape where nothing is left to find
            rest = F.when(F.col("n_") > 0, lg("n_") - whole).when(m > 0, lg(d) - whole + F.col("rest_")).otherwise(F.col("rest_"))
        else:
            rest = -lg(left - F.col("d"))
        whole = lg(F.col("m") + F.when(F.col("d") < left, F.col("d")).otherwise(0))
        log_p = F.when(F.col("m") == 0, F.col("log_p_") if k else -lg(F.lit(left))).when(F.col("n") > 0, lg("n") - whole).otherwise(
            lg("d") - whole + F.col("rest"))
        out = rows.withColumn("rest", rest).select("run", "n", "m", "d", "rest", log_p.alias("log_p"))
    return out.select("run", "n", "m", "log_p")


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task's texts, in parts of bounded size."""
    held: Counter = Counter()

    def part():
        out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for b in batches:
        for t in b.column(0):
            held.update(_words(t.as_py()))
            if len(held) > 300_000:
                yield part()
    if held:
        yield part()


def _score(model):
    """Per text: the score without its rare runs, and those; per word either its part of the base score (heavy words) or the word itself.

    A task holds the open words and runs of one part of ``PART`` symbols at a time, however many texts Spark hands over at once.
    """
    def listed(ends, fields: dict[str, pa.Array]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, common, log_p, heavy = model.value
        for b in batches:
            done = 0
            for texts in chunked(((t.as_py() or b"") for t in b.column(2)), PART):
                scores, text, runs, n = trie.scores([t.lower() for t in texts], common, log_p)
                tokens, known, base, words, times, ends = [], [], [], [], [], [0]
                for t in texts:
                    counts = Counter(_words(t))
                    tokens.append(sum(counts.values()) + 1)
                    mine = [(n, heavy[w]) for w, n in counts.items() if w in heavy]
                    known.append(sum(n for n, _ in mine))
                    base.append(float(sum(n * p for n, p in mine)))
                    open_ = [w for w in counts if w not in heavy]
                    words += open_
                    times += [counts[w] for w in open_]
                    ends.append(len(words))
                rest = listed(ends, {"word": pa.array(words, pa.binary()), "n": pa.array(times, pa.int32())})
                rare = listed(np.searchsorted(text, np.arange(len(texts) + 1)), {"run": pa.array(runs), "n": pa.array(n, pa.int32())})
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(done, len(texts)), b.column(1).slice(done, len(texts)), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64()),
                     pa.array(known, pa.int64()), pa.array(base, pa.float64()), rest, rare], ["id", "row", "n_tokens", "score", "known", "base", "rest", "runs"])
                done += len(texts)
    return run


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2,
           heavy_words: int = HEAVY_WORDS, max_nodes: int = MAX_NODES, common_runs: int = COMMON_RUNS) -> DataFrame:
    """``row`` (the key), held_out, n_tokens, n_known, train_tokens, base_score and score of every text.

    Both models learn from the rows that are not held out. base_score adds log10((c + 1) / (N + V + 1)) over the words (A-Z lowered)
    and one end token per text; c is the token's count, N all and V the distinct training tokens. Words that make up at least
    1/``heavy_words`` of all tokens (so at most as many as that go to the tasks) are scored where the text is read, all others by a join on the word, so that
    no join key is hot. ``score`` is the log10 probability of the text with all contexts of the training texts; ``max_nodes`` and ``common_runs``
    say in the same way which contexts and runs go to the tasks, and change no result. Null texts count as empty, null keys are
    training rows unless crc32 of the empty text says otherwise; with no training rows N is 0; repeated rows are scored each.
    """
    out = held_out(docs[f"`{key}`"], folds, fold)
    rows = docs.select(docs[f"`{key}`"].alias("row"), out.alias("held_out"), docs[f"`{text}`"].cast("string").cast("binary").alias("text"))
    train = rows.where(~F.col("held_out"))
    counts = cut_lineage(train.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")))
    n_train = train.count()
    seen = counts.agg(F.sum("c"), F.count("*")).first()
    total, distinct = (seen[0] or 0) + n_train, seen[1] + (n_train > 0)
    log_p = lambda c: F.log10((c + 1) / F.lit(float(total + distinct + 1)))
    heavy = counts.where(F.col("c") * heavy_words >= total).select("word", log_p(F.col("c")).alias("p"))
    runs = counted(rows, "text", F.col("held_out"))
    symbols = runs.agg(F.sum("n")).first()[0] or 0
    prices = cut_lineage(priced(runs).where((F.col("m") * max_nodes < symbols) | (F.col("m") == 0)).select("run", "n", "log_p"))
    common = prices.where((F.col("n") > 0) & (F.col("n") * common_runs >= symbols)).select("run", "log_p").toArrow().sort_by("run")
    model = docs.sparkSession.sparkContext.broadcast((
        trie_of(runs, symbols, max_nodes), common["run"].to_numpy().astype(np.uint64), common["log_p"].to_numpy(),
        {bytes(r["word"]): r["p"] for r in heavy.collect()}))

    kind = rows.schema["row"].dataType.simpleString()
    parts = cut_lineage(rows.select(F.struct("held_out", F.monotonically_increasing_id().alias("at")).alias("id"), "row", "text").mapInArrow(
        _score(model), f"id struct<held_out:boolean,at:bigint>, row {kind}, n_tokens long, score double, known long, base double, "
        "rest array<struct<word:binary,n:int>>, runs array<struct<run:bigint,n:int>>"))
    words = parts.select("id.at", F.inline("rest"))
    rare_words = words.join(counts, "word", "left").select(
        "at", F.when(F.col("c").isNotNull(), F.col("n")).alias("known2"), (F.col("n") * log_p(F.coalesce("c", F.lit(0)))).alias("base2"), F.lit(0.0).alias("score2"))
    rare_runs = parts.select("id.at", F.inline("runs")).join(prices.select("run", "log_p"), "run").select(
        "at", F.lit(0).alias("known2"), F.lit(0.0).alias("base2"), (F.col("n") * F.col("log_p")).alias("score2"))
    rest = rare_words.unionByName(rare_runs).groupBy("at").agg(*[F.sum(c).alias(c) for c in ("known2", "base2", "score2")])
    end = float(np.log10((n_train + 1) / (total + distinct + 1)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return parts.select("id.at", "id.held_out", "row", "n_tokens", "score", "known", "base").join(rest, "at", "left").select(
        "row", "held_out", "n_tokens", (F.col("known") + zero("known2") + int(n_train > 0)).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + zero("base2") + end).alias("base_score"),
        (F.col("score") + zero("score2")).alias("score"))
