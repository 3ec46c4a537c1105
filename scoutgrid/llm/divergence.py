"""Source divergence audit over a quadtree of the group-term count matrix.

1. Terms are counted per (lang, source) inside the tasks that read the texts, then summed; a lang keeps the terms of enough documents.
2. A lang's kept terms are dealt to buckets by a hash, as many as the corpus has blocks of ``BUCKET_DOCS`` documents; a bucket numbers
   its terms, widespread ones first, so that the columns of rare terms lie together. Groups are dealt to blocks of about
   ``BLOCK_ROWS`` rows. A task sees one bucket's columns for two blocks of groups.
3. There the counts are a matrix, cut into 4 x 4 quadrants down to leaves of 4 x 4 counts. Two groups walk down it together: a quadrant
   with no count on either side is left at once; its terms all have the price of a pair of zero counts, so their number
   times that price is added at the end. Only leaves with a count on one side are priced term by term.
4. All is integer arithmetic in 64 bits, split where a product could be longer.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from scoutgrid.session import cut_lineage

SCALE = 1_000_000_000
SIDE, SLAB = 4, 4096
BLOCK_ROWS, BUCKET_DOCS = 64, 2000
HELD_TERMS, CHUNK_BYTES, LEAF_BATCH = 300_000, 1 << 20, 20_000
#: Bytes of terms (letters A-Z lowered and all of non-ASCII characters) as they are, all others as blanks.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    text = text.translate(_TERM_BYTES)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + CHUNK_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's texts; what a task holds is bounded."""
    names = ["lang", "source", "term", "n", "docs"]
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([lang]).take(pa.array(np.zeros(len(n), np.int32))), pa.array([source]).take(pa.array(np.zeros(len(n), np.int32))),
                pa.array(n.keys(), pa.binary()), pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, n), pa.int64())], names)
        found.clear()

    held = 0
    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), set()
            for terms in _pieces(text.as_py()):
                n.update(terms)
                own.update(terms)
            docs.update(own)
            held += len(n) - before
            if held > HELD_TERMS:
                yield from handed()
                held = 0
    yield from handed()


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact for totals up to 9 * 10 ** 13."""
    part = (count + 1) * 100_000
    return 1 + part // total * 10_000 + part % total * 10_000 // total


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _coarser(a: np.ndarray) -> np.ndarray:
    r, c = (-(-n // SIDE) for n in a.shape)
    out = np.zeros((r * SIDE, c * SIDE), bool)
    out[:a.shape[0], :a.shape[1]] = a
    return out.reshape(r, SIDE, c, SIDE).any(axis=(1, 3))


def leaf_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, column) of all leaves with a count on either side, walking both trees down together."""
    trees = [(a, b)]
    while trees[-1][0].size > 1 or trees[-1][1].size > 1:
        trees.append((_coarser(trees[-1][0]), _coarser(trees[-1][1])))
    i = j = c = np.zeros(1, np.int64)
    for level, (x, y) in enumerate(reversed(trees)):
        if level:
            i, j, c = (np.repeat(v * SIDE, SIDE ** 3) + np.tile(np.arange(SIDE ** 3) // SIDE ** k % SIDE, len(v)) for k, v in ((2, i), (1, j), (0, c)))
            inside = (i < x.shape[0]) & (j < y.shape[0]) & (c < x.shape[1])
            i, j, c = i[inside], j[inside], c[inside]
        alive = x[i, c] | y[j, c]
        i, j, c = i[alive], j[alive], c[alive]
    return i, j, c


def _padded(counts: np.ndarray) -> np.ndarray:
    out = np.zeros([-(-n // SIDE) * SIDE for n in counts.shape], np.int64)
    out[:counts.shape[0], :counts.shape[1]] = counts
    return out


def joint_prices(a: np.ndarray, b: np.ndarray, total_a: np.ndarray, total_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all row pairs of two count matrices over the same columns: the summed distance over visited columns, and their number."""
    rows, cols = len(a), len(b)
    a, b = _padded(a), _padded(b)
    real = ((a > 0).any(axis=0) | (b > 0).any(axis=0)).astype(np.int64)
    p = _share(a, np.concatenate([total_a, np.ones(len(a) - rows, np.int64)])[:, None])
    q = _share(b, np.concatenate([total_b, np.ones(len(b) - cols, np.int64)])[:, None])
    leaf = lambda m: m.reshape(len(m) // SIDE, SIDE, -1, SIDE).swapaxes(1, 2)  # noqa: E731 - (row, column, 4, 4)
    p, q, real = leaf(p), leaf(q), real.reshape(-1, SIDE)
    i, j, c = leaf_pairs(leaf(a).any(axis=(2, 3)), leaf(b).any(axis=(2, 3)))
    value, width = np.zeros((len(p) * len(q), SIDE, SIDE), np.int64), np.zeros(len(p) * len(q), np.int64)
    order = np.argsort(i * len(q) + j, kind="stable")
    for at in range(0, len(order), LEAF_BATCH):
        o = order[at:at + LEAF_BATCH]
        x, y, z, pair = i[o], j[o], c[o], i[o] * len(q) + j[o]
        each = (_distance(p[x, z][:, :, None, :], q[y, z][:, None, :, :]) * real[z][:, None, None, :]).sum(axis=3)
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        value[pair[first]] += np.add.reduceat(each, first)
        width[pair[first]] += np.add.reduceat(real[z].sum(axis=1), first)
    value = value.reshape(len(p), len(q), SIDE, SIDE).swapaxes(1, 2).reshape(len(p) * SIDE, len(q) * SIDE)
    width = np.repeat(np.repeat(width.reshape(len(p), len(q)), SIDE, axis=0), SIDE, axis=1)
    return value[:rows, :cols], width[:rows, :cols]


_MARKS = "lang string, source string, part string, item string, value bigint, width bigint, zero bigint, kept bigint"


def _best_terms(lang: str, cells: pa.Table, sides: pa.Table, limit: int) -> list[pa.Table]:
    """The terms of a bucket that are more frequent in their group than in the lang: the ``limit`` with the largest distance per group."""
    if not len(cells):
        return []
    at = pc.index_in(cells["source"], sides["source"].combine_chunks()).to_numpy()
    p = _share(cells["n"].to_numpy(), sides["total"].to_numpy()[at])
    q = _share(cells["lang_n"].to_numpy(), sides["lang_total"].to_numpy()[at])
    found = pa.table({"source": cells["source"], "item": cells["term"], "value": _distance(p, q)}).filter(pa.array(p > q))
    found = found.sort_by([("source", "ascending"), ("value", "descending"), ("item", "ascending")])
    codes = found["source"].combine_chunks().dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    place = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
    found = found.filter(pa.array(place < limit))
    n = len(found)
    none = pa.nulls(n, pa.int64())
    return [pa.table({"lang": pa.array([lang] * n, pa.string()), "source": found["source"], "part": pa.array(["term"] * n, pa.string()), "item": found["item"],
                      "value": found["value"], "width": none, "zero": none, "kept": none})]


def _audited(limit: int):
    def run(key: tuple, cells: pa.Table, sides: pa.Table) -> pa.Table:
        lang, _, low, high = (k.as_py() for k in key)
        of = lambda t, block: t.filter(pc.equal(t["block"], block))
        left = of(sides, low)
        right = left if low == high else of(sides, high)
        out = _best_terms(lang, cells, left, limit) if low == high else []
        a, b = left["total"].to_numpy(), right["total"].to_numpy()
        value, width = np.zeros((len(a), len(b)), np.int64), np.zeros((len(a), len(b)), np.int64)
        back, back_width = value.T.copy(), width.T.copy()
        where = [(pc.index_in(t["source"], s["source"].combine_chunks()).to_numpy(), t["col"].to_numpy(), t["n"].to_numpy())
                 for t, s in ((of(cells, low), left), (of(cells, high), right))]
        columns = max(c.max(initial=-1) for _, c, _ in where) + 1 if len(a) and len(b) else 0  # a hash may leave a block without groups
        for at in range(0, columns, SLAB):
            slab = []
            for (r, c, n), rows in zip(where, (len(a), len(b))):
                m = np.zeros((rows, min(SLAB, columns - at)), np.int64)
                here = (c >= at) & (c < at + SLAB)
                m[r[here], c[here] - at] = n[here]
                slab.append(m)
            v, w = joint_prices(slab[0], slab[1], a, b)
            value += v
            width += w
            if low != high:
                v, w = joint_prices(slab[1], slab[0], b, a)
                back += v
                back_width += w
        for v, w, s, t in [(value, width, left, right), (back, back_width, right, left)][:1 + (low != high)]:
            mine, other = s["source"].combine_chunks(), t["source"].combine_chunks()
            n, m = len(mine), len(other)
            zero = np.zeros(1, np.int64)
            price = _distance(_share(zero, s["total"].to_numpy())[:, None], _share(zero, t["total"].to_numpy())[None, :])
            i, j = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
            keep = (i != j) if low == high else np.ones(n * m, bool)
            i, j = i[keep], j[keep]
            out.append(pa.table({"lang": pa.array([lang] * len(i), pa.string()), "source": mine.take(pa.array(i)), "part": pa.array(["pair"] * len(i), pa.string()),
                                 "item": other.take(pa.array(j)), "value": v[i, j], "width": w[i, j], "zero": price[i, j], "kept": s["kept"].to_numpy()[i]}))
        return pa.concat_tables(out)
    return run


def audited(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): how far every (lang, source) group's term shares lie from those of others.

    Terms are runs of letters and non-ASCII characters, A-Z lowered; a lang keeps those in at least ``min_docs`` of its documents (V terms). A
    share is p = 1 + floor(10^9 (count + 1) / (N + V)), the distance of p from q is floor((p - q)^2 / q).
    Part ``pair`` has every other source of the lang with the distances summed over all kept terms (0 without any); part ``term`` has the
    ``top_terms`` terms of the group with the largest distance from the lang, as far as they are more frequent in the group. Ranks go from 1
    by value, ties by item. Null text, lang and source are empty; texts without a term still make a group; repeated rows count as documents of their own;
    very long texts are read in pieces. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    blank = lambda c: F.coalesce(docs[f"`{c}`"].cast("string"), F.lit(""))
    rows = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).cast("binary").alias("text"))
    groups = cut_lineage(rows.select("lang", "source").distinct())
    most = groups.groupBy("lang").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    blocks, buckets = -(-most // BLOCK_ROWS), max(1, -(-docs.count() // BUCKET_DOCS))
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")

    parts = rows.mapInArrow(_count, "lang string, source string, term binary, n bigint, docs bigint")
    counts = parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    dealt = counts.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).repartition("lang", "bucket")
    term = Window.partitionBy("lang", "bucket", "term")
    kept = dealt.withColumn("df", F.sum("docs").over(term)).withColumn("lang_n", F.sum("n").over(term)).where(F.col("df") >= min_docs)
    col = F.dense_rank().over(Window.partitionBy("lang", "bucket").orderBy(F.desc("df"), "term")) - 1
    kept = cut_lineage(kept.select("lang", "bucket", "source", "term", "n", "lang_n", col.alias("col")))

    terms = kept.groupBy("lang", "bucket").agg((F.max("col") + 1).alias("v")).groupBy("lang").agg(F.sum("v").cast("long").alias("v"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    whole = own.groupBy("lang").agg(F.sum("own_n").alias("all_n"))
    sides = groups.join(own, ["lang", "source"], "left").join(terms.join(whole, "lang"), "lang", "left")
    number = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    v = number("v")
    # with no kept term all shares are those of an empty count over one
    sides = cut_lineage(sides.select("lang", "source", block.alias("block"), F.greatest(F.lit(1), number("own_n") + v).alias("total"),
                                     F.greatest(F.lit(1), number("all_n") + v).alias("lang_total"), v.alias("kept")))

    def met(t: DataFrame) -> DataFrame:
        """Every block goes to its pairs with all blocks."""
        other = t.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return other.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")

    cells = met(kept.withColumn("block", block)).groupBy("lang", "bucket", "low", "high")
    sides = met(sides.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))).groupBy("lang", "bucket", "low", "high")
    marks = cut_lineage(cells.cogroup(sides).applyInArrow(_audited(top_terms), _MARKS))

    pairs = marks.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(
        (F.sum("value") + (F.first("kept") - F.sum("width")) * F.first("zero")).alias("value"))
    found = marks.where("part = 'term'").select("lang", "source", "part", "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda t: t.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionAll(ranked(found).where(F.col("rank") <= top_terms))
