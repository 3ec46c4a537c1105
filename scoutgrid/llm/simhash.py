"""SimHash near-duplicates by a self-join of the binary trie of all fingerprints.

1. Every whole text becomes a 64-bit fingerprint, in Arrow batches; equal fingerprints are one from here on.
2. The trie is cut into leaves of at most ``LEAF`` fingerprints, ``STRIDE`` bits at a time, as deep as it is crowded there: a family
   of many near copies gets more levels, nothing else does.
3. Pairs of trie nodes are walked down together from (root, root). A pair adds up the bits in which its two prefixes
   differ and is dropped once they exceed the budget; a node is paired with itself once.
4. Pairs of leaves that are left meet as two packed arrays and are compared exactly. What leaves a task is one row
   per fingerprint that has a link there, never a row per pair.
5. Links become components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from scoutgrid.llm.components import components
from scoutgrid.session import cut_lineage

STRIDE, LEAF = 4, 512
CHUNK = 255 * 256
_NODE = "struct<depth:int,prefix:bigint,leaf:boolean>"


def fingerprint(text: bytes | None, k: int) -> int:
    """Bits set in over half of the hashes of all ``k``-word shingles (A-Z lowered, repeats included); 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - k + 1)
    starts = np.concatenate([[0], ends[:n - 1] + 1])
    ends = ends[-n:]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        pieces = map(joined.__getitem__, map(slice, starts[at:at + CHUNK].tolist(), ends[at:at + CHUNK].tolist()))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64)
        # sums of 255 rows fit in a byte
        padded = np.zeros(-len(hashes) % 255 + len(hashes), "<u8")
        padded[:len(hashes)] = hashes
        bits = np.unpackbits(padded.view(np.uint8), bitorder="little").reshape(-1, 255, 64)
        ones += bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint(t.as_py(), k) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], ["row", "print"])
    return run


def _mask(depth: int | Column) -> Column:
    """The first ``depth`` of 64 bits."""
    if isinstance(depth, int):
        return F.lit(((1 << 64) - (1 << (64 - depth))) - ((1 << 64) if depth else 0)).cast("long")
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), 64 - depth))


def _leaves(prints: DataFrame) -> DataFrame:
    """(print, depth, prefix): the leaf of every fingerprint. Starts at the depth where leaves of even spread would be full."""
    depth = max(0, (max(1, prints.count()) // LEAF).bit_length() - 1) // STRIDE * STRIDE
    done, rest = [], prints
    while True:
        rest = rest.select("print", F.col("print").bitwiseAND(_mask(depth)).alias("prefix"))
        crowd = rest.groupBy(F.col("prefix").alias("_prefix")).agg(F.count("*").alias("crowd"))
        placed = cut_lineage(rest.join(crowd, F.col("prefix") == F.col("_prefix")).select("print", "prefix", "crowd"))
        done.append(placed.where(F.col("crowd") <= LEAF).select("print", F.lit(depth).alias("depth"), "prefix"))
        rest = placed.where(F.col("crowd") > LEAF)
        if rest.isEmpty():
            return reduce(DataFrame.unionAll, done)
        depth += STRIDE


def _kids(leaves: DataFrame) -> DataFrame:
    """(depth, prefix, kids): the nodes below every inner node, from the leaves up."""
    at = F.explode(F.sequence(F.lit(STRIDE), F.col("depth"), F.lit(STRIDE)))
    below = leaves.where("depth > 0").select("prefix", F.col("depth").alias("own"), at.alias("depth"))
    kid = F.struct("depth", F.col("prefix").bitwiseAND(_mask(F.col("depth"))).alias("prefix"), (F.col("depth") == F.col("own")).alias("leaf"))
    below = below.select(kid.alias("kid")).distinct()
    return below.groupBy((F.col("kid.depth") - STRIDE).alias("depth"), F.col("kid.prefix").bitwiseAND(_mask(F.col("kid.depth") - STRIDE)).alias("prefix")).agg(
        F.collect_list("kid").alias("kids"))


def _pairs(leaves: DataFrame, deepest: int, bits: int) -> DataFrame:
    """(a, b) leaves whose prefixes differ in at most ``bits`` bits; each pair once, every leaf with itself."""
    kids = cut_lineage(_kids(leaves))
    root = leaves.groupBy().agg(F.max("depth").alias("top")).where("top is not null").select(
        F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), (F.col("top") == 0).alias("leaf")).alias("a"))
    front = root.select("a", F.col("a").alias("b"), F.lit(0).alias("differing"))
    found = []
    for _ in range(0, deepest, STRIDE):
        found.append(front.where("a.leaf and b.leaf").select("a", "b"))
        more = front.where("not (a.leaf and b.leaf)")
        for side in ("a", "b"):
            own = kids.select(F.col("depth").alias(f"{side}_depth"), F.col("prefix").alias(f"{side}_prefix"), F.col("kids").alias(f"{side}_kids"))
            more = more.join(own, (F.col(f"{side}.depth") == F.col(f"{side}_depth")) & (F.col(f"{side}.prefix") == F.col(f"{side}_prefix")), "left")
        below = lambda side: F.coalesce(f"{side}_kids", F.array(side))  # noqa: E731 - a leaf waits for the other side
        seen = _mask(F.least("a.depth", "b.depth"))

        def step(x: Column, y: Column) -> Column:
            fresh = x["prefix"].bitwiseXOR(y["prefix"]).bitwiseAND(_mask(F.least(x["depth"], y["depth"]))).bitwiseAND(F.bitwise_not(seen))
            return F.struct(x.alias("a"), y.alias("b"), (F.col("differing") + F.bit_count(fresh)).alias("differing"))

        both = F.flatten(F.transform(below("a"), lambda x: F.transform(below("b"), lambda y: step(x, y))))
        alive = F.filter(both, lambda p: (p["differing"] <= bits) & ((F.col("a") != F.col("b")) | (p["a"]["prefix"] <= p["b"]["prefix"])))
        front = cut_lineage(more.select(F.inline(alive)))
    found.append(front.where("a.leaf and b.leaf").select("a", "b"))
    return reduce(DataFrame.unionAll, found)


def _near(a: np.ndarray, b: np.ndarray, same: bool, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints of two leaves, and the least one that each of them reaches inside this pair."""
    linked = np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= bits
    if same:
        np.fill_diagonal(linked, False)
    rows, cols = linked.any(axis=1), linked.any(axis=0)
    if not rows.any():
        return a[:0], a[:0]
    linked, a, b = linked[rows][:, cols], a[rows], b[cols]
    most = np.iinfo(np.int64).max
    low_a, low_b = a.copy(), b.copy()
    while True:
        to_a = np.minimum(low_a, np.where(linked, low_b[None, :], most).min(axis=1))
        to_b = np.minimum(low_b, np.where(linked, to_a[:, None], most).min(axis=0))
        if same:
            to_a = to_b = np.minimum(to_a, to_b)
        if (to_a == low_a).all() and (to_b == low_b).all():
            break
        low_a, low_b = to_a, to_b
    return (a, low_a) if same else (np.concatenate([a, b]), np.concatenate([low_a, low_b]))


def _compare(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for a, b, same in zip(batch.column(0), batch.column(1), batch.column(2)):
                u, v = _near(a.values.to_numpy(), b.values.to_numpy(), same.as_py(), bits)
                us.append(u)
                vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
    return run


def links(prints: DataFrame, bits: int) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints (column ``print``, distinct) linked through at most ``bits`` differing bits a step."""
    leaves = _leaves(prints)
    packed = cut_lineage(leaves.groupBy("depth", "prefix").agg(F.sort_array(F.collect_list("print")).alias("prints")))
    tops = packed.select("depth", "prefix")
    deepest = tops.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    pairs = _pairs(tops, deepest, bits)
    for side in ("a", "b"):
        own = packed.select(F.col("depth").alias(f"{side}_depth"), F.col("prefix").alias(f"{side}_prefix"), F.col("prints").alias(f"{side}_prints"))
        pairs = pairs.join(own, (F.col(f"{side}.depth") == F.col(f"{side}_depth")) & (F.col(f"{side}.prefix") == F.col(f"{side}_prefix")))
    met = pairs.select("a_prints", "b_prints", (F.col("a") == F.col("b")).alias("same"))
    return met.mapInArrow(_compare(bits), "u long, v long").where("u <> v")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, bits: int = 2) -> DataFrame:
    """``row`` (the key), ``print`` (fingerprint as a signed long) and component_id of every input row.

    Two rows link when their fingerprints differ in at most ``bits`` bits, equal ones included; component_id is the smallest key
    reachable by links, the row's own included (null keys are passed over, a component without another key has null). Null,
    empty and blank texts have fingerprint 0 and link like any other; a text of fewer than ``k`` words is one shingle. Texts are
    hashed whole, very long ones in chunks. Repeated rows are linked copies. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    plain = docs.select(docs[f"`{key}`"].alias("row"), docs[f"`{text}`"].cast("string").cast("binary").alias("text"))
    kind = plain.schema["row"].dataType.simpleString()
    rows = cut_lineage(plain.mapInArrow(_fingerprints(k), f"row {kind}, print long"))
    own = cut_lineage(rows.groupBy("print").agg(F.min("row").alias("least")))
    label = components(links(own.select("print"), bits))
    known = own.join(label, own["print"] == label["node"], "left").select("print", "least", F.coalesce("label", "print").alias("label"))
    first = known.groupBy("label").agg(F.min("least").alias("component_id"))
    known = known.join(first, "label").select(F.col("print").alias("_print"), "component_id")
    return rows.join(known, F.col("print") == F.col("_print")).select("row", "print", "component_id")
