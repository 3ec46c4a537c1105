"""N-gram Jaccard join: a grouped prefix join over word shingles, exact, without ever listing the pairs of a group.

1. Texts with equal shingle sets are one class.
2. A class's prefix is its n - ceil(t n) + 1 first shingles in one global order: shingles of a hash-chosen share come first,
   rarest first, the others after them. Linked classes share a prefix shingle. Only the share is counted, and shingles
   found once link nothing, so most classes have an empty prefix and are done.
3. Classes with equal prefix and size are one group. Each prefix shingle names one of its groups the hub; every two
   groups that share a shingle thus meet at a hub. Hubs with many members are dealt out in blocks of bounded size.
4. Members are expanded with their texts and verified exactly, block against block; what leaves a task is one row per member.
5. Links become components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from scoutgrid.llm.components import components
from scoutgrid.llm.shingles import WordCodes, shingles
from scoutgrid.llm.text import packed
from scoutgrid.session import cut_lineage

BLOCK_MEMBERS, BLOCK_BYTES = 1000, 16_000_000
#: Counted shingles for each one of a prefix; up to the share KEPT of all shingles they are kept from the first pass, else texts are read again for them.
COUNTED, KEPT = 2.5, 0.3


def _prefix_size(n: int, percent: int) -> int:
    return n + (-percent * n) // 100 + 1


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _split(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The counted share of a set (two and a half times the prefix) and, if it is shorter than the prefix, what the others add."""
    first = (s & np.uint64(0xFFFF)) < np.uint64(min(65536, round(65536 * COUNTED * (100 - percent) / 100)))
    counted = s[first]
    return counted, s[~first][:max(0, _prefix_size(len(s), percent) - len(counted))]


def _class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0


def _describe(k: int, percent: int, keep: bool):
    """(row, text_hash, class, n, counted, rest, tokens) of every text; ``tokens`` is the counted share, if it is to be kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seen = WordCodes(), set()
        for b in batches:
            out = []
            for text in b.column(2):
                s = shingles(text.as_py(), k, codes)
                counted, rest = _split(s, percent)
                c = _class_of(s)
                new = keep and len(s) > 0 and c not in seen  # a class counts once; copies met in other tasks only change the order
                if new and len(seen) < 2_000_000:
                    seen.add(c)
                out.append((c, len(s), len(counted), _signed(rest), _signed(counted) if new else None))
            cols = list(zip(*out)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in cols[:3]],
                                              *[pa.array(c, pa.list_(pa.int64())) for c in cols[3:]]], ["row", "text_hash", "class", "n", "counted", "rest", "tokens"])
    return run


def _tokens(k: int, percent: int):
    """(class, tokens) of the texts, a class once per task."""
    describe = _describe(k, percent, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in describe(pa.RecordBatch.from_arrays([b.column(0), b.column(0), b.column(0)], ["row", "text_hash", "text"]) for b in batches):
            yield pa.RecordBatch.from_arrays([b.column("class"), b.column("tokens")], ["class", "tokens"])
    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections: incidence matrices over shared shingles, multiplied some columns at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    where = [[np.searchsorted(shared, s[np.isin(s, shared, assume_unique=True)]) for s in side] for side in (left, right)]
    for at in range(0, len(shared), columns):
        parts = []
        for side in where:
            m = np.zeros((len(side), min(columns, len(shared) - at)), np.float32)
            for i, w in enumerate(side):
                m[i, w[np.searchsorted(w, at):np.searchsorted(w, at + columns)] - at] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _member_of(hubs: list, hub: int, names: dict) -> np.ndarray:
    out = np.zeros((len(hubs), max(1, len(names))), np.float32)
    for i, hs in enumerate(hubs):
        for h in hs:
            if h < hub:
                out[i, names[h]] = 1
    return out


def _verify(k: int, percent: int):
    def run(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        hub, low, high = key
        sides = [members] if low == high else [members[members["block"] == low], members[members["block"] == high]]
        if any(len(s) == 0 for s in sides) or len(members) < 2:
            return pd.DataFrame({"class": [], "root": [], "links": []})
        codes = WordCodes()
        sets = [[shingles(t, k, codes) for t in s["text"]] for s in sides]
        names = {h: i for i, h in enumerate(sorted({h for hs in members["hubs"] for h in hs if h < hub}))}
        own = [_member_of(list(s["hubs"]), hub, names) for s in sides]
        sets, own, sides = [x if len(x) == 2 else [x[0], x[0]] for x in (sets, own, sides)]
        common = _overlaps(*sets)
        sizes = [np.array([len(s) for s in side], np.float32) for side in sets]
        linked = 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)
        if low == high:
            np.fill_diagonal(linked, False)
        fresh = linked & (own[0] @ own[1].T == 0)  # a pair that meets at several hubs counts at the first
        ids = [s["class"].to_numpy() for s in sides]
        links = [fresh @ sides[1]["copies"].to_numpy(), fresh.T @ sides[0]["copies"].to_numpy()]
        every = ids[0] if low == high else np.concatenate(ids)
        # labels settle on the smallest class reachable inside this block pair
        label = [i.copy() for i in ids]
        while True:
            to = [np.minimum(label[0], np.where(linked, label[1][None, :], np.iinfo(np.int64).max).min(axis=1)),
                  np.minimum(label[1], np.where(linked, label[0][:, None], np.iinfo(np.int64).max).min(axis=0))]
            if low == high:
                to = [np.minimum(*to)] * 2
            if all((a == b).all() for a, b in zip(to, label)):
                break
            label = to
        return pd.DataFrame({"class": every, "root": label[0] if low == high else np.concatenate(label),
                             "links": links[0] if low == high else np.concatenate(links)})
    return run


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """``row`` (the key), ``class``, n_shingles, component_id, n_links for every input row.

    Two rows link when 100 * common shingles >= ``percent`` * shingles of both; n_links counts the linked rows, equal sets included.
    component_id is the smallest key reachable by links, the row's own included (null keys are passed over). Rows without a word
    have class 0 and no shingles and link with nothing; shorter texts are one shingle. Repeated rows are linked copies.
    An empty table gives an empty result; other columns are ignored. Hashes have 64 bits.
    """
    body = docs[f"`{text}`"].cast("string")
    plain = docs.select(docs[f"`{key}`"].alias("row"), F.xxhash64(body).alias("text_hash"), body.cast("binary").alias("text"))
    kind = plain.schema["row"].dataType.simpleString()
    keep = COUNTED * (100 - percent) / 100 <= KEPT
    info = cut_lineage(plain.mapInArrow(_describe(k, percent, keep), f"row {kind}, text_hash long, class long, n long, counted long, rest array<long>, tokens array<long>"))
    classes = cut_lineage(info.where("n > 0").groupBy("class").agg(
        F.first("n").alias("n"), F.first("counted").alias("counted"), F.first("rest").alias("rest"), F.min("text_hash").alias("text_hash"),
        F.count("*").alias("copies"), F.min("row").alias("least")))

    sets = info.select("class", "tokens") if keep else plain.select("text").mapInArrow(_tokens(k, percent), "class long, tokens array<long>")
    tokens = sets.select("class", F.explode("tokens").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(common, "token").groupBy("class").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("shared"))
    n, counted = F.col("n"), F.col("counted")
    due = F.least(n - F.ceil(percent * n / 100) + 1, counted) - counted + F.size("shared")
    prefix = F.concat(F.slice(F.transform("shared", lambda s: s["token"]), F.lit(1), F.greatest(F.lit(0), due).cast("int")), "rest")
    prefixes = classes.join(shared, "class", "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<struct<df:bigint,token:bigint>>")))
    prefixes = cut_lineage(prefixes.select("class", "n", "copies", "text_hash", prefix.alias("prefix")).where(F.size("prefix") > 0).select(
        "*", F.xxhash64("n", "prefix").alias("group")))

    groups = prefixes.groupBy("group").agg(F.first("prefix").alias("prefix"), F.count("*").alias("members"))
    postings = groups.select("group", "members", F.explode("prefix").alias("token"))
    hubs = postings.groupBy("token").agg(F.min("group").alias("hub"), F.sum("members").alias("all")).where(F.col("all") > 1).drop("all")
    meets = postings.join(hubs, "token").select("group", "hub").distinct()
    meets = meets.groupBy("group").agg(F.collect_set("hub").alias("hubs"))  # as many as a prefix has shingles at most
    members = cut_lineage(prefixes.join(meets, "group").select("class", "n", "copies", "text_hash", "hubs", F.explode("hubs").alias("hub")))
    blocks = members.groupBy("hub").agg(F.count("*").alias("m"), F.sum("n").alias("size")).where("m > 1").select(
        "hub", F.greatest(F.ceil(F.col("m") / BLOCK_MEMBERS), F.ceil(8 * F.col("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = members.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    placed = placed.select("class", "copies", "text_hash", "hubs", "hub", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    texts = plain.select("text_hash", "text").dropDuplicates(["text_hash"]).join(placed.select("text_hash").distinct(), "text_hash", "left_semi")
    met = placed.join(texts, "text_hash").select("hub", "low", "high", "block", "class", "copies", "hubs", "text")
    found = cut_lineage(met.groupBy("hub", "low", "high").applyInPandas(_verify(k, percent), "class long, root long, links long"))

    label = components(found.select(F.col("class").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    known = classes.join(label, classes["class"] == label["node"], "left").select(
        classes["class"], "copies", "least", F.coalesce("label", "class").alias("label"))
    first = known.groupBy("label").agg(F.min("least").alias("component_id"))
    known = known.join(first, "label").join(links, "class", "left").select(
        "class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return info.select("row", "class", "n").join(known, "class", "left").select(
        "row", "class", F.col("n").alias("n_shingles"), F.coalesce("component_id", "row").alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row of every linked group with its own columns: the one with the smallest key, among these the smallest text hash.

    Rows without a word are not linked and all stay, except that rows equal in key and text are kept once. The input row travels as one struct,
    so that names of other columns cannot clash; an empty table gives no rows; very long texts are compared whole.
    """
    name = F.struct(docs[f"`{key}`"].alias("key"), F.xxhash64(F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))).alias("hash"))
    known = joined(docs.select(name.alias("name"), docs[f"`{text}`"].alias("text")), "name", "text", k, percent)
    kept = known.where(F.col("row") == F.col("component_id")).select(F.col("row.key").alias("kept_key"), F.col("row.hash").alias("kept_hash")).distinct()
    rows = packed(docs, key=name["key"], hash=name["hash"])
    both = rows.join(kept, rows["key"].eqNullSafe(kept["kept_key"]) & (rows["hash"] == kept["kept_hash"]))
    return both.select("row", "key", "hash").dropDuplicates(["key", "hash"]).select("row.*")
