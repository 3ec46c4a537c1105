"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification over item-sized windows.

The CGK walk turns a word sequence into a longer one: at step j it writes the word it stands on and moves on if a random
bit of (j, word) says so. Sequences at a small edit distance walk together again after an edit, so that their embeddings
have a small Hamming distance. Bands of a few sampled steps are the LSH keys; several walks with several bands each
are repeated until the recall is high. Every hit is verified by the exact edit distance in words.

Only windows with an intact run of an item's words are embedded: with at most ``k`` edits in ``L`` words some run of
(L - k) // (k + 1) words is intact, so that this loses no window within the limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scoutgrid.llm.shingles import WordCodes, mixed

WALKS, BANDS, SAMPLES = 4, 8, 4
EDIT_PERCENT = 20
CHUNK_WORDS = 200_000
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)

# Letters and digits stay, A-Z are lowered, other signs below 128 part words.
FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def folded(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def limit(n: int, percent: int = EDIT_PERCENT) -> int:
    return n * percent // 100


def size_class(n: int) -> int:
    """The largest of 1, 2, 3, 4, 5, 7, 9, 12, 15, 19, ... (growth by a quarter) that is not above n."""
    w = 1
    while (up := w + max(1, (w + 2) // 4)) <= n:
        w = up
    return w


def _gram(c: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q words from each position; positions near the end are left out."""
    acc = np.full(max(0, len(c) - q + 1), q, np.uint64)
    for j in range(q):
        acc = mixed(acc * _STEP + c[j:j + len(acc)])
    return acc


class _Keys:
    """Sorted 64-bit keys with values; a bitmap of their last bits, 64 to 128 places a key, turns most questions away."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.mask = np.uint64((1 << (64 * len(keys)).bit_length()) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[(keys & self.mask).astype(np.int64)] = True

    def hits(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``asked`` and the values found there, a pair per match."""
        at = np.flatnonzero(self.bits[(asked & self.mask).astype(np.int64)])
        low, high = (np.searchsorted(self.keys, asked[at], side) for side in ("left", "right"))
        n = high - low
        first = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(at, n), self.values[first]


def _bands(c: np.ndarray, starts: np.ndarray, w: int, walk: int) -> Iterator[np.ndarray]:
    """LSH keys of the windows of w words at ``starts``; c ends in 2 w words of padding.

    The random bits of the words are drawn for 64 steps at a time, so that a long walk needs no more memory than a short one.
    """
    salts = np.random.default_rng(walk).integers(1, 1 << 62, 4096, dtype=np.uint64)
    draw = np.random.default_rng((w, walk))
    steps = 2 * w
    wanted = np.array([np.resize(draw.permutation(steps), SAMPLES) for _ in range(BANDS)])
    seen, at = {}, starts.copy()
    needed = set(wanted.ravel().tolist())
    for j in range(max(needed) + 1):
        if j % 64 == 0:
            coins = mixed(c * _STEP + salts[j // 64 % 4096] + np.uint64(j // 64 // 4096))
        if j in needed:
            seen[j] = np.where(at - starts < w, c[at], np.uint64(0))
        at += ((coins[at] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
    for b in range(BANDS):
        acc = np.full(len(starts), (w << 16) + (walk << 8) + b, np.uint64)
        for j in wanted[b]:
            acc = mixed(acc * _STEP + seen[int(j)])
        yield acc


def edit_spans(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the part of ``region`` closest to ``item`` in word edits; the first such end, the shortest part."""
    def ends(a, b):
        steps = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64)
        for i, word in enumerate(a):
            new = np.concatenate(([i + 1], np.minimum(row[:-1] + (b != word), row[1:] + 1)))
            row = np.minimum.accumulate(new - steps) + steps
        return row

    row = ends(item, region)
    end = int(row.argmin())
    back = ends(item[::-1], region[:end][::-1])
    return int(row[end]), end - int(back.argmin()), end


@dataclass
class _Class:
    """Items whose windows have w words."""

    w: int
    q: int
    seeds: _Keys
    bands: list[_Keys]


class Index:
    """Items ready to be looked for: per size class the intact runs to wait for and the band keys of the item windows."""

    def __init__(self, items: list[tuple[object, bytes | None]], percent: int = EDIT_PERCENT):
        codes = WordCodes()
        self.percent = percent
        self.ids, self.words = [], []
        for key, text in items:
            if words := folded(text):
                self.ids.append(key)
                self.words.append(codes.of(words))
        self.classes = [self._class(w) for w in sorted({size_class(len(c)) for c in self.words})]

    def _class(self, w: int) -> _Class:
        mine = [i for i, c in enumerate(self.words) if size_class(len(c)) == w]
        runs = [(len(self.words[i]) - limit(len(self.words[i]), self.percent)) // (limit(len(self.words[i]), self.percent) + 1) for i in mine]
        q = max(1, min(4, w, *runs))
        seeds = np.unique(np.concatenate([_gram(self.words[i], q) for i in mine]))
        flat, starts, owner, offset = [], [], [], []
        at = 0
        for i in mine:
            for o in sorted({0, (len(self.words[i]) - w) // 2, len(self.words[i]) - w}):
                starts.append(at)
                owner.append((i, o))
                flat += [self.words[i][o:o + w], np.zeros(2 * w, np.uint64)]
                at += 3 * w
        c, starts = np.concatenate(flat), np.array(starts)
        bands = [_Keys(k, np.array(owner)) for walk in range(WALKS) for k in _bands(c, starts, w, walk)]
        return _Class(w, q, _Keys(seeds, seeds), bands)

    def _candidates(self, k: _Class, docs: list[np.ndarray], names: np.ndarray) -> Iterator[np.ndarray]:
        """Rows (document, word where item begins, item) of windows of one class that share a band with an item."""
        pad = np.zeros(2 * k.w + 1, np.uint64)
        flat, begin, at = [pad], [], len(pad)
        for n in names:
            begin.append(at)
            flat += [docs[n], pad]
            at += len(docs[n]) + len(pad)
        c, begin = np.concatenate(flat), np.array(begin)
        hit = np.zeros(len(c) + 1, np.int64)
        hit[np.unique(k.seeds.hits(_gram(c, k.q))[0]) + 1] = 1
        upto = np.cumsum(hit)  # runs that begin before a position
        last = len(c) - len(pad)
        inside = np.minimum(np.arange(last) + k.w, len(c))
        # every window that holds a whole run
        starts = np.flatnonzero(upto[inside] - upto[:last] > 0)
        n = 0
        for walk in range(WALKS):
            for key in _bands(c, starts, k.w, walk):
                at, owners = k.bands[n].hits(key)
                n += 1
                if len(at):
                    place = starts[at] - owners[:, 1]
                    owner = np.maximum(np.searchsorted(begin, place + k.w, "right") - 1, 0)
                    yield np.column_stack((names[owner], place - begin[owner], owners[:, 0]))

    def candidates(self, docs: list[np.ndarray]) -> np.ndarray:
        """Rows (document, item, word where the item begins) in this order. Each class sees the documents with one of its runs only,
        padded for its own size, ``CHUNK_WORDS`` words with their padding at a time."""
        gap = np.zeros(1, np.uint64)
        flat = np.concatenate([x for d in docs for x in (d, gap)])
        begin = np.cumsum([0, *(len(d) + 1 for d in docs)])[:-1]
        found = [np.empty((0, 3), np.int64)]
        for k in self.classes:
            near = np.unique(np.searchsorted(begin, k.seeds.hits(_gram(flat, k.q))[0], "right") - 1)
            if not len(near):
                continue
            size = np.cumsum([len(docs[n]) + 2 * k.w + 1 for n in near])
            for part in np.split(near, np.unique(np.searchsorted(size, np.arange(CHUNK_WORDS, size[-1], CHUNK_WORDS)) + 1)):
                if len(part):
                    found += self._candidates(k, docs, part)
        return np.unique(np.concatenate(found)[:, [0, 2, 1]], axis=0)

    def found_in(self, docs: list[np.ndarray]) -> list[list[dict]]:
        """Hits of each document: item, start, end (words, end exclusive) and distance."""
        out: list[list[dict]] = [[] for _ in docs]
        if not self.classes or not docs:
            return out
        last = None
        for doc, item, place in self.candidates(docs).tolist():
            words = self.words[item]
            allowed = limit(len(words), self.percent)
            if last and last[:2] == (doc, item) and place < last[2]:
                continue
            low = max(0, place - 2 * allowed - 2)
            region = docs[doc][low:max(0, place) + len(words) + 2 * allowed + 2]
            if len(words) - np.isin(words, region).sum() > allowed:  # each word that is missing costs an edit
                continue
            distance, s, e = edit_spans(words, region)
            if distance <= allowed:
                last = (doc, item, low + e - allowed)
                hit = {"item": self.ids[item], "start": low + s, "end": low + e, "distance": distance}
                if hit not in out[doc]:
                    out[doc].append(hit)
        return out


def _mark(index, item_type: pa.DataType):
    hit = pa.list_(pa.struct([("item", item_type), ("start", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for b in batches:
            hits, docs, size = [], [], 0
            for text in b.column(1):
                docs.append(codes.of(folded(text.as_py())))
                size += len(docs[-1])
                if size >= CHUNK_WORDS:
                    hits += index.value.found_in(docs)
                    docs, size = [], 0
            hits += index.value.found_in(docs)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, hit)], ["row", "hits"])
    return run


def marked(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
           keep: tuple[str, ...] | None = None, percent: int = EDIT_PERCENT) -> DataFrame:
    """``row`` (the columns ``keep``, default all) and ``hits`` (item, start, end, distance) of every document.

    A hit is a part of the text whose words are within ``percent`` % word edits of an item, overlapping parts reported once; words are
    folded to lower-case letters and digits. The items are the query set: they go to every task in blocks of about
    ``BLOCK_ITEMS`` items or ``BLOCK_BYTES`` bytes, one pass over the documents a block. A long item's windows are padded and walked by themselves,
    and only in documents that share a run with it; very long texts are read whole. Null and empty texts have no hits, items without a word
    match nothing, repeated items are all reported, empty tables of either kind give rows without hits. The input row travels as one struct, so that
    names of other columns cannot clash.
    """
    spark = docs.sparkSession
    body = items[f"`{item_text}`"].cast("string").cast("binary")
    wanted = items.select(items[f"`{item_key}`"].alias("item"), body.alias("text"))
    n, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    columns = list(keep or docs.columns)
    out = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("row"), docs[f"`{text}`"].cast("string").cast("binary").alias("t"))
    kind, item_kind = out.schema["row"].dataType.simpleString(), wanted.schema["item"].dataType.simpleString()
    hit_kind = f"array<struct<item:{item_kind},start:int,end:int,distance:int>>"
    arrow_type = wanted.limit(0).select("item").toArrow().schema.field("item").type
    result = None
    for n in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == n) if blocks > 1 else wanted
        index = spark.sparkContext.broadcast(Index(sorted(((r["item"], r["text"]) for r in part.collect()), key=str), percent))
        source = out if result is None else result
        if blocks > 1:
            nested = F.struct("row", *([F.col("hits")] if result is not None else []), "t").alias("row")
            source = source.select(nested, "t")
            kind_n = source.schema["row"].dataType.simpleString()
            found = source.mapInArrow(_mark(index, arrow_type), f"row {kind_n}, hits {hit_kind}")
            hits = F.concat("row.hits", "hits") if result is not None else F.col("hits")
            result = found.select(F.col("row.row").alias("row"), hits.alias("hits"), F.col("row.t").alias("t"))
        else:
            result = source.mapInArrow(_mark(index, arrow_type), f"row {kind}, hits {hit_kind}")
    return result.select("row", "hits")


def clean_only(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without a hit, with their own columns."""
    return marked(docs, items, **options).where(F.size("hits") == 0).select("row.*")
