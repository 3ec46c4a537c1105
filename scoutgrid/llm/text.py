"""Text conventions shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Words between ASCII blanks; ``bytes.split()`` cuts at the same places."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The input row as one struct ``row`` beside computed columns, so that no name of the input can clash with them."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once.

    A filter on a plain projection is pushed below it and repeats its expressions; a one-row
    generator holds it above.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text leaves ``fold``; null keys count as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def hashed_sample(keys: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` of the keys (column ``key``), all if there are no more: those with the smallest hashes.

    The bound on the hash comes from a count, so that no task sends more than its share of the sample.
    """
    n = keys.count()
    if n <= limit:
        return keys
    bound = int((limit * 0.97 / n) * 2**62)
    return keys.where(F.shiftrightunsigned(F.xxhash64(F.lit(11), "key"), 2) < bound).limit(limit)
