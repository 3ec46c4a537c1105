"""Dense ranks within groups of any size: one global sort, then an offset per group and sorted partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scoutgrid.session import cut_lineage


def ranked(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Add ``rank`` (from 0 within ``group``, null being a group of its own) and ``size`` (rows of the group).

    The sorted rows are kept, so that a row's place in its partition stands. A group may span many partitions; what a
    window sees of it is one row for each. ``order`` should not tie, or equal rows should be interchangeable; to let Spark
    split a long run of equal rows, end it with a column that differs.
    """
    placed = cut_lineage(df.orderBy(F.col(group).asc_nulls_first(), *order)).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    pieces = placed.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_piece")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("_group", "_piece", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("size"))
    both = placed.join(pieces, placed[group].eqNullSafe(pieces["_group"]) & (placed["_part"] == pieces["_piece"]))
    return both.withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_group", "_piece", "_shift")
