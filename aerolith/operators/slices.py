"""Ordered series cut into slices of bounded length, so that one hot entity is never one task.

`sliced` cuts a series with one row per entity and second by time: a slice is a span of `width` seconds and so holds at
most that many rows, however hot its entity is. A slice also gets guests, rows of the slices beside it, so that windows
that look no further are exact at the seams. Guests come from the first and last rows of every slice, of which each
slice gives a bounded array; rows and arrays are two readings of one exchange, so what stands upstream runs once, and
everything after stays in the partitioning by (entity, slice).

`numbered` gives every row its number in its entity's series, for series with many rows in one second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sliced(
    df: DataFrame, key: str, second: str, back: int = 1, ahead: int = 0, width: int = 86_400, more: int = 0, reach_s: int = 0,
    tie: str | None = None, keep_tie: bool = True,
) -> DataFrame:
    """df with _slice and _own (false for guests), partitioned by (key, _slice). Rows without key or second are left
    out.

    Guests of a slice are the `back` rows before it and the `ahead` rows after it, wherever they are; and of the rows
    within reach_s seconds of it (less than width) up to `more` on each side that has any guests. There may be further
    rows before these, not next to each other: of the guests only the nearest `back` and `ahead` ones, and those within
    reach, are sure to be the series as it is.

    df must have one row per key and second, or `tie`: then the first row by `tie` stays, which must be unique but for
    repeated rows. That is a hash aggregate, filled on the map side, so a group of copies of any size is one row a task
    before anything moves or is sorted. All columns of the result should be used: a column that only one of the two
    readings needs makes two exchanges of the one."""
    df = df.where(F.col(key).isNotNull() & F.col(second).isNotNull())
    if tie:
        rest = [c for c in df.columns if c not in (key, second, tie)]
        df = df.groupBy(key, second).agg(F.min(tie).alias(tie), *[F.min_by(c, tie).alias(c) for c in rest])
        df = df if keep_tie else df.drop(tie)
    cols = [c for c in df.columns if c != key]
    # what the join below would infer for one of its sides only is said for both, or the exchange isn't the same
    base = df.withColumn("_slice", F.floor(F.col(second) / width)).where(F.col("_slice").isNotNull()).repartition(key, "_slice")
    here = W.partitionBy(key, "_slice").orderBy(second)
    base = base.withColumn("_i", F.row_number().over(here)).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(key, "_slice")))
    row = F.struct(*[F.col(f"`{c}`") for c in cols], F.lit(False).alias("_own"))
    s, start = F.col(second), F.col("_slice") * width
    first = (F.col("_i") <= ahead) | ((F.col("_i") <= (more if ahead else 0)) & (s < start + reach_s))
    last = (F.col("_i") > F.col("_n") - back) | ((F.col("_i") > F.col("_n") - (more if back else 0)) & (s >= start + width - reach_s))
    edges = base.where(first | last | (F.col("_i") == 1)).groupBy(key, "_slice").agg(
        F.collect_list(F.when(first, row)).alias("_first"), F.collect_list(F.when(last, row)).alias("_last")
    )
    none = F.array().cast(dict(edges.dtypes)["_last"])
    over = lambda a, b: W.partitionBy(key).orderBy("_slice").rowsBetween(a, b)
    before = F.flatten(F.collect_list("_last").over(over(-back, -1))) if back else none
    after = F.flatten(F.collect_list("_first").over(over(1, ahead))) if ahead else none
    guests = edges.select(F.col(key).alias("_key"), F.col("_slice").alias("_at"), F.concat(F.coalesce(before, none), F.coalesce(after, none)).alias("_guests"))
    rows = base.join(guests.hint("merge"), (F.col(key) == F.col("_key")) & (F.col("_slice") == F.col("_at")))
    own = F.array(F.struct(*[F.col(f"`{c}`") for c in cols], F.lit(True).alias("_own")))
    return rows.select(key, "_slice", F.inline(F.when(F.col("_i") == 1, F.concat(own, "_guests")).otherwise(own)))


def numbered(df: DataFrame, key: str, order: list[str], bucket: Column) -> DataFrame:
    """df with _rn (number of the row in its entity's series, from 0) and _len (the length of the series); order must be
    total for a defined result. Found in two levels: inside coarse buckets of the order column, and over one row per
    entity and bucket, whose number doesn't grow with the density of the series."""
    base = df.withColumn("_b", bucket)
    base = base.withColumn("_i", F.row_number().over(W.partitionBy(key, "_b").orderBy(*order)))
    counts = base.groupBy(key, "_b").agg(F.max("_i").alias("_n"))
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(
        F.col(key).alias("_ok"), F.col("_b").alias("_ob"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"),
        F.sum("_n").over(W.partitionBy(key)).alias("_len"),
    )
    out = base.join(counts.hint("merge"), (F.col(key) == F.col("_ok")) & (F.col("_b") == F.col("_ob")))
    return out.withColumn("_rn", F.col("_from") + F.col("_i") - 1).drop("_b", "_i", "_ok", "_ob", "_from")
