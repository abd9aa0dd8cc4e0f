"""Risk scores and how they are shown, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed weights for (delta_t, movement) and the intercept: probability one half at a movement of 0.7.
FIXED_WEIGHTS, FIXED_INTERCEPT = (0.0, 4.0), -2.8


def probability(features: Sequence[Column], weights: Sequence[float] = FIXED_WEIGHTS, intercept: float = FIXED_INTERCEPT) -> Column:
    """The logistic function of a linear score; null and NaN features count as 0."""
    z = F.lit(float(intercept))
    for f, w in zip(features, weights):
        f = F.nanvl(F.coalesce(f.cast("double"), F.lit(0.0)), F.lit(0.0))
        z = z + f * float(w)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def normalise_risk(df: DataFrame, risk: str, out: str = "risk") -> DataFrame:
    """Risks as fractions: percentages (99th percentile, between ranks, above 1) are divided by 100, then everything
    is cut to [0, 1]; null, NaN and texts that are no numbers become 0.

    Whether the percentile lies above 1 follows from four numbers, so no sketch and no list of values is needed: how
    many values there are, how many are at most 1, the greatest of those and the least of the others."""
    x = F.nullif(F.expr(f"try_cast(`{risk}` AS double)"), F.lit(float("nan")))
    m = df.select(x.alias("x")).agg(
        F.count("x").alias("n"), F.count_if(F.col("x") <= 1).alias("c"), F.max(F.when(F.col("x") <= 1, F.col("x"))).alias("a"), F.min(F.when(F.col("x") > 1, F.col("x"))).alias("b")
    )
    rank = F.lit(0.99) * (F.col("n") - 1)
    low = F.floor(rank)
    between = F.col("a") + (rank - low) * (F.col("b") - F.col("a")) > 1
    above = F.when(F.col("n") == 0, False).when(low >= F.col("c"), True).when((low + 1 < F.col("c")) | (F.col("c") == F.col("n")), False).otherwise(between)
    scale = m.select(F.when(above, 100.0).otherwise(1.0)).scalar()
    return df.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0)) / scale)))


def risk_colour(risk: Column) -> Column:
    """#rrgg00, from green to red."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), risk))
    return F.format_string("#%02x%02x00", (r * 255).cast("int"), ((1 - r) * 255).cast("int"))


def line_weight(risk: Column) -> Column:
    return F.lit(2.0) + risk * 6.0
