"""Distributions that describe a cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import HISTOGRAM_BINS
from ..functions.time import elapsed_days, years
from ..sources.shared import written


def histogram(df: DataFrame, value: Column, bins: int = HISTOGRAM_BINS, weight: Column | None = None) -> DataFrame:
    """Equal-width bins between the smallest and the largest value: (bin, lo, hi, n).

    Every bin includes its lower edge and the last one its upper edge; bins without values
    have n = 0. NULL, NaN and infinite values are left out. A single distinct value gets the range half
    below to half above it, and no values at all the range 0 to 1. `weight` counts
    a row several times, so that equal values can be aggregated beforehand.

    The range is found first, by a job of its own that returns two numbers.
    """
    data = df.select(value.cast("double").alias("v"), (weight if weight is not None else F.lit(1)).alias("w")).filter(
        F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    )
    low, high = data.agg(F.min("v"), F.max("v")).first()
    if low is None:
        low, high = 0.0, 1.0
    elif low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.lit(high)).otherwise(F.lit(low) + i * F.lit(step))

    v, b = F.col("v"), F.col("bin")
    # the quotient may land next to an edge by rounding; the edges themselves decide
    guess = F.least(F.floor((v - F.lit(low)) / F.lit(high - low) * bins), F.lit(bins - 1)).cast("int")
    exact = b - (v < edge(b)).cast("int") + ((v >= edge(b + 1)) & (b != bins - 1)).cast("int")
    counts = data.withColumn("bin", guess).groupBy(exact.alias("bin")).agg(F.sum("w").alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin", edge(b).alias("lo"), edge(b + 1).alias("hi"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def years_histogram(df: DataFrame, start: Column, end: Column, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Histogram of the elapsed years between two times.

    Gaps are whole days, so the data is read once to count rows per day. Range and bins read
    the written day counts, one row per distinct gap.
    """
    per_day = df.select(elapsed_days(start, end).alias("days")).dropna().groupBy("days").agg(
        F.count(F.lit(1)).alias("n")
    )
    return histogram(written(per_day, "days"), years(F.col("days")), bins, F.col("n"))


def age_at(birth: Column, at: Column) -> Column:
    """Age in years at some time."""
    return years(elapsed_days(birth, at))


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    """The labels that occur, sorted."""
    return df.select(label).distinct().orderBy(label)


def shape(df: DataFrame) -> DataFrame:
    """Number of rows and columns, and the column names."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.array(*[F.lit(c) for c in df.columns]).alias("columns")
    )
