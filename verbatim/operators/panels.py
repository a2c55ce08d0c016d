"""Descriptive panels over periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def descriptive_panel(rows: DataFrame, value: str, subject: str, *keys: str) -> DataFrame:
    """By keys: rows, distinct subjects, sum, mean, median, sample deviation and the 25th, 75th and 90th percentiles (exact, linear between values)."""
    v = F.col(value)
    p = {q: F.percentile(v, q / 100) for q in (25, 75, 90)}
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(subject).alias("n_subjects"),
        F.sum(v).alias("total"),
        F.avg(v).alias("mean"),
        F.median(v).alias("median"),
        F.stddev_samp(v).alias("deviation"),
        *[x.alias(f"p{q}") for q, x in p.items()],
    )


def period_difference(panel: DataFrame, value: str, period: str, *keys: str) -> DataFrame:
    """Adds what each row's value has more than the period before it."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(period))
    return panel.withColumn("difference", F.col(value) - before)


def deviation_from_median(panel: DataFrame, value: str, *keys: str) -> DataFrame:
    middle = F.percentile(value, 0.5).over(Window.partitionBy(*keys))
    return panel.withColumn("from_median", F.col(value) - middle)


def weighted_median(rows: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.percentile(value, 0.5, weight).alias("median"))


def trend(panel: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Slope and intercept of the least-squares line; null with fewer than two x."""
    return panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def prevalence(rows: DataFrame, item: str, present: str, words: str, *keys: str) -> DataFrame:
    """Items, how many are marked, and marks per 1000 words (null without words)."""
    marks = F.sum(F.col(present).cast("long"))
    return rows.groupBy(*keys).agg(F.count_distinct(item).alias("n_items"), marks.alias("n_present"), (1000.0 * marks / F.nullif(F.sum(words), F.lit(0))).alias("per_1000_words"))
