"""Samples that the rows alone decide: ranks of hashes, quotas, turns and even spreads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import selection_key


def _ranked(rows: DataFrame, strata: list[str], *order: Column) -> DataFrame:
    by = Window.partitionBy(*strata)
    return rows.withColumn("_rank", F.row_number().over(by.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(by))


def exact_rate(rows: DataFrame, strata: list[str], identity: str, seed: str, rate: str = "0.01") -> DataFrame:
    """Of each stratum the max(1, ceil(n * rate)) rows first in the seed's order; the rate is an exact decimal."""
    key = selection_key(seed, F.col(identity))
    size = F.greatest(F.lit(1), F.ceil(F.col("_n").cast("decimal(18,0)") * F.lit(rate).cast("decimal(18,10)")))
    return _ranked(rows.withColumn("selection_key", key), strata, F.col("selection_key"), F.col(identity)).filter(F.col("_rank") <= size).drop("_rank", "_n")


def hash_sample(rows: DataFrame, strata: list[str], key: Column, identity: str, rate: float, least: int) -> DataFrame:
    """Of each stratum the max(least, ceil(n * rate)) rows with the smallest sha1 of their key."""
    size = F.greatest(F.lit(least), F.ceil(F.col("_n") * rate))
    return _ranked(rows.withColumn("_h", F.sha1(key)), strata, F.col("_h"), F.col(identity)).filter(F.col("_rank") <= size).drop("_rank", "_n", "_h")


def capped(rows: DataFrame, strata: list[str], identity: str, seed: str, most: int) -> DataFrame:
    """At most so many rows of each stratum, by the seed's order."""
    return _ranked(rows, strata, selection_key(seed, F.col(identity)), F.col(identity)).filter(F.col("_rank") <= most).drop("_rank", "_n")


def quota_over_bins(rows: DataFrame, strata: list[str], value: str, identity: str, seed: str, bins: int, each: int) -> DataFrame:
    """The same quota from each stratum and each of ``bins`` equal parts of its values' order."""
    part = F.ntile(bins).over(Window.partitionBy(*strata).orderBy(F.col(value), F.col(identity)))
    return capped(rows.withColumn("bin", part), [*strata, "bin"], identity, seed, each)


def round_robin(rows: DataFrame, stratum: str, identity: str, seed: str, size: int, forced: Column | None = None) -> DataFrame:
    """Forced rows first, then one row of each stratum in turn until there are ``size``."""
    ranked = _ranked(rows.withColumn("_h", selection_key(seed, F.col(identity))).withColumn("_forced", F.coalesce(forced, F.lit(False)) if forced is not None else F.lit(False)), [stratum, "_forced"], F.col("_h"), F.col(identity))
    return ranked.orderBy(F.col("_forced").desc(), "_rank", stratum, identity).limit(size).drop("_h", "_forced", "_rank", "_n")


def even_spread(rows: DataFrame, strata: list[str], order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each stratum, spread evenly over its order, first and last among them."""
    at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / max(1, most - 1), 0).cast("int") + 1)
    ranked = _ranked(rows, strata, F.col(order))
    return ranked.filter((F.col("_n") <= most) | F.array_contains(at, F.col("_rank"))).drop("_rank", "_n")


def representatives(rows: DataFrame, group: str, size: str, identity: str) -> DataFrame:
    """The smallest and the largest row of each group, ties to the smaller identity."""
    by = Window.partitionBy(group)
    low, high = (F.row_number().over(by.orderBy(o, F.col(identity))) for o in (F.col(size).asc_nulls_last(), F.col(size).desc_nulls_last()))
    return rows.withColumn("_low", low).withColumn("_high", high).filter("_low = 1 or _high = 1").drop("_low", "_high")


def nearest_to_median(rows: DataFrame, group: str, size: str, identity: str) -> DataFrame:
    """The row of each group whose size is nearest to the group's median; ties by a hash of the identity."""
    away = F.abs(F.col(size) - F.percentile(size, 0.5).over(Window.partitionBy(group)))
    nth = F.row_number().over(Window.partitionBy(group).orderBy("_away", F.sha2(F.col(identity).cast("string"), 256)))
    return rows.withColumn("_away", away).withColumn("_nth", nth).filter("_nth = 1").drop("_away", "_nth")


def smallest_hashes(values: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """The n distinct values of each group with the smallest sha256."""
    hashed = values.select(group, F.col(value).cast("string").alias("value"), F.sha2(F.col(value).cast("string"), 256).alias("sha256")).distinct()
    return _ranked(hashed, [group], F.col("sha256"), F.col("value")).filter(F.col("_rank") <= n).drop("_rank", "_n")


def greedy_batches(rows: DataFrame, group: list[str], order: str, size: str, most_rows: int, most_bytes: int) -> DataFrame:
    """Rows with the number of their batch: a batch ends where a row more would pass a limit; a row beyond the limit is alone.

    A batch's start depends on the one before, so each group runs in order in one task: give groups.
    """
    schema = rows.withColumn("batch", F.lit(0).cast("long")).schema

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        batch, n, total, out = 0, 0, 0, []
        for s in pdf[size]:
            if n and (n >= most_rows or total + s > most_bytes):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + s
            out.append(batch)
        return pdf.assign(batch=out)

    return rows.groupBy(*group).applyInPandas(pack, schema)
