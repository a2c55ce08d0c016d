"""Counts that describe tables: censuses, frequencies, coverage and conservation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def base_census(rows: DataFrame, key: str, day: str, expected: dict[str, str] | None = None) -> DataFrame:
    """One row: rows, distinct and missing keys, first and last day, and for each expected column how many rows differ from its value (nulls differ)."""
    differ = [F.count_if(~F.col(c).eqNullSafe(F.lit(v))).alias(f"not_{c}") for c, v in (expected or {}).items()]
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(key).alias("n_keys"),
        F.count_if(F.col(key).isNull()).alias("n_missing"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        *differ,
    )


def counts_by(rows: DataFrame, *keys: str, missing: str = "(none)") -> DataFrame:
    """Rows for each combination of keys, nulls under one name."""
    named = [F.coalesce(F.col(k).cast("string"), F.lit(missing)).alias(k) for k in keys]
    return rows.select(*named).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def category_frequencies(rows: DataFrame, *dimensions: str) -> DataFrame:
    """dimension, value, n_rows of all dimensions in one pass over the rows."""
    long = rows.select(*[F.col(d).cast("string").alias(d) for d in dimensions]).unpivot([], list(dimensions), "dimension", "value")
    return long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def distinct_over(tables: list[DataFrame], key: str) -> DataFrame:
    union = reduce(DataFrame.unionByName, [t.select(F.col(key).cast("string").alias("key")) for t in tables])
    return union.agg(F.count_distinct("key").alias("n_keys"))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """How many keys stand in several rows, and how many rows that makes beyond the first."""
    many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return many.agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_extra"))


def pairwise_overlap(rows: DataFrame, group: str, key: str) -> DataFrame:
    """For each pair of groups how many distinct keys both have."""
    one = rows.filter(F.col(group).isNotNull() & F.col(key).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k")).distinct()
    # A key's groups are few, so pairs are made inside each key rather than by a join of all rows.
    held = one.groupBy("k").agg(F.array_sort(F.collect_set("g")).alias("gs")).filter(F.size("gs") > 1)
    pairs = held.select(F.posexplode("gs").alias("i", "left_group"), "gs").select("left_group", F.explode(F.slice("gs", F.col("i") + 2, F.size("gs"))).alias("right_group"))
    return pairs.groupBy("left_group", "right_group").agg(F.count(F.lit(1)).alias("n_keys"))


def conflicting_keys(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of keys that have several distinct values."""
    many = rows.groupBy(key).agg(F.count_distinct(value).alias("n_values")).filter("n_values > 1")
    return rows.join(many, key)


def coverage_matrix(rows: DataFrame, step: str, group: str, groups: list, first: int, last: int) -> DataFrame:
    """One row for each step from first to last, a column of counts for each group; 0 where nothing is."""
    steps = rows.sparkSession.range(first, last + 1).select(F.col("id").alias(step))
    counted = rows.groupBy(F.col(step).cast("long").alias(step)).pivot(group, groups).count()
    return steps.join(counted, step, "left").fillna(0, [str(g) for g in groups])


def missing_coverage(matrix: DataFrame, step: str, required: list | None = None) -> DataFrame:
    """The empty cells of a coverage matrix, of the required steps alone where they are given."""
    groups = [c for c in matrix.columns if c != step]
    cells = matrix.unpivot(step, groups, "group", "n_rows").filter("n_rows = 0")
    return cells.filter(F.col(step).isin(required)) if required else cells


def role_coverage(rows: DataFrame, roles: dict[str, tuple[str, str]]) -> DataFrame:
    """For each role (id column, attribute column): rows by whether both are filled."""
    long = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(F.col(i).cast("string") != "", F.lit(False)).alias("has_id"), F.coalesce(F.col(a).cast("string") != "", F.lit(False)).alias("has_attribute")) for r, (i, a) in roles.items()])).alias("x")
    return rows.select(long).select("x.*").groupBy("role", "has_id", "has_attribute").agg(F.count(F.lit(1)).alias("n_rows"))


def date_cut(rows: DataFrame, day: str, start: str, end: str) -> tuple[DataFrame, Column]:
    """The rows inside [start, end], and an expression that says of any row where it is."""
    d = F.col(day).cast("date")
    where = F.when(d.isNull(), "invalid").when(d < F.lit(start).cast("date"), "before").when(d > F.lit(end).cast("date"), "after").otherwise("within")
    return rows.filter(where == "within"), where


def conservation(rows: DataFrame, where: Column, *keys: str) -> DataFrame:
    """Rows within, before, after and invalid, by keys and in all (keys null), with their total."""
    parts = [F.count_if(where == w).alias(w) for w in ("within", "before", "after", "invalid")]
    frame = rows.rollup(*keys) if keys else rows.groupBy()
    return frame.agg(F.count(F.lit(1)).alias("n_rows"), *parts)


def quality_flags(**conditions: Column) -> Column:
    """An array of the names whose condition holds, in the order given; null conditions don't."""
    return F.array_compact(F.array(*[F.when(c, name) for name, c in conditions.items()]))


def share_of_total(rows: DataFrame, value: str, *keys: str, per: float = 1000.0) -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(*keys))
    return rows.withColumn("share", F.when(total != 0, per * F.col(value) / total))
