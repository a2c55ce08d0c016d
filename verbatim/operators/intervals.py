"""Joins of dated rows to validity intervals.

Ends are inclusive or exclusive by parameter. All joins are on equality of a key with the days as a
further condition, so Spark shuffles by key and never pairs rows of different keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_PRIORITY = 999
OPEN_START, OPEN_END = "0001-01-01", "9999-12-31"


def inside(day: Column, start: Column, end: Column, inclusive: bool) -> Column:
    return (day >= start) & ((day <= end) if inclusive else (day < end))


def interval_join(rows: DataFrame, intervals: DataFrame, on: list[str], row_id: str, day: str, start: str, end: str, priority: str | None = None, inclusive: bool = True) -> DataFrame:
    """Each row with the best interval of its key that holds its day; status and n_candidates say how it went.

    Best: least priority (missing or 0 counts as 999), then least start, then least end. Status:
    missing_key, missing_date, unmatched, matched, or ambiguous (several candidates of best priority).
    """
    kept = [c for c in intervals.columns if c not in on]
    right = intervals.select(*[F.col(c).alias(f"_k_{c}") for c in on], F.struct(*kept).alias("_interval"))
    s, e = F.col(f"_interval.{start}"), F.col(f"_interval.{end}")
    rank = F.coalesce(F.nullif(F.col(f"_interval.{priority}").cast("long"), F.lit(0)), F.lit(NO_PRIORITY)) if priority else F.lit(NO_PRIORITY)
    joined = rows.join(right, [*[F.col(c) == F.col(f"_k_{c}") for c in on], inside(F.col(day), s, e, inclusive)], "left")
    joined = joined.withColumn("_rank", F.when(F.col("_interval").isNotNull(), rank)).withColumn("_start", s).withColumn("_end", e)
    by = Window.partitionBy(row_id)
    best = F.row_number().over(by.orderBy(F.col("_rank").asc_nulls_last(), F.col("_start").asc_nulls_last(), F.col("_end").asc_nulls_last()))
    joined = joined.withColumn("n_candidates", F.count("_interval").over(by)).withColumn("_top", F.min("_rank").over(by))
    joined = joined.withColumn("_ties", F.count_if(F.col("_rank") == F.col("_top")).over(by)).withColumn("_nth", best).filter("_nth = 1")
    no_key = F.lit(False)
    for c in on:
        no_key = no_key | F.col(c).isNull()
    status = F.when(no_key, "missing_key").when(F.col(day).isNull(), "missing_date").when(F.col("n_candidates") == 0, "unmatched").when(F.col("_ties") > 1, "ambiguous").otherwise("matched")
    return joined.withColumn("status", status).select(*rows.columns, *[F.col(f"_interval.{c}").alias(f"interval_{c}") for c in kept], "n_candidates", "status")


def best_candidates(rows: DataFrame, intervals: DataFrame, on: list[str], row_id: str, day: str, start: str, end: str, priority: str, inclusive: bool = False) -> DataFrame:
    """Every interval of best priority that holds a row's day: several rows where they tie."""
    right = intervals.select(*[F.col(c).alias(f"_k_{c}") for c in on], *[F.col(c).alias(f"interval_{c}") for c in intervals.columns if c not in on])
    joined = rows.join(right, [*[F.col(c) == F.col(f"_k_{c}") for c in on], inside(F.col(day), F.col(f"interval_{start}"), F.col(f"interval_{end}"), inclusive)]).drop(*[f"_k_{c}" for c in on])
    best = F.rank().over(Window.partitionBy(row_id).orderBy(F.coalesce(F.nullif(F.col(f"interval_{priority}").cast("long"), F.lit(0)), F.lit(NO_PRIORITY))))
    return joined.withColumn("_best", best).filter("_best = 1").drop("_best")


def overlap_clip(intervals: DataFrame, key: str, start: str, end: str, first: str, last: str) -> DataFrame:
    """For each key the first and last day inside [first, last], and how many intervals meet it."""
    a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
    s, e = F.col(start).cast("date"), F.col(end).cast("date")
    met = intervals.filter((s <= b) & (e >= a))
    return met.groupBy(key).agg(F.min(F.greatest(s, a)).alias("clip_start"), F.max(F.least(e, b)).alias("clip_end"), F.count(F.lit(1)).alias("n_intervals"))


def derive_intervals(states: DataFrame, key: str, day: str, at: str, *tie: str) -> DataFrame:
    """Intervals from dated states: the last state of each day holds until the day before the next one, the last for ever."""
    last = F.row_number().over(Window.partitionBy(key, day).orderBy(F.col(at).desc_nulls_last(), *[F.col(t).desc() for t in tie]))
    daily = states.filter(F.col(day).isNotNull()).withColumn("_nth", last).filter("_nth = 1").drop("_nth")
    following = F.lead(day).over(Window.partitionBy(key).orderBy(day))
    return daily.withColumn("valid_from", F.col(day)).withColumn("valid_to", F.coalesce(F.date_sub(following, 1), F.lit(OPEN_END).cast("date"))).withColumn("inferred_end", following.isNotNull())


def overlapping_spans(spans: DataFrame, group: str, key: str, start: str, end: str) -> DataFrame:
    """Spans with a flag that says whether another span of the group overlaps it: an earlier one reaches past its start, or a later one starts before its end."""
    order = [F.col(start).asc(), F.col(end).asc(), F.col(key).asc()]
    w = Window.partitionBy(group).orderBy(*order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(start).over(w.rowsBetween(1, Window.unboundedFollowing))
    return spans.withColumn("overlaps", F.coalesce(reach > F.col(start), F.lit(False)) | F.coalesce(following < F.col(end), F.lit(False)))


def legislature(day: Column, first_year: int = 1827, length: int = 4) -> Column:
    return F.floor((F.year(day) - first_year) / length).cast("int") + 1


def nearest_day(rows: DataFrame, issues: DataFrame, row_id: str, day: str, issue_day: str, page: str, first_page: str, last_page: str, most_days: int = 5) -> DataFrame:
    """Each row's issue nearest in time whose pages hold its page; of equal distances the earlier one."""
    away = F.datediff(F.col(issue_day), F.col(day))
    offsets = F.explode(F.sequence(F.lit(-most_days), F.lit(most_days)))
    spread = rows.withColumn("_off", offsets).withColumn("_day", F.date_add(day, F.col("_off")))
    joined = spread.join(issues, (F.col("_day") == F.col(issue_day)) & F.col(page).between(F.col(first_page), F.col(last_page)))
    nth = F.row_number().over(Window.partitionBy(row_id).orderBy(F.abs(away), away, F.col(first_page)))
    return joined.withColumn("_nth", nth).filter("_nth = 1").drop("_nth", "_off", "_day")


def score_bridge(left: DataFrame, right: DataFrame, left_id: str, right_id: str, on: list[str], evidence: list[tuple[Column, int]], reject: Column | None = None, sure: int = 8, margin: int = 2) -> DataFrame:
    """Each left row's best right row by summed evidence: exact, probable, ambiguous (too near the second best) or absent."""
    other = right.select(*[F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in right.columns])
    pairs = left.join(other, [F.col(c) == F.col(f"_{c}") for c in on])
    if reject is not None:
        pairs = pairs.filter(~F.coalesce(reject, F.lit(False)))
    score = F.lit(0)
    for holds, points in evidence:
        score = score + F.when(F.coalesce(holds, F.lit(False)), points).otherwise(0)
    by = Window.partitionBy(left_id).orderBy(F.col("score").desc(), F.col(right_id))
    scored = pairs.withColumn("score", score).filter("score > 0")
    ranked = scored.withColumn("_nth", F.row_number().over(by)).withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(by), F.lit(0))).filter("_nth = 1")
    found = ranked.select(F.col(left_id).alias("_id"), F.col(right_id), "score", "margin")
    status = F.when(F.col("score").isNull(), "absent").when(F.col("margin") < margin, "ambiguous").when(F.col("score") >= sure, "exact").otherwise("probable")
    return left.join(found, F.col(left_id) == F.col("_id"), "left").withColumn("bridge_status", status).drop("_id")
