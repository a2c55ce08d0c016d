"""Names to people, attempts to one result, and requests to their responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_key


def speaker_assignment(mentions: DataFrame, people: DataFrame, scope: str, mention_id: str, name: str, person: str, person_name: str, least_length: int = 5) -> DataFrame:
    """mention_id, person and how: exact name in the scope, else the only compatible one (one name inside the other), else none.

    A name of fewer than ``least_length`` characters is compatible with nothing; several candidates give no person.
    """
    left = mentions.select(scope, mention_id, name_key(F.col(name)).alias("_m"))
    right = people.select(F.col(scope).alias("_s"), F.col(person).alias("_p"), name_key(F.col(person_name)).alias("_n"))
    pairs = left.join(right, (F.col(scope) == F.col("_s")) & ((F.col("_m") == F.col("_n")) | ((F.length("_m") >= least_length) & (F.length("_n") >= least_length) & (F.contains("_m", "_n") | F.contains("_n", "_m")))), "left")
    same = F.col("_m") == F.col("_n")
    one = pairs.groupBy(mention_id).agg(
        F.count_distinct(F.when(same, F.col("_p"))).alias("exact"), F.min(F.when(same, F.col("_p"))).alias("_e"), F.count_distinct("_p").alias("compatible"), F.min("_p").alias("_c")
    )
    how = F.when(F.col("exact") == 1, "exact").when((F.col("exact") == 0) & (F.col("compatible") == 1), "compatible").when(F.col("compatible") > 0, "ambiguous").otherwise("absent")
    return one.select(mention_id, F.when(how == "exact", F.col("_e")).when(how == "compatible", F.col("_c")).alias(person), how.alias("how"))


def merge_attempts(attempts: list[DataFrame], wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, problems): all attempts together, and keys that are repeated, unknown or missing."""
    from .reconcile import exact_cover

    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [a.withColumn("attempt", F.lit(i)) for i, a in enumerate(attempts, 1)])
    return union, exact_cover(wanted, union, key)


def request_chunks(rows: DataFrame, group: str, order: str, size: int, prefix: str = "req") -> DataFrame:
    """Rows with chunk (from 0 in each group) and custom_id."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    chunk = F.floor(nth / size)
    return rows.withColumn("chunk", chunk).withColumn("custom_id", F.concat_ws("-", F.lit(prefix), F.col(group).cast("string"), F.lpad(chunk.cast("string"), 4, "0")))


def parsed_responses(requests: DataFrame, responses: DataFrame, schema: str, body: str = "body", key: str = "custom_id") -> tuple[DataFrame, DataFrame]:
    """(parsed, problems): one row a request whose response is JSON of the schema; else invalid, repeated, unknown or missing."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    read = responses.withColumn("_n", n).withColumn("parsed", F.from_json(body, schema, {"mode": "PERMISSIVE"})).withColumn("_json", F.expr(f"try_parse_json(`{body}`)").isNotNull())
    asked = requests.select(F.col(key).alias("_k")).distinct()
    joined = asked.join(read, F.col("_k") == F.col(key), "full")
    problem = F.when(F.col(key).isNull(), "missing").when(F.col("_k").isNull(), "unknown").when(F.col("_n") > 1, "repeated").when(~F.col("_json") | F.col("parsed").isNull(), "invalid")
    marked = joined.select(F.coalesce("_k", key).alias(key), "parsed", problem.alias("problem"))
    return marked.filter("problem is null").drop("problem"), marked.filter("problem is not null").select(key, "problem").distinct()


def look_back(steps: DataFrame, case: str, order: str, trigger: Column, eligible: Column, prefer: Column | None = None) -> DataFrame:
    """Steps with ``marked``: for each trigger the last earlier eligible step of its case that isn't marked yet, a preferred one first.

    A later trigger takes what earlier ones left, so a case is worked through in order in one task.
    """
    import pandas as pd

    flags = steps.withColumn("_t", F.coalesce(trigger, F.lit(False))).withColumn("_e", F.coalesce(eligible, F.lit(False))).withColumn("_p", F.coalesce(prefer, F.lit(False)) if prefer is not None else F.lit(False)).withColumn("marked", F.lit(False))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        marked = [False] * len(pdf)
        for i in range(len(pdf)):
            if pdf["_t"].iloc[i]:
                open_steps = [j for j in range(i) if pdf["_e"].iloc[j] and not marked[j]]
                best = [j for j in open_steps if pdf["_p"].iloc[j]] or open_steps
                if best:
                    marked[best[-1]] = True
        return pdf.assign(marked=marked)

    return flags.groupBy(case).applyInPandas(run, flags.schema).drop("_t", "_e", "_p")


def adaptive_windows(found: DataFrame, start: str, end: str) -> DataFrame:
    """The months to ask for: those of years and quarters in which a probe found something.

    ``found``: unit (year, quarter or month), period_start, n. A branch whose probe found nothing is skipped with all below it.
    """
    from ..functions.dates import windows

    spark = found.sparkSession
    months = windows(spark, start, end, "month").withColumn("_y", F.trunc("window_start", "year")).withColumn("_q", F.trunc("window_start", "quarter"))
    none = lambda unit: found.filter((F.col("unit") == unit) & (F.col("n") == 0)).select(F.trunc("period_start", unit).alias("_z"))
    out = months.join(none("year"), F.col("_y") == F.col("_z"), "left_anti").join(none("quarter"), F.col("_q") == F.col("_z"), "left_anti")
    return out.join(none("month"), F.trunc("window_start", "month") == F.col("_z"), "left_anti").select("window_start", "window_end")
