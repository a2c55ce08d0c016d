"""Prices, verification of copies, coverage, prevalence, review gates and small selections.

Every function takes and returns DataFrames or Columns. Groups are aggregated before they are joined or ranked, so
no group's rows meet in one task. Null group values form groups of their own unless a docstring says otherwise.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_space

LINKED = ("matched", "probable")


# --- prices


def usage_cost(usage: DataFrame, prices: DataFrame, key: str) -> DataFrame:
    """Adds ``cost`` to usage rows (input, cached, output units) by the price of their key.

    ``prices``: key, input_price, cached_price (null: as input), output_price, each per million, and discount (a share).
    Null unit counts are 0, cached units come off the input ones, never below 0. A key without a price or with two stops
    the query, as does a null price.
    """
    one = prices.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).cast("decimal(18,6)").alias(f"_{c}") for c in ("input_price", "cached_price", "output_price", "discount")])
    units = {c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(20,0)") for c in ("input", "cached", "output")}
    priced = (F.col("_n") == 1) & F.col("_input_price").isNotNull() & F.col("_output_price").isNotNull() & F.col("_discount").isNotNull()
    fresh = F.greatest(units["input"] - units["cached"], F.lit(0).cast("decimal(20,0)")).cast("double")
    gross = fresh * F.col("_input_price").cast("double") + units["cached"].cast("double") * F.coalesce("_cached_price", "_input_price").cast("double") + units["output"].cast("double") * F.col("_output_price").cast("double")
    cost = gross / 1e6 * (1 - F.col("_discount").cast("double"))
    checked = F.when(F.coalesce(priced, F.lit(False)), cost).otherwise(F.raise_error(F.concat(F.lit("not one whole price for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("double"))
    return usage.join(one, key, "left").withColumn("cost", checked).drop("_n", "_input_price", "_cached_price", "_output_price", "_discount")


# --- verification of copies


def verified_destination(catalog: DataFrame, observed: DataFrame, key: str, metadata: list[str], complete: bool = True) -> DataFrame:
    """One row a locator: equal, different, surprise (observed alone) or missing (in the catalog alone, if all must be there)."""
    a, b = catalog.select(key, *metadata).alias("a"), observed.select(key, *metadata).alias("b")
    same = F.lit(True)
    for name in metadata:
        same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    status = F.when(F.col(f"a.{key}").isNull(), "surprise").when(F.col(f"b.{key}").isNull(), "missing" if complete else "pending").when(same, "equal").otherwise("different")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), status.alias("status"))


def marker_status(expected: DataFrame, reported: DataFrame, key: str, marker: str, accepted: list[str]) -> DataFrame:
    """Locators against markers: ok, rejected (any marker that isn't accepted, null too), repeated, absent or unexpected."""
    told = reported.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(F.coalesce(F.col(marker).isin(accepted), F.lit(False))).alias("_ok"))
    asked = expected.select(key).distinct().withColumn("_asked", F.lit(True))
    status = F.when(F.col("_asked").isNull(), "unexpected").when(F.col("_n").isNull(), "absent").when(F.col("_n") > 1, "repeated").when(F.col("_ok"), "ok").otherwise("rejected")
    return asked.join(told, key, "full").select(key, status.alias("status"))


def copy_plan(objects: DataFrame, source: str, destination: Column, excluded: list[str]) -> DataFrame:
    """Each object with its destination and action: excluded, source_collision, destination_collision or copy.

    Only objects that aren't excluded collide. Null sources are excluded.
    """
    out = F.coalesce(F.col(source).isNull() | F.col(source).isin(excluded), F.lit(True)) if excluded else F.col(source).isNull()
    rows = objects.select(F.col(source).alias("source"), destination.alias("destination"), out.alias("_out"))
    kept = rows.filter("not _out")
    sources = kept.groupBy("source").agg((F.count(F.lit(1)) > 1).alias("_twice"))
    targets = kept.groupBy("destination").agg((F.count_distinct("source") > 1).alias("_met"))
    action = F.when(F.col("_out"), "excluded").when(F.col("_twice"), "source_collision").when(F.col("_met"), "destination_collision").otherwise("copy")
    return rows.join(sources, "source", "left").join(targets, "destination", "left").select("source", "destination", action.alias("action"))


def archive_action(path: Column, layer: Column) -> Column:
    """preserve where a folder of the path or the layer is ``raw`` in any case; else archive_candidate. Nulls are empty."""
    parts = F.split(F.lower(F.coalesce(path, F.lit(""))), "/")
    raw = F.array_contains(parts, "raw") | (F.lower(F.trim(F.coalesce(layer, F.lit("")))) == "raw")
    return F.when(raw, "preserve").otherwise("archive_candidate")


# --- coverage and prevalence


def layer_months(rows: DataFrame, group: str, layer: str, day: Column, first: str, last: str, layers: list[str]) -> DataFrame:
    """Rows of each (group, year, month, layer) between two days, 0 where there are none; the groups are those of ``rows``."""
    month = F.trunc(day, "month").alias("_month")
    seen = rows.filter(day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))).groupBy(group, F.col(layer).alias("_layer"), month).agg(F.count(F.lit(1)).alias("_n"))
    months = F.explode(F.sequence(F.trunc(F.lit(first).cast("date"), "month"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("_month")
    dense = rows.select(group).distinct().select(group, months).select(group, "_month", F.explode(F.array(*map(F.lit, layers))).alias("_layer")).alias("d")
    seen = seen.alias("s")
    on = F.col(f"d.{group}").eqNullSafe(F.col(f"s.{group}")) & (F.col("d._month") == F.col("s._month")) & (F.col("d._layer") == F.col("s._layer"))
    kept = [F.col(f"d.{group}").alias(group), F.year("d._month").alias("year"), F.month("d._month").alias("month"), F.col("d._layer").alias("layer")]
    return dense.join(seen, on, "left").select(*kept, F.coalesce("_n", F.lit(0)).alias("n_rows"))


def media_coverage(rows: DataFrame, by: str, unit: str, has_text: Column, has_media: Column) -> DataFrame:
    """Occurrences, different units, units with a text, with media and with either, and their shares of the units.

    A unit counts where any of its rows does; rows with a null unit are occurrences only.
    """
    each = rows.groupBy(by, unit).agg(F.count(F.lit(1)).alias("_n"), F.max(F.coalesce(has_text, F.lit(False))).alias("_t"), F.max(F.coalesce(has_media, F.lit(False))).alias("_m"))
    known = F.col(unit).isNotNull()
    out = each.groupBy(by).agg(
        F.sum("_n").alias("occurrences"), F.count_if(known).alias("units"), F.count_if(known & F.col("_t")).alias("with_text"), F.count_if(known & F.col("_m")).alias("with_media"),
        F.count_if(known & (F.col("_t") | F.col("_m"))).alias("covered"),
    )
    return out.withColumns({"text_rate": F.try_divide("with_text", "units"), "media_rate": F.try_divide("with_media", "units")})


def prevalence_from_median(rows: DataFrame, groups: list[str], period: str, flag: Column) -> DataFrame:
    """n, present and share of each (groups, period), beside the median of the shares of a group's periods.

    The windows run over one row a group and period. A null flag counts in n but neither in present nor in the share.
    """
    cells = rows.groupBy(*groups, period).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(flag.cast("int")), F.lit(0)).alias("present"), F.avg(flag.cast("int")).alias("share"))
    median = F.median("share").over(Window.partitionBy(*groups))
    return cells.withColumn("usual", median).withColumn("from_usual", F.col("share") - F.col("usual"))


def topic_prevalence(assigned: DataFrame, strata: list[str], topic: str) -> DataFrame:
    """Rows of each topic in its stratum, their share of the stratum, and whether the topic is the outliers' (-1)."""
    cells = assigned.groupBy(*strata, topic).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*strata))
    return cells.withColumns({"share": share, "outlier": F.coalesce(F.col(topic) == -1, F.lit(False))})


def topic_coverage(rows: DataFrame, sample: DataFrame, assigned: DataFrame, strata: list[str], summary: str, topic: str) -> DataFrame:
    """For each stratum of ``rows``: rows, those with a summary that isn't blank, sampled ones, outliers, and two rates."""
    zero = F.lit(0)
    parts = [
        rows.select(*strata, F.lit(1).alias("rows"), F.coalesce(F.trim(summary) != "", F.lit(False)).cast("int").alias("summaries"), zero.alias("sampled"), zero.alias("outliers")),
        sample.select(*strata, zero, zero, F.lit(1), zero),
        assigned.select(*strata, zero, zero, zero, F.coalesce(F.col(topic) == -1, F.lit(False)).cast("int")),
    ]
    counted = parts[0].union(parts[1]).union(parts[2]).groupBy(*strata).agg(*[F.sum(c).alias(c) for c in ("rows", "summaries", "sampled", "outliers")]).filter("rows > 0")
    return counted.withColumns({"summary_coverage": F.col("summaries") / F.col("rows"), "outlier_rate": F.try_divide("outliers", "sampled")})


def temporal_join_summary(joined: DataFrame, *by: str) -> DataFrame:
    return joined.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))


# --- quality of links and reviews


def bridge_quality(bridge: DataFrame, gold: DataFrame, key: str, target: str, status: str, linked: tuple[str, ...] = LINKED) -> DataFrame:
    """One row: n, linked, coverage, gold rows met, and the share of linked ones among them that name gold's target.

    ``gold``: key and target. A linked row with a null target is wrong; rates without a denominator are null.
    """
    is_linked = F.coalesce(F.col(status).isin(*linked), F.lit(False))
    told = gold.select(F.col(key), F.col(target).alias("_gold"), F.lit(1).alias("_met"))
    both = bridge.join(told, key, "left")
    judged = is_linked & F.col("_met").isNotNull()
    whole = bridge.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_linked).alias("linked"))
    met = both.agg(F.count("_met").alias("n_gold"), F.count_if(judged).alias("_judged"), F.count_if(judged & (F.col(target) == F.col("_gold"))).alias("_right"))
    return whole.crossJoin(F.broadcast(met)).select("n", "linked", F.try_divide("linked", "n").alias("coverage"), "n_gold", F.try_divide("_right", "_judged").alias("precision"))  # one row each


def authorized(quality: DataFrame, least_precision: float = 0.95, least_coverage: float = 0.8) -> DataFrame:
    """Adds whether both rates are known and reach their thresholds."""
    return quality.withColumn("authorized", F.coalesce((F.col("precision") >= least_precision) & (F.col("coverage") >= least_coverage), F.lit(False)))


def review_gates(reviews: DataFrame, verdict: Column, complete: Column, case: str, required: list[str], least_reviewed: int, least_precision: float) -> DataFrame:
    """One row: complete and invalid reviews, precision, required cases that are approved, and whether the gate opens.

    A verdict is true, false or null (not valid). Precision is over complete reviews with a verdict; a required case is
    approved where it has complete reviews and all of them are true.
    """
    done = F.coalesce(complete, F.lit(False))
    rows = reviews.select(verdict.alias("_v"), done.alias("_done"), F.col(case).alias("_case"))
    judged = F.col("_done") & F.col("_v").isNotNull()
    each = rows.groupBy("_case").agg(
        F.count_if(judged).alias("_judged"), F.count_if(judged & F.col("_v")).alias("_right"), F.count_if(F.col("_done") & F.col("_v").isNull()).alias("_invalid"), F.count_if("_done").alias("_n"),
    )
    approved = F.col("_case").isin(required) & (F.col("_n") > 0) & (F.col("_right") == F.col("_n"))
    zero = F.lit(0)
    out = each.agg(*[F.coalesce(F.sum(c), zero).alias(n) for c, n in (("_n", "reviewed"), ("_invalid", "invalid"), ("_judged", "_judged"), ("_right", "_right"))], F.count_if(approved).alias("approved_cases"))
    precision = F.try_divide("_right", "_judged")
    opens = (F.col("reviewed") >= least_reviewed) & (F.col("invalid") == 0) & (precision >= least_precision) & (F.col("approved_cases") == len(set(required)))
    return out.select("reviewed", "invalid", precision.alias("precision"), "approved_cases", F.coalesce(opens, F.lit(False)).alias("opens"))


def compare_conditions(rows: DataFrame, pair: str, condition: str, first: str, second: str, verdict: Column, tokens: str) -> DataFrame:
    """For each pair: accepted and incorrect answers and tokens under both conditions; null verdicts are neither."""
    def part(which: str) -> list[Column]:
        here = F.col(condition) == which
        return [F.count_if(here & verdict).alias(f"accepted_{which}"), F.count_if(here & ~verdict).alias(f"incorrect_{which}"), F.coalesce(F.sum(F.when(here, F.col(tokens))), F.lit(0)).alias(f"tokens_{which}")]

    return rows.groupBy(pair).agg(*part(first), *part(second))


# --- selections


def ranked_candidates(rows: DataFrame, strata: list[str], seed: str, key: str) -> DataFrame:
    """Adds selection_key (a seeded hash of the key) and its rank in the stratum, ties to the lesser key."""
    hashed = rows.withColumn("selection_key", F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256))
    return hashed.withColumn("rank", F.row_number().over(Window.partitionBy(*strata).orderBy("selection_key", key)))


def conflicts_first(rows: DataFrame, group: str, conflict: Column, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows a group, evenly spread: up to half of them conflicts, then the others, then conflicts again."""
    flagged = rows.withColumn("_c", F.coalesce(conflict, F.lit(False)))
    own = Window.partitionBy(group, "_c")
    size, place = F.count(F.lit(1)).over(own), F.row_number().over(own.orderBy(*order)) - 1
    spread = flagged.withColumns({"_size": size, "_place": place})
    whole = Window.partitionBy(group)
    sizes = {"_cs": F.max(F.when(F.col("_c"), F.col("_size")).otherwise(0)).over(whole), "_os": F.max(F.when(~F.col("_c"), F.col("_size")).otherwise(0)).over(whole)}
    half = F.least(F.col("_cs"), F.lit((most + 1) // 2))
    others = F.least(F.col("_os"), F.lit(most) - half)
    quota = F.when(F.col("_c"), F.least(F.col("_cs"), F.lit(most) - others)).otherwise(others)
    # Row i of n is taken for a quota q where i*q/n passes a whole number.
    taken = F.expr("(_place + 1) * _quota div _size") > F.expr("_place * _quota div _size")
    return spread.withColumns(sizes).withColumn("_quota", quota).filter(taken).withColumn("conflict", F.col("_c")).drop("_c", "_size", "_place", "_cs", "_os", "_quota")


def last_unknown(periods: DataFrame, key: str, value: Column, unknown: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The last row of each key among those whose trimmed lower-cased value is an unknown one (null: empty)."""
    found = periods.filter(F.lower(F.trim(F.coalesce(value, F.lit("")))).isin(unknown))
    return found.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_m")).select(key, *[f"_m.{c}" for c in columns])


def code_years(rows: DataFrame, house: str, code: str, *days: Column) -> DataFrame:
    """The different years of each (house, code), by the first date that is one, and how many rows have none."""
    year = F.coalesce(*[F.year(d) for d in days])
    return rows.groupBy(house, code).agg(F.array_sort(F.collect_set(year)).alias("years"), F.count_if(year.isNull()).alias("undated"))


def known_ids(*sources: DataFrame) -> DataFrame:
    """Different non-blank identifiers of tables of one column each, as strings named ``id``."""
    found = None
    for rows in sources:
        ids = rows.select(F.trim(F.col(rows.columns[0]).cast("string")).alias("id")).filter("id <> ''")
        found = ids if found is None else found.union(ids)
    return found.distinct()


def identity_checked(rows: DataFrame, parts: list[str], start: Column, year: int) -> DataFrame:
    """Adds identity (parts joined by |; null if one is null or blank) and whether the period starts in the stratum's year."""
    whole = F.lit(True)
    for p in parts:
        whole = whole & F.coalesce(F.trim(F.col(p).cast("string")) != "", F.lit(False))
    identity = F.when(whole, F.concat_ws("|", *[F.trim(F.col(p).cast("string")) for p in parts]))
    return rows.withColumns({"identity": identity, "in_stratum": F.coalesce(F.year(start) == year, F.lit(False))})


def stage_counts(counts: DataFrame, group: str, stages: list[str]) -> DataFrame:
    """Wide counts of successive stages as rows: group, stage number, stage, rows, and rows lost since the stage before."""
    items = [F.struct(F.lit(i).alias("number"), F.lit(s).alias("stage"), F.col(s).cast("long").alias("n_rows"), (F.col(stages[i - 1]) - F.col(s) if i else F.lit(0)).cast("long").alias("lost")) for i, s in enumerate(stages)]
    return counts.select(group, F.inline(F.array(*items)))


def issues(metrics: DataFrame, rules: dict[str, str]) -> DataFrame:
    """A row for every metric above 0 that has a rule: metric, n, severity."""
    items = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("n"), F.lit(level).alias("severity")) for m, level in rules.items()]
    return metrics.select(F.inline(F.array(*items))).filter("n > 0")


# --- scalars


def preview(text: Column, size: int = 500) -> Column:
    """White space collapsed; longer texts cut, with three dots, to ``size`` characters."""
    flat = collapse_space(text)
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size - 3), F.lit("..."))).otherwise(flat)


def declared_type(kind: Column, declared: Column) -> Column:
    """The declared record type of an object, __missing__ where it is blank; for other kinds their name in underscores."""
    return F.when(kind == "object", F.coalesce(F.nullif(F.trim(declared), F.lit("")), F.lit("__missing__"))).otherwise(F.concat(F.lit("__"), kind, F.lit("__")))


def composite_key(*parts: Column) -> Column:
    """Trimmed parts joined by |; a null part stays as an empty one."""
    return F.concat_ws("|", *[F.coalesce(F.trim(p.cast("string")), F.lit("")) for p in parts])


def terms_in(first: Column, last: Column, start_year: int = 2011, start_number: int = 54) -> Column:
    """Numbers (1 to 99) of the four-year terms, from 1 February to 31 January, that meet the period; null with a null day."""
    began = lambda d: F.when(F.month(d) >= 2, F.year(d)).otherwise(F.year(d) - 1)
    number = lambda d: (F.floor((began(d) - start_year) / 4) + start_number).cast("int")
    a, b = F.greatest(number(first), F.lit(1)), F.least(number(last), F.lit(99))
    return F.when(first.isNull() | last.isNull(), None).when((first > last) | (a > b), F.array().cast("array<int>")).otherwise(F.sequence(a, b))


def term_span(number: int, start_year: int = 2011, start_number: int = 54) -> tuple[date, date]:
    year = start_year + (number - start_number) * 4
    return date(year, 2, 1), date(year + 4, 1, 31)
