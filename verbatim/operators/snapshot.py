"""Snapshots with their exclusions, eligibility, control blocks, ranked picks and catalog groups.

Every function takes and returns DataFrames or Columns, reads each row once and keeps nulls apart as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def date_reason(day: Column, first: str, last: str) -> Column:
    """null inside [first, last]; else invalid_date (null), before_window or after_window."""
    return F.when(day.isNull(), "invalid_date").when(day < F.lit(first).cast("date"), "before_window").when(day > F.lit(last).cast("date"), "after_window")


def snapshot_select(rows: DataFrame, day: str, first: str, last: str, key: str, columns: dict[str, Column], most: int | None = None) -> DataFrame:
    """The declared columns of the rows inside the window; with ``most``, those of the least keys."""
    found = rows.filter(date_reason(F.col(day), first, last).isNull()).select(*[c.alias(n) for n, c in columns.items()])
    return found if most is None else found.orderBy(key).limit(most)


def exclusion_select(rows: DataFrame, day: str, first: str, last: str, columns: list[str]) -> DataFrame:
    """The complement of snapshot_select, null dates too, each row with its reason."""
    return rows.withColumn("reason", date_reason(F.col(day), first, last)).filter("reason is not null").select(*columns, "reason")


def eligibility_flags(rows: DataFrame, n_words: Column, summary: Column, day: Column, least_words: dict[str, int], years: tuple[int, int], year_to_date: str) -> DataFrame:
    """A flag for each word threshold, for a summary that isn't blank, for the years, and for the part of the last year up to a day.

    Nulls make a flag false.
    """
    no = F.lit(False)
    flags = {name: F.coalesce(n_words >= n, no) for name, n in least_words.items()}
    flags["has_summary"] = F.coalesce(F.trim(summary) != "", no)
    flags["in_years"] = F.coalesce(F.year(day).between(*years), no)
    flags["in_year_to_date"] = F.coalesce(day.between(F.trunc(F.lit(year_to_date).cast("date"), "year"), F.lit(year_to_date).cast("date")), no)
    return rows.withColumns(flags)


def segmentable(status: Column, text: Column, allowed: list[str]) -> Column:
    """True where the status is an allowed one and the text isn't blank; never null."""
    return F.coalesce(status.isin(allowed) & (F.trim(text) != ""), F.lit(False))


def speaker_summary(rows: DataFrame, by: list[str], words: str) -> DataFrame:
    """Rows, sum and median of ``words`` by those of the dimensions ``by`` that the table has."""
    kept = [c for c in by if c in rows.columns]
    return rows.groupBy(*kept).agg(F.count(F.lit(1)).alias("n"), F.sum(words).alias("total"), F.median(words).alias("median"))


def control_block(rows: DataFrame, key: str, text: str, day: Column) -> DataFrame:
    """For each year: rows, different, repeated and missing keys, rows with non-ASCII or replacement characters, first and last day.

    Rows without a day form the year null. Counts of a key are taken first, so no year's keys meet in one task.
    """
    flat = rows.select(F.year(day).alias("year"), F.col(key).alias("_key"), day.alias("_day"), F.col(text).alias("_text"))
    each = flat.groupBy("year", "_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_text").rlike(r"[^\x00-\x7F]")).alias("marked"),
        F.count_if(F.col("_text").contains("�")).alias("replaced"),
        F.min("_day").alias("a"),
        F.max("_day").alias("b"),
    )
    known = F.col("_key").isNotNull()
    return each.groupBy("year").agg(
        F.sum("n").alias("n_rows"),
        F.count_if(known).alias("unique_ids"),
        F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("duplicate_ids"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing_ids"),
        F.sum("marked").alias("diacritic_rows"),
        F.sum("replaced").alias("replacement_rows"),
        F.min("a").alias("first_day"),
        F.max("b").alias("last_day"),
    )


def numeric_first(c: Column) -> list[Column]:
    """Order of identifiers: those that are numbers by value, then the others by text."""
    number = F.when(c.rlike("^[0-9]+$"), c.try_cast("decimal(38,0)"))
    return [number.asc_nulls_last(), c.asc()]


def eligible_first(rows: DataFrame, group: str, eligible: Column, audio: Column, key: str, seed: str, most: int) -> DataFrame:
    """The ``most`` rows of each group: eligible ones first, then those with audio, then by a seeded hash of the key."""
    order = Window.partitionBy(group).orderBy(F.coalesce(eligible, F.lit(False)).desc(), F.coalesce(audio, F.lit(False)).desc(), F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def smallest_per_category(rows: DataFrame, category: str, size: str, locator: str) -> DataFrame:
    """One row of each category: the least (size, locator); null sizes never win against others."""
    least = F.min_by(F.struct(size, locator), F.struct(F.col(size).isNull(), F.col(size), F.col(locator))).alias("m")
    return rows.groupBy(category).agg(least).select(category, f"m.{size}", f"m.{locator}")


def universe_groups(rows: DataFrame, by: list[str], size: str) -> DataFrame:
    """Items and bytes of each group of ``by``, and whether all groups add up to the whole, in every row."""
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    whole = rows.agg(F.count(F.lit(1)).alias("_items"), F.coalesce(F.sum(size), F.lit(0)).alias("_bytes"))
    added = groups.agg(F.sum("items").alias("_i"), F.sum("bytes").alias("_b"))
    check = whole.crossJoin(added).select(((F.col("_items") == F.col("_i")) & (F.col("_bytes") == F.col("_b"))).alias("reconciled"))
    return groups.crossJoin(F.broadcast(check))  # one row


def potential_duplicates(rows: DataFrame, name: Column, size: str, path: str) -> DataFrame:
    """Groups of more than one row with one lower-cased name and size: how many, and their paths in order."""
    named = rows.select(F.lower(name).alias("name"), F.col(size).alias("size"), F.col(path).cast("string").alias("path"))
    found = named.filter("name is not null and size is not null").groupBy("name", "size")
    return found.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("path")), "|").alias("paths")).filter("n > 1")


def near_in_time(a: Column, b: Column, minutes: int = 5) -> Column:
    """True where two instants are at most so many minutes apart; null with a null."""
    return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) <= minutes * 60_000_000


def numbered(rows: DataFrame, group: str, order: list[Column], prefix: str, width: int, name: str = "number") -> DataFrame:
    """Adds identifiers such as T000001 in each group's order."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn(name, F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0")))


def role_orders(rows: DataFrame, group: str, role: str, order: list[Column]) -> DataFrame:
    """Adds each row's place among its group's rows of its role, and among all of the group."""
    return rows.withColumn("order_in_role", F.row_number().over(Window.partitionBy(group, role).orderBy(*order))).withColumn("order_overall", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def newest_first(files: DataFrame) -> DataFrame:
    """Adds ``rank``: by time of change, latest first, then by path, last first. ``files``: path, modified; one row a file."""
    return files.withColumn("rank", F.row_number().over(Window.orderBy(F.col("modified").desc(), F.col("path").desc())))


def described(rows: DataFrame) -> DataFrame:
    """position, column, type of each column of the table; the schema alone, no row is read."""
    fields = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(rows.schema)]
    return rows.sparkSession.createDataFrame(fields, "position int, column string, type string")


# --- scalars


def trailing_id(c: Column) -> Column:
    """The digits that end an address (before one slash); null without."""
    return F.nullif(F.regexp_extract(c, r"([0-9]+)/?$", 1), F.lit(""))


def speaker_key(person: Column, name: Column) -> Column:
    """The identifier, or else the lower-cased name; null where both are blank."""
    return F.coalesce(F.nullif(F.trim(person), F.lit("")), F.nullif(F.lower(F.trim(name)), F.lit("")))


#: Words that mean yes and no.
YES, NO = ("1", "true", "t", "yes", "y", "sim", "s"), ("0", "false", "f", "no", "n", "nao", "não")


def truth(c: Column) -> tuple[Column, Column]:
    """(true, false or null, whether the value is neither blank nor a word for yes or no)."""
    word = F.lower(F.trim(c))
    value = F.when(word.isin(*YES), True).when(word.isin(*NO), False)
    return value, F.coalesce((word != "") & value.isNull(), F.lit(False))


def byte_size(c: Column) -> Column:
    """Bytes of texts such as 12, 3KiB, 4 MiB and 5GiB; null for others."""
    number, unit = F.regexp_extract(c, r"^\s*([0-9]+)\s*([A-Za-z]*)\s*$", 1), F.lower(F.regexp_extract(c, r"^\s*([0-9]+)\s*([A-Za-z]*)\s*$", 2))
    factor = F.when(unit.isin("", "b"), 1).when(unit == "kib", 1 << 10).when(unit == "mib", 1 << 20).when(unit == "gib", 1 << 30)
    return F.nullif(number, F.lit("")).try_cast("bigint") * factor.cast("bigint")


def day_before(c: Column) -> Column:
    return F.date_sub(c.try_cast("date"), 1)


def day_after(c: Column) -> Column:
    return F.date_add(c.try_cast("date"), 1)


def ordered_distinct(c: Column) -> Column:
    """A list without repeated items, in the order in which they first come."""
    return F.array_distinct(c)


def as_list(value: Column) -> Column:
    """A VARIANT as a list: an array's items, one item for any other value, none for null."""
    kind = F.schema_of_variant(value)
    return F.when(value.isNull() | (kind == "VOID"), F.array().cast("array<variant>")).when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))
