"""Profiles of nested JSON: every path and value, the states of each field, cardinalities and frequencies."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values up to which a cardinality is exact, and smallest hashes kept beyond it.
EXACT, KEPT = 10_000, 1_024


def type_name(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


def state(value) -> str:
    """null, empty (no characters, members or items) or filled."""
    if value is None:
        return "null"
    return "empty" if value in ("", [], {}) else "filled"


def walk(value, path: str = "$") -> Iterator[tuple[str, object]]:
    """(path, value) of the value and all below it, containers first, members in the order of their names."""
    stack = [(path, value)]
    while stack:
        at, v = stack.pop()
        yield at, v
        if isinstance(v, dict):
            stack += [(f"{at}.{k.replace(chr(92), chr(92) * 2).replace('.', chr(92) + '.')}", v[k]) for k in sorted(v, reverse=True)]
        elif isinstance(v, list):
            stack += [(f"{at}[]", x) for x in reversed(v)]


def shape(value) -> str:
    """A hash of the value's structure: names, types and states, not contents."""

    def outline(v):
        if isinstance(v, dict):
            return {k: outline(v[k]) for k in sorted(v)}
        if isinstance(v, list):
            return [outline(x) for x in v]
        return [type_name(v), state(v)]

    return hashlib.sha256(json.dumps(outline(value), separators=(",", ":")).encode()).hexdigest()


def flatten(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, ordinal, path, type, state, length and value (JSON text; strings as they are) of everything in the JSON column.

    Rows whose column is null or isn't JSON give nothing; ``rejected`` finds those.
    """
    fields = [rows.schema[k] for k in keys]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches):
        for batch in batches:
            at, found = [], []
            for i, x in enumerate(batch.column(len(keys)).to_pylist()):
                try:
                    value = json.loads(x) if x is not None else None
                except ValueError:
                    continue
                if x is None:
                    continue
                for n, (path, v) in enumerate(walk(value)):
                    plain = v if isinstance(v, str) else json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
                    at.append(i)
                    found.append((n, path, type_name(v), state(v), len(v) if isinstance(v, (str, list, dict)) else None, plain))
            columns = list(zip(*found, strict=True)) or [()] * 6
            taken = batch.select(list(range(len(keys)))).take(pa.array(at, pa.int64())) if keys else None
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*(taken.columns if keys else []), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*keys, "ordinal", "path", "type", "state", "length", "value"])

    return rows.select(*keys, text).mapInArrow(run, f"{ddl + ', ' if keys else ''}ordinal long, path string, type string, state string, length long, value string")


def rejected(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose JSON column isn't null and doesn't parse, with the text's sha256."""
    return rows.filter(F.col(text).isNotNull() & F.expr(f"try_parse_json(`{text}`)").isNull()).withColumn("text_sha256", F.sha2(text, 256))


def under_key(rows: DataFrame, text: str, key: str, *keys: str) -> DataFrame:
    """keys, ordinal, path and value of every value a member named ``key`` holds at any depth; a list's items one by one.

    Nulls give nothing, nor do empty lists; items that are lists stay whole. Rows that aren't JSON give nothing.
    """
    name = re.escape("." + key.replace("\\", "\\" * 2).replace(".", "\\."))
    end = rf"(?<!\\)(?:\\\\)*{name}"
    own = F.col("path").rlike(f"{end}$") & (F.col("type") != "array")
    return flatten(rows, text, *keys).filter((own | F.col("path").rlike(rf"{end}\[\]$")) & (F.col("type") != "null")).select(*keys, "ordinal", "path", "value")


def deep_text(rows: DataFrame, text: str, names: list[str], key: str) -> DataFrame:
    """key and text: the trimmed non-blank strings under members of these names (in any case), joined by an empty line.

    Members of one object come in the order of their names. Rows without such a string give nothing; ``key`` tells rows apart.
    """
    last = F.lower(F.regexp_extract("path", r"\.([^.\[\]]+)(?:\[\])*$", 1))
    found = flatten(rows, text, key).filter((F.col("type") == "string") & last.isin([n.lower() for n in names]) & F.col("value").rlike(r"\S"))
    parts = F.array_sort(F.collect_list(F.struct("ordinal", F.regexp_replace("value", r"^\s+|\s+$", "").alias("t"))))
    return found.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("text"))


def field_profile(flat: DataFrame, record: str, group: str, universe: DataFrame) -> DataFrame:
    """For each group and path: records by state (absent too), fill rate, types, lengths and whether types conflict.

    A record counts once a path: filled if any occurrence is, else empty if any is, else null.
    ``universe``: group and n_records.
    """
    best = F.max(F.when(F.col("state") == "filled", 3).when(F.col("state") == "empty", 2).otherwise(1))
    types = F.array_sort(F.collect_set("type"))
    per = flat.groupBy(group, "path", record).agg(best.alias("_s"), types.alias("_t"), F.collect_list("length").alias("_l"))
    out = per.groupBy(group, "path").agg(
        F.count(F.lit(1)).alias("present"),
        F.count_if(F.col("_s") == 3).alias("filled"),
        F.count_if(F.col("_s") == 2).alias("empty"),
        F.count_if(F.col("_s") == 1).alias("nulls"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_t")))).alias("types"),
    )
    lengths = flat.filter("length is not null").groupBy(group, "path").agg(F.min("length").alias("least_length"), F.percentile("length", 0.5).alias("median_length"), F.max("length").alias("most_length"))
    out = out.join(lengths, [group, "path"], "left").join(universe, group)
    solid = F.size(F.array_except("types", F.array(F.lit("null"))))
    return out.withColumn("absent", F.col("n_records") - F.col("present")).withColumn("fill_rate", F.col("filled") / F.col("n_records")).withColumn("type_conflict", solid > 1)


def kmv_cardinality(values: DataFrame, group: str, value: str, exact: int = EXACT, kept: int = KEPT) -> DataFrame:
    """Distinct values by group: exact up to ``exact``, beyond it (k - 1) / the k-th smallest sha256 as a share of all."""
    distinct = values.filter(F.col(value).isNotNull()).select(group, F.sha2(F.col(value).cast("string"), 256).alias("h")).distinct()
    counted = distinct.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy(group).orderBy("h"))
    edge = distinct.withColumn("_r", nth).filter(F.col("_r") == kept).select(group, (F.conv(F.substring("h", 1, 13), 16, 10).cast("double") / float(16**13)).alias("edge"))
    out = counted.join(edge, group, "left")
    return out.select(group, F.when(F.col("n") <= exact, F.col("n").cast("double")).otherwise((kept - 1) / F.col("edge")).alias("cardinality"), (F.col("n") <= exact).alias("is_exact"))


def value_frequencies(values: DataFrame, group: str, value: str, most: int = 100) -> DataFrame:
    """Values by frequency, of groups with at most ``most`` distinct values."""
    n = values.groupBy(group, value).agg(F.count(F.lit(1)).alias("n_rows"))
    by = Window.partitionBy(group)
    ranked = n.withColumn("_d", F.count(F.lit(1)).over(by)).filter(F.col("_d") <= most).withColumn("rank", F.row_number().over(by.orderBy(F.col("n_rows").desc(), F.col(value))))
    return ranked.drop("_d")


def alias_candidates(profile: DataFrame, group: str) -> DataFrame:
    """Pairs of paths of a group that end in the same name and have the same types but null."""
    last = F.element_at(F.split(F.regexp_replace("path", r"\[\]", ""), r"\."), -1)
    kinds = F.array_except("types", F.array(F.lit("null")))
    named = profile.select(group, "path", last.alias("terminal"), kinds.alias("kinds")).filter(F.size("kinds") > 0)
    right = named.select(*[F.col(c).alias(f"_{c}") for c in named.columns])
    on = (F.col(group) == F.col(f"_{group}")) & (F.col("terminal") == F.col("_terminal")) & (F.col("kinds") == F.col("_kinds")) & (F.col("path") < F.col("_path"))
    return named.join(right, on).select(group, "terminal", F.col("path").alias("left_path"), F.col("_path").alias("right_path"))


def parent_path(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)(?<!\\)\.[^.]*$", 1)


def redact(text: Column, most: int = 200) -> Column:
    """JSON text with each string longer than ``most`` replaced by its length and hash; the structure stays."""
    def clean(v):
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items()}
        if isinstance(v, list):
            return [clean(x) for x in v]
        if isinstance(v, str) and len(v) > most:
            return {"length": len(v), "sha256": hashlib.sha256(v.encode()).hexdigest()}
        return v

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else json.dumps(clean(json.loads(x)), sort_keys=True, ensure_ascii=False)
            except ValueError:
                return None

        return column.map(one)

    return run(text)
