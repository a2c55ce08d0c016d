"""Stable identifiers, selection keys and content hashes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_id(*parts: Column, sep: str = "|", digits: int = 24) -> Column:
    """The first hex digits of the sha1 of the joined parts; null parts count as empty."""
    return F.substring(F.sha1(F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, digits)


def namespaced_id(namespace: str, *parts: Column, sep: str = "|", digits: int = 24) -> Column:
    text = F.concat_ws(sep, F.lit(namespace), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(text, 256), 1, digits)


def selection_key(seed: str, identity: Column) -> Column:
    """sha256 of the seed, a zero character and the identity: an order that the seed alone decides."""
    return F.sha2(F.concat(F.lit(seed), F.lit("\0"), identity.cast("string")), 256)


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no blanks; null where it isn't JSON."""
    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else json.dumps(json.loads(x), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return column.map(one)

    return run(text)


def content_hash(rows: DataFrame) -> DataFrame:
    """One row: how many rows, and two sums over their hashes, equal for equal sets of rows in any order or layout."""
    names = sorted(rows.columns)
    row = F.xxhash64(*names), F.xxhash64(F.lit(1), *names)
    fold = [F.coalesce(F.sum(F.pmod(h, F.lit(2**31 - 1))), F.lit(0)).alias(f"sum_{i}") for i, h in enumerate(row)]
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), *fold)


def rate(numerator: Column, denominator: Column) -> Column:
    """A ratio with eight decimals, or 'nao_aplicavel' for a denominator of 0."""
    exact = numerator.cast("decimal(20,0)") / denominator.cast("decimal(18,0)")
    return F.when(denominator == 0, "nao_aplicavel").otherwise(F.format_string("%s", F.bround(exact, 8).cast("decimal(20,8)").cast("string")))
