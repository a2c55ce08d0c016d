"""Comparison of tables that should agree: layers, baselines, catalogues and linked records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def layer_presence(layers: dict[str, DataFrame], key: str, metadata: list[str] | None = None) -> DataFrame:
    """One row a key: in which layers it is, the first filled metadata in layer order, and the first layer that lost it.

    ``lost_at`` names the first layer without the key after one that has it; null where none lost it.
    """
    metadata = metadata or []
    tagged = []
    for i, (name, rows) in enumerate(layers.items()):
        kept = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in metadata]
        tagged.append(rows.select(F.col(key), *kept, F.lit(name).alias("_layer"), F.lit(i).alias("_i")))
    union = reduce(DataFrame.unionByName, tagged)
    seen = [F.bool_or(F.col("_layer") == name).alias(f"in_{name}") for name in layers]
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_i"))).alias(c) for c in metadata]
    out = union.filter(F.col(key).isNotNull()).groupBy(key).agg(*seen, *first)
    lost, before = F.lit(None).cast("string"), F.lit(False)
    for name in layers:
        lost = F.coalesce(lost, F.when(before & ~F.col(f"in_{name}"), name))
        before = before | F.col(f"in_{name}")
    return out.withColumn("lost_at", lost)


def coverage_gaps(source: DataFrame, raw: DataFrame, key: str, partition: str) -> DataFrame:
    """By partition: keys expected, present, missing, filed under another partition, and beyond what is expected; and a status."""
    a = source.select(F.col(key).alias("_k"), F.col(partition).alias("_p")).distinct()
    b = raw.select(F.col(key).alias("_rk"), F.col(partition).alias("_rp")).distinct()
    joined = a.join(b, F.col("_k") == F.col("_rk"), "full")
    where = F.when(F.col("_rk").isNull(), "missing").when(F.col("_k").isNull(), "extra").when(F.col("_p").eqNullSafe(F.col("_rp")), "present").otherwise("misplaced")
    counted = joined.withColumn("_w", where).groupBy(F.coalesce("_p", "_rp").alias(partition)).agg(*[F.count_if(F.col("_w") == w).alias(w) for w in ("present", "missing", "misplaced", "extra")])
    status = F.when(F.col("missing") > 0, "incomplete").when(F.col("misplaced") > 0, "misplaced").when(F.col("extra") > 0, "extra").otherwise("complete")
    return counted.withColumn("status", status)


def baseline_changes(before: DataFrame, after: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """key, state (missing, added, changed or equal) and which compared columns differ."""
    left = before.select(F.col(key).alias("_l"), *[F.col(c).alias(f"_l_{c}") for c in compared])
    right = after.select(F.col(key).alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in compared])
    joined = left.join(right, F.col("_l") == F.col("_r"), "full")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")), c) for c in compared]))
    state = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "added").when(F.size(differ) > 0, "changed").otherwise("equal")
    return joined.select(F.coalesce("_l", "_r").alias(key), state.alias("state"), F.when(state == "changed", differ).otherwise(F.array().cast("array<string>")).alias("changed"))


def merge_sides(left: DataFrame, right: DataFrame, key: str, prefer_right: list[str]) -> DataFrame:
    """Full outer union of two tables by key: the left's values, but the right's where filled for ``prefer_right``."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])
    joined = left.join(other, F.col(key) == F.col(f"_r_{key}"), "full")
    columns = []
    for c in dict.fromkeys([*left.columns, *right.columns]):
        own, theirs = (F.col(c) if c in left.columns else None), (F.col(f"_r_{c}") if c in right.columns else None)
        both = [x for x in ([theirs, own] if c in prefer_right else [own, theirs]) if x is not None]
        columns.append(F.coalesce(*both).alias(c))
    return joined.select(*columns)


def unique_bridge(rows: DataFrame, targets: DataFrame, key: str, target: str) -> DataFrame:
    """Rows with the target of their key: matched where it has one, ambiguous (no target) where several, absent where none."""
    per = targets.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("n_targets"), F.min(target).alias("_target"))
    joined = rows.join(per, F.col(key) == F.col("_k"), "left").drop("_k")
    n = F.coalesce("n_targets", F.lit(0))
    status = F.when(n == 0, "absent").when(n == 1, "matched").otherwise("ambiguous")
    return joined.withColumn("n_targets", n).withColumn(target, F.when(n == 1, F.col("_target"))).withColumn("bridge_status", status).drop("_target")


def linked_records(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """One row: keys on both sides once (matched), keys repeated on a side (ambiguous, left out of all else), keys on one side, and equal and different values of the matched."""
    a, b = (t.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"k{i}")).agg(F.count(F.lit(1)).alias(f"n{i}"), F.min(F.struct(value)).alias(f"v{i}")) for i, t in enumerate((left, right)))
    joined = a.join(b, F.col("k0") == F.col("k1"), "full")
    many = (F.coalesce("n0", F.lit(0)) > 1) | (F.coalesce("n1", F.lit(0)) > 1)
    both = ~many & F.col("k0").isNotNull() & F.col("k1").isNotNull()
    equal = F.col("v0").eqNullSafe(F.col("v1"))
    return joined.agg(
        F.count_if(both).alias("matched"),
        F.count_if(many).alias("ambiguous"),
        F.count_if(~many & F.col("k1").isNull()).alias("only_left"),
        F.count_if(~many & F.col("k0").isNull()).alias("only_right"),
        F.count_if(both & equal).alias("equal"),
        F.count_if(both & ~equal).alias("different"),
    )


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """A join that fails when it runs if a key is repeated on either side."""

    def checked(rows: DataFrame, side: str) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(key))
        ok = F.assert_true((n == 1) | F.col(key).isNull(), F.concat(F.lit(f"{side} key repeated: "), F.col(key).cast("string")))
        return rows.withColumn("_ok", ok).filter("_ok is null").drop("_ok")

    return checked(left, "left").join(checked(right, "right"), key, how)


def enrich(rows: DataFrame, values: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the given columns replaced where ``values`` (unique by key) has something for them."""
    new = values.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    joined = rows.join(new, F.col(key) == F.col("_k"), "left")
    return joined.select(*[F.coalesce(f"_n_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def exact_cover(wanted: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """key and problem (missing, unknown or repeated) of all that keeps ``given`` from covering ``wanted`` exactly."""
    n = given.groupBy(F.col(key).alias("_g")).agg(F.count(F.lit(1)).alias("n"))
    joined = wanted.select(F.col(key).alias("_w")).distinct().join(n, F.col("_w") == F.col("_g"), "full")
    problem = F.when(F.col("_g").isNull(), "missing").when(F.col("_w").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return joined.select(F.coalesce("_w", "_g").alias(key), problem.alias("problem")).filter("problem is not null")


def pair_metrics(rows: DataFrame, left: Column, right: Column, *keys: str) -> DataFrame:
    """Of two alternative columns: rows with either, with both, equal, different, one side alone, and the rates."""
    a, b = left.isNotNull(), right.isNotNull()
    frame = rows.groupBy(*keys) if keys else rows.groupBy()
    out = frame.agg(F.count_if(a | b).alias("either"), F.count_if(a & b).alias("both"), F.count_if(a & b & (left == right)).alias("equal"), F.count_if(a & b & (left != right)).alias("different"), F.count_if(a & ~b).alias("only_left"), F.count_if(b & ~a).alias("only_right"))
    return out.withColumn("equal_rate", F.when(F.col("both") > 0, F.col("equal") / F.col("both"))).withColumn("both_rate", F.when(F.col("either") > 0, F.col("both") / F.col("either")))
