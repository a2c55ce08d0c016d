"""Mixing sources to target weights by balanced sampling with the cube method.

Every source gets a target number of words. A document of a source with target/size = r is taken
floor(r) times, and once more with probability r - floor(r). These probabilities start a random
walk (the cube method's flight): it moves along directions in which the source's number of taken
documents and of taken words both stay as they are, until a document's probability reaches 0 or 1.
The flight runs in blocks of documents; what a block leaves undecided (two documents at most) flies
again in blocks of leftovers, until one block a source is left, whose two documents are landed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK = 4096
EDGE = 1e-9


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row for each source: its size, number of documents and target.

    Targets share the total by weight; one that would exceed ``max_repeats`` times its source's size
    stops there and the excess goes to the others by weight. With all sources in ascending order of
    (limit / weight) those that stop come first, so one running sum finds the share of the rest.
    A total of 0 gives targets of 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # One row a source, never documents, passes through these windows.
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("most", F.col("source_size") * float(max_repeats))
    by = Window.orderBy((F.col("most") / F.col("w")).asc(), "rank")
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    left = F.col("total") - F.coalesce(F.sum("most").over(upto), F.lit(0.0))
    share = left / (F.col("all_w") - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
    per = per.withColumn("share", share)
    # A source that stops raises the share of those after it, one that doesn't can't: the largest share is the level.
    level = F.max("share").over(everything)
    return per.withColumn("target", F.least("most", F.coalesce(level, F.lit(0.0)) * F.col("w"))).select("source", "rank", "source_size", "n_docs", "target")


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: at most two are left between 0 and 1; sum(p) and sum(p * size) are kept."""
    p = p.astype(float).copy()
    held: list[int] = []
    draws = rng.random(len(p) + 1)
    for i in range(len(p)):
        if not EDGE < p[i] < 1 - EDGE:
            p[i] = round(p[i])
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        held = _step(p, held, u, draws[i])
    return p


def land(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide what is left: first with the words alone in balance, then the last document by its probability."""
    p = flight(size, p, rng)
    held = [int(i) for i in np.flatnonzero((p > 0) & (p < 1))]
    while len(held) > 1:
        a, b = held[:2]
        u = (size[b], -size[a]) if size[a] or size[b] else (1.0, -1.0)
        held = _step(p, [a, b], u, rng.random()) + held[2:]
    for i in held:
        p[i] = float(rng.random() < p[i])
    return p


def _step(p: np.ndarray, held: list[int], u, draw: float) -> list[int]:
    ahead = min(((1 - p[i]) / x if x > 0 else p[i] / -x) for i, x in zip(held, u, strict=True) if x)
    back = min((p[i] / x if x > 0 else (1 - p[i]) / -x) for i, x in zip(held, u, strict=True) if x)
    move = ahead if draw < back / (ahead + back) else -back
    for i, x in zip(held, u, strict=True):
        p[i] += move * x
        if p[i] < EDGE:
            p[i] = 0.0
        elif p[i] > 1 - EDGE:
            p[i] = 1.0
    return [i for i in held if 0 < p[i] < 1]


def _fly(last: bool, level: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["doc_id", "size", "tie"], kind="stable", na_position="first")
        rng = np.random.default_rng([level, int(block["rank"].iloc[0]), int(block["block"].iloc[0])])
        move = land if last else flight
        return block.assign(p=move(block["size"].to_numpy(float), block["p"].to_numpy(float), rng))

    return run


def balanced_take(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, block: int = BLOCK) -> DataFrame:
    """doc_id, tie, source, size, source_size, target and copies (how often the mix takes the document).

    ``docs``: doc_id, text, source; more columns are left out. Null texts have size 0; null sources
    form one source, last in order; null and repeated doc_ids are documents like others (``tie``
    is a hash of the text). Empty tables give empty results. Reruns give the same copies: blocks,
    their order and their random numbers depend on the rows alone.
    """
    sizes = cut(docs.select("doc_id", "source", n_words("text").alias("size"), F.xxhash64("text").alias("tie")))
    per = source_targets(sizes, weights, max_repeats)
    joined = sizes.alias("d").join(per.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + EDGE)
    rows = joined.select(
        "doc_id", "tie", "d.source", "size", "source_size", "target", "rank", whole.cast("long").alias("whole"), F.greatest(F.lit(0.0), ratio - whole).alias("p"),
        F.pmod(F.xxhash64("doc_id", "tie"), F.ceil(F.col("n_docs") / block)).alias("block"),
    )
    done, level, blocks = [], 0, 2
    while True:
        top = rows.agg(F.max("block")).first()[0]
        blocks = 1 if top is None else top + 1
        moved = cut(rows.groupBy("rank", "block").applyInPandas(_fly(blocks == 1, level), rows.schema))
        done.append(moved.filter(~((F.col("p") > 0) & (F.col("p") < 1))))
        if blocks == 1:
            break
        rows = moved.filter((F.col("p") > 0) & (F.col("p") < 1)).withColumn("block", F.floor(F.col("block") / (block // 2)))
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "tie", "source", "size", "source_size", "target", (F.col("whole") + F.round("p").cast("long")).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns; one that the mix takes n times comes n times.

    Null and empty texts have size 0 and come as often as their probability says; null sources, doc_ids
    and repeated rows count as in balanced_take. Rows equal in doc_id, text and source share their
    copies in the order of a hash of all columns, so reruns take the same ones. An empty table gives
    an empty mix; further columns may have any name.
    """
    names = docs.columns
    take = balanced_take(docs, **options).filter("copies > 0")
    # Equal rows of one source may differ in copies; number them on both sides, so that each meets its own.
    key = ["_id", "_tie", "_source"]
    nth = Window.partitionBy(*key).orderBy("_all")
    left = docs.select(F.struct(*names).alias("whole_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_tie"), F.col("source").alias("_source"), F.xxhash64(F.to_json(F.struct(*names))).alias("_all"))
    per = take.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("source").alias("_source"), "copies").groupBy(*key, "copies").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("_to", F.sum("n").over(Window.partitionBy(*key).orderBy("copies"))).withColumn("_from", F.col("_to") - F.col("n"))
    per = per.select(*[F.col(k).alias(f"{k}2") for k in key], "copies", "_from", "_to")
    left = left.withColumn("_nth", F.row_number().over(nth) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"{k}2")) for k in key]
    joined = left.join(per, [*on, F.col("_nth") >= F.col("_from"), F.col("_nth") < F.col("_to")])
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole_row.*")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return balanced_take(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
