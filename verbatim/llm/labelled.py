"""The labelled rows that a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that are kept for evaluation: crc32 of the identifier's text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learning_sample(docs: DataFrame, labels: DataFrame, label: str, each: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, y) of at most ``each`` labelled rows of either class, those with the least hashes; and how many rows each class has in all.

    Rows that are held out, null labels and null doc_ids teach nothing. Where a doc_id has several
    labels its largest counts; documents that repeat a doc_id each count.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [r for y in (0, 1) for r in known.filter(F.col("y") == y).orderBy(*by_hash).limit(each).collect()]
    sample = docs.sparkSession.createDataFrame(picked, "doc_id long, y int")
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y"), counts
