"""Places that driver and executors share, and how a plan's lineage is cut there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether shuffled files are deleted at the end of the job that they were written for.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one is set only where the session has none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="verbatim-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder as a table and read again, so that lost executors cost no recomputation.

    A table takes a fraction of a checkpoint's room, and later scans read only the columns they need.
    The files that were shuffled for it go at once, not when the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, "cut")
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote and that no plan reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def likely_in(rows: DataFrame, column: str, keys: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """The ``rows`` whose ``column`` (a hash, long) may be among ``keys``' first column: all that are, and few others.

    The keys' low bits are marked in a bitmap of fixed size (2 MB at 24 bits), which goes to all
    tasks, so that a join that follows moves few rows; with too many keys it lets all rows through.
    """
    place = lambda c: F.pmod(c, F.lit(bits)) + 1
    key = F.col(keys.columns[0])
    marked = keys.select(place(key).alias("k")).groupBy(F.bitmap_bucket_number("k").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("_bitmap"))
    spot = rows.withColumn("_spot", place(F.col(column))).withColumn("_bucket", F.bitmap_bucket_number("_spot")).withColumn("_bit", F.bitmap_bit_position("_spot"))
    byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(_bit div 8 + 1 as int), 1)")), 16, 10).cast("int")
    hit = spot.join(F.broadcast(marked), "_bucket").filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0)
    return hit.select(*rows.columns)
