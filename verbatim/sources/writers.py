"""Writers with declared winners, order and refusal to overwrite."""

from __future__ import annotations

import gzip
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import content_hash


def write_ordered(rows: DataFrame, path: str, key: str, files: int | None = None) -> None:
    """Parquet with zstd, ordered by key over all files; with ``files`` = 1, one file."""
    placed = rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)
    placed.sortWithinPartitions(key).write.option("compression", "zstd").parquet(path)


def write_by_dataset(rows: DataFrame, path: str, key: str, *newest: Column) -> None:
    """Parquet by source and dataset, of each key the first row in the given order."""
    from ..operators.dedup import keep_first

    keep_first(rows, key, *newest).write.partitionBy("source", "dataset").option("compression", "zstd").parquet(path)


def write_lines(rows: DataFrame, path: str, columns: list[str], *partitions: str) -> None:
    """JSON lines with the columns in this order, nulls written."""
    rows.select(*columns, *[p for p in partitions if p not in columns]).write.partitionBy(*partitions).option("ignoreNullFields", "false").json(path)


def write_table(rows: DataFrame, path: str) -> None:
    """Parquet, CSV with a header or JSON lines, by the path's suffix."""
    kind = path.rsplit(".", 1)[-1]
    if kind == "parquet":
        rows.write.parquet(path)
    elif kind == "csv":
        rows.write.option("header", "true").csv(path)
    elif kind in ("json", "jsonl"):
        rows.write.option("ignoreNullFields", "false").json(path)
    else:
        raise ValueError(f"unknown kind of table: {path}")


def publish_once(rows: DataFrame, path: str) -> bool:
    """Write a table that isn't there (True); leave an equal one alone (False); refuse to replace a different one."""
    spark = rows.sparkSession
    try:
        there = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows.write.mode("errorifexists").parquet(path)
        return True
    if content_hash(there.select(*sorted(there.columns))).first() != content_hash(rows.select(*sorted(rows.columns))).first():
        raise FileExistsError(f"{path} holds other rows")
    return False


def append_new(rows: DataFrame, path: str, *key: str) -> int:
    """Append the rows whose key the table hasn't, one each; how many there were."""
    fresh = rows.dropDuplicates(list(key))
    try:
        fresh = fresh.join(rows.sparkSession.read.parquet(path).select(*key).distinct(), list(key), "left_anti")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    fresh = fresh.cache()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def cell(value: Column, most: int = 32_767, mark: str = " [...]") -> Column:
    """A spreadsheet cell: control characters dropped, formulas quoted, long text cut with a mark."""
    clean = F.regexp_replace(value.cast("string"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    safe = F.when(clean.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), clean)).otherwise(clean)
    return F.when(F.length(safe) > most, F.concat(F.substring(safe, 1, most - len(mark)), F.lit(mark))).otherwise(safe)


def steady_gzip(source: str, target: str, level: int = 6) -> tuple[str, str]:
    """Compress a local file so that equal files give equal bytes; sha256 of the plain and of the packed bytes. Never overwrites."""
    plain, size = hashlib.sha256(), 1 << 20
    with open(source, "rb") as read, open(target, "xb") as out, gzip.GzipFile("", "wb", level, out, mtime=0) as pack:
        while part := read.read(size):
            plain.update(part)
            pack.write(part)
    with open(target, "rb") as packed:
        return plain.hexdigest(), hashlib.file_digest(packed, "sha256").hexdigest()
