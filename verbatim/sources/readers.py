"""Readers of raw records; what can't be read is kept apart, never lost silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, rejections) of line-delimited JSON, plain or gzip.

    Records: file, line_number (from 1, over physical lines), line, record (VARIANT). Rejections: file,
    line_number, line, line_sha256, reason (invalid_json or not_object). Blank lines are neither; a
    byte order mark at the start of a file is dropped. Line numbers need a file in one task.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("value"))
    rows = files.select("file", F.posexplode(F.split("value", "\r?\n", -1)).alias("n", "line")).filter(F.trim("line") != "")
    rows = rows.select("file", (F.col("n") + 1).cast("long").alias("line_number"), "line", F.expr("try_parse_json(line)").alias("record"))
    whole = F.col("record").isNotNull() & F.expr("schema_of_variant(record)").startswith("OBJECT")
    reason = F.when(F.col("record").isNull(), "invalid_json").otherwise("not_object")
    return rows.filter(whole), rows.filter(~whole).select("file", "line_number", "line", F.sha2("line", 256).alias("line_sha256"), reason.alias("reason"))


def json_lines_fast(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The objects of line-delimited JSON as VARIANT, splittable, without line numbers; other lines are dropped."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.expr("try_parse_json(value)").alias("record"))
    return rows.filter(F.col("record").isNotNull()).filter(F.expr("schema_of_variant(record)").startswith("OBJECT"))


def json_lines_strict(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records as in json_lines; the job fails at the first line that isn't an object, naming file and line."""
    good, bad = json_lines(spark, path)
    place = F.concat("file", F.lit(":"), F.col("line_number").cast("string"), F.lit(": "), "reason")
    stop = bad.filter(F.raise_error(place).cast("string").isNull()).select("file", "line_number", "line", F.lit(None).cast("variant").alias("record"))
    return good.unionByName(stop)


def json_documents(spark: SparkSession, path: str | list[str], most_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """(records, rejections) of whole JSON files: file, ordinal (from 1) and record for each item of an array, or the one object.

    Rejections: file and reason, too_large (above ``most_bytes``: read it by lines), invalid_json or
    not_object (with the item's ordinal; null where the whole file is rejected). Blank files are neither.
    """
    sized = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    large = sized.filter(F.col("length") > most_bytes).select("file", F.lit(None).cast("long").alias("ordinal"), F.lit("too_large").alias("reason"))
    files = spark.read.text(path, wholetext=True).filter(F.col("_metadata.file_size") <= most_bytes)
    parsed = files.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("value")).filter(F.col("value").rlike(r"\S"))
    parsed = parsed.select("file", F.expr("try_parse_json(value)").alias("doc"))
    broken = parsed.filter("doc is null").select("file", F.lit(None).cast("long").alias("ordinal"), F.lit("invalid_json").alias("reason"))
    items = F.when(F.expr("schema_of_variant(doc)").startswith("ARRAY"), F.expr("try_variant_get(doc, '$', 'array<variant>')")).otherwise(F.array("doc"))
    each = parsed.filter("doc is not null").select("file", F.posexplode(items).alias("n", "record")).select("file", (F.col("n") + 1).cast("long").alias("ordinal"), "record")
    whole = F.coalesce(F.expr("schema_of_variant(record)").startswith("OBJECT"), F.lit(False))
    other = each.filter(~whole).select("file", "ordinal", F.lit("not_object").alias("reason"))
    return each.filter(whole), large.unionByName(broken).unionByName(other)


def csv_records(spark: SparkSession, path: str | list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, rejections) of CSV files with a header each; columns are found by the file's own header, in any order.

    Quoted fields may hold line breaks; a column that a file lacks, and what a short row leaves out, is
    null. A row that is too long, or whose value isn't of its column's type, is rejected whole (file,
    line, reason). Header names are trimmed; blank lines and files without a header give nothing. A
    file is one task's, as quoted line breaks ask for, and is held in its memory.
    """
    names = [f.name for f in schema]
    plain = T.StructType([T.StructField("file", T.StringType()), T.StructField("values", T.MapType(T.StringType(), T.StringType())), T.StructField("line", T.StringType()), T.StructField("reason", T.StringType())])

    def run(frames):
        import csv
        import io

        import pandas as pd

        for pdf in frames:
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                rows = csv.reader(io.StringIO(bytes(content).decode("utf-8-sig", "replace"), newline=""))
                header, found = None, []
                for row in rows:
                    if not any(x.strip() for x in row):
                        continue
                    if header is None:
                        header = [x.strip() for x in row]
                        continue
                    out = io.StringIO()
                    csv.writer(out, lineterminator="").writerow(row)
                    found.append((file, {h: v for h, v in zip(header, row, strict=False) if h in names}, out.getvalue(), "too_long" if len(row) > len(header) else None))
                yield pd.DataFrame(found, columns=["file", "values", "line", "reason"])

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    rows = files.mapInPandas(run, plain)
    value = lambda n: F.nullif(F.col("values")[n], F.lit(""))
    typed = rows.select("file", "line", "reason", *[value(f.name).try_cast(f.dataType).alias(f"_{i}") for i, f in enumerate(schema)], *[value(f.name).alias(f"_raw{i}") for i, f in enumerate(schema)])
    wrong = F.lit(False)
    for i in range(len(names)):
        wrong = wrong | (F.col(f"_{i}").isNull() & F.col(f"_raw{i}").isNotNull())
    why = F.coalesce("reason", F.when(wrong, "wrong_type"))
    told = typed.withColumn("reason", why)
    return told.filter("reason is null").select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)]), told.filter("reason is not null").select("file", "line", "reason")


def parquet_columns(spark: SparkSession, path: str | list[str], wanted: list[str], required: list[str] | None = None) -> DataFrame | None:
    """The wanted columns that the files have; None where a required one is missing."""
    rows = spark.read.parquet(path)
    if any(c not in rows.columns for c in required or []):
        return None
    return rows.select([c for c in wanted if c in rows.columns])


def checked_parquet(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Rows in the order of ``key`` from files whose schema is the declared one; anything else is an error."""
    rows = spark.read.parquet(path)
    have = [(f.name, f.dataType) for f in rows.schema]
    if have != [(f.name, f.dataType) for f in schema]:
        raise ValueError(f"schema differs: {rows.schema.simpleString()}")
    filled = [f.name for f in schema if not f.nullable]
    ok = F.lit(True)
    for c in filled:
        ok = ok & F.col(c).isNotNull()
    return rows.withColumn("_ok", F.assert_true(ok, F.lit("a required column is null"))).filter("_ok is null").drop("_ok").orderBy(key)


def with_partition(rows: DataFrame, path: str = "file") -> DataFrame:
    """Adds ano and mes from the path's folders (null without them)."""
    part = lambda name, n: F.nullif(F.regexp_extract(path, rf"(?:^|/){name}=(\d{{{n}}})(?:/|$)", 1), F.lit("")).cast("int")
    return rows.withColumn("ano", part("ano", 4)).withColumn("mes", part("mes", 2))


def file_catalog(spark: SparkSession, path: str) -> DataFrame:
    """file, size_bytes, modified, suffix of every file below a folder, contents unread."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    return rows.withColumn("suffix", F.regexp_extract("file", r"(\.[^./]+(?:\.gz)?)$", 1))


def selected_lines(records: DataFrame, selection: DataFrame) -> DataFrame:
    """The records that a selection names (file, line_number, line_sha256), in its position's order; a changed line fails."""
    wanted = selection.select("file", "line_number", "position", F.col("line_sha256").alias("_h"))
    joined = records.join(wanted, ["file", "line_number"])
    ok = F.assert_true(F.sha2("line", 256) == F.col("_h"), F.lit("a selected line has changed"))
    return joined.withColumn("_ok", ok).filter("_ok is null").drop("_ok", "_h").orderBy("position")


def wrong_scope(url: Column, start: Column, end: Column, first: str = "dataInicio", last: str = "dataFim") -> Column:
    """A request whose date parameters aren't the declared period's."""
    return ~(F.parse_url(url, F.lit("QUERY"), F.lit(first)).eqNullSafe(start) & F.parse_url(url, F.lit("QUERY"), F.lit(last)).eqNullSafe(end))


def parquet_marks(files: DataFrame, size: str | None = None) -> DataFrame:
    """path and status of whole files (rows of path and content): ok, short, wrong_size (by a column), no_header or no_footer.

    A null content is short; the marks are the format's four bytes at both ends.
    """
    n, mark = F.octet_length("content"), F.lit(b"PAR1")
    status = F.when(F.coalesce(n < 8, F.lit(True)), "short")
    if size:
        status = status.when(n != F.col(size), "wrong_size")
    status = status.when(F.substring("content", 1, 4) != mark, "no_header").when(F.substring("content", -4, 4) != mark, "no_footer")
    return files.select("path", status.otherwise("ok").alias("status"))
