import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbatim.plans.operation import Operation, outside
from verbatim.sources import paged, readers, writers
from verbatim.streaming import append


def test_json_lines(spark, tmp_path):
    (tmp_path / "ano=2020").mkdir()
    (tmp_path / "ano=2020" / "a.jsonl").write_text('{"k": 1}\n\nbad\n[1]\n{"k": 2}\n', encoding="utf-8-sig")
    good, bad = readers.json_lines(spark, str(tmp_path / "ano=2020"))
    assert [(r.line_number, r.k) for r in good.select("line_number", F.expr("variant_get(record, '$.k', 'int')").alias("k")).orderBy("line_number").collect()] == [(1, 1), (5, 2)]
    assert [(r.line_number, r.reason) for r in bad.orderBy("line_number").collect()] == [(3, "invalid_json"), (4, "not_object")]
    assert readers.with_partition(good).first().ano == 2020
    with pytest.raises(Exception, match="invalid_json"):
        readers.json_lines_strict(spark, str(tmp_path / "ano=2020")).select("line").collect()
    (tmp_path / "d.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert readers.json_documents(spark, str(tmp_path / "d.json"))[0].count() == 2


def test_json_documents_reject(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    for name, content in (("a", '[{"k": 1}, 2, {"k": 3}]'), ("b", '{"k": 4}'), ("c", "{bad"), ("d", " \n"), ("e", json.dumps([{"k": "x" * 500}]))):
        (folder / f"{name}.json").write_text(content)
    good, bad = readers.json_documents(spark, str(folder), most_bytes=200)
    assert sorted((r.file[-6:-5], r.ordinal) for r in good.select("file", "ordinal").collect()) == [("a", 1), ("a", 3), ("b", 1)]
    assert sorted((r.file[-6:-5], r.ordinal, r.reason) for r in bad.collect()) == [("a", 2, "not_object"), ("c", None, "invalid_json"), ("e", None, "too_large")]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n2,y,z\nq,w\n")
    good, bad = readers.csv_records(spark, str(tmp_path / "a.csv"), T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())]))
    assert [tuple(r) for r in good.collect()] == [(1, "x")] and bad.count() == 2


def test_csv_with_breaks_and_two_headers(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text('a,b\n1,x\n2,"l1\nl2"\n\na,b\n3\n')
    (folder / "b.csv").write_text("b,extra, a\ny,?,7\n")
    (folder / "c.csv").write_text("")
    good, bad = readers.csv_records(spark, str(folder), T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())]))
    assert sorted(map(tuple, good.collect()), key=str) == [(1, "x"), (2, "l1\nl2"), (3, None), (7, "y")]
    assert [(r.line, r.reason) for r in bad.collect()] == [("a,b", "wrong_type")]


def test_publish(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "t")
    assert writers.publish_once(rows, path) and not writers.publish_once(rows, path)
    with pytest.raises(FileExistsError):
        writers.publish_once(rows.limit(1), path)
    assert writers.append_new(spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k int, v string"), path, "k") == 1
    assert spark.read.parquet(path).count() == 3
    cells = spark.createDataFrame([("=1+1",), ("a\x00b",), ("x" * 20,)], "v string").select(writers.cell(F.col("v"), 10, "..")).collect()
    assert [c[0] for c in cells] == ["'=1+1", "ab", "x" * 8 + ".."]


def test_pages():
    answers = {"http://h/1": {"n": 1, "links": [{"rel": "next", "href": "2"}]}, "http://h/2": {"n": 2}}
    calls = []

    def fetch(url, params):
        calls.append(url)
        if len(calls) == 1:
            return 503, {"Retry-After": "0"}, ""
        return 200, {}, json.dumps(answers[url])

    assert [d["n"] for _, d in paged.pages(fetch, "http://h/1", sleep=lambda s: None)] == [1, 2]
    assert calls == ["http://h/1", "http://h/1", "http://h/2"]
    with pytest.raises(OSError):
        paged.fetch_with_retry(lambda u, p: (404, {}, ""), "u")


def test_operation(tmp_path):
    ran = []

    def stage(name, fail=False):
        def run(root):
            ran.append(name)
            if fail and ran.count(name) == 1:
                raise RuntimeError("stop")
            (root / name).write_text(name)
            return [name]

        return run

    def build():
        op = Operation(tmp_path, "op-1", {"x": 1})
        op.stage("a", stage("a"))
        op.stage("b", stage("b", fail=True), ("a",))
        op.stage("c", stage("c"), ("b",))
        return op

    with pytest.raises(RuntimeError):
        build().execute()
    assert build().execute() == ["b", "c"]
    (tmp_path / "op-1" / "b").write_text("changed")
    assert build().execute() == ["b", "c"]
    assert build().execute() == []
    with pytest.raises(ValueError):
        Operation(tmp_path, "op-1", {"x": 2})
    with pytest.raises(ValueError):
        outside(tmp_path / "s" / "o", tmp_path / "s")


def test_stream(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([(1, "2024-01-01 00:00:10"), (1, "2024-01-01 00:00:20"), (2, "2024-01-01 00:06:00")], "k int, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(source))
    stream = spark.readStream.schema("k int, ts timestamp").parquet(str(source))
    query = append.append_stream(append.once_per_key(stream, ["k"], "ts"), out, str(tmp_path / "cp"), "k").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(out).count() == 2
    counts = append.windowed_counts(spark.read.parquet(str(source)), "ts", "5 minutes", "k")
    assert sorted((r.k, r.n_rows) for r in counts.collect()) == [(1, 2), (2, 1)]
