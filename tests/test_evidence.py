"""Nulls, ties, empty tables and thresholds of the evidence operators."""

import datetime
import gzip
import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from verbatim.functions import text
from verbatim.operators import evidence, nested, stats
from verbatim.sources import readers, writers


def told(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows.collect()), key=str)


def test_cost_needs_one_whole_price(spark):
    prices = "k string, input_price double, cached_price double, output_price double, discount double"
    usage = spark.createDataFrame([("a", 10, 4, 2), ("a", 3, 5, None)], "k string, input long, cached long, output long")
    one = spark.createDataFrame([("a", 1e6, None, 2e6, 0.5)], prices)
    assert told(evidence.usage_cost(usage, one, "k"), "cost") == [(2.5,), (7.0,)]
    for wrong in ([("b", 1.0, 1.0, 1.0, 0.0)], [("a", 1.0, 1.0, 1.0, 0.0)] * 2, [("a", None, 1.0, 1.0, 0.0)]):
        with pytest.raises(Exception, match="not one whole price for a"):
            evidence.usage_cost(usage, spark.createDataFrame(wrong, prices), "k").collect()


def test_destination_and_markers(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 3), (3, "z", 4)], "id int, h string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", 9), (4, "q", 1)], "id int, h string, n int")
    assert told(evidence.verified_destination(a, b, "id", ["h", "n"]), "id", "status") == [(1, "equal"), (2, "different"), (3, "missing"), (4, "surprise")]
    assert (3, "pending") in told(evidence.verified_destination(a, b, "id", ["h", "n"], complete=False), "id", "status")
    marks = spark.createDataFrame([(1, "="), (2, None), (3, "="), (3, "="), (9, "=")], "id int, mark string")
    asked = spark.createDataFrame([(1,), (2,), (3,), (5,)], "id int")
    assert told(evidence.marker_status(asked, marks, "id", "mark", ["="]), "id", "status") == [(1, "ok"), (2, "rejected"), (3, "repeated"), (5, "absent"), (9, "unexpected")]


def test_copy_plan_collisions(spark):
    rows = spark.createDataFrame([("a/1",), ("b/1",), ("c/2",), ("d/3",), ("d/3",), ("e/2",), (None,)], "p string")
    plan = evidence.copy_plan(rows, "p", F.split("p", "/")[1], ["e/2"])
    assert told(plan, "source", "action") == [("a/1", "destination_collision"), ("b/1", "destination_collision"), ("c/2", "copy"), ("d/3", "source_collision"), ("d/3", "source_collision"), ("e/2", "excluded"), (None, "excluded")]


def test_quality_without_denominators(spark):
    bridge = spark.createDataFrame([], "k int, t int, s string")
    gold = spark.createDataFrame([(1, 2)], "k int, t int")
    row = evidence.authorized(evidence.bridge_quality(bridge, gold, "k", "t", "s")).first()
    assert (row.n, row.linked, row.coverage, row.n_gold, row.precision, row.authorized) == (0, 0, None, 0, None, False)
    bridge = spark.createDataFrame([(1, 2, "matched"), (2, None, "matched"), (3, 1, None)], "k int, t int, s string")
    row = evidence.bridge_quality(bridge, spark.createDataFrame([(1, 2), (2, 5)], "k int, t int"), "k", "t", "s").first()
    assert (row.linked, row.n_gold, row.precision) == (2, 2, 0.5)


@pytest.mark.parametrize(("rows", "opens"), [([("a", True, True)] * 3, True), ([("a", True, True), ("a", None, True)], False), ([("b", True, True)] * 3, False), ([("a", True, True), ("a", False, False)], True), ([], False)])
def test_review_gate(spark, rows, opens):
    reviews = spark.createDataFrame(rows, "c string, v boolean, done boolean")
    assert evidence.review_gates(reviews, F.col("v"), F.col("done"), "c", ["a"], 1, 0.9).first().opens is opens


@pytest.mark.parametrize(("conflicts", "others", "most", "want"), [(10, 10, 4, (2, 2)), (1, 10, 4, (1, 3)), (10, 1, 5, (4, 1)), (0, 2, 5, (0, 2)), (3, 0, 2, (2, 0)), (5, 5, 3, (2, 1))])
def test_conflicts_come_first(spark, conflicts, others, most, want):
    rows = spark.createDataFrame([("g", i, i < conflicts) for i in range(conflicts + others)], "g string, i int, c boolean")
    got = [r.conflict for r in evidence.conflicts_first(rows, "g", F.col("c"), ["i"], most).collect()]
    assert (sum(got), len(got) - sum(got)) == want


def test_terms_meet_their_spans(spark):
    days = [(datetime.date(2011, 1, 31), datetime.date(2011, 2, 1)), (datetime.date(2015, 1, 31), datetime.date(2015, 1, 31)), (datetime.date(2000, 5, 5), datetime.date(1999, 1, 1)), (None, datetime.date(2000, 1, 1)), (datetime.date(1790, 1, 1), datetime.date(1803, 2, 1))]
    rows = spark.createDataFrame(days, "a date, b date").select("a", "b", evidence.terms_in(F.col("a"), F.col("b")).alias("t")).collect()
    for r in rows:
        if r.a is None:
            assert r.t is None
        else:
            assert r.t == ([n for n in range(1, 100) if evidence.term_span(n)[0] <= r.b and evidence.term_span(n)[1] >= r.a] if r.a <= r.b else [])


def test_scalars_of_nulls(spark):
    kind = F.lit("object")
    row = spark.range(1).select(
        evidence.preview(F.lit(" a \n b ")).alias("a"), evidence.preview(F.lit("x" * 501)).alias("b"), evidence.preview(F.lit(None).cast("string")).alias("c"),
        evidence.declared_type(kind, F.lit(" ")).alias("d"), evidence.declared_type(kind, F.lit(" q ")).alias("e"), evidence.declared_type(F.lit("array"), F.lit("q")).alias("f"),
        evidence.composite_key(F.lit(" x "), F.lit(None)).alias("g"), evidence.archive_action(F.lit("A/RAW/x"), F.lit(None)).alias("h"), evidence.archive_action(F.lit(None).cast("string"), F.lit(None)).alias("i"),
    ).first()
    assert tuple(row) == ("a b", "x" * 497 + "...", None, "__missing__", "q", "__array__", "x|", "preserve", "archive_candidate")


def test_counts_with_nulls(spark):
    rows = spark.createDataFrame([("g", 1, True), ("g", 1, None), ("g", None, True), ("g", 2, False), (None, 3, True)], "g string, u int, t boolean")
    got = evidence.media_coverage(rows, "g", "u", F.col("t"), F.lit(None).cast("boolean"))
    assert told(got, "g", "occurrences", "units", "with_text", "with_media", "text_rate") == [("g", 4, 2, 1, 0, 0.5), (None, 1, 1, 1, 0, 1.0)]
    cells = evidence.layer_months(spark.createDataFrame([("g", "l", datetime.date(2020, 1, 31)), (None, "l", None)], "g string, l string, d date"), "g", "l", F.col("d"), "2020-01-31", "2020-03-01", ["l", "m"])
    assert cells.count() == 12 and cells.agg(F.sum("n_rows")).first()[0] == 1
    assert evidence.known_ids(rows.select("u"), rows.select("g")).count() == 4


def test_values_under_a_key(spark):
    rows = spark.createDataFrame([(1, '{"k": [1, {"k": "x"}, null, [2]], "a.k": 5, "b": {"k": null}}'), (2, "no"), (3, None), (4, '{"k": []}'), (5, '{"q": {"k": {"z": 1}}}')], "id int, j string")
    assert told(nested.under_key(rows, "j", "k", "id"), "id", "value") == sorted([(1, "1"), (1, '{"k":"x"}'), (1, "x"), (1, "[2]"), (5, '{"z":1}')], key=str)
    assert told(nested.under_key(rows, "j", "a.k", "id"), "id", "value") == [(1, "5")]


def test_deep_text(spark):
    rows = spark.createDataFrame([(1, '{"b": [{"Text": " two "}, {"text": ["three", " "]}], "a": {"text": "one"}, "text": 4}'), (2, "{}"), (3, None)], "id int, j string")
    assert told(nested.deep_text(rows, "j", ["text"], "id"), "id", "text") == [(1, "one\n\ntwo\n\nthree")]


def test_paired_jaccard(spark):
    rows = [(f"c{i % 40}", ["x", "y"], ["x", "y"] if i % 4 else ["x"], ["x"] if i % 2 else None) for i in range(400)]
    frame = spark.createDataFrame([*rows, (None, None, None, None)], "c string, t array<string>, a array<string>, b array<string>")
    got = stats.paired_jaccard_bootstrap(frame, "c", "t", "a", "b", 300).first()
    jaccard = lambda x, y: len(set(x or ()) & set(y or ())) / len(set(x or ()) | set(y or ())) if x or y else 1.0
    assert got.difference == pytest.approx(sum(jaccard(t, a) - jaccard(t, b) for _, t, a, b in rows) / 401)
    assert got.n_clusters == 41 and got.low < got.difference < got.high and got.p_not_above == 0
    assert stats.paired_jaccard_bootstrap(frame.limit(0), "c", "t", "a", "b", 10).first().n_clusters == 0


def test_compatible_hashes(spark):
    texts = ["Straße  ﬁne", "STRASSE FINE", "ＷＩＤＥ\u3000x", None, "", " \n "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.compatible_hash(F.col("t")).alias("h"))
    want = [hashlib.sha256(" ".join(unicodedata.normalize("NFKC", t or "").casefold().split()).encode()).hexdigest() for t in texts]
    assert [r.h for r in rows.orderBy("i").collect()] == want and want[0] == want[1] and want[3] == want[4] == want[5]


def test_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 3_000_000)
    first = writers.steady_gzip(f"{tmp_path}/a", f"{tmp_path}/a.gz")
    assert first == writers.steady_gzip(f"{tmp_path}/a", f"{tmp_path}/b.gz") and gzip.open(f"{tmp_path}/a.gz").read() == b"x" * 3_000_000
    with pytest.raises(FileExistsError):
        writers.steady_gzip(f"{tmp_path}/a", f"{tmp_path}/a.gz")
    files = spark.createDataFrame([("a", b"PAR1..PAR1", 10), ("b", b"PAR1", 4), ("c", b"....PAR1", 8), ("d", b"PAR1....", 8), ("e", b"PAR1PAR1", 9), ("f", None, 0)], "path string, content binary, n int")
    assert told(readers.parquet_marks(files, "n"), "path", "status") == [("a", "ok"), ("b", "short"), ("c", "no_header"), ("d", "no_footer"), ("e", "wrong_size"), ("f", "short")]
