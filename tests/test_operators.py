import datetime
import random

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from verbatim.operators import census, dedup, intervals, nested, reconcile, sampling, segment, snapshot, stats
from verbatim.queries import QUERIES


def test_interval_statuses(spark):
    rows = spark.createDataFrame([(1, "a", "2020-01-05"), (2, "a", "2021-01-01"), (3, None, "2020-01-05"), (4, "a", None), (5, "b", "2020-01-05")], "id int, k string, d string")
    spans = spark.createDataFrame([("a", "2020-01-01", "2020-01-05", 1, "x"), ("a", "2020-01-05", "2020-02-01", 1, "y"), ("b", "2020-01-01", "2020-02-01", 0, "z"), ("b", "2020-01-02", "2020-02-01", 2, "w")], "k string, s string, e string, p int, v string")
    got = {r.id: (r.interval_v, r.n_candidates, r.status) for r in intervals.interval_join(rows, spans, ["k"], "id", "d", "s", "e", "p").collect()}
    assert got == {1: ("x", 2, "ambiguous"), 2: (None, 0, "unmatched"), 3: (None, 0, "missing_key"), 4: (None, 0, "missing_date"), 5: ("w", 2, "matched")}
    half = {r.id: r.interval_v for r in intervals.best_candidates(rows, spans, ["k"], "id", "d", "s", "e", "p").collect()}
    assert half == {1: "y", 5: "w"}


def test_nearest_day(spark):
    day = datetime.date
    rows = spark.createDataFrame([(1, day(2020, 1, 10), 7)], "id int, d date, page int")
    issues = spark.createDataFrame([(day(2020, 1, 9), 1, 9, "a"), (day(2020, 1, 11), 1, 9, "b"), (day(2020, 1, 10), 20, 30, "c")], "i date, f int, l int, v string")
    assert [r.v for r in intervals.nearest_day(rows, issues, "id", "d", "i", "page", "f", "l").collect()] == ["a"]


def test_dedup(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (1, "b", "xx"), (2, "c", "y")], "k int, o string, p string")
    assert sorted(r.o for r in dedup.keep_longest(rows, "k", "p", "o").collect()) == ["b", "c"]
    assert dedup.merge_equal(rows.withColumn("p", F.lit("same")), "k", "p").count() == 2
    with pytest.raises(Exception, match="different rows"):
        dedup.merge_equal(rows, "k", "p").collect()
    big = spark.range(100).select(F.lit(1).alias("b"), F.col("id"), F.array(F.lit("w")).alias("w"))
    assert dedup.oversized_blocks(big, ["b"]).count() == 1


def test_reconcile(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (3, "z")], "k int, v string")
    assert sorted(tuple(r) for r in reconcile.merge_sides(a, b, "k", ["v"]).collect()) == [(1, "x"), (2, "y"), (3, "z")]
    assert sorted((r.k, r.problem) for r in reconcile.exact_cover(a, b.union(b), "k").collect()) == [(1, "missing"), (2, "repeated"), (3, "unknown")]
    assert [r.v for r in reconcile.enrich(a, b, "k", ["v"]).orderBy("k").collect()] == ["x", "y"]
    with pytest.raises(Exception, match="right key repeated"):
        reconcile.one_to_one(a, b.union(b), "k").collect()
    source = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "k int, part string")
    raw = spark.createDataFrame([(1, "p"), (2, "q"), (9, "q")], "k int, part string")
    gaps = {r.part: (r.present, r.missing, r.misplaced, r.extra, r.status) for r in reconcile.coverage_gaps(source, raw, "k", "part").collect()}
    assert gaps == {"p": (1, 0, 1, 0, "misplaced"), "q": (0, 1, 0, 1, "incomplete")}
    pair = reconcile.pair_metrics(spark.createDataFrame([("a", "a"), ("a", None), (None, None), ("a", "b")], "l string, r string"), F.col("l"), F.col("r")).first()
    assert (pair.either, pair.both, pair.equal, pair.different, pair.only_left) == (3, 2, 1, 1, 1)


def test_batches(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([4, 4, 30, 1, 1, 1])], "g int, o int, s int")
    got = [r.batch for r in sampling.greedy_batches(rows, ["g"], "o", "s", 2, 10).orderBy("o").collect()]
    assert got == [0, 0, 1, 2, 2, 3]


def test_statistics(spark):
    assert stats.upper_gamma(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-9)
    assert stats.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857)
    table = spark.createDataFrame([("a", "x")] * 30 + [("a", "y")] * 10 + [("b", "x")] * 10 + [("b", "y")] * 30, "r string, c string")
    row = stats.chi_square(table, "r", "c").first()
    assert row.chi2 == pytest.approx(20.0) and row.df == 1 and row.cramers_v == pytest.approx(0.5) and row.p == pytest.approx(7.744e-06, rel=1e-3)
    q = stats.bh_adjust(spark.createDataFrame([(1, 0.01), (2, 0.02), (3, None), (4, 0.9)], "i int, p double").withColumn("f", F.lit(0)), "p", "f", order="i").orderBy("i").collect()
    assert [r.q for r in q] == [pytest.approx(0.03), pytest.approx(0.03), None, pytest.approx(0.9)]
    line = spark.createDataFrame([(1, float(x), 2.0 * x + 1) for x in range(10)], "k int, x double, y double")
    fit = stats.hac_trend(line, "x", "y", "k").first()
    assert fit.slope == pytest.approx(2) and fit.se == pytest.approx(0, abs=1e-6) and fit.lag == 2
    same = spark.createDataFrame([(1, 5), (1, 5), (2, 6)], "a int, b int")
    assert stats.normalised_mutual_information(same, "a", "b").first().nmi == pytest.approx(1)


def test_nested(spark):
    rows = spark.createDataFrame([(1, "g", '{"a": {"b": [1, "x"]}, "c.d": ""}'), (2, "g", '{"a": null}'), (3, "g", "bad"), (4, "g", None)], "id int, g string, j string")
    flat = nested.flatten(rows, "j", "id", "g")
    assert [(r.path, r.type, r.state) for r in flat.filter("id = 1").orderBy("ordinal").collect()] == [
        ("$", "object", "filled"), ("$.a", "object", "filled"), ("$.a.b", "array", "filled"), ("$.a.b[]", "integer", "filled"), ("$.a.b[]", "string", "filled"), ("$.c\\.d", "string", "empty"),
    ]
    assert [r.id for r in nested.rejected(rows, "j").collect()] == [3]
    universe = spark.createDataFrame([("g", 2)], "g string, n_records int")
    profile = {r.path: r for r in nested.field_profile(flat, "id", "g", universe).collect()}
    assert (profile["$.a"].present, profile["$.a"].nulls, profile["$.a"].absent) == (2, 1, 0)
    assert profile["$.a.b[]"].type_conflict and profile["$.a.b"].absent == 1
    assert nested.flatten(rows.limit(0), "j", "id").count() == 0


def test_segments(spark):
    text = "Abertura.\nO SR. JOÃO SILVA — Bom dia. Segue.\nA SRA. ANA – Obrigada!\n"
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, t string")
    turns = segment.speaker_turns(rows, "id", "t").orderBy("part").collect()
    assert "".join(t.part_text for t in turns) == text and [t.speaker for t in turns] == [None, "JOÃO SILVA", "ANA"]
    assert all(text[t.char_start : t.char_end] == t.part_text for t in turns)
    long = "word " * 500
    parts = list(segment.blocks(long, 100))
    assert "".join(long[a:b] for a, b, _ in parts) == long and max(b - a for a, b, _ in parts) <= 100
    assert segment.visible_text("<head><title>x</title></head><p>a&amp;b <script>1</script></p><p> c</p>") == "a&b\nc"
    units = segment.sentence_units(rows, "id", "t", 20).collect()
    assert all(text[u.char_start : u.char_end] == u.part_text == u.part_text.strip() for u in units)


def test_conservation(spark):
    rows = spark.createDataFrame([("2020-01-01",), ("2019-01-01",), (None,), ("2022-01-01",)], "d string")
    inside, where = census.date_cut(rows, "d", "2020-01-01", "2020-12-31")
    total = census.conservation(rows, where).first()
    assert inside.count() == total.within == 1 and total.n_rows == total.within + total.before + total.after + total.invalid == 4


def test_fisher_where_expected_counts_are_small(spark):
    rows = [("x", "u")] * 3 + [("x", "v")] + [("y", "u")] + [("y", "v")] * 3
    table = spark.createDataFrame(rows, "r string, c string")
    assert stats.chi_square(table, "r", "c").first().fisher_p == pytest.approx(34 / 70)
    many = spark.createDataFrame(rows * 20, "r string, c string")
    assert stats.chi_square(many, "r", "c").first().fisher_p is None


def test_scalars_of_records(spark):
    rows = spark.createDataFrame([("sim", "3KiB"), (" ", "4 MiB"), ("maybe", "x"), (None, None), ("0", "12")], "t string, s string")
    value, invalid = snapshot.truth(F.col("t"))
    assert [tuple(r) for r in rows.select(value, invalid, snapshot.byte_size(F.col("s"))).collect()] == [(True, False, 3072), (None, False, 4 << 20), (None, True, None), (None, False, None), (False, False, 12)]
    lists = rows.sparkSession.createDataFrame([('[1, 2]',), ('3',), ('null',), (None,)], "j string").select(F.size(snapshot.as_list(F.parse_json("j"))).alias("n"))
    assert [r.n for r in lists.collect()] == [2, 1, 0, 0]


def test_joins_of_whole_tables(spark):
    """Joins take every event and every order."""
    ids = {t: {r[0] for r in spark.read.parquet(f"{SF_DIR}/{t}.parquet").select(c).collect()} for t, c in (("events", "event_id"), ("orders", "o_orderkey"))}
    for name, t in (("interval_join_inclusive", "events"), ("interval_join_halfopen_ties", "events"), ("unique_bridge", "orders"), ("baseline_changes", "orders")):
        rows = QUERIES[name](spark, SF_DIR)
        assert {r[0] for r in rows.select(rows.columns[0]).collect()} >= ids[t], name
    counts = QUERIES["linked_records"](spark, SF_DIR).first()
    assert counts.matched + counts.ambiguous + counts.only_left >= len(ids["orders"])


@pytest.mark.parametrize("least", [0.3, 0.92])
def test_near_duplicates_in_large_blocks(spark, least):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(60)}" for _ in range(30)] for _ in range(12)]
    rows = [(i, None if i % 3 else "s", sorted({w for w in base[i % 12] if rng.random() < 0.97} | ({f"w{rng.randrange(60)}"} if i % 2 else set()))) for i in range(300)] + [(300, "s", [])]
    want = {}
    for i, b, u in rows:
        for j, c, v in rows:
            both = len({*u} & {*v})
            if i < j and b == c and u and v and least <= both / (len(u) + len(v) - both) < 1:
                want[i, j] = both / (len(u) + len(v) - both)
    docs = spark.createDataFrame(rows, "id long, b string, w array<string>")
    found = dedup.near_duplicates(docs, "id", ["b"], "w", least, most_in_block=None).collect()
    assert want and len(found) == len(want) and {(r.left_key, r.right_key): r.similarity for r in found} == want


def test_kmeans_sweep_takes_every_k(spark):
    assert sorted(r.k for r in QUERIES["kmeans_sweep"](spark, SF_DIR).collect()) == list(range(2, 9))


@pytest.mark.parametrize("tile", [8192, 7])
def test_near_duplicates_move_sets_only(spark, monkeypatch, tile):
    """No rows of single words are joined, so no pairs of sets that share a word are moved; blocks are cut into parts."""
    monkeypatch.setattr(dedup, "TILE", tile)
    words = {i: sorted({f"w{(i * j * j + j) % 23}" for j in range(1 + i % 9)} | {"all"}) for i in range(60)}
    docs = spark.createDataFrame([(i, "b" if i % 3 else "c", w) for i, w in words.items()], "id long, b string, w array<string>")
    found = dedup.near_duplicates(docs, "id", ["b"], "w", 0.5, most_in_block=None)
    near = lambda a, b: len(set(words[a]) & set(words[b])) / len(set(words[a]) | set(words[b]))
    want = {(a, b): near(a, b) for a in words for b in words if a < b and bool(a % 3) == bool(b % 3) and 0.5 <= near(a, b) < 1}
    rows = found.collect()
    assert len(rows) == len(want) and {(r.left_key, r.right_key): r.similarity for r in rows} == want
    assert "_word#" not in found._jdf.queryExecution().optimizedPlan().toString()
