import datetime

from pyspark.sql import functions as F

from verbatim.operators import linking


def test_speakers(spark):
    mentions = spark.createDataFrame([("t", 1, "João Silva"), ("t", 2, "Maria"), ("t", 3, "Souza"), ("t", 4, "Zé"), ("u", 5, "João Silva")], "text string, id int, name string")
    people = spark.createDataFrame([("t", "p1", "JOAO SILVA"), ("t", "p2", "Maria da Penha"), ("t", "p3", "Ana Souza"), ("t", "p4", "Rui Souza"), ("t", "p5", "João Silva Neto")], "text string, person string, full string")
    got = {r.id: (r.person, r.how) for r in linking.speaker_assignment(mentions, people, "text", "id", "name", "person", "full").collect()}
    assert got == {1: ("p1", "exact"), 2: ("p2", "compatible"), 3: (None, "ambiguous"), 4: (None, "absent"), 5: (None, "absent")}


def test_requests(spark):
    rows = spark.createDataFrame([("g", i) for i in range(5)], "g string, i int")
    chunks = linking.request_chunks(rows, "g", "i", 2)
    assert sorted(r.custom_id for r in chunks.select("custom_id").distinct().collect()) == ["req-g-0000", "req-g-0001", "req-g-0002"]
    answers = spark.createDataFrame([("req-g-0000", '{"a": 1}'), ("req-g-0001", "bad"), ("x", '{"a": 2}')], "custom_id string, body string")
    good, bad = linking.parsed_responses(chunks, answers, "a int")
    assert [(r.custom_id, r.parsed.a) for r in good.collect()] == [("req-g-0000", 1)]
    assert sorted(tuple(r) for r in bad.collect()) == [("req-g-0001", "invalid"), ("req-g-0002", "missing"), ("x", "unknown")]
    merged, problems = linking.merge_attempts([rows.limit(1), rows.limit(1)], rows.limit(1), "i")
    assert merged.count() == 2 and problems.first().problem == "repeated"


def test_look_back(spark):
    steps = spark.createDataFrame([("c", 1, "op", "x"), ("c", 2, "op", "y"), ("c", 3, "lost", None), ("c", 4, "lost", None), ("d", 1, "lost", None)], "c string, o int, kind string, who string")
    out = linking.look_back(steps, "c", "o", F.col("kind") == "lost", F.col("kind") == "op", F.col("who") == "x")
    assert sorted((r.c, r.o) for r in out.filter("marked").collect()) == [("c", 1), ("c", 2)]


def test_windows(spark):
    day = datetime.date
    found = spark.createDataFrame([("year", day(2020, 1, 1), 5), ("year", day(2021, 1, 1), 0), ("quarter", day(2020, 4, 1), 0), ("month", day(2020, 1, 1), 0)], "unit string, period_start date, n int")
    got = [r.window_start.month for r in linking.adaptive_windows(found, "2020-01-01", "2021-12-31").orderBy("window_start").collect()]
    assert got == [2, 3, 7, 8, 9, 10, 11, 12]
