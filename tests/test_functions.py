from pyspark.sql import functions as F

from verbatim.functions import dates, keys, text
from verbatim.operators import search


def values(spark, rows, *columns):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [r[0] if len(columns) == 1 else tuple(r) for r in df.select(*columns).collect()]


def test_folding_and_counts(spark):
    x = F.col("x")
    assert values(spark, ["Ação ÉÑÜ ß ø", None], text.strip_accents(x)) == ["Acao ENU ß ø", ""]
    assert values(spark, ["José d'Ávila-Neto (SP)"], text.name_key(x)) == ["JOSE D AVILA NETO SP"]
    assert values(spark, ["um dois_3 4 çã", "", None], text.word_count(x)) == [3, 0, 0]
    assert values(spark, ["guarda-chuva d'água 12"], text.unicode_word_count(x)) == [2]
    assert values(spark, ["  ", "", " a "], text.blank_to_null(x)) == [None, None, "a"]
    assert values(spark, ["a b a", ""], text.lexical_diversity(x)["ttr"]) == [2 / 3, None]
    assert values(spark, ["ORDEM DO DIA", "Ordem do dia", "ABC"], text.looks_like_heading(x)) == [True, False, False]


def test_excerpts(spark):
    x = F.col("x")
    out = values(spark, ["abcdefghij", "abc"], text.head_tail(x, 6)["excerpt"], text.head_tail(x, 6)["omitted"])
    assert out == [("abghij", 4), ("abc", 0)]
    assert values(spark, ["0123456789"], text.around(x, F.lit(4), F.lit(6), 3)["before"], text.around(x, F.lit(4), F.lit(6), 3)["after"]) == [("123", "678")]
    cut = text.hard_cut(x, {"end": "FIM", "close": "ENCERRA"})
    assert values(spark, ["fala ENCERRA x FIM", "fala"], cut["text"], cut["rule"]) == [("fala", "close"), ("fala", None)]


def test_dates(spark):
    x = F.col("x")
    got = values(spark, ["em 2020-02-03 às", "3/2/2020", "20200203", "2020", "31/02/2020", None], dates.any_date(x).cast("string"))
    assert got == ["2020-02-03", "2020-02-03", "2020-02-03", None, None, None]
    assert values(spark, ["2010", "2010-05-06", "2010-13-01"], dates.strict_date(x).cast("string")) == [None, "2010-05-06", None]
    assert values(spark, ["12.7", "1e3", "x"], dates.bigint_like(x)) == [13, 1000, None]
    assert values(spark, ["2020-01-01T01:00:00Z", "2020-01-01T01:00:00"], dates.calendar_day(x).cast("string")) == ["2019-12-31", "2020-01-01"]
    assert values(spark, ["d 2021-07-01", "-"], dates.year_month(x)["year"], dates.year_month(x)["month"]) == [("2021", "07"), ("0000", "00")]


def test_keys(spark):
    x = F.col("x")
    assert values(spark, ['{"b": 1, "a": [ 2 ]}', "no", None], keys.canonical_json(x)) == ['{"a":[2],"b":1}', None, None]
    assert values(spark, ["1"], keys.rate(F.lit(1), F.lit(3)), keys.rate(F.lit(1), F.lit(0))) == [("0.33333333", "nao_aplicavel")]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    assert keys.content_hash(df).first() == keys.content_hash(df.orderBy(F.desc("i"))).first()
    assert keys.content_hash(df).first() != keys.content_hash(df.filter("i = 1")).first()


def test_query_language():
    q = search.parse('a "b  c" OR -d e\\"f | "OR"')
    assert q.groups == [["a", "b c"], ['e"f'], ["OR"]] and q.excluded == ["d"]
    assert search.parse("").groups == []


def test_search(spark):
    rows = spark.createDataFrame([(1, "O complexo plexo"), (2, "Complexo só"), (3, None), (4, "SOL e ação_x")], "i int, t string")
    find = lambda s: [r[0] for r in rows.filter(search.matches(text.strip_accents(F.col("t")), s)).orderBy("i").collect()]
    assert find("plexo") == [1]
    assert find("-plexo") == [2, 3, 4]
    assert find("so OR plexo") == [1, 2]
    assert find("ação") == []
    assert find("") == [1, 2, 3, 4]
    kept, ignored = search.filtered(rows.withColumn("mes", F.lpad("i", 2, "0")), {"mes": "4", "other": "x", "t": ""})
    assert [r.i for r in kept.collect()] == [4] and ignored == ["other"]
