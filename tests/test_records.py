import json

import pytest
from pyspark.sql import functions as F

from verbatim.operators import records


def test_flat_records(spark):
    line = json.dumps({"source": "s", "dataset": "d", "record_type": "r", "source_id": " 7 ", "payload": {"texto": "", "TextoIntegral": "olá", "metadata": {"pronunciamento": {"UF": "SP", "TipoUsoPalavra": {"Codigo": 3}}}}})
    rows = spark.createDataFrame([(line,), ('{"source": "s"}',)], "line string").withColumn("record", F.expr("try_parse_json(line)"))
    flat = records.flat_records(rows).orderBy(F.col("source_id").desc_nulls_last()).collect()
    assert (flat[0].source_id, flat[0].text, flat[0].text_bytes, flat[0].federative_unit, flat[0].speech_type_code) == ("7", "olá", 4, "SP", "3")
    assert flat[1].text is None and flat[1].text_bytes == 0
    bad = records.contract_violations(records.flat_records(rows)).first()
    assert (bad.n_rows, bad.missing_source, bad.missing_source_id, bad.repeated_keys) == (2, 0, 1, 0)


def test_labels(spark):
    rows = spark.createDataFrame([("Parecer vencedor",), ("Aprovado o parecer do relator, vencido fulano",), ("relatório",), ("despacho",), (None,)], "t string")
    got = [tuple(r) for r in rows.select(records.deliberative_status(F.col("t")), records.label_by_phrases(F.col("t"), records.DOCUMENT_CLASS)).collect()]
    assert got == [("vencedor", "parecer"), ("vencido", "parecer"), ("proposto", "relatorio"), ("indeterminado", None), ("indeterminado", None)]
    assert [r[0] for r in spark.createDataFrame([(" M ",), ("Mulher",), (None,)], "g string").select(records.gender(F.col("g"))).collect()] == ["masculino", "feminino", "nao_informado"]
    cases = [("", "1", "n", None, None), ("d", None, "n", None, "ambiguous"), ("d", "1", "n", "ambiguous", None), ("d", "1", None, None, "ambiguous"), ("d", None, "n", "unmatched", None), ("d", None, None, None, None)]
    df = spark.createDataFrame(cases, "day string, person string, name string, ns string, os string")
    assert [r[0] for r in df.select(records.match_status(*[F.col(c) for c in df.columns])).collect()] == ["missing_date", "ambiguous", "ambiguous", "matched", "unmatched", "name_only"]


def test_periods(spark):
    members = spark.createDataFrame([("a",), ("b",), ("c",)], "member_key string")
    mandates = spark.createDataFrame([("a", "2019-02-01", "2023-01-31"), ("b", "2019-02-01", None)], "member_key string, mandate_start string, mandate_end string")
    parties = spark.createDataFrame([("a", "X", None, "2020-12-31"), ("a", "Y", "2021-01-01", None)], "member_key string, party string, party_start string, party_end string")
    got = sorted((r.member_key, r.party or "", r.valid_from, r.valid_to, r.valid_to_exclusive, r.match_priority) for r in records.validity_periods(members, mandates, parties).collect())
    assert got == [
        ("a", "X", "2019-02-01", "2020-12-31", "2021-01-01", 1), ("a", "Y", "2021-01-01", "2023-01-31", "2023-02-01", 1),
        ("b", "", "2019-02-01", "9999-12-31", "9999-12-31", 50), ("c", "", "0001-01-01", "9999-12-31", "9999-12-31", 99),
    ]
    with pytest.raises(Exception, match="ends before"):
        records.validity_periods(members, spark.createDataFrame([("a", "2023-01-01", "2020-01-01")], "member_key string, mandate_start string, mandate_end string"), parties.limit(0)).collect()
