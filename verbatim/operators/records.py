"""Raw envelopes to flat typed rows, and labels by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key
from .intervals import OPEN_END

#: Output columns and the places they come from, first filled place first.
SPEECH_FIELDS = {
    "source": ("source",),
    "dataset": ("dataset",),
    "record_type": ("record_type",),
    "source_id": ("source_id",),
    "checksum": ("checksum",),
    "collected_at": ("collected_at",),
    "coverage_start_date": ("periodo.data_inicio",),
    "coverage_end_date": ("periodo.data_fim",),
    "partition": ("partition",),
    "run_id": ("run_id",),
    "pronouncement_id": ("payload.codigo_pronunciamento", "payload.metadata.pronunciamento.CodigoPronunciamento"),
    "pronouncement_date": ("payload.metadata.pronunciamento.Data",),
    "plenary_session_id": ("payload.metadata.sessao.CodigoSessao",),
    "legislative_session_id": ("payload.metadata.sessao.CodigoSessaoLegislativa",),
    "session_date": ("payload.metadata.sessao.DataSessao",),
    "session_type": ("payload.metadata.sessao.TipoSessao",),
    "author_name": ("payload.metadata.pronunciamento.NomeAutor",),
    "author_type": ("payload.metadata.pronunciamento.TipoAutor",),
    "author_function": ("payload.metadata.pronunciamento.FuncaoAutor",),
    "party": ("payload.metadata.pronunciamento.Partido",),
    "federative_unit": ("payload.metadata.pronunciamento.UF",),
    "speech_type_code": ("payload.metadata.pronunciamento.TipoUsoPalavra.Codigo",),
    "speech_type_description": ("payload.metadata.pronunciamento.TipoUsoPalavra.Descricao",),
    "speech_type_active": ("payload.metadata.pronunciamento.TipoUsoPalavra.IndicadorAtivo",),
    "retrieval_method": ("payload.metodo_obtencao",),
    "text_status": ("payload.texto_status",),
    "text": ("payload.texto", "payload.TextoIntegral"),
}
REQUIRED = ("source", "dataset", "record_type", "source_id")

#: Ordered phrases in folded upper-case text, and the label of the first that is found.
DELIBERATIVE_STATUS = (
    ("vencido", ("VENCID", "PASSOU A CONSTITUIR VOTO EM SEPARADO")),
    ("vencedor", ("PARECER VENCEDOR", "RELATOR DO VENCEDOR")),
    ("aprovado", ("APROVADO O PARECER", "APROVACAO DO PARECER")),
    ("rejeitado", ("REJEICAO DO PARECER", "REJEITADO O PARECER")),
)
DOCUMENT_CLASS = (("voto_em_separado", ("VOTO EM SEPARADO",)), ("relatorio", ("RELATORIO",)), ("parecer", ("PARECER", "COMPLEMENTACAO DE VOTO")))
GENDER = {"masculino": ("m", "masculino", "male", "homem"), "feminino": ("f", "feminino", "female", "mulher")}
NOT_GIVEN = "nao_informado"


def flat_records(records: DataFrame, fields: dict[str, tuple[str, ...]] = SPEECH_FIELDS, record: str = "record", line: str = "line") -> DataFrame:
    """One row a record (VARIANT, with its line): the fields as trimmed strings (null where blank or no scalar), raw_sha256, text_sha256 and text_bytes."""
    at = lambda path: F.nullif(F.trim(F.try_variant_get(F.col(record), f"$.{path}", "string")), F.lit(""))
    flat = records.select(F.sha2(line, 256).alias("raw_sha256"), *[F.coalesce(*[at(p) for p in paths]).alias(name) for name, paths in fields.items()])
    text = F.coalesce(F.col("text"), F.lit(""))
    return flat.withColumn("text_sha256", F.sha2(text, 256)).withColumn("text_bytes", F.octet_length(text).cast("long"))


def contract_violations(rows: DataFrame, required: tuple[str, ...] = REQUIRED, key: str = "source_id") -> DataFrame:
    """One row: missing required values, repeated keys, and rows in all."""
    missing = [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in required]
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), (F.count(key) - F.count_distinct(key)).alias("repeated_keys"), *missing)


def label_by_phrases(text: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], otherwise: str | None = None) -> Column:
    """The first label one of whose phrases is in the text, accents and case aside."""
    folded = name_key(text)
    out = F.lit(otherwise).cast("string")
    for label, phrases in reversed(rules):
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | F.contains(folded, F.lit(phrase))
        out = F.when(hit, label).otherwise(out)
    return out


def deliberative_status(text: Column) -> Column:
    """The decision a step's text names; proposto for other opinions, indeterminado for other steps."""
    proposed = F.when(label_by_phrases(text, DOCUMENT_CLASS).isNotNull(), "proposto").otherwise("indeterminado")
    return F.coalesce(label_by_phrases(text, DELIBERATIVE_STATUS), proposed)


def gender(value: Column) -> Column:
    given = F.lower(F.trim(value.cast("string")))
    out = F.lit(NOT_GIVEN)
    for label, names in GENDER.items():
        out = F.when(given.isin(*names), label).otherwise(out)
    return out


def match_status(day: Column, person: Column, name: Column, name_status: Column, other_status: Column) -> Column:
    """missing_date, ambiguous, matched, or what the name alone gave."""
    no_day = F.coalesce(day.cast("string"), F.lit("")) == ""
    no_person, no_name = (F.coalesce(x.cast("string"), F.lit("")) == "" for x in (person, name))
    unclear = F.coalesce(name_status == "ambiguous", F.lit(False)) | (no_person & F.coalesce(other_status == "ambiguous", F.lit(False)))
    by_name = F.when(no_name, "name_only").otherwise(F.coalesce(F.nullif(name_status, F.lit("")), F.lit("name_only")))
    return F.when(no_day, "missing_date").when(unclear, "ambiguous").when(~no_person, "matched").otherwise(by_name)


def validity_periods(members: DataFrame, mandates: DataFrame, affiliations: DataFrame, key: str = "member_key") -> DataFrame:
    """Members with their mandates' and affiliations' common days: priority 1 where both are known, 50 for a mandate alone, 99 for a member without one.

    mandates: key, mandate_start, mandate_end; affiliations: key, party, party_start, party_end (ISO
    strings; null ends are open). An interval that ends before it starts fails when it runs.
    """
    low, high = F.lit("0001-01-01"), F.lit(OPEN_END)
    m = mandates.select(F.col(key).alias("_m"), F.coalesce("mandate_start", low).alias("_ms"), F.coalesce("mandate_end", high).alias("_me"))
    a = affiliations.select(F.col(key).alias("_a"), F.col("party").alias("_party"), F.coalesce("party_start", low).alias("_ps"), F.coalesce("party_end", high).alias("_pe"))
    joined = members.join(m, F.col(key) == F.col("_m"), "left").join(a, (F.col("_m") == F.col("_a")) & (F.col("_ps") <= F.col("_me")) & (F.col("_pe") >= F.col("_ms")), "left")
    start = F.greatest(F.coalesce("_ms", low), F.coalesce("_ps", low))
    end = F.least(F.coalesce("_me", high), F.coalesce("_pe", high))
    priority = F.when(F.col("_m").isNull(), 99).when(F.col("_a").isNull(), 50).otherwise(1)
    rows = joined.select(*members.columns, F.col("_party").alias("party"), start.alias("valid_from"), end.alias("valid_to"), priority.alias("match_priority"), (priority > 1).alias("inferred"))
    ok = F.assert_true(F.col("valid_from") <= F.col("valid_to"), F.concat(F.lit("an interval ends before it starts: "), F.col(key).cast("string")))
    exclusive = F.when(F.col("valid_to") == OPEN_END, OPEN_END).otherwise(F.date_add(F.col("valid_to").cast("date"), 1).cast("string"))
    return rows.withColumn("_ok", ok).filter("_ok is null").drop("_ok").withColumn("valid_to_exclusive", exclusive)
