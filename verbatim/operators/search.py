"""Search over text columns: a small query language, filters, and yearly metrics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_literal, like_escape, phrase_pattern, strip_accents, word_count


@dataclass
class Query:
    """Groups of terms: a row matches if all terms of one group are in it and no excluded one is."""

    groups: list[list[str]] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)


def parse(search: str) -> Query:
    """Blanks join terms, OR (or |) parts groups, quotes hold phrases, a leading - excludes, a backslash takes the next character as it is."""
    tokens, at = [], 0
    while at < len(search):
        if search[at].isspace():
            at += 1
            continue
        minus = search[at] == "-" and at + 1 < len(search) and not search[at + 1].isspace()
        at += minus
        quoted = at < len(search) and search[at] == '"'
        at += quoted
        word = ""
        while at < len(search) and (search[at] != '"' if quoted else not search[at].isspace()):
            if search[at] == "\\" and at + 1 < len(search):
                at += 1
            word += search[at]
            at += 1
        at += quoted
        tokens.append((minus, quoted, " ".join(word.split())))
    query = Query([[]])
    for minus, quoted, word in tokens:
        if not quoted and not minus and word in ("OR", "|"):
            query.groups.append([])
        elif word:
            (query.excluded if minus else query.groups[-1]).append(word)
    query.groups = [g for g in query.groups if g]
    return query


def has_term(folded: Column, term: str) -> Column:
    """The term stands in the folded text as whole words; a cheap test for its words goes first."""
    plain = fold_literal(term)
    cheap = F.lit(True)
    for word in plain.split():
        cheap = cheap & F.contains(F.lower(folded), F.lit(word.lower()))
    return F.when(cheap, folded.rlike(phrase_pattern(plain))).otherwise(False)


def matches(folded: Column, search: str) -> Column:
    """The predicate of a search; one of exclusions alone keeps all other rows, an empty one all rows."""
    query = parse(search)
    hit = F.lit(not query.groups)
    for group in query.groups:
        every = F.lit(True)
        for term in group:
            every = every & has_term(folded, term)
        hit = hit | every
    for term in query.excluded:
        hit = hit & ~has_term(folded, term)
    return hit


def filtered(rows: DataFrame, filters: dict[str, str], year: str = "ano", month: str = "mes") -> tuple[DataFrame, list[str]]:
    """Rows that pass all filters, and the names of filters for which there is no column.

    A year is compared as text, a month with or without a leading zero, anything else as a part of
    the value without regard to case; % and _ in such a value stand for any text.
    """
    ignored = []
    for name, value in filters.items():
        if value in (None, ""):
            continue
        if name not in rows.columns:
            ignored.append(name)
        elif name == year:
            rows = rows.filter(F.col(name).cast("string") == str(value))
        elif name == month:
            rows = rows.filter(F.col(name).cast("string").isin(str(value), str(value).zfill(2)))
        else:
            rows = rows.filter(F.col(name).cast("string").ilike(f"%{value}%"))
    return rows, ignored


def contains_all(rows: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows whose joined columns hold the needle, case aside; nulls count as empty."""
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return rows.filter(F.lower(joined).contains(needle.lower()))


def compact(rows: DataFrame, wanted: list[str], text: str = "texto", fallback: int = 20) -> DataFrame:
    """The wanted columns that exist, never the text; the first ``fallback`` ones where none does."""
    found = [c for c in wanted if c in rows.columns and c != text]
    return rows.select(found or [c for c in rows.columns if c != text][:fallback])


def top(rows: DataFrame, by: str, descending: bool = True, limit: int | None = 100, unsortable: tuple[str, ...] = ("texto", "text")) -> DataFrame:
    if by in unsortable:
        raise ValueError(f"rows can't be ordered by {by}")
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return rows.orderBy(order).limit(max(1, min(1000, 100 if limit is None else limit)))


def point_lookup(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.filter(F.col(key) == value).limit(1)


def options(rows: DataFrame, column: str) -> DataFrame:
    """The column's distinct filled values in order."""
    value = F.col(column).cast("string")
    return rows.select(value.alias("value")).filter((value != "") & value.isNotNull()).distinct().orderBy("value")


def yearly_metrics(rows: DataFrame, search: str, by: str, text: str = "text") -> DataFrame:
    """For each value of ``by``: documents, words, hits, hits per document and per 1000 words; ratios are 0 without documents or words.

    Both aggregates come from one scan. As with a join on equality, rows whose ``by`` is null count no hits.
    """
    hit = matches(F.col("_folded"), search)
    seen = rows.select(by, strip_accents(F.col(text)).alias("_folded"), word_count(F.col(text)).alias("_words"))
    per = seen.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.sum("_words").alias("words"), F.count_if(hit & F.col(by).isNotNull()).alias("hits"))
    share = lambda d, k: F.when(F.col(d) > 0, k * F.col("hits") / F.col(d)).otherwise(0.0)
    return per.withColumn("per_document", share("documents", 1.0)).withColumn("per_1000_words", share("words", 1000.0))


def ilike_any_words(column: Column, term: str) -> Column:
    """All words of the term are somewhere in the column, each taken literally."""
    out = F.lit(True)
    for word in term.split():
        out = out & column.ilike(f"%{like_escape(word)}%")
    return out
