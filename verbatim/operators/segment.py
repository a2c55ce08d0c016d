"""Texts cut into addressed parts; offsets are code points, and parts cut whole texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A speaker's header: O SR. or A SRA. (or in full), a name, and a dash.
HEADER = re.compile(r"^[ \t]*(?P<who>[OA]S?\s+(?:SR|SRA|SENHOR|SENHORA)S?\.?\s+(?P<name>[^\n—–-]{2,120}?))\s*(?:[—–]|\s-\s)", re.M | re.I)


def turns(text: str) -> Iterator[tuple[int, int, str | None]]:
    """(start, end, speaker) of the turns; what stands before the first header has no speaker."""
    at, who = 0, None
    for m in HEADER.finditer(text):
        if m.start() > at:
            yield at, m.start(), who
        at, who = m.start(), " ".join(m["name"].split()).rstrip(" .:")
    if at < len(text):
        yield at, len(text), who


def blocks(text: str, most: int) -> Iterator[tuple[int, int, None]]:
    """Parts of at most ``most`` characters that cover every character: lines, cut at a blank in their upper half where too long."""
    start = 0
    while start < len(text):
        line = text.find("\n", start)
        end = len(text) if line < 0 else line + 1
        if end - start > most:
            end = start + most
            blank = max(text.rfind(" ", start + most // 2, end), text.rfind("\t", start + most // 2, end))
            if blank >= 0:
                end = blank + 1
        yield start, end, None
        start = end


def sentences(text: str, most: int) -> Iterator[tuple[int, int, None]]:
    """Trimmed sentences or lines; a longer one is cut like a block."""
    for m in re.finditer(r"[^\n.!?]+(?:[.!?]+(?=\s|$)|[.!?]+|\n|$)*", text):
        part = m[0]
        for a, b, _ in blocks(part, most):
            own = part[a:b]
            left = len(own) - len(own.lstrip())
            if own.strip():
                yield m.start() + a + left, m.start() + a + left + len(own.strip()), None


def _cut(rows: DataFrame, key: str, text: str, how: Callable[[str], Iterator[tuple[int, int, str | None]]]) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            found = [(k, n, a, b, who, t[a:b]) for k, t in zip(pdf[key], pdf[text], strict=True) if t for n, (a, b, who) in enumerate(how(t), 1)]
            yield pd.DataFrame(found, columns=[key, "part", "char_start", "char_end", "speaker", "part_text"])

    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, part int, char_start int, char_end int, speaker string, part_text string")


def speaker_turns(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, part, char_start, char_end, speaker, part_text; the parts of a text joined are the text. Null and empty texts give none."""
    return _cut(rows, key, text, turns)


def text_blocks(rows: DataFrame, key: str, text: str, most: int = 1200) -> DataFrame:
    return _cut(rows, key, text, lambda t: blocks(t, most)).drop("speaker")


def sentence_units(rows: DataFrame, key: str, text: str, most: int = 600) -> DataFrame:
    return _cut(rows, key, text, lambda t: sentences(t, most)).drop("speaker")


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Filled lines with their number, counted from 1 over all lines."""
    split = rows.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))
    return split.select(key, (F.col("n") + 1).alias("line_number"), "line").filter(F.trim("line") != "")


def separator_kind(line: Column) -> Column:
    """stars, parenthesis, heading or null."""
    from ..functions.text import looks_like_heading

    return F.when(line.rlike(r"^\s*(\*\s*){3,}$"), "stars").when(line.rlike(r"^\s*\(.{3,180}\)\s*$"), "parenthesis").when(looks_like_heading(line), "heading")


def separator_summary(rows: DataFrame, key: str, text: str) -> DataFrame:
    """By kind and label: occurrences, distinct texts, and the first place."""
    found = lines(rows, key, text).withColumn("kind", separator_kind(F.col("line"))).filter("kind is not null").withColumn("label", F.upper(F.trim("line")))
    return found.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_texts"), F.min(F.struct(key, "line_number")).alias("first_place"))


def responses(rows: DataFrame, conversation: str, turn: str, role: str, asks: str, answers: str, within: int = 3) -> DataFrame:
    """Each asking turn with the first answering turn among the next few of its conversation (null where none is)."""
    nexts = F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("r"))).over(Window.partitionBy(conversation).orderBy(turn).rowsBetween(1, within))
    first = F.element_at(F.filter(F.col("_next"), lambda x: x["r"] == answers), 1)
    asked = rows.withColumn("_next", nexts).filter(F.col(role) == asks)
    return asked.select(conversation, F.col(turn).alias("turn"), F.when(F.size(F.filter("_next", lambda x: x["r"] == answers)) > 0, first["t"]).alias("response_turn"))


class _Visible(HTMLParser):
    HIDDEN = frozenset(("script", "style", "noscript", "template", "head"))
    BREAKS = frozenset(("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "td", "th", "ul", "ol", "table"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.HIDDEN
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - (tag in self.HIDDEN))
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def visible_text(html: str | None) -> str | None:
    """The text a reader sees: blanks collapsed inside lines, empty lines dropped."""
    if html is None:
        return None
    parser = _Visible()
    parser.feed(html)
    parser.close()
    rows = (" ".join(line.split()) for line in "".join(parser.parts).split("\n"))
    return "\n".join(r for r in rows if r)


def page_texts(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    run = F.pandas_udf(lambda s: s.map(visible_text), "string")
    return pages.withColumn(out, run(F.col(html)))
