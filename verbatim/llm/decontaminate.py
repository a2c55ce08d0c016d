"""Benchmark items inside training documents, whole or edited.

All word trigrams of the items are seeds, and their places in all documents are found by hash. A seed
at document word p and item word q proposes that the item begins near p - q; the proposal is checked by
Smith-Waterman alignment of the item's words with the document's words around it. An alignment without
three equal words in a row has no seed and isn't found. Of m item words, some left out or replaced, such
a one scores 0.5 + 1 / m at most; with words put in between, up to about 0.75. An item of one or two
words has no trigram; its seed is the item itself, and it is found only in a document of just its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, likely_in
from .textkit import NOT_TERM, chunks, mix, run_hashes, run_starts, split_words, word_hashes

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the score of an exact copy from which an alignment counts.
LEAST_SCORE = 0.5
#: A table of this many bits, as a power of two, tells all tasks which trigrams may be seeds (2 MB whatever their number).
BITS = 24
#: Words of a text that are aligned at once; longer stretches go in parts that overlap by more than any alignment's length.
STRETCH = 1 << 15
#: Alignments made at once, and the most words of text in them together (a longer one is made alone).
TOGETHER, WORDS_TOGETHER = 256, 1 << 17


def whole_short(words: np.ndarray, counts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, seeds) of the rows that have fewer words than a seed, but some: one seed for all words."""
    rows = np.flatnonzero((counts > 0) & (counts < SEED_WORDS))
    return rows, np.array([mix(run_hashes(words[offsets[r] : offsets[r + 1]], int(counts[r])) + counts[r : r + 1].astype(np.uint64))[0] for r in rows.tolist()], np.uint64)


def _items(batches):
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.binary()), ("seeds", pa.list_(pa.struct([("seed", pa.int64()), ("q", pa.int64())])))])
    for batch in batches:
        for c in chunks(batch.column(1), lower=True, apart=NOT_TERM):
            words = word_hashes(c)
            runs, at, upto = run_hashes(words, SEED_WORDS).view(np.int64), run_starts(c.counts, SEED_WORDS), c.word_offsets
            rows = [[{"seed": int(runs[i]), "q": int(i - upto[r])} for i in at[np.searchsorted(at, upto[r]) : np.searchsorted(at, upto[r + 1])]] for r in range(c.rows)]
            for r, seed in zip(*(x.tolist() for x in whole_short(words, c.counts, upto)), strict=True):
                rows[r] = [{"seed": int(np.uint64(seed).view(np.int64)), "q": 0}]
            own = [words[a:b].tobytes() for a, b in zip(upto, upto[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).slice(c.first, c.rows), pa.array(own, pa.binary()), pa.array(rows, schema.types[2])], schema=schema)


def _places(bits):
    def run(batches):
        table = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            ids, ties = batch.column(0).cast(pa.int64()), batch.column(1)
            for c in chunks(batch.column(2), lower=True, apart=NOT_TERM):
                words = word_hashes(c)
                runs, at = run_hashes(words, SEED_WORDS), run_starts(c.counts, SEED_WORDS)
                row = np.repeat(np.arange(c.rows), c.counts)[at] if len(at) else np.zeros(0, np.int64)
                short, own = whole_short(words, c.counts, c.word_offsets)
                seed, row, p = np.append(runs[at], own), np.append(row, short), np.append(at - c.word_offsets[row], np.zeros(len(short), np.int64))
                keep = np.flatnonzero(table[(seed & np.uint64((1 << BITS) - 1)).astype(np.int64)])
                to = pa.array(row[keep] + c.first)
                yield pa.RecordBatch.from_arrays([ids.take(to), ties.take(to), pa.array(seed[keep].view(np.int64)), pa.array(p[keep])], ["doc_id", "tie", "seed", "p"])

    return run


def _table(seeds: DataFrame) -> bytes:
    """A bit for the low BITS of each seed, put together by Spark: 4 KB a row, at most 512 rows."""
    place = F.pmod(F.col("seed"), F.lit(1 << BITS)) + 1
    rows = seeds.select(place.alias("k")).groupBy(F.bitmap_bucket_number("k").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("bits")).collect()
    whole = bytearray(1 << (BITS - 3))
    for r in rows:
        part = bytes(r["bits"])
        whole[(r["bucket"] - 1) * len(part) : r["bucket"] * len(part)] = part
    return bytes(whole)


def align(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each row pair: (score, first text word, word after the last).

    Rows are word hashes; 0 pads them and matches nothing. A cell's best path is found row by row,
    for all pairs at once; of equal scores the one that ends first counts.
    """
    n, m, w = len(items), items.shape[1], texts.shape[1]
    last = np.zeros((n, w + 1), np.int32)
    start = np.tile(np.arange(w + 1, dtype=np.int32), (n, 1))
    best, first, end = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    for i in range(m):
        word = items[:, i]
        step = np.where((texts == word[:, None]) & (word != 0)[:, None], MATCH, MISMATCH).astype(np.int32)
        score, begin = np.zeros_like(last), np.tile(np.arange(w + 1, dtype=np.int32), (n, 1))
        across, above = last[:, :-1] + step, last[:, 1:] + GAP
        score[:, 1:] = np.maximum(0, np.maximum(across, above))
        begin[:, 1:] = np.where(score[:, 1:] == 0, begin[:, 1:], np.where(across >= above, start[:, :-1], start[:, 1:]))
        # Words of the text left out of the item: a running maximum of score + j * -GAP.
        ramp = np.arange(w + 1, dtype=np.int32) * -GAP
        lifted = (score + ramp) * np.int64(w + 1) + (w - np.arange(w + 1))
        top = np.maximum.accumulate(lifted, axis=1)
        source = w - top % (w + 1)
        carried = (top // (w + 1)).astype(np.int32) - ramp
        begin = np.where(carried > score, np.take_along_axis(begin, source, 1), begin)
        score = np.maximum(score, carried)
        column = score.argmax(axis=1)
        high = score[np.arange(n), column]
        better = high > best
        best[better], end[better] = high[better], column[better]
        first[better] = begin[np.arange(n), column][better]
        last, start = score, begin
    return best, first, end


def _check(least_score: float):
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])

    def flush(tasks):
        size = max(len(t[3]) for t in tasks)
        wide = max(len(t[4]) for t in tasks)
        items, texts = np.zeros((len(tasks), size), np.uint64), np.zeros((len(tasks), wide), np.uint64)
        for k, t in enumerate(tasks):
            items[k, : len(t[3])], texts[k, : len(t[4])] = t[3], t[4]
        best, first, end = align(items, texts)
        found: dict[tuple, tuple] = {}
        for k, (doc_id, tie, item_id, item, _, at) in enumerate(tasks):
            row = (best[k] / (MATCH * len(item)), int(at + first[k]), int(at + end[k] - 1))
            key = (doc_id, tie, item_id)
            if row[0] >= least_score and (key not in found or (-row[0], row[1]) < (-found[key][0], found[key][1])):
                found[key] = row
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*k, *v), strict=True)) for k, v in found.items()], schema)

    def run(batches):
        for batch in batches:
            tasks, wide = [], 0
            for doc_id, tie, text, proposals in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                raw = np.where((raw >= 0x41) & (raw <= 0x5A), raw + 32, raw).astype(np.uint8)
                words = word_hashes(split_words(0, raw, np.array([0, len(raw)]), NOT_TERM))
                for p in proposals.as_py():
                    item = np.frombuffer(p["words"], "<u8")
                    # An alignment of the least score has no more words of the text left out of the item.
                    pad = int(np.ceil(MATCH * len(item) * (1 - least_score))) + 1
                    starts = np.sort(np.array(p["starts"]))
                    near = [(max(0, part[0] - pad), min(len(words), part[-1] + len(item) + pad)) for part in np.split(starts, np.flatnonzero(np.diff(starts) > pad) + 1)]
                    reach = len(item) + pad
                    for a, b in ((x, min(to, x + STRETCH + reach)) for since, to in near for x in range(since, max(since + 1, to - reach), STRETCH)):
                        if tasks and (len(tasks) >= TOGETHER or (len(tasks) + 1) * max(wide, b - a) > WORDS_TOGETHER):
                            yield flush(tasks)
                            tasks, wide = [], 0
                        tasks.append((doc_id.as_py(), tie.as_py(), p["item_id"], item, words[a:b], a))
                        wide = max(wide, b - a)
            if tasks:
                yield flush(tasks)

    return run


def find_items(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """doc_id, tie, item_id, score, first_word and last_word: the best alignment of each item found in each document.

    ``docs``: doc_id, text. ``benchmark``: item_id, text. Words are runs of letters, digits and
    non-ASCII characters, A-Z lower-cased. score is the alignment's share of an exact copy's; first_word
    and last_word count from 0. Null and empty texts and items hold nothing; an item of one or two words
    is found in documents of just these words. Very long texts are aligned in overlapping parts. ``tie`` is a hash of the text: rows that repeat both doc_id and text give
    one result, equal items one each; null ids are kept; more columns are left out.
    """
    spark = docs.sparkSession
    items = cut(benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().mapInArrow(_items, "item_id long, words binary, seeds array<struct<seed: long, q: long>>"))
    items = items.filter(F.size("seeds") > 0).withColumn("item", F.xxhash64("item_id", "words"))
    seeds = items.select("item", F.explode("seeds").alias("s")).select("item", "s.seed", "s.q")
    bits = spark.sparkContext.broadcast(_table(seeds))
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    places = rows.mapInArrow(_places(bits), "doc_id long, tie long, seed long, p long")
    hits = places.join(seeds, "seed").groupBy("doc_id", "tie", "item").agg(F.collect_set(F.col("p") - F.col("q")).alias("starts"))
    proposals = hits.join(items.select("item", "item_id", "words"), "item").groupBy("doc_id", "tie").agg(F.collect_list(F.struct("item_id", "words", "starts")).alias("proposals"))
    once = F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy(F.lit(0)))
    proposals = cut(proposals.select(F.col("tie").alias("_tie"), F.col("doc_id").alias("_id"), "proposals"))
    texts = likely_in(rows, "tie", proposals).join(proposals, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
    texts = texts.withColumn("_nth", once).filter("_nth = 1").select("doc_id", "tie", "text", "proposals")
    found = texts.mapInArrow(_check(least_score), "doc_id long, tie long, item_id long, score double, first_word long, last_word long")
    best = F.max(F.struct("score", -F.col("first_word"), -F.col("last_word"))).alias("m")
    return found.groupBy("doc_id", "tie", "item_id").agg(best).select("doc_id", "tie", "item_id", "m.score", (-F.col("m.col2")).alias("first_word"), (-F.col("m.col3")).alias("last_word"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents, all columns kept, in which no item is found."""
    names = docs.columns
    found = find_items(docs, benchmark, least_score).select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).distinct()
    whole = docs.select(F.struct(*names).alias("row"), F.xxhash64("text").alias("_t"), F.col("doc_id").alias("_d"))
    on = F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_tie"))
    return whole.join(found, on, "left_anti").select("row.*")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_items(docs, benchmark).select("doc_id", "item_id", "score", "first_word", "last_word")
