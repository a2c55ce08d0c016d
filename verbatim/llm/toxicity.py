"""Toxicity by the nearest labelled examples.

Texts are TF-IDF vectors over all words of the examples, and over those beginnings of words that tell
of the label (which catch inflected forms). A term's weight is its frequency in the text times its idf, times how much its
presence among the labelled rows tells of the label: this factor is never 0, so every term has its
postings and every text its neighbours, but prose that all texts share doesn't decide which are near.
Examples stand in an inverted index: a term's postings are example numbers and weights, cut into
blocks of consecutive examples with each block's largest weight. Terms that many examples hold have
no gaps to skip; their postings are full rows, added for many texts at once. A block's largest sum of
these with the largest weights of its other terms bounds every cosine in it; blocks are scored to the
end only while their bound can reach the k-th best cosine, so the neighbours are exact. Their votes are weighted by cosine and calibrated on the examples themselves, each left out
in turn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, learning_sample
from .textkit import NOT_TERM, chunks, mix, span_hashes

#: Labelled rows of either class that are learned from.
EXAMPLES = 2500
NEIGHBOURS = 15
PREFIXES = (4, 5, 6, 7)
BLOCK = 128
#: A term has a full row of postings if at least one example in so many holds it. Texts whose full rows are added at once.
FULL, TEXTS_TOGETHER = 12, 256
#: G statistic up to which a term's association with the label may be chance, and the factor of such terms.
CHANCE, LEAST_FACTOR = 8.0, 0.25
THRESHOLD = 0.7


def row_terms(c) -> tuple[np.ndarray, np.ndarray]:
    """(row, term hash) of every word of the chunk, an even hash, and of its prefixes, odd ones."""
    row = np.repeat(np.arange(c.rows), c.counts)
    bounds, rows = [c.starts, c.ends], [row]
    for n in PREFIXES:
        long = c.ends - c.starts > n
        bounds += [c.starts[long], c.starts[long] + n]
        rows.append(row[long])
    hashes = span_hashes(c, *bounds)
    marks = np.repeat(np.arange(len(rows), dtype=np.uint64), [len(r) for r in rows])
    term = mix(hashes + marks) & ~np.uint64(1)
    term[len(row) :] |= np.uint64(1)
    return np.concatenate(rows), term


def _terms_of_sample(batches):
    for batch in batches:
        for c in chunks(batch.column(0), lower=True, apart=NOT_TERM):
            row, term = row_terms(c)
            order = np.lexsort((term, row))
            row, term = row[order], term[order]
            new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (term[1:] != term[:-1]))) if len(row) else np.zeros(0, np.int64)
            tf = np.diff(np.append(new, len(row))).astype("<u4")
            cuts = np.searchsorted(row[new], np.arange(c.rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).slice(c.first, c.rows),
                    pa.array([term[new[a:b]].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                    pa.array([tf[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                ],
                ["y", "terms", "tf"],
            )


def g_statistic(rows_1: np.ndarray, rows_0: np.ndarray, n_1: int, n_0: int) -> np.ndarray:
    """How far a term's presence departs from independence of the label, over the 2x2 table."""
    total = n_1 + n_0
    g = np.zeros(len(rows_1))
    for seen, size in ((rows_1, n_1), (rows_0, n_0)):
        for part, share in ((seen, (rows_1 + rows_0) / total), (size - seen, 1 - (rows_1 + rows_0) / total)):
            expected = size * share
            with np.errstate(divide="ignore", invalid="ignore"):
                g += np.where(part > 0, 2 * part * np.log(part / expected), 0.0)
    return g


class BlockMaxIndex:
    """Postings of unit vectors by term: full rows of frequent terms, and segments of one block of examples each, with the segment's largest weight."""

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray], n_terms: int):
        self.n = len(terms)
        self.blocks = -(-max(1, self.n) // BLOCK)
        example = np.repeat(np.arange(self.n), [len(t) for t in terms])
        term = np.concatenate([*terms, np.zeros(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([*weights, np.zeros(0)])
        often = np.bincount(term, minlength=n_terms) * FULL >= max(1, self.n)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.full = np.zeros((int(often.sum()), self.blocks * BLOCK))
        own = often[term]
        self.full[self.row[term[own]], example[own]] = weight[own]
        example, term, weight = example[~own], term[~own], weight[~own]
        order = np.lexsort((example, term))
        self.example, self.weight, term = example[order].astype(np.int32), weight[order], term[order]
        block = self.example // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        begin = np.flatnonzero(new)
        self.segment = np.append(begin, len(term))
        self.segment_block = block[begin].astype(np.int32)
        self.segment_most = np.maximum.reduceat(self.weight, begin) if len(begin) else np.zeros(0)
        #: The segments of term t are those from of_term[t] to of_term[t + 1].
        self.of_term = np.searchsorted(term[begin], np.arange(n_terms + 1))

    def begun(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """For each vector (terms, weights) and example the sum over frequent terms."""
        asked = np.zeros((len(vectors), len(self.full)))
        for i, (terms, weights) in enumerate(vectors):
            own = self.row[terms]
            asked[i, own[own >= 0]] = weights[own >= 0]
        return asked @ self.full

    def _postings(self, segments: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, n = self.segment[segments], self.segment[segments + 1] - self.segment[segments]
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.example[at], self.weight[at] * np.repeat(weights, n)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave: int = -1, begun: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the exact k best with a cosine above 0, ties to the smaller number."""
        begun = self.begun([(terms, weights)])[0] if begun is None else begun
        rare = self.row[terms] < 0
        terms, weights = terms[rare], weights[rare]
        n = self.of_term[terms + 1] - self.of_term[terms]
        segments = np.repeat(self.of_term[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        weights = np.repeat(weights, n)
        block = self.segment_block[segments]
        bound = begun.reshape(self.blocks, BLOCK).max(axis=1) + np.bincount(block, self.segment_most[segments] * weights, minlength=self.blocks)
        ranked = np.argsort(-bound, kind="stable")
        found, scores = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 2
        while at < self.blocks and bound[ranked[at]] > 0 and (len(scores) < k or bound[ranked[at]] >= scores[-1] - 1e-9):
            # First a few blocks, for a k-th best cosine; then all whose bound still reaches it, in one go.
            to = min(self.blocks, at + step)
            if len(scores) == k:
                to = max(to, int(np.searchsorted(-bound[ranked], -(scores[-1] - 1e-9), side="right")))
            chosen = np.zeros(self.blocks, bool)
            chosen[ranked[at:to]] = True
            own = chosen[block]
            examples, parts = self._postings(segments[own], weights[own])
            cosine = np.where(np.repeat(chosen, BLOCK), begun, 0.0)
            cosine += np.bincount(examples, parts, minlength=len(cosine))
            new = np.flatnonzero(cosine > 0)
            new = new[new != leave]
            if len(new) > k:
                edge = np.partition(cosine[new], -k)[-k]
                new = new[cosine[new] >= edge - 1e-12]
            found, scores = np.append(found, new), np.append(scores, np.minimum(1.0, cosine[new]))
            order = np.lexsort((found, -scores))[:k]
            found, scores, at = found[order], scores[order], to
        return found, scores


class Model:
    def __init__(self, terms: list[np.ndarray], tf: list[np.ndarray], y: np.ndarray, counts: dict[int, int], k: int = NEIGHBOURS):
        order = np.lexsort((np.array([int(mix(t).sum()) if len(t) else 0 for t in terms], np.uint64), y))
        terms, tf, y = [terms[i] for i in order], [tf[i] for i in order], y[order]
        self.y, self.k = y, k
        n = {c: max(1, int((y == c).sum())) for c in (0, 1)}
        self.weight = np.array([counts.get(c, 0) / n[c] for c in (0, 1)])[y]
        every = np.concatenate([*terms, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        self.vocabulary, code = np.unique(every, return_inverse=True)
        rows_1, rows_0 = (np.bincount(code[y[owner] == c], minlength=len(self.vocabulary)) for c in (1, 0))
        g = g_statistic(rows_1, rows_0, int((y == 1).sum()), int((y == 0).sum()))
        leans = rows_1 / n[1] / np.maximum(1e-12, rows_1 / n[1] + rows_0 / n[0])
        # From LEAST_FACTOR to 1: by how sure the term's association is and how far it leans from half and half.
        sure = np.maximum(0.0, g - CHANCE) / (np.maximum(0.0, g - CHANCE) + CHANCE)
        factor = LEAST_FACTOR + (1 - LEAST_FACTOR) * sure * np.maximum(0.0, 2 * leans - 1) ** 0.5
        keep = (self.vocabulary & np.uint64(1) == 0) | (factor > LEAST_FACTOR)
        self.idf = ((1 + np.log(max(1, len(terms)) / np.maximum(1, rows_1 + rows_0))) * factor)[keep]
        self.vocabulary = self.vocabulary[keep]
        del every, owner, code, rows_1, rows_0, g, leans, sure, factor
        own = [self.vector(t, f) for t, f in zip(terms, tf, strict=True)]
        del terms, tf
        self.index = BlockMaxIndex([a for a, _ in own], [w for _, w in own], len(self.vocabulary))
        #: The share of label 1 among all labelled rows, for texts without any known term.
        self.prior = float((self.weight * y).sum() / self.weight.sum()) if self.weight.sum() else 0.0
        raw = np.array([r for r, *_ in self.all_raw(own, range(len(own)))])
        self._calibrate(raw, y, self.weight)

    def vector(self, terms: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of a text's unit vector over the known terms; ``terms`` ascending."""
        if not len(self.vocabulary) or not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == terms
        at = at[known]
        w = (1 + np.log(tf[known])) * self.idf[at]
        return at, w / np.sqrt((w**2).sum()) if len(at) else w

    def all_raw(self, vectors: list[tuple[np.ndarray, np.ndarray]], leave=None):
        """What raw gives, for each vector."""
        for i in range(0, len(vectors), TEXTS_TOGETHER):
            begun = self.index.begun(vectors[i : i + TEXTS_TOGETHER])
            for j, (at, w) in enumerate(vectors[i : i + TEXTS_TOGETHER]):
                yield self.raw(at, w, -1 if leave is None else leave[i + j], begun[j])

    def raw(self, at: np.ndarray, w: np.ndarray, leave: int = -1, begun: np.ndarray | None = None):
        """(share of the neighbours' votes for label 1, their numbers, their cosines)."""
        if not len(at):
            return self.prior, np.zeros(0, np.int64), np.zeros(0)
        found, cosine = self.index.nearest(at, w, self.k, leave, begun)
        if not len(found):
            return self.prior, found, cosine
        votes = self.weight[found] * cosine
        return float((votes * self.y[found]).sum() / votes.sum()), found, cosine

    def _calibrate(self, raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Shares of label 1 that never fall as the raw score rises (pooled neighbours), between sorted raw scores."""
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []
        for r, v, w in zip(raw[order], y[order], weight[order], strict=True):
            pools.append([v * w, w, r * w])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.steps = np.array([(r / w, v / w) for v, w, r in pools if w]) if pools else np.array([[0.0, 0.0], [1.0, 1.0]])

    def score(self, raw: float) -> float:
        return float(np.clip(np.interp(raw, self.steps[:, 0], self.steps[:, 1]), 0, 1))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES) -> Model:
    sample, counts = learning_sample(docs, labels, label, examples)
    table = sample.mapInArrow(_terms_of_sample, "y int, terms binary, tf binary").toArrow()
    terms, tf = ([np.frombuffer(x.as_buffer(), of) for x in table.column(name)] for name, of in (("terms", "<u8"), ("tf", "<u4")))
    return Model(terms, tf, table.column("y").to_numpy().astype(np.int64), counts)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and evidence (numbers, cosines and labels of the neighbours) of each document.

    Every whole text is read; null and empty texts, and texts without any term of an example, get the
    calibrated share of label 1 and no evidence. Null and repeated doc_ids are kept; equal texts get
    equal scores; more columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for c in chunks(batch.column(1), lower=True, apart=NOT_TERM):
                row, term = row_terms(c)
                order = np.argsort(row, kind="stable")
                term, cuts = term[order], np.searchsorted(row[order], np.arange(c.rows + 1))
                scores, examples, cosines, size = [], [], [], []
                vectors = [m.vector(*np.unique(term[a:b], return_counts=True)) for a, b in zip(cuts, cuts[1:], strict=False)]
                for raw, found, cosine in m.all_raw(vectors):
                    scores.append(m.score(raw))
                    examples.append(found)
                    cosines.append(cosine)
                    size.append(len(found))
                found = np.concatenate([*examples, np.zeros(0, np.int64)]).astype(np.int64)
                cosine = np.concatenate([*cosines, np.zeros(0)])
                evidence = pa.StructArray.from_arrays([pa.array(found), pa.array(cosine), pa.array(m.y[found].astype(np.int64))], ["example", "cosine", "label"])
                ends = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).slice(c.first, c.rows), pa.array(scores, pa.float64()), pa.ListArray.from_arrays(ends, evidence)], ["doc_id", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, evidence array<struct<example: long, cosine: double, label: long>>")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
