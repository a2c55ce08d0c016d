"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is a vector of what its words are (signed sums of hashed
words and of hashed word beginnings) and of their shape (kinds of characters, lengths, repetition),
encoded by a hidden layer; gated attention weighs the passages, and the
weighted mean of their codes gives the score. Only documents are labelled: which passages matter is
learned. Training is Adam in numpy on a bounded sample of labelled documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, learning_sample
from .textkit import chunks, mix, span_hashes, word_hashes

#: Labelled rows of either class that are learned from.
EXAMPLES = 2500
PASSAGE_WORDS = 64
HIDDEN, GATES = 16, 12
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.01, 1e-4
THRESHOLD = 0.5
_KIND = np.zeros(256, np.uint8)  # 0: control and others
_KIND[0x61:0x7B] = 1
_KIND[0x41:0x5B] = 2
_KIND[0x30:0x3A] = 3
_KIND[0x80:] = 4
_KIND[[ord(x) for x in ".,;:'\"()?-"]] = 5
_KIND[[ord(x) for x in "#$%&*+=<>@^_~{}[]\\/"]] = 6
_KIND[ord("|")] = 7
_KIND[ord("!")] = 8
_KINDS = 9
SHAPE = _KINDS + 9
#: Places for hashed words, and as many for hashed beginnings of words.
HASHED, BEGINNING = 32, 3
HASHED_SCALE = 6.0
FEATURES = SHAPE + 2 * HASHED


def passages(c) -> tuple[np.ndarray, np.ndarray]:
    """(passages of each row, features): every word of every row is in one passage; a row without words has one of zeros."""
    n = np.maximum(1, -(-c.counts // PASSAGE_WORDS))
    total = int(n.sum())
    x = np.zeros((total, FEATURES))
    if not len(c.starts):
        return n, x
    base = np.append(0, np.cumsum(n))[:-1]
    row = np.repeat(np.arange(c.rows), c.counts)
    of_word = base[row] + (np.arange(len(row)) - c.word_offsets[row]) // PASSAGE_WORDS
    first = np.flatnonzero(np.append(True, of_word[1:] != of_word[:-1]))
    at = of_word[first]
    last = np.append(first[1:], len(of_word)) - 1
    words = (last - first + 1).astype(float)
    kind = _KIND[c.data]
    size = np.maximum(1, c.ends[last] - c.starts[first])
    for k in range(_KINDS):
        upto = np.append(0, np.cumsum(kind == k, dtype=np.int64))
        x[at, k] = (upto[c.ends[last]] - upto[c.starts[first]]) / size
        if k == 2:
            caps = upto[c.ends] - upto[c.starts]
    length = (c.ends - c.starts).astype(float)
    mean = lambda v: np.add.reduceat(v.astype(float), first) / words
    x[at, _KINDS] = mean(length) / 10
    x[at, _KINDS + 1] = np.sqrt(np.maximum(0, mean(length**2) - mean(length) ** 2)) / 10
    h = word_hashes(c)
    same = np.append(False, (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1]))
    x[at, _KINDS + 2] = mean(same)
    key = np.sort(mix(h + of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    again = np.append(False, key[1:] == key[:-1])
    if again.any():
        ranks = mix(h + of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        twice = np.isin(ranks, np.unique(key[again]))
        x[at, _KINDS + 3] = mean(twice)
    x[at, _KINDS + 4] = mean(caps >= np.maximum(2, length - 3))
    x[at, _KINDS + 5] = mean(_KIND[c.data[c.ends - 1]] >= 6)
    x[at, _KINDS + 6] = mean(length == 1)
    x[at, _KINDS + 7] = mean(length > 20)
    x[at, _KINDS + 8] = np.log1p(words) / 4
    for part, of in enumerate((h, span_hashes(c, c.starts, np.minimum(c.ends, c.starts + BEGINNING)))):
        sign = 1.0 - 2.0 * ((of >> np.uint64(40)) & np.uint64(1)).astype(float)
        sums = np.bincount(of_word * HASHED + (of % np.uint64(HASHED)).astype(np.int64), sign, minlength=total * HASHED).reshape(total, HASHED)
        x[at, SHAPE + part * HASHED : SHAPE + (part + 1) * HASHED] = sums[at] / words[:, None]
    return n, x


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * v) + 1)


class AttentionModel:
    def __init__(self, features: int = FEATURES, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.mean, self.scale = np.zeros(features), np.ones(features)
        self.p = {"w": draw(features, HIDDEN), "b": np.zeros(HIDDEN), "v": draw(HIDDEN, GATES), "u": draw(HIDDEN, GATES), "a": draw(GATES, 1)[:, 0], "o": draw(HIDDEN, 1)[:, 0], "c": np.zeros(1)}

    def forward(self, x: np.ndarray, n: np.ndarray):
        """(scores' logits, attention, what backward needs) of bags with n passages each."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["w"] + p["b"])
        tv, su = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (tv * su) @ p["a"]
        begin = np.append(0, np.cumsum(n))[:-1]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), n))
        attention = e / np.repeat(np.add.reduceat(e, begin), n)
        z = np.add.reduceat(attention[:, None] * h, begin)
        return z @ p["o"] + p["c"][0], attention, (x, h, tv, su, z, begin)

    def gradient(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        logit, attention, (x, h, tv, su, z, begin) = self.forward(x, n)
        d = weight * (_sigmoid(logit) - y) / len(y)
        dz = np.repeat(d[:, None] * p["o"], n, axis=0)
        da = (dz * h).sum(1)
        de = attention * (da - np.repeat(np.add.reduceat(attention * da, begin), n))
        gate = de[:, None] * p["a"]
        dv, du = gate * su * (1 - tv**2), gate * tv * su * (1 - su)
        dh = attention[:, None] * dz + dv @ p["v"].T + du @ p["u"].T
        dx = dh * (1 - h**2)
        return {"w": x.T @ dx, "b": dx.sum(0), "v": h.T @ dv, "u": h.T @ du, "a": (tv * su).T @ de, "o": z.T @ d, "c": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 5) -> AttentionModel:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 0.02
        # Each hashed place says little alone and there are many; unscaled they would be learned by heart.
        self.scale[SHAPE:] *= HASHED_SCALE
        rng, step = np.random.default_rng(seed), 0
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for epoch in range(EPOCHS):
            rate = RATE * (0.5 + 0.5 * np.cos(np.pi * epoch / EPOCHS))
            order = rng.permutation(len(bags))
            for at in (order[i : i + BATCH] for i in range(0, len(order), BATCH)):
                step += 1
                g = self.gradient(np.concatenate([bags[i] for i in at]), np.array([len(bags[i]) for i in at]), y[at], weight[at])
                for k, v in self.p.items():
                    m[k] += 0.1 * (g[k] - m[k])
                    s[k] += 0.001 * (g[k] ** 2 - s[k])
                    v -= rate * (m[k] / (1 - 0.9**step) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8) + DECAY * v)
        return self


def _bags(batches):
    for batch in batches:
        for c in chunks(batch.column(0)):
            n, x = passages(c)
            at = np.append(0, np.cumsum(n))
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(c.first, c.rows), pa.array([x[a:b].astype("<f4").tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["y", "bag"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", examples: int = EXAMPLES) -> AttentionModel | None:
    """A model of the labels, or None where no row is labelled."""
    sample, counts = learning_sample(docs, labels, label, examples)
    rows = sorted(sample.mapInArrow(_bags, "y int, bag binary").collect(), key=lambda r: (r["y"], bytes(r["bag"])))
    if not rows:
        return None
    y = np.array([r["y"] for r in rows], float)
    n = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.where(y == 1, counts.get(1, 0) / n[1], counts.get(0, 0) / n[0])
    return AttentionModel().fit([np.frombuffer(r["bag"], "<f4").reshape(-1, FEATURES).astype(float) for r in rows], y, weight / weight.mean())


def score_quality(docs: DataFrame, model: AttentionModel | None) -> DataFrame:
    """doc_id, score, and the passage (number from 0, and its attention) that weighs most, of each document.

    Every whole text is read. Null and empty texts are one passage of zeros; without a model the
    score is 0.5. Null and repeated doc_ids are kept; equal texts get equal scores; more columns are
    left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for c in chunks(batch.column(1)):
                n, x = passages(c)
                if m is None:
                    score, top, most = np.full(c.rows, 0.5), np.zeros(c.rows, np.int64), 1 / n
                else:
                    # Rounded as in training, so that a text scores alike in any chunk.
                    logit, attention, (*_, begin) = m.forward(x.astype("<f4").astype(float), n)
                    score, most = np.round(_sigmoid(logit), 9), np.maximum.reduceat(attention, begin)
                    ids = np.arange(len(x)) - np.repeat(begin, n)
                    top = np.minimum.reduceat(np.where(attention == np.repeat(most, n), ids, len(x)), begin)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).slice(c.first, c.rows), pa.array(score), pa.array(top), pa.array(most)], ["doc_id", "score", "passage", "attention"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, passage long, attention double")


def keep_good(docs: DataFrame, model: AttentionModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose score reaches the threshold; without a model all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            for c in chunks(batch.column(text)):
                n, x = passages(c)
                score = np.round(_sigmoid(m.forward(x.astype("<f4").astype(float), n)[0]), 9) if m else np.ones(c.rows)
                yield batch.slice(c.first, c.rows).filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
