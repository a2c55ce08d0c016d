"""Removal of passages that occur more than once in the corpus.

Each window of ``length`` consecutive words has a Rabin-Karp hash. Windows travel to the task that
counts them in runs: consecutive windows with the same least n-gram hash (their anchor) go together
to the anchor's bucket, so equal windows meet and a run costs one identifier, not one a window. A map
task remembers the hashes that it sent last, in a table of fixed size: one that it meets again is sent
once more, marked, and then no longer, so a passage that a third of all documents share reaches its
bucket about twice for each task, not once for each document. What
is known to be repeated comes back as bit masks over runs, which are or-ed by text, and merge into
maximal intervals of words when the texts are read again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import chunks, mix, run_hashes, run_starts, split_words, word_hashes

LENGTH = 35
ANCHOR_WORDS = 8
RUN = 28
#: Bytes of text whose windows one bucket gets on average.
BUCKET_BYTES = 12 << 20
#: A task remembers two to this many window hashes (18 MB).
MEMORY_BITS = 21
_HEAD = np.dtype([("t1", "<i8"), ("t2", "<i8"), ("start", "<i4"), ("known", "<u4"), ("sent", "<u4"), ("multi", "<u4")])


def anchors(words: np.ndarray, length: int, n: int) -> np.ndarray:
    """For each window the least hash of the ``n``-grams inside it."""
    grams = run_hashes(words, n, 1)
    span = length - n + 1
    least, width = grams, 1
    while width * 2 <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    return np.minimum(least[: len(least) - (span - width)], least[span - width :])


class _Sent:
    """Hashes that a task has sent, and which of them it marked as repeated; a newer one takes an older one's slot."""

    def __init__(self, bits: int = MEMORY_BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.hash, self.used, self.marked = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)

    def meet(self, hashes: np.ndarray, multi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(met before, marked before) of a chunk's different hashes, which are then remembered as sent."""
        slot = (hashes & self.mask).astype(np.int64)
        met = self.used[slot] & (self.hash[slot] == hashes)
        told = met & self.marked[slot]
        self.hash[slot], self.used[slot] = hashes, True
        # Of hashes that share a slot the last one stays; only what is said of that one may stand there.
        self.marked[slot] = False
        stays = self.hash[slot] == hashes
        self.marked[slot[stays]] = (multi | met)[stays]
        return met, told


def _runs(t1: np.ndarray, t2: np.ndarray, c, length: int, buckets: int, sent: _Sent):
    """(buckets, heads, hashes) of the runs of a chunk's texts, hashes cut by the bits sent."""
    same = pd.DataFrame({"a": t1, "b": t2})
    copied = same.duplicated(keep=False).to_numpy()
    keep = ~same.duplicated().to_numpy()
    starts = run_starts(c.counts, length)
    if not len(starts):
        return None
    row_of_word = np.repeat(np.arange(c.rows), c.counts)
    starts = starts[keep[row_of_word[starts]]]
    if not len(starts):
        return None
    words = word_hashes(c)
    hashes = run_hashes(words, length)[starts]
    anchor = anchors(words, length, min(ANCHOR_WORDS, length))[starts]
    row = row_of_word[starts]
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    again = np.zeros(len(ordered), bool)
    again[1:] = ordered[1:] == ordered[:-1]
    first = np.empty(len(ordered), bool)
    first[order] = ~again
    twice = again.copy()
    twice[:-1] |= again[1:]
    multi = np.empty(len(ordered), bool)
    multi[order] = twice
    multi |= copied[row]
    if copied.any():  # an equal window of another text is repeated too
        hot = np.unique(hashes[copied[row]])
        multi |= np.isin(hashes, hot)
    met, told = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    # All windows of one hash must agree on being repeated, so the flags go from the first to the rest.
    any_multi = np.logical_or.reduceat(multi[order], np.flatnonzero(first[order]))
    one_met, one_told = sent.meet(ordered[np.flatnonzero(first[order])], any_multi)
    group = np.cumsum(first[order]) - 1
    met[order], told[order] = one_met[group], one_told[group]
    multi |= met
    first &= ~told
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    since = np.arange(len(starts)) - np.repeat(begin, np.diff(np.append(begin, len(starts))))
    new |= since % RUN == 0
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(starts)))
    bit = (np.uint32(1) << (np.arange(len(starts)) - np.repeat(begin, n)).astype(np.uint32)).astype(np.uint32)
    head = np.zeros(len(begin), _HEAD)
    head["t1"], head["t2"] = t1[row[begin]], t2[row[begin]]
    head["start"] = starts[begin] - c.word_offsets[row[begin]]
    for name, flag in (("known", multi), ("sent", first), ("multi", first & multi)):
        head[name] = np.bitwise_or.reduceat(np.where(flag, bit, np.uint32(0)), begin)
    bucket = (mix(anchor[begin]) % np.uint64(buckets)).astype(np.int64)
    silent = head["sent"] == 0  # nothing to count, so any bucket will do
    bucket[silent] = (mix(head["t1"][silent].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    sizes = np.bitwise_count(head["sent"]).astype(np.int64)
    sent_hashes = hashes[first]
    upto = np.cumsum(sizes)
    n = sizes[by]
    at = np.repeat(upto[by] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return bucket[by], head[by], sent_hashes[at], n


def _send(length: int, buckets: int):
    def run(batches):
        sent = _Sent()
        for batch in batches:
            t1, t2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for c in chunks(batch.column(2)):
                to = slice(c.first, c.first + c.rows)
                found = _runs(t1[to], t2[to], c, length, buckets, sent)
                if found is None:
                    continue
                bucket, head, hashes, n = found
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ends = np.append(cuts[1:], len(bucket))
                upto = np.append(0, np.cumsum(n))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[cuts]),
                        pa.array([head[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                        pa.array([hashes[upto[a] : upto[b]].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                    ],
                    ["bucket", "heads", "hashes"],
                )

    return run


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    head = np.frombuffer(b"".join(pdf["heads"]), _HEAD)
    hashes = np.frombuffer(b"".join(pdf["hashes"]), "<u8")
    bits = np.arange(RUN, dtype=np.uint32)
    n = np.bitwise_count(head["sent"]).astype(np.int64)
    owner = np.repeat(np.arange(len(head)), n)
    sent = (head["sent"][:, None] >> bits) & 1
    bit = np.nonzero(sent)[1].astype(np.uint32)
    marked = ((head["multi"][owner] >> bit) & 1).astype(bool)
    order = np.argsort(hashes)
    ordered, marked = hashes[order], marked[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]
    group = np.cumsum(new) - 1
    count = np.bincount(group)
    repeated = (count > 1) | (np.bincount(group, marked) > 0) if len(count) else np.zeros(0, bool)
    mask = head["known"].copy()
    hit = order[repeated[group]] if len(group) else order
    np.bitwise_or.at(mask, owner[hit], np.uint32(1) << bit[hit])
    some = mask > 0
    return pd.DataFrame({"t1": head["t1"][some], "t2": head["t2"][some], "start": head["start"][some], "mask": mask[some].astype(np.int64)})


def _strip(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def clean(text: bytes, starts, masks) -> tuple[int, int, bytes]:
        c = split_words(0, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        if starts is None:
            return len(c.starts), 0, b" ".join(text.split())
        starts, masks = np.asarray(starts, np.int64), np.asarray(masks, np.int64)
        owner, bit = np.nonzero((masks[:, None] >> np.arange(RUN)) & 1)
        change = np.zeros(len(c.starts) + 1, np.int64)
        np.add.at(change, starts[owner] + bit, 1)
        np.add.at(change, starts[owner] + bit + length, -1)
        kept = np.cumsum(change)[:-1] == 0
        words = [text[a:b] for a, b in zip(c.starts[kept].tolist(), c.ends[kept].tolist(), strict=True)]
        return len(kept), int((~kept).sum()), b" ".join(words)

    def run(batches):
        for batch in batches:
            ids, texts, starts, masks = (batch.column(i) for i in range(4))
            out = [clean((t.as_py() or "").encode(), s.values if s.is_valid else None, m.values if m.is_valid else None) for t, s, m in zip(texts, starts, masks, strict=True)]
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(x, t) for x, t in zip(columns, schema.types[1:], strict=True))], schema=schema)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept (UTF-8 bytes: the kept words joined by one space) of each document.

    A word goes if a window of ``length`` words over it occurs elsewhere in ``docs``, in the same
    document too. Null and empty texts have no words; texts of fewer than ``length`` words stay
    whole; repeated rows remove each other; null doc_ids are kept; more columns are left out.
    """
    if length < 2:
        raise ValueError("a window has two words at least")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"))
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-total // BUCKET_BYTES))
    sent = rows.select("t1", "t2", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_send(length, buckets), "bucket long, heads binary, hashes binary")
    counted = sent.groupBy("bucket").applyInPandas(_count, "t1 long, t2 long, start int, mask long")
    runs = counted.groupBy("t1", "t2", "start").agg(F.bit_or("mask").alias("mask"))
    flags = runs.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "mask")).alias("runs"))
    flags = flags.select("t1", "t2", F.col("runs.start").alias("starts"), F.col("runs.mask").alias("masks"))
    joined = rows.join(flags, ["t1", "t2"], "left").select("doc_id", "text", "starts", "masks")
    return joined.mapInArrow(_strip(length), "doc_id long, n_words long, n_removed long, kept binary")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = remove_repeats(docs)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
