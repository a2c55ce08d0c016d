"""Similarity join of documents by the Jaccard measure of their word n-grams, over parity sketches.

A document's n-grams are hashed to the bits of a long sketch, and each bit is the parity of the
n-grams on it, so two sketches differ in no more bits than the sets have n-grams in their symmetric
difference. Two sets of at most b n-grams with Jaccard measure t differ in at most
2b(1 - t)/(1 + t); with more sketch pieces than that, one piece at least is equal in both. Sizes are
cut into bands of ratio 1/t, so linked sets lie in one band or in two next to each other; each set
keys its pieces for its own band and for the next one. Most sets leave few pieces empty; an empty
piece gets a key only in a set that has more of them than there are pieces beyond the difference,
for only two such sets can be linked without an equal piece that holds something.

There are some pieces more than that, so linked sets agree in several: a pair from the groups of
equal keys is kept if its equal pieces, counted over all groups, are as many as the two sets' own
empty pieces leave certain, and it is verified exactly. Groups of more than PAIRED members, whose
pairs would grow with their square, go another way. A pair whose counted pieces fall short of what is
certain has the others in large groups; a set whose large groups, with the most pieces that it shares
with any one set in small groups, are fewer than what is certain has no such pair and leaves them. The
sets that stay, the crowd, are each verified against one hub of their groups, and what is linked becomes
one component. Then they are grouped anew, by n-grams: sets linked with one of n members share at least
n * t, so with all n-grams in one order, the same for all sets, the first n-gram that two linked sets
share is among the first n - n * t + 1 of either. The order puts first what few of the crowd hold, so a
passage that many sets hold makes no group as long as it fills less than the share t of them. In a
group whose members are not all of one component, each is verified against the hub (the member that is
in most groups); then only the members outside the hub's component are compared with their group, in
blocks, by Hamming distance of their whole sketches, and verified. No link is lost on any way.

Before n-grams are moved to verify pairs, the pairs' whole sketches are compared; they differ in no more
bits than the sets in n-grams, so no link is lost. Of what is left one pair a set is verified, and then
only pairs whose sets no verified link connects yet.

A key that a map task meets in more than PAIRED sets of one run of texts reaches its bucket once,
marked; its members go on beside the bucket, so a piece that a third of all sets share doesn't land
in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import cut, drop, likely_in
from .textkit import chunks, mix, run_hashes, word_hashes

WORDS, NEED, OF = 4, 85, 100
#: Bits of one sketch piece; the fingerprint of a piece is the xor of its odd bits' numbers, mixed.
PIECE_BITS = 1 << 20
#: Bytes of keys that one bucket gets on average, and bytes of text a word takes.
BUCKET_BYTES, WORD_BYTES = 6 << 20, 6
#: Members compared at once, and pairs counted at once.
BLOCK, PAIRS_TOGETHER = 512, 1 << 19
#: Members up to which a group's pairs are counted one by one.
PAIRED = 32
#: Rounds in which a large group's members are verified against a hub before all that are still apart are compared.
ROUNDS = 1
#: Cells in which the crowd's n-grams are counted; two of one cell only stand at like places in the order. And cells that one row counts.
CELLS, CELLS_TOGETHER = 1 << 22, 1 << 14
#: Sets put in order at once.
ORDERED = 500


def shingle_sets(c, k: int):
    """(ends, hashes): each row's distinct n-gram hashes in ascending order, rows after one another."""
    words = word_hashes(c)
    ends = np.cumsum(c.counts)
    row = np.repeat(np.arange(c.rows), c.counts)
    runs = np.zeros(len(words), np.uint64)
    all_runs = run_hashes(words, k)
    runs[: len(all_runs)] = all_runs
    keep = np.arange(len(words)) + k <= ends[row] if len(words) else np.zeros(0, bool)
    short = np.flatnonzero((c.counts > 0) & (c.counts < k))
    for r in short.tolist():  # the whole sequence as one n-gram
        own = words[ends[r] - c.counts[r] : ends[r]]
        at = ends[r] - c.counts[r]
        runs[at], keep[at] = mix(run_hashes(own, len(own)) + np.uint64(len(own)))[0], True
    runs, row = runs[keep], row[keep]
    order = np.argsort(runs, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    runs, row = runs[order], row[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (row[1:] != row[:-1])
    runs, row = runs[new], row[new]
    return np.cumsum(np.bincount(row, minlength=c.rows)), runs


def set_ids(ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A 64-bit number of each set; among a billion different sets two agree with a chance of 3 %."""
    total = np.append(np.uint64(0), np.cumsum(mix(hashes + np.uint64(0x1234567))))
    at = np.append(0, ends)
    return mix((total[at[1:]] - total[at[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + np.diff(at).astype(np.uint64)).view(np.int64)


def most_apart(a: int, b: int, need: int, of: int) -> int:
    """The largest symmetric difference of linked sets of a and b members."""
    least = -(-need * (a + b) // (of + need))
    return a + b - 2 * least


def band(n: np.ndarray | int, need: int, of: int):
    """Number of the size band, so that linked sets' bands differ by one at most."""
    return np.floor(np.log(np.asarray(n, float)) / np.log(of / need) + 1e-9).astype(np.int64)


def band_end(b: int, need: int, of: int) -> int:
    """The largest size in band b."""
    n = int((of / need) ** (b + 1)) + 2
    while int(band(n, need, of)) > b:
        n -= 1
    return n


_limits: dict[tuple, tuple[int, int]] = {}


def _pieces(b: int, need: int, of: int) -> tuple[int, int]:
    """(pieces, largest symmetric difference) for pairs whose larger set is in size band b."""
    key = (b, need, of)
    if key not in _limits:
        end = band_end(b, need, of)
        apart = max(most_apart(a, end, need, of) for a in range(max(1, -(-need * end // of)), end + 1))
        _limits[key] = (apart + 1 + (apart and 2 + apart // 12), apart)
    return _limits[key]



def band_start(b: int, need: int, of: int) -> int:
    return band_end(b - 1, need, of) + 1 if b else 1


def piece_keys(ends: np.ndarray, hashes: np.ndarray, need: int, of: int):
    """(set, key, size band, need) of every piece of all sets, each for its own size band and, if a linked set can be there, the next.

    need: how many pieces that hold something are equal in a linked set of the band at least.
    """
    n = np.diff(np.append(0, ends))
    sets = np.flatnonzero(n)
    own = np.zeros(len(n), np.int64)
    own[sets] = band(n[sets], need, of)
    found = []
    for step in (0, 1):
        bands = {b: (*_pieces(b + step, need, of), band_start(b + step, need, of)) for b in np.unique(own[sets]).tolist()}
        table = np.zeros((max(bands, default=0) + 1, 3), np.int64)
        for b, row in bands.items():
            table[b] = row
        pieces, apart, least = table[own].T if len(bands) else np.zeros((3, len(n)), np.int64)
        use = (n > 0) & (n * of // need >= least)
        pieces = np.where(use, pieces, 0)
        base = np.append(0, np.cumsum(pieces))
        of_set = np.repeat(np.arange(len(n)), n)
        h = hashes[use[of_set]]
        of_set = of_set[use[of_set]]
        piece = ((h >> np.uint64(20)) % np.maximum(pieces, 1)[of_set].astype(np.uint64)).astype(np.int64)
        seed = mix((((own[of_set] + step) << 32) + piece).astype(np.uint64))
        bit = mix(seed + (h & np.uint64(PIECE_BITS - 1)))
        at = base[of_set] + piece
        order = np.argsort(at, kind="stable")
        at = at[order]
        begin = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
        if not len(begin):
            continue
        key = mix(np.bitwise_xor.reduceat(bit[order], begin) ^ seed[order][begin])
        at = at[begin]
        owner = of_set[order][begin]
        empty = pieces - np.bincount(owner, minlength=len(n))
        sure = np.maximum(1, pieces - apart - empty)
        found.append((owner, key, own[owner] + step, sure[owner]))
        many = np.flatnonzero(use & (empty > pieces - apart - 1))
        for r in many.tolist():
            held = np.zeros(pieces[r], bool)
            held[at[owner == r] - base[r]] = True
            spots = np.flatnonzero(~held)
            found.append((np.full(len(spots), r), mix(mix((((own[r] + step) << 32) + spots).astype(np.uint64))), np.full(len(spots), own[r] + step), np.ones(len(spots), np.int64)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The whole parity sketch, four to eight bits for each n-gram, as bytes."""
    bits = 1 << max(9, int(4 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool))


def _describe(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("node", pa.int64())])

    def run(batches):
        for batch in batches:
            ids, ties = batch.column(0).cast(pa.int64()), batch.column(1)
            for c in chunks(batch.column(2), lower=True):
                ends, hashes = shingle_sets(c, k)
                n = np.diff(np.append(0, ends))
                yield pa.RecordBatch.from_arrays([ids.slice(c.first, c.rows), ties.slice(c.first, c.rows), pa.array(n), pa.array(set_ids(ends, hashes))], schema=schema)

    return run


_OWNER = np.dtype([("node", "<i8"), ("keys", "<u4"), ("band", "<u2"), ("sure", "<u2")])
#: Added to the band of a key whose other members went beside the bucket.
MARKED = 0x8000
_MEMBER = np.dtype([("node", "<i8"), ("sure", "<u2")])


def _beside(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys that more than PAIRED sets have: (places in order of key and node, where each key begins there)."""
    order = np.lexsort((node, key))
    ordered = key[order]
    begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    many = size > PAIRED
    return order[np.repeat(many, size)], np.append(0, np.cumsum(size[many]))


def _send_keys(k: int, need: int, of: int, buckets: int):
    """Rows (bucket, owners, keys); without owners, keys is one key and members of its large group, for any bucket to hand on."""

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(0), lower=True):
                ends, hashes = shingle_sets(c, k)
                nodes = set_ids(ends, hashes)
                owner, key, size_band, sure = piece_keys(ends, hashes, need, of)
                first = np.zeros(c.rows, bool)
                first[np.unique(nodes, return_index=True)[1]] = True
                keep = first[owner]
                owner, key, size_band, sure = owner[keep], key[keep], size_band[keep], sure[keep]
                rows = [[], [], []]
                places, begin = _beside(key, nodes[owner])
                if len(places):
                    at = np.zeros(len(places), _MEMBER)
                    at["node"], at["sure"] = nodes[owner[places]], np.minimum(sure[places], 0xFFFF)
                    for a, b in zip(begin, begin[1:], strict=False):
                        own = np.array([key[places[a]], size_band[places[a]]], np.uint64)
                        rows[0].append(int(mix(own[:1] + np.uint64(at["node"][a] & 0xFFFF))[0] % np.uint64(buckets)))
                        rows[1].append(None)
                        rows[2].append(own.tobytes() + at[a:b].tobytes())
                    stay = np.ones(len(key), bool)
                    stay[places] = False
                    stay[places[begin[:-1]]] = True
                    size_band[places[begin[:-1]]] += MARKED
                    owner, key, size_band, sure = owner[stay], key[stay], size_band[stay], sure[stay]
                bucket = ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((size_band, owner, bucket))
                bucket, owner, key, size_band, sure = bucket[order], owner[order], key[order], size_band[order], sure[order]
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
                for a, b in zip(cuts, np.append(cuts[1:], len(bucket)), strict=False):
                    new = a + np.flatnonzero(np.append(True, (owner[a + 1 : b] != owner[a : b - 1]) | (size_band[a + 1 : b] != size_band[a : b - 1])))
                    head = np.zeros(len(new), _OWNER)
                    head["node"], head["keys"] = nodes[owner[new]], np.diff(np.append(new, b))
                    head["band"], head["sure"] = size_band[new], np.minimum(sure[new], 0xFFFF)
                    rows[0].append(bucket[a])
                    rows[1].append(head.tobytes())
                    rows[2].append(key[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(x, pa.binary()) for x in rows[1:])], ["bucket", "owners", "keys"])

    return run


_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("band", pa.int64()), ("shared", pa.int64()), ("needed", pa.int64()), ("members", pa.binary())])


def _large(gid: int, band: int, members: np.ndarray, times: int = 1) -> pa.RecordBatch:
    """Rows of a large group: a is its least member, b its number, shared how many keys have just these members."""
    parts = [members[i : i + BLOCK].tobytes() for i in range(0, len(members), BLOCK)]
    same = lambda v: pa.array([v] * len(parts), pa.int64())
    return pa.RecordBatch.from_arrays([same(int(members["node"].min())), same(gid), same(band), same(times), pa.nulls(len(parts), pa.int64()), pa.array(parts, pa.binary())], schema=_MET)


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, band) with how many keys they share here and need in all; and members of larger groups, in blocks, b being the group's number."""
    heads, keys = [], []
    for batch in batches:
        owners, sent = batch.column("owners"), batch.column("keys")
        for own, own_keys in zip(owners, sent, strict=True):
            if own.is_valid:
                heads.append(own.as_py())
                keys.append(own_keys.as_py())
            else:
                raw = own_keys.as_py()
                gid, band = np.frombuffer(raw[:16], "<i8").tolist()
                yield _large(gid, band, np.frombuffer(raw[16:], _MEMBER))
    head = np.frombuffer(b"".join(heads), _OWNER)
    keys = np.frombuffer(b"".join(keys), "<u8")
    del heads
    who = np.repeat(np.arange(len(head), dtype=np.int32), head["keys"])
    order = np.argsort(keys)
    ordered = keys[order]
    twin = np.zeros(len(keys), bool)
    twin[1:] = ordered[1:] == ordered[:-1]
    twin[:-1] |= twin[1:]
    order = order[twin]
    del ordered, twin
    order = order[np.lexsort((head["node"][who[order]], keys[order]))]
    keys, who = keys[order], who[order]
    nodes = head["node"][who]
    marked = head["band"][who] >= MARKED
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    beside = np.logical_or.reduceat(marked, cuts) if len(cuts) else np.zeros(0, bool)
    # A set has a key once; only a marked one can come again, from another run of texts.
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, who, nodes = keys[new], who[new], nodes[new]
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(cuts, len(keys)))
    for m in range(2, PAIRED + 1):
        at = cuts[(size == m) & ~beside]
        i, j = np.triu_indices(m, 1)
        step = max(1, PAIRS_TOGETHER // len(i))
        for part in (at[x : x + step] for x in range(0, len(at), step)):
            left, right = who[(part[:, None] + i).ravel()], who[(part[:, None] + j).ravel()]
            pairs = pd.DataFrame({"a": head["node"][left], "b": head["node"][right], "band": head["band"][left].astype(np.int64), "needed": np.maximum(head["sure"][left], head["sure"][right]).astype(np.int64)})
            pairs = pairs.groupby(["a", "b", "band"], sort=False, as_index=False).agg(shared=("needed", "size"), needed=("needed", "max"))
            yield pa.RecordBatch.from_arrays([*(pa.array(pairs[x].to_numpy(np.int64)) for x in _MET.names[:5]), pa.nulls(len(pairs), pa.binary())], schema=_MET)
    told: dict[tuple[int, int], list] = {}
    for a, m, by_key in zip(cuts.tolist(), size.tolist(), beside.tolist(), strict=True):
        if m > PAIRED or by_key:
            own = np.zeros(m, _MEMBER)
            own["node"], own["sure"] = nodes[a : a + m], head["sure"][who[a : a + m]]
            band = int(head["band"][who[a]]) % MARKED
            if by_key:
                yield _large(int(keys[a : a + 1].view("<i8")[0]), band, own)
            else:
                told.setdefault((hash_of(own["node"].tobytes()), band), [own, 0])[1] += 1
    for (gid, band), (own, times) in told.items():
        yield _large(gid, band, own, times)


def _unpack(batches):
    for batch in batches:
        own = [np.frombuffer(m.as_buffer(), _MEMBER) for m in batch.column("members")]
        every = np.concatenate(own) if own else np.zeros(0, _MEMBER)
        at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i).cast(pa.int64()).take(at) for i in ("hub", "gid", "band", "times")), pa.array(every["node"]), pa.array(every["sure"].astype(np.int64))],
            ["hub", "gid", "band", "times", "node", "sure"],
        )


def hash_of(members: bytes) -> int:
    x = np.frombuffer(members, "<u8")
    return int(mix(mix(x) * np.arange(1, 2 * len(x), 2, dtype=np.uint64)).sum().view(np.int64))


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(0), lower=True):
                ends, hashes = shingle_sets(c, k)
                at = np.append(0, ends)
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(ends, hashes)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))], ["node", "members"])

    return run


def _sketched(k: int):
    """(node, n, sketch, text) of each text."""

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(0), lower=True):
                ends, hashes = shingle_sets(c, k)
                n = np.diff(np.append(0, ends))
                sketches = pa.array([sketch(hashes[a - m : a]).tobytes() for a, m in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(ends, hashes)), pa.array(n), sketches, batch.column(0).slice(c.first, c.rows)], ["node", "n", "sketch", "text"])

    return run


def _may_link(need: int, of: int):
    """The pairs (a, b) whose sketches don't differ in more bits than linked sets of their sizes can."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).cast(pa.binary()) for i in (4, 5))
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            most = total - 2 * (-(-need * total // (of + need)))
            keep = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                x, y = (np.frombuffer(s[i].as_buffer(), "<u8") for s in (a, b))
                # In the longer of two sketches bits fold onto the shorter one's.
                small = min(len(x), len(y))
                apart = np.bitwise_xor.reduce(x.reshape(-1, small), axis=0) ^ np.bitwise_xor.reduce(y.reshape(-1, small), axis=0)
                keep[i] = int(np.bitwise_count(apart).sum()) <= most[i]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["a", "b"])

    return run


def _count_cells(batches):
    """How many n-grams of all sets fall in each cell, a row for each range of cells that has any."""
    total = np.zeros(CELLS, np.uint32)
    for batch in batches:
        cells = batch.column(0).flatten().to_numpy(zero_copy_only=False) & (CELLS - 1)
        found, n = np.unique(cells, return_counts=True)
        total[found] += n.astype(np.uint32)
    ranges = total.reshape(-1, CELLS_TOGETHER)
    found = np.flatnonzero(ranges.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([ranges[i].tobytes() for i in found.tolist()], pa.binary())], ["range", "counts"])


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each cell of a range a number that grows with its count, 0 for one n-gram or none."""
    total = np.zeros(CELLS_TOGETHER, np.int64)
    for batch in batches:
        for counts in batch.column("counts"):
            total += np.frombuffer(counts.as_buffer(), np.uint32)
        at = batch.column("range")[0]
    often = np.minimum(np.ceil(8 * np.log2(np.maximum(total, 1))), 255).astype(np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([at.as_py()], pa.int64()), pa.array([often.tobytes()], pa.binary())], ["range", "often"])


def _rarest(often: np.ndarray, need: int, of: int):
    """(gid, node): of each set the n-grams of which one at least is shared by any two linked sets, without most of those that only one set has.

    often: for each cell a number that grows with its count, 0 for one n-gram or none.
    """

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, ORDERED) for i in range(0, len(batch), ORDERED)):
                h = part.column(1).flatten().to_numpy(zero_copy_only=False)
                n = part.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                count = often[h & (CELLS - 1)]
                order = np.lexsort((h, count, row))
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                keep = (place <= (n - -(-need * n // of))[row]) & (count[order] > 0)
                yield pa.RecordBatch.from_arrays([pa.array(h[order[keep]]), part.column(0).take(pa.array(row[keep]))], ["gid", "node"])

    return run


class _Members:
    """A block of a group's members, from an Arrow list: flat arrays, nothing copied."""

    def __init__(self, block: pa.StructArray):
        self.node, self.component, self.n = (block.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        sketches, gids = block.field(3), block.field(4)
        size = len(block)
        self.at = np.frombuffer(sketches.buffers()[1], np.int32)[sketches.offset : sketches.offset + size + 1]
        self.bytes = np.frombuffer(sketches.buffers()[2], np.uint8)
        self.gids = gids
        self.size = size

    def sketch(self, i: int) -> np.ndarray:
        return self.bytes[self.at[i] : self.at[i + 1]]

    def gids_of(self, i: int) -> np.ndarray:
        return self.gids[i].values.to_numpy(zero_copy_only=False)


def _near(need: int, of: int):
    """Pairs of members of two blocks of a group that are in different components and near enough by their sketches.

    Left are members outside the component of the group's hub. A pair of two such comes once, from the smaller
    node; one that meets in several groups comes from that with the least number.
    """

    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                gid, hub = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                left, right = (_Members(batch.column(i)[row].values) for i in (2, 3))
                a, b = [], []
                length = np.diff(right.at)
                stacks = {bits: js for bits in np.unique(length).tolist() if len(js := np.flatnonzero(length == bits))}
                stacks = {bits: (js, np.stack([right.sketch(j) for j in js.tolist()])) for bits, js in stacks.items()}
                for i in range(left.size):
                    node, n, own = left.node[i], left.n[i], left.sketch(i)
                    own_gids = None
                    for bits, (js, stack) in stacks.items():
                        # In the longer of two sketches bits fold onto the shorter one's.
                        small = min(bits, len(own))
                        take = (right.component[js] != left.component[i]) & ((right.component[js] == hub) | (right.node[js] > node))
                        least, most = np.minimum(right.n[js], n), np.maximum(right.n[js], n)
                        take &= of * least >= need * most
                        at = js[take]
                        if not len(at):
                            continue
                        mine = np.bitwise_xor.reduce(own.reshape(-1, small), axis=0).view("<u8")
                        theirs = np.bitwise_xor.reduce(stack[take].reshape(len(at), -1, small), axis=1).view("<u8")
                        apart = np.bitwise_count(theirs ^ mine).sum(axis=1, dtype=np.int64)
                        total = right.n[at] + n
                        at = at[apart <= total - 2 * (-(-need * total // (of + need)))]
                        for j in at.tolist():
                            own_gids = left.gids_of(i) if own_gids is None else own_gids
                            if np.intersect1d(own_gids, right.gids_of(j))[0] == gid:
                                a.append(node)
                                b.append(right.node[j])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _id_of(column: str) -> list:
    """A doc_id that may be null, as two columns that are equal where it is: a join by them leaves rows dealt for a grouping by them."""
    return [F.coalesce(F.col(column).cast("long"), F.lit(0)).alias("_id"), F.col(column).isNull().alias("_bare")]


def similarity_classes(docs: DataFrame, k: int = WORDS, need: int = NEED, of: int = OF) -> DataFrame:
    """doc_id, n_shingles, component (the least set number that links reach), component_id and the text's tie of each document.

    Documents with equal sets are one node; nodes link when ``of`` * intersection >= ``need`` * union;
    component_id is the least doc_id that links reach. Null and empty texts have an empty set and a null component, are
    linked with nothing and keep their own doc_id; so do null doc_ids as long as no document with a
    doc_id is linked with them. Repeated rows are linked with each other. More columns are left out.
    """
    if not 0 < need <= of:
        raise ValueError("the measure is above 0 and at most 1")
    tie = F.xxhash64("text")
    rows = docs.select("doc_id", tie.alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    described = cut(rows.mapInArrow(_describe(k), "doc_id long, tie long, n long, node long"))
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    # Two bands' pieces for each word, eight bytes each.
    key_bytes = total / WORD_BYTES * 2 * 8 * min(1.0, 2.2 * (of - need) / (of + need))
    buckets = max(16, int(-(-key_bytes // BUCKET_BYTES)))
    sent = rows.select("text").mapInArrow(_send_keys(k, need, of, buckets), "bucket long, owners binary, keys binary")
    met = cut(sent.groupBy("bucket").applyInArrow(_group, "a long, b long, band long, shared long, needed long, members binary"))
    counted = cut(met.filter("members is null").groupBy("a", "b", "band").agg(F.sum("shared").alias("shared"), F.max("needed").alias("needed")))
    # A pair can come once a band, twice at most; those that are verified are made distinct after the sketches.
    likely = counted.filter("shared >= needed").select("a", "b")
    # Equal groups of several buckets are one, as often as they came; a marked key's parts have one number.
    alike = met.filter("members is not null").groupBy(F.col("a").alias("hub"), F.col("b").alias("gid"), "band", "members").agg(F.sum("shared").cast("int").alias("times"))
    every = cut(alike.mapInArrow(_unpack, "hub long, gid long, band long, times long, node long, sure long"))
    # A marked key's sets may come twice, from its bucket and beside it: more groups than there are, never fewer.
    groups_of = every.groupBy("node", "band").agg(F.sum("times").alias("groups"), F.max("sure").alias("sure"))
    best = counted.select("band", "shared", F.explode(F.array("a", "b")).alias("node")).groupBy("node", "band").agg(F.max("shared").alias("most"))
    alive = groups_of.join(best, ["node", "band"], "left").filter(F.col("groups") + F.coalesce("most", F.lit(0)) >= F.col("sure")).select("node", "band")
    # Of each node of the crowd: how many of its groups have which least member.
    tied = cut(every.join(alive, ["node", "band"], "left_semi").groupBy("gid", "node").agg(F.min("hub").alias("hub")).groupBy("node", "hub").agg(F.count(F.lit(1)).alias("count")))
    crowd = tied.select("node").distinct()
    # The set of each node of a pair or large group, from the text of one document that has it.
    wanted = crowd.unionByName(likely.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    # Documents of one set are counted together before the join, where they would land in one task.
    picks = described.groupBy("node").agg(F.min(F.struct("doc_id", "tie")).alias("at")).join(wanted, "node").select(F.col("at.tie").alias("tie"), *_id_of("at.doc_id"))
    picks = cut(picks)
    # Of repeated rows one stays, in the partitions of the join.
    texts = likely_in(rows, "tie", picks).select("tie", *_id_of("doc_id"), "text").join(picks, ["tie", "_id", "_bare"]).groupBy("tie", "_id", "_bare", "text").agg(F.lit(1).alias("one"))
    sets = cut(texts.select("text").mapInArrow(_sketched(k), "node long, n long, sketch binary, text string"))

    def grams(nodes: DataFrame) -> DataFrame:
        """The n-grams of these nodes' sets and of a few others, from their texts again: they take more room than those."""
        return likely_in(sets.select("node", "text"), "node", nodes).select("text").mapInArrow(_sets(k), "node long, members array<long>")

    def verified(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        found = cut(grams(nodes))
        left, right = (found.select(F.col("node").alias(x), F.col("members").alias(f"set_{x}")) for x in "ab")
        sized = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b"), F.size(F.array_intersect("set_a", "set_b")).alias("both"))
        linked = cut(sized.filter(of * F.col("both") >= need * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b"))
        drop(found)
        return linked

    def linked_by(parts: DataFrame | None, pairs: DataFrame) -> DataFrame:
        """The components parts, brought together by the linked ones of the pairs.

        One pair a node is verified first; of the others only those whose ends are then still apart can connect
        more. So what is moved grows with the sets, not with the pairs of a group.
        """
        left, right = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
        sized = pairs.join(left, "a").join(right, "b").filter(of * F.least("n_a", "n_b") >= need * F.greatest("n_a", "n_b")).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
        near = cut(sized.mapInArrow(_may_link(need, of), "a long, b long"))
        near = near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        one_each = near.groupBy("a").agg(F.min("b").alias("b"))
        for turn in range(2):
            asked = one_each
            if turn:
                known = [parts.select(F.col("node").alias(x), F.col("component").alias(f"in_{x}")) for x in "ab"]
                apart = near.join(known[0], "a", "left").join(known[1], "b", "left").filter(F.coalesce("in_a", "a") != F.coalesce("in_b", "b"))
                asked = cut(apart.select("a", "b").distinct().join(one_each, ["a", "b"], "left_anti"))
            if parts is not None and asked.isEmpty():
                continue
            fresh = verified(asked)
            if parts is None or not fresh.isEmpty():
                # Each node's tie to its component stands for all links so far.
                parts = connected(fresh if parts is None else fresh.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b"))))
            drop(fresh)
        drop(near)
        return parts

    def stars(met_with: DataFrame) -> DataFrame:
        """Each node (a) and the hub (b) that it meets most often."""
        often = met_with.groupBy("node").agg(F.max(F.struct("count", "hub")).alias("m"))
        return often.select(F.col("node").alias("a"), F.col("m.hub").alias("b"))

    # The least member is the same in most groups of like sets, and no join is needed to find it.
    begun = stars(tied.filter("node <> hub").join(crowd.select(F.col("node").alias("hub")), "hub", "left_semi"))
    parts = linked_by(None, likely.unionByName(begun))
    # From here on a group is the sets that have one n-gram, and its hub the member that is in most groups.
    crowded = cut(grams(crowd).join(crowd, "node", "left_semi"))
    counts = cut(crowded.select("members").mapInArrow(_count_cells, "range long, counts binary").groupBy("range").applyInArrow(_often, "range long, often binary"))
    often = np.zeros((CELLS // CELLS_TOGETHER, CELLS_TOGETHER), np.uint8)
    for at, cells in counts.collect():
        often[at] = np.frombuffer(cells, np.uint8)
    often = often.ravel()
    first_few = cut(crowded.mapInArrow(_rarest(often, need, of), "gid long, node long"))
    drop(crowded, counts)
    # Full cells let n-grams through that only one set has.
    tied = cut(first_few.join(first_few.groupBy("gid").count().filter("count > 1"), "gid", "left_semi"))
    meets = cut(tied.groupBy("node").agg(F.collect_list("gid").alias("gids")))
    for turn in range(ROUNDS + 1):
        degree = meets.select("node", F.size("gids").alias("degree"))
        spread = tied.join(degree, "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        first = F.max(F.struct("degree", F.xxhash64(F.lit(turn), "node").alias("order"), F.col("node").alias("hub"), F.col("component").alias("hub_component"))).alias("h")
        size = F.count(F.lit(1)).alias("n_members")
        open_groups = spread.groupBy("gid").agg(F.min("component").alias("x"), F.max("component").alias("y"), size, first).filter("x <> y").select("gid", "n_members", "h.hub", "h.hub_component")
        rest = cut(spread.drop("degree").join(open_groups, "gid"))
        if turn == ROUNDS or rest.isEmpty():
            break
        # Of the hubs of its groups, each member is verified against the one it meets most often.
        parts = linked_by(parts, stars(rest.filter("component <> hub_component").groupBy("node", "hub").count()))
    if not rest.isEmpty():
        sketches = sets.select("node", "n", "sketch")
        block = F.pmod(F.xxhash64("node"), F.ceil(F.col("n_members") / BLOCK)).alias("block")
        of_group = rest.select("gid", "hub_component", "node", "component", block).join(sketches.join(meets, "node"), "node")

        def blocks(side: DataFrame, name: str) -> DataFrame:
            return side.groupBy("gid", "hub_component", "block").agg(F.collect_list(F.struct("node", "component", "n", "sketch", "gids")).alias(name)).drop("block")

        left, right = blocks(of_group.filter("component <> hub_component"), "left"), blocks(of_group, "right")
        pairs = left.join(right.drop("hub_component"), "gid").select("gid", "hub_component", "left", "right")
        pairs = pairs.mapInArrow(_near(need, of), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        parts = linked_by(parts, pairs)
    # What is read from here on are the descriptions and the components.
    drop(met, counted, every, picks, sets, first_few, tied, meets, rest)
    known = described.join(parts, "node", "left").withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "node")))
    least = known.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = known.join(least, "component", "left")
    return out.select("doc_id", "tie", F.col("n").alias("n_shingles"), "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_each(docs: DataFrame, k: int = 5, need: int = 80, of: int = 100) -> DataFrame:
    """One row of each group of linked documents, that of the least doc_id and text hash, and all rows without words; all columns kept."""
    names = docs.columns
    classes = similarity_classes(docs, k, need, of)
    kept = classes.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct("doc_id", "tie")).alias("m")).select("m.doc_id", "m.tie", F.lit(True).alias("one"))
    bare = classes.filter(F.col("component").isNull()).select("doc_id", "tie", F.lit(False).alias("one")).distinct()
    at = ["_tie", "_id", "_bare"]
    keys = cut(kept.unionByName(bare).select(F.col("tie").alias("_tie"), *_id_of("doc_id"), F.col("one").alias("_one")))
    whole = docs.select(F.struct(*names).alias("row"), F.xxhash64("text").alias("_tie"), *_id_of("doc_id"))
    found = whole.join(keys, at)
    # In the partitions of the join: whole rows are moved once.
    one = found.filter("_one").groupBy(*at).agg(F.first("row").alias("row"))
    return one.select("row").unionByName(found.filter("not _one").select("row")).select("row.*")


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
