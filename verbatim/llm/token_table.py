"""Token ids of documents in sorted-string-table shards, and lookup by document identifier.

A shard file, all integers little-endian unless said otherwise:

    block*      zstd frames; each holds entries of consecutive documents in key order. An entry is
                varint(bytes shared with the previous key), varint(further key bytes),
                varint(value bytes), key bytes, value. The first key of a block is whole.
    index       zstd frame: for each block, varint(key bytes), first key, u64 offset, u32 length, u32 crc32
    bloom       bits of a Bloom filter over the shard's keys
    footer      u64 index offset, u32 index length, u64 bloom offset, u32 bloom length,
                u32 hash functions, u64 documents, u64 ids, 8 bytes magic

A key is the identifier as 8 bytes big-endian with its sign bit turned, so byte order is number
order; a null identifier's key is empty and so comes first. A value is the ids as unsigned 16-bit
integers behind the byte 2 if all fit, else as 32-bit ones behind the byte 4.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat
from operator import itemgetter
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_dir
from .textkit import Chunk, chunks, give_back, word_hashes

MAGIC = b"SSTOKEN1"
FOOTER = struct.Struct("<QIQIIQQ8s")
BLOCK_BYTES = 128 << 10
BLOOM_BITS = 10
BLOOM_HASHES = 7
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Bytes of text in one shard; small tables are cut finer, to give all cores work.
SHARD_BYTES = 256 << 20
#: Words whose ids a worker remembers, and how many of them, those met most often, it keeps at that number and at a task's end.
REMEMBERED, KEPT = 500_000, 200_000
#: Bytes of a word that are compared as integers.
LANES = 64
#: Masks of the first 0 to 8 bytes of a little-endian integer.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def key_bytes(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def key_id(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def pack_ids(ids: np.ndarray) -> bytes:
    wide = len(ids) and ids.max() > 0xFFFF
    return b"\4" + ids.astype("<u4").tobytes() if wide else b"\2" + ids.astype("<u2").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u4" if value[0] == 4 else "<u2", offset=1).astype("<u4")


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    """Bit numbers, a row a key, by double hashing of two crc32 values."""
    a = np.array([zlib.crc32(k) for k in keys], np.uint64)
    b = np.array([zlib.crc32(k, 0x5BD1E995) for k in keys], np.uint64) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)


class ShardWriter:
    """Writes entries, which must come in key order, to an open binary file."""

    def __init__(self, out, block_bytes: int = BLOCK_BYTES):
        import zstandard

        self.out, self.block_bytes, self.squeeze = out, block_bytes, zstandard.ZstdCompressor(level=3).compress
        self.at = self.n_ids = 0
        self.block, self.index, self.keys = bytearray(), bytearray(), []
        self.first = self.last = b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            shared = len(os.path.commonprefix([self.last, key]))
        else:
            self.first = key
        value = pack_ids(ids)
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.n_ids += len(ids)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        data = self.squeeze(bytes(self.block))
        self.out.write(data)
        self.index += varint(len(self.first)) + self.first + struct.pack("<QII", self.at, len(data), zlib.crc32(data))
        self.at += len(data)
        self.block.clear()

    def finish(self) -> None:
        if self.block:
            self._flush()
        index = self.squeeze(bytes(self.index))
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        bloom = np.zeros(bits, bool)
        if self.keys:
            bloom[_probes(self.keys, bits).ravel().astype(np.int64)] = True
        bloom_bytes = np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index)
        self.out.write(bloom_bytes)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom_bytes), BLOOM_HASHES, len(self.keys), self.n_ids, MAGIC))


@dataclass
class Shard:
    """Reads a shard file: its entries in order, or the values of one identifier."""

    file: object

    def __post_init__(self):
        import zstandard

        self.expand = zstandard.ZstdDecompressor().decompress
        self.file.seek(0, 2)
        self.file.seek(self.file.tell() - FOOTER.size)
        index_at, index_n, self.bloom_at, self.bloom_n, _, self.n_docs, self.n_ids, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        index = self.expand(self._at(index_at, index_n))
        self.blocks, at = [], 0
        while at < len(index):
            n, at = read_varint(index, at)
            self.blocks.append((index[at : at + n], *struct.unpack_from("<QII", index, at + n)))
            at += n + 16

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, n, crc = self.blocks[block]
        data = self._at(offset, n)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {block} is damaged")
        data, at, key = self.expand(data), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, unpack_ids(data[at : at + size])
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in range(len(self.blocks)):
            yield from self.entries(block)

    def may_hold(self, doc_id: int | None) -> bool:
        bloom = np.unpackbits(np.frombuffer(self._at(self.bloom_at, self.bloom_n), np.uint8), bitorder="little")
        return bool(bloom[_probes([key_bytes(doc_id)], len(bloom))[0].astype(np.int64)].all())

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry of this identifier: none, one, or several where it is repeated."""
        if not self.blocks or not self.may_hold(doc_id):
            return []
        key, low, high = key_bytes(doc_id), 0, len(self.blocks)
        while low < high:  # the first block whose first key is not below the key
            middle = (low + high) // 2
            if self.blocks[middle][0] < key:
                low = middle + 1
            else:
                high = middle
        found = []
        for block in range(max(0, low - 1), len(self.blocks)):
            if self.blocks[block][0] > key:
                break
            found += [ids for k, ids in self.entries(block) if k == key]
        return found


def joins_nothing(tokenizer) -> bool:
    """Whether the tokenizer drops all white space and never joins characters across it, by its own description."""
    told = json.loads(tokenizer.to_str())
    steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [told.get("pre_tokenizer") or {}]
    split, rest = steps[0], steps[1:]
    pattern = (split.get("pattern") or {}).get("Regex", "")
    apart = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
    # What the pattern takes is a literal, or a class of letters, of digits, or of what isn't white space.
    takes = re.sub(r"\[\^\\s[^\]]*\]\+?|\[\\p\{[LN]\}\]\+?|\\p\{[LN]\}\+?", "", pattern)
    apart = apart and bool(pattern) and not re.search(r"[\s\\\[\].*?]", takes)
    apart = apart and all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in rest)
    normal = told.get("normalizer") or {"type": "Sequence", "normalizers": []}
    for step in normal.get("normalizers", [normal]):
        blanks = step.get("type") == "Replace" and step.get("pattern") == {"Regex": r"\s+"} and step.get("content") == " "
        apart = apart and (blanks or step.get("type") in ("NFC", "Lowercase"))
    for token in told.get("added_tokens", ()):
        apart = apart and not re.search(r"\s", token["content"]) and not token["single_word"]
    return apart and told.get("post_processor") is None and told.get("truncation") is None


def token_sizes(tokenizer) -> np.ndarray:
    """Bytes that each token stands for, where the tokenizer writes a byte as a character, by its own description; else 0.

    Added tokens stand for nothing here: a text that holds one is told apart by its characters.
    """
    told = json.loads(tokenizer.to_str())
    vocabulary = told["model"].get("vocab", {})
    size = np.zeros(max(tokenizer.get_vocab(with_added_tokens=True).values(), default=0) + 1, np.int64)
    last = told["pre_tokenizer"] or {}
    last = last.get("pretokenizers", [last])[-1]
    if last.get("type") == "ByteLevel" and isinstance(vocabulary, dict):
        suffix = told["model"].get("end_of_word_suffix") or ""
        for token, number in vocabulary.items():
            size[number] = len(token.removesuffix(suffix))
        for token in told.get("added_tokens", ()):
            size[token["id"]] = 0
    return size


def unlike(c: Chunk, other: np.ndarray) -> np.ndarray:
    """Whether each word of the chunk differs in any byte from its word number ``other``."""
    n, like = c.ends - c.starts, c.starts[other]
    differs = n != n[other]
    # Eight bytes at a time, those behind a word's end masked; the few long words as byte strings.
    padded = np.append(c.data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(c.data) + 1, "<u8", padded, strides=(1,))
    left = np.flatnonzero(~differs & (like != c.starts))
    for at in range(0, LANES, 8):
        a, b = eight[c.starts[left] + at], eight[like[left] + at]
        differs[left[(a ^ b) & _FIRST[np.minimum(n[left] - at, 8)] != 0]] = True
        left = left[n[left] > at + 8]
    for i in left[~differs[left]].tolist():
        size = int(n[i])
        differs[i] = c.data[c.starts[i] : c.starts[i] + size].tobytes() != c.data[like[i] : like[i] + size].tobytes()
    return differs


class TextEncoder:
    """Ids of whole texts by the tokenizers library.

    Where the tokenizer's own description says that it joins nothing across white space, a text's ids
    are its words' ids in turn, and the library encodes each word once: a word is remembered under its
    bytes, so no other word can stand for it. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.by_word = joins_nothing(self.whole)
        self.size = token_sizes(self.whole)
        self.of_word: dict[bytes, int] = {}
        self.flat, self.begin, self.met = array("I"), array("q", [0]), array("I")
        give_back()

    def forget(self, most: int = KEPT) -> None:
        """Remember no more than ``most`` words, those that most chunks held; of equal ones those met first."""
        if len(self.of_word) <= most:
            return
        met, begin = np.array(self.met), np.array(self.begin)
        keep = np.sort(np.argsort(-met.astype(np.int64), kind="stable")[:most])
        words = list(self.of_word)
        self.of_word = {words[i]: at for at, i in enumerate(keep.tolist())}
        del words
        n = begin[keep + 1] - begin[keep]
        total = np.cumsum(n)
        at = np.repeat(begin[keep] - (total - n), n) + np.arange(total[-1] if len(total) else 0)
        self.flat = array("I", np.array(self.flat, np.uint32)[at].tobytes())
        self.begin, self.met = array("q", np.append(0, total).astype(np.int64).tobytes()), array("I", (met[keep] // 2).astype(np.uint32).tobytes())
        give_back()

    def _counts_by_bytes(self, text: str, ids: np.ndarray, n_words: int) -> np.ndarray | None:
        """Tokens of each word, from the bytes that tokens stand for; None unless every word ends where a token ends.

        Words that hold further kinds of white space, which a tokenizer may take for blanks, have no such counts.
        """
        if " ".join(text.split()) != text:
            return None
        normal = self.whole.normalizer.normalize_str(text) if self.whole.normalizer else text
        data = np.frombuffer(normal.encode(), np.uint8)
        blanks = np.append(np.flatnonzero(data == 0x20), len(data))
        if len(blanks) != n_words or not len(ids):
            return None
        upto, size = blanks - np.arange(n_words), self.size[ids]
        ends = np.cumsum(size)
        last = np.searchsorted(ends, upto)
        if size.min() < 1 or ends[-1] != upto[-1] or (ends[last] != upto).any():
            return None
        return np.diff(last, prepend=-1)

    def _learn(self, words: list[bytes]) -> None:
        """Remember the ids of new, different words: the library encodes them as one text.

        Its tokens are dealt to words by the bytes they stand for, or else by the character they begin with.
        """
        if not words:
            return
        text = b" ".join(words).decode()
        found = self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids
        count = self._counts_by_bytes(text, np.array(found, np.int64), len(words))
        if count is None:
            whole = self.whole.encode(text, add_special_tokens=False)
            ends = np.cumsum(np.fromiter((len(w.decode()) for w in words), np.int64, len(words)) + 1)
            first = np.fromiter(map(itemgetter(0), whole.offsets), np.int64, len(found))
            count = np.bincount(np.searchsorted(ends, first, side="right"), minlength=len(words))
        known = len(self.begin) - 1
        self.of_word.update(zip(words, range(known, known + len(words)), strict=True))
        self.begin.frombytes((len(self.flat) + np.cumsum(count)).astype(np.int64).tobytes())
        self.flat.extend(found)
        self.met.frombytes(bytes(4 * len(words)))

    def _places(self, c: Chunk) -> np.ndarray:
        """The place of each word of the chunk among the remembered ones."""
        _, first, which = np.unique(word_hashes(c), return_index=True, return_inverse=True)
        # Words of one hash are compared byte by byte with its first one; one that differs stands for itself.
        alone = np.flatnonzero(unlike(c, first[which]))
        raw, asked = c.data.tobytes(), np.append(first, alone)
        words = [raw[a:b] for a, b in zip(c.starts[asked].tolist(), c.ends[asked].tolist(), strict=True)]
        known = np.fromiter(map(self.of_word.get, words, repeat(-1)), np.int64, len(words))
        new = [words[i] for i in np.flatnonzero(known < 0).tolist()]
        if len(alone):
            new = list(dict.fromkeys(new))
        self._learn(new)
        if len(alone):
            known = np.fromiter(map(self.of_word.__getitem__, words), np.int64, len(words))
        else:
            known[known < 0] = np.arange(len(self.begin) - 1 - len(new), len(self.begin) - 1)
        if len(known):
            met = np.frombuffer(self.met, np.uint32)
            met[known] += 1
            del met  # the array behind it grows with the next chunk
        out = known[: len(first)][which]
        out[alone] = known[len(first) :]
        return out

    def encode(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's rows, and how many each row has."""
        if not self.by_word:
            found = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast([c.text(r).decode() for r in range(c.rows)], add_special_tokens=False)]
            return np.concatenate([*found, np.zeros(0, np.uint32)]), np.array([len(x) for x in found], np.int64)
        if len(self.of_word) > REMEMBERED:
            self.forget()
        which = self._places(c)
        flat, bounds = np.frombuffer(self.flat, np.uint32) if self.flat else np.zeros(0, np.uint32), np.frombuffer(self.begin, np.int64)
        begin, n = bounds[which], bounds[which + 1] - bounds[which]
        total = np.cumsum(n)
        at = np.repeat(begin - (total - n), n) + np.arange(total[-1] if len(total) else 0)
        ids = flat[at]
        of_row = np.diff(np.append(0, total)[c.word_offsets])
        del flat, bounds  # the arrays behind them grow with the next chunk
        return ids, of_row


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def document_ids(c: Chunk, path: str) -> Iterator[np.ndarray]:
    ids, n = encoder(path).encode(c)
    upto = np.append(0, np.cumsum(n))
    for row in range(c.rows):
        yield np.append(ids[upto[row] : upto[row + 1]].astype("<u4"), np.uint32(END_ID))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _local(folder: str) -> tuple[object, str]:
    """A file system and the folder's path in it."""
    from pyarrow import fs

    url = urlparse(folder)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), url.path
    return fs.FileSystem.from_uri(folder)


def write_shards(docs: DataFrame, folder: str, path: str | None = None, shards: int | None = None) -> DataFrame:
    """Write the documents' ids to shard files in ascending doc_id order; one manifest row a shard.

    There are as many shards as SHARD_BYTES ask for, twice the cores at least.

    A task writes its shard under a name of its own and then renames it, so a task that runs twice
    leaves one whole file. Null texts give the end id alone; null doc_ids come first, repeated ones
    in the order of a hash of their texts; columns but doc_id and text are not read.
    """
    spark = docs.sparkSession
    path = path or vocabulary_path()
    tie = F.xxhash64("text")
    total = 0 if shards else docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shards or max(2 * spark.sparkContext.defaultParallelism, -(-total // SHARD_BYTES))
    rows = docs.select("doc_id", "text", tie.alias("tie")).repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}.sst"
        files, root = _local(folder)
        files.create_dir(root, recursive=True)
        part = f"{root}/{name}.{task.taskAttemptId()}"
        least = most = None
        with files.open_output_stream(part) as out:
            writer = ShardWriter(out)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for c in chunks(batch.column(1)):
                    for row, found in enumerate(document_ids(c, path)):
                        key = key_bytes(ids[c.first + row])
                        least, most = key if least is None else least, key
                        writer.add(key, found)
            writer.finish()
        # Workers outlive their task: what they remember adds to the memory of later stages.
        encoder(path).forget()
        files.move(part, f"{root}/{name}")
        yield pa.RecordBatch.from_pylist(
            [{"shard": task.partitionId(), "file": name, "first_key": least, "last_key": most, "n_docs": len(writer.keys), "n_ids": writer.n_ids}],
            pa.schema([("shard", pa.int64()), ("file", pa.string()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
        )

    return rows.mapInArrow(write, "shard long, file string, first_key binary, last_key binary, n_docs long, n_ids long")


def read_shards(spark, folder: str, manifest: list) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone but for their list.

    ``manifest``: the rows that write_shards returned, one a shard.
    """
    tasks, before = [], 0
    for row in sorted(manifest, key=lambda r: r["shard"]):
        tasks.append((row["file"], before))
        before += row["n_ids"]
    plan = spark.createDataFrame(tasks, "file string, start long").repartition(max(1, len(tasks)), "file")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        files, root = _local(folder)
        for batch in batches:
            for task in batch.to_pylist():
                with files.open_input_file(f"{root}/{task['file']}") as source:
                    at, shard = task["start"], Shard(source)
                    for block in range(len(shard.blocks)):
                        out = []
                        for key, ids in shard.entries(block):
                            out.append((key_id(key), at, len(ids), zlib.crc32(ids.tobytes())))
                            at += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)

    return plan.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def find(folder: str, manifest: list, doc_id: int | None) -> list[np.ndarray]:
    """The ids of one document: binary search over the shards, then inside the shard that may hold it."""
    key = key_bytes(doc_id)
    files, root = _local(folder)
    rows = [r for r in sorted(manifest, key=lambda r: r["shard"]) if r["n_docs"]]
    low, high = 0, len(rows)
    while low < high:
        middle = (low + high) // 2
        if bytes(rows[middle]["last_key"]) < key:
            low = middle + 1
        else:
            high = middle
    found = []
    while low < len(rows) and bytes(rows[low]["first_key"]) <= key:
        with files.open_input_file(f"{root}/{rows[low]['file']}") as source:
            found += Shard(source).lookup(doc_id)
        low += 1
    return found


def token_table(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as shards (a new folder in the shared one unless given), and read them back.

    doc_id, start, n_tokens and ids_crc32 of each row of ``docs``. Null and empty texts hold the end id
    alone; null doc_ids come first, repeated ones in the order of a hash of their texts, and rows
    equal in both are written each; an empty table gives no row; more columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "tokens")
    return read_shards(spark, folder, write_shards(docs, folder).collect())


def op3_token_table(spark, sf_dir: str) -> DataFrame:
    return token_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
