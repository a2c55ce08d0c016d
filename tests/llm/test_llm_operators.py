"""The operators against brute force, round trips and held-out labels."""

import hashlib
import io
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF_DIR

from verbatim.llm import decontaminate, license_scan, mixing, ngram_join, pii, quality, substring_dedup, token_table, toxicity
from verbatim.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return {r.doc_id: r.text or "" for r in rows}


def test_mix(spark):
    got = QUERIES["op1_mix_sources"](spark, SF_DIR).collect()
    again = QUERIES["op1_mix_sources"](spark, SF_DIR).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
    want, names, total = {}, sorted(size), sum(size.values())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    free, left = set(names), float(total)
    while True:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * size[s]}
        if not over:
            break
        want |= {s: 3.0 * size[s] for s in over}
        left -= sum(3.0 * size[s] for s in over)
        free -= over
    want |= {s: share * weight[s] for s in free}
    longest = max(r.size for r in got)
    for s in names:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= longest


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size, p = rng.integers(0, 900, 500).astype(float), np.full(500, 0.37)
    out = mixing.flight(size, p, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())
    mean = np.mean([mixing.land(size[:40], p[:40], np.random.default_rng(i)) for i in range(400)])
    assert mean == pytest.approx(0.37, abs=0.03)


def test_vectors(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    place = {v: i for i, v in enumerate(ids.tolist())}
    hits = total = 0
    got: dict[int, list] = {}
    for r in QUERIES["op2_vector_search"](spark, SF_DIR).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    for q in ids[ids % 20 == 0].tolist():
        score = x @ x[place[q]]
        score[place[q]] = -np.inf
        best = sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:20]
        found = got[q]
        assert [r.rank for r in found] == list(range(1, 21))
        assert all(r.score == pytest.approx(float(score[place[r.vec_id]]), abs=1e-12) for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & {int(ids[i]) for i in best})
        total += 20
    assert hits / total >= 0.9


def test_token_table(spark, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_table.vocabulary_path())
    got = {r.doc_id: r for r in QUERIES["op3_token_table"](spark, SF_DIR).collect()}
    at = 0
    for doc_id, text in texts.items():
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 2], "<u4")
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


ODD = ["don't", "It'S", "naïve", "A1b22", "<|endoftext|>", "x<|startoftext|>y", "İstanbul", "ΣΑΣ", "中文", "é", "e\u0301 \u0301x", " a", "...!?", "\U0001f600", "ﬁn", "a\u00a0b\u3000c\u2028d", "\x1c\x85x", "'S 's t'ree", ""]


def test_texts_encode_as_the_library_does():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from verbatim.llm.textkit import chunks

    rng = np.random.default_rng(14)
    pool = [*"abcXYZ 019'.,!<|>-_\n\t\u0301\u00a0\u3000ßéİσς中\U0001f600\u200d٣Ⅷ"]
    texts = [*ODD, " ".join(ODD), *("".join(rng.choice(pool, 80)) for _ in range(2000))]
    path = token_table.vocabulary_path()
    whole, own = Tokenizer.from_file(path), token_table.TextEncoder(path)
    assert own.by_word
    for by_word in (True, False):
        own.by_word = by_word
        got = []
        for c in chunks(pa.array(texts), size=5000):
            ids, n = own.encode(c)
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa

    from verbatim.llm.textkit import chunks

    path = token_table.vocabulary_path()
    own, whole = token_table.TextEncoder(path), token_table.TextEncoder(path).whole
    monkeypatch.setattr(token_table, "word_hashes", lambda c: (c.ends - c.starts).astype(np.uint64) // np.uint64(3))
    text = "the cat sat on a mat with nine other cats and dogs"
    (c,) = chunks(pa.array([text]))
    assert own.encode(c)[0].tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("words", [["0", "\u00a0", "a", "b\u00a0c"], ["a", "\u3000", "x\u2028", "é"], ["Éa", "I\u0307", "ßé", "中'S", "e\u0301"], ["<|endoftext|>", "x"]])
def test_tokens_are_dealt_to_their_words(words):
    own = token_table.TextEncoder(token_table.vocabulary_path())
    own._learn([w.encode() for w in words])
    dealt = [list(own.flat[a:b]) for a, b in zip(own.begin[:-1], own.begin[1:], strict=True)]
    assert dealt == [own.whole.encode(w, add_special_tokens=False).ids for w in words]


def test_long_words_of_one_hash_are_told_apart():
    import pyarrow as pa

    from verbatim.llm.textkit import chunks

    words = ["a" * 8, "a" * 7 + "b", "a" * 9, "a" * 64, "a" * 100, "a" * 99 + "b", "a" * 100, "a" * 8]
    (c,) = chunks(pa.array([" ".join(words)]))
    for first in range(len(words)):
        assert token_table.unlike(c, np.full(len(words), first)).tolist() == [w != words[first] for w in words]


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a b": 0, "x": 1}, unk_token="x"))
    assert not token_table.joins_nothing(other)
    other.pre_tokenizer = pre_tokenizers.ByteLevel()
    assert not token_table.joins_nothing(other)


def test_shard_lookup():
    out = io.BytesIO()
    writer = token_table.ShardWriter(out, block_bytes=64)
    rows = [(None, [9]), (-5, [1, 2]), (3, list(range(70_000, 70_020))), (3, [7]), *[(i, [i]) for i in range(10, 200, 2)]]
    for doc_id, ids in rows:
        writer.add(token_table.key_bytes(doc_id), np.array(ids, np.int64))
    writer.finish()
    shard = token_table.Shard(out)
    assert [(token_table.key_id(k), v.tolist()) for k, v in shard] == rows
    assert len(shard.blocks) > 3 and shard.n_docs == len(rows)
    assert [x.tolist() for x in shard.lookup(3)] == [rows[2][1], [7]]
    assert [x.tolist() for x in shard.lookup(None)] == [[9]] and shard.lookup(11) == [] and shard.lookup(1000) == []
    assert sum(shard.may_hold(i) for i in range(11, 2011, 2)) < 60
    with pytest.raises(ValueError):
        writer.add(token_table.key_bytes(1), np.array([1]))


def brute_alignment(item, text):
    best = 0
    score = np.zeros((len(item) + 1, len(text) + 1), int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            score[i, j] = max(0, score[i - 1, j - 1] + (2 if a == b else -1), score[i - 1, j] - 1, score[i, j - 1] - 1)
            best = max(best, score[i, j])
    return best


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(40):
        item, text = rng.integers(1, 6, rng.integers(1, 12)).astype(np.uint64), rng.integers(1, 6, rng.integers(1, 20)).astype(np.uint64)
        best, first, end = decontaminate.align(item[None], text[None])
        assert best[0] == brute_alignment(item, text)
        if best[0]:
            assert brute_alignment(item, text[first[0] : end[0]]) == best[0]


def test_edited_copies(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    items = [[str(x) for x in rng.choice(words, 40)] for _ in range(6)]
    docs = []
    for i, item in enumerate(items):
        edited = [w if k % 8 else "changed" for k, w in enumerate(item)]
        del edited[13]
        docs.append((i, " ".join([*rng.choice(words, 300), *edited, *rng.choice(words, 300)])))
        docs.append((100 + i, " ".join(rng.choice(words, 600))))
    found = decontaminate.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, i) for i in range(6)]
    assert all(abs(r.first_word - 301) <= 2 for r in found)


def test_edited_copies_from_half_a_score(spark):
    """Every aligned copy of 0.5 to 0.8 that holds three equal words in a row is found, with its score."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    items = [[str(x) for x in rng.choice(words, 40)] for _ in range(12)]
    edits = [lambda x: [w if (k + 1) % 4 else "changed" for k, w in enumerate(x)], lambda x: [w if (k + 1) % 5 else "changed" for k, w in enumerate(x)]]
    edits += [lambda x: x[:20], lambda x: x[:21], lambda x: x[12:40], lambda x: [y for k, w in enumerate(x) for y in ([w, "more"] if k % 3 == 2 else [w])]]
    edits += [lambda x: [*x[:20], *["more"] * 30, *x[20:]]]
    edits += [lambda x: [w if rng.random() < 0.82 else "changed" for w in x]] * 3
    texts = [[str(w) for w in [*rng.choice(words, 90), *edit(item), *rng.choice(words, 90)]] for edit in edits for item in items]
    number = {w: i for i, w in enumerate([*words, "changed", "more"], 1)}
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            best = brute_alignment([number[w] for w in item], [number[w] for w in text]) if d % len(items) == i else 0
            if best >= 40 and {*zip(item, item[1:], item[2:], strict=False)} & {*zip(text, text[1:], text[2:], strict=False)}:
                want[d, i] = best / 80
    assert len(want) > 90 and sum(0.5 <= x <= 0.8 for x in want.values()) > 80
    docs = spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(texts)], "doc_id long, text string")
    found = decontaminate.find_items(docs, spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.score for r in found} == want


def test_short_items_and_repeating_texts(spark):
    """Items below a seed's length are whole documents; a text of one trigram over and over is aligned in parts."""
    items = spark.createDataFrame([(1, "Alpha"), (2, "alpha beta"), (3, " ".join(f"i{k}" for k in range(20))), (4, "again and " * 9)], "item_id long, text string")
    item = " ".join(f"i{k}" for k in range(20))
    docs = [(1, "alpha!"), (2, "ALPHA, beta"), (3, "alpha beta gamma"), (4, "again and " * 60_000 + item), (5, "i0 i1 i2 " * 40_000), (6, "x " * (decontaminate.STRETCH - 8) + item + " y" * 50_000)]
    found = {(r.doc_id, r.item_id): (r.score, r.first_word) for r in decontaminate.find_items(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert {k: v for k, v in found.items() if k[0] != 4} == {(1, 1): (1.0, 0), (2, 2): (1.0, 0), (6, 3): (1.0, decontaminate.STRETCH - 8)}
    assert found[4, 4] == (1.0, 0) and found[4, 3] == (1.0, 120_000)


def test_benchmark_passages(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    exact = {(d, i) for d, t in texts.items() for i, u in items.items() if u in t}
    assert exact <= {(r.doc_id, r.item_id) for r in QUERIES["op4_decontaminate"](spark, SF_DIR).collect()}


@pytest.mark.parametrize("name,label,least", [("op5_toxicity", "toxic", 0.9), ("op6_quality", "quality", 0.95)])
def test_held_out(spark, name, label, least):
    folder = SF_DIR.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES[name](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) >= least
    assert np.mean([a for a, b in held if b]) >= 0.75


def test_exact_neighbours():
    rng = np.random.default_rng(3)
    vectors = rng.random((500, 30)) * (rng.random((500, 30)) < 0.2)
    vectors /= np.maximum(1e-12, np.sqrt((vectors**2).sum(1)))[:, None]
    vectors[100] = vectors[5]
    places = [np.flatnonzero(v) for v in vectors]
    index = toxicity.BlockMaxIndex(places, [v[at] for v, at in zip(vectors, places, strict=True)], 30)
    for q in vectors[:40]:
        at = np.flatnonzero(q)
        found, cosine = index.nearest(at, q[at], 10)
        score = vectors[:, at] @ q[at]
        want = [i for i in sorted(range(500), key=lambda i: (-round(score[i], 12), i))[:10] if score[i] > 0]
        assert cosine == pytest.approx(score[want]) and set(found) == set(want)


def test_attention_gradient():
    rng = np.random.default_rng(5)
    model = quality.AttentionModel(6)
    n, y, w = np.array([3, 1, 4]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    x = rng.normal(size=(8, 6))

    def loss():
        logit, *_ = model.forward(x, n)
        return float((w * (np.log1p(np.exp(logit)) - y * logit)).sum() / 3)

    for k, g in model.gradient(x, n, y, w).items():
        flat = model.p[k].reshape(-1)
        for i in range(0, len(flat), 7):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert g.reshape(-1)[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def reference_spans(text):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_fixed_patterns(texts):
    odd = ["+b.c+d@e.f a@b.c+d@e.f", "1.2.3.4.5.6.7.8 01.2.3.004", "4-4 5 6", "@@a@b..c a@b.c.", "+1(((5 +12 3456789 012", "x@y.z@w.v", "é@a.b ü+49 151 2345678", "4111 1111 1111 1111-4111111111111111"]
    rng = np.random.default_rng(6)
    odd += ["".join(rng.choice(list("a1@.+- 25"), 60)) for _ in range(300)]
    for text in [*odd, *texts.values()]:
        assert pii.base_spans(text) == reference_spans(text)


def test_tagger_gradient():
    rng = np.random.default_rng(7)
    tagger = pii.Tagger()
    code, tags = rng.integers(0, pii.CLASSES, (3, 7)), rng.integers(0, pii.TAGS, (3, 7))

    def loss():
        e, _ = tagger.emissions(code)
        a = e[:, 0] + tagger.p["s"]
        gold = a[np.arange(3), tags[:, 0]].copy()
        for t in range(1, 7):
            a = e[:, t] + pii._logsum(a[:, :, None] + tagger.p["t"], 1)
            gold += tagger.p["t"][tags[:, t - 1], tags[:, t]] + e[np.arange(3), t, tags[:, t]]
        return float((pii._logsum(a, 1) - gold).sum() / 3)

    for k, g in tagger.gradient(code, tags).items():
        flat = tagger.p[k].reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 6)):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert g.reshape(-1)[i] == pytest.approx((up - down) / 2e-5, abs=2e-5)


def test_tagger_finds_held_out_spans():
    tagger = pii.trained()
    found = made = right = 0
    for text, spans in pii.training_text(200, seed=99):
        tags = tagger.decode(tagger.emissions(pii.classes(text)[None])[0])[0]
        got, t = set(), 0
        while t < len(tags):
            start = t
            t += 1
            if tags[start]:
                kind = int(tags[start] - 1) // 2
                while t < len(tags) and tags[t] == 2 + 2 * kind:
                    t += 1
                got.add((start, t, kind))
        spans = {(max(0, a), b, k) for a, b, k in spans}
        found, made, right = found + len(got), made + len(spans), right + len(got & spans)
    assert right / found > 0.7 and right / made > 0.7


def test_tagger_finds_a_span_at_any_offset(texts):
    """Spans longer than the windows' overlap, cut by a window's edge at most offsets."""
    tagger, filler = pii.trained(), next(t for t in texts.values() if len(t) > 500 and not pii.base_spans(t) and not any(x.isdigit() or x == "@" for x in t))
    filler = filler.replace("\n", " ")
    for piece, kind in (("mora.stei.anchle99 @ er-anti.timole.com", 0), ("rast.mochle@er-antiö.timole.de", 0)):
        hits = 0
        for offset in range(150, 150 + pii.STRIDE):
            text = f"{filler[:offset]} {piece} {filler[offset : offset + 200]}"
            (added,) = pii.added_spans([text], [pii.base_spans(text)], tagger)
            hits += any(a <= offset + 4 and b >= offset + 1 + len(piece) - 3 and k == kind for a, b, k in added)
        assert hits >= 0.9 * pii.STRIDE, (piece, hits)


def test_tagger_in_documents(texts):
    """Forms that the fixed patterns miss, put into real texts: found, and little else."""
    tagger, rng = pii.trained(), np.random.default_rng(16)
    pieces = [(t[a:b], k) for t, spans in pii.training_text(1500, seed=123) for a, b, k in spans if a > 0 and b < pii.WINDOW - 1]
    pieces = [(p, k) for p, k in pieces if pii.fits(k, p) and not any(x == 0 and y == len(p) for x, y, _ in pii.base_spans(p))][:200]
    prose = [t for t in texts.values() if 200 < len(t) < 4000]
    hits = wrong = 0
    for i, (piece, kind) in enumerate(pieces):
        text = prose[i % len(prose)]
        at = text.index(" ", int(rng.integers(0, len(text) // 2)))
        text = f"{text[:at]} {piece}{text[at:]}"
        (added,) = pii.added_spans([text], [pii.base_spans(text)], tagger)
        hit = [k == kind and a <= at + 3 and b >= at + len(piece) - 1 for a, b, k in added]
        hits, wrong = hits + any(hit), wrong + len(hit) - any(hit)
    assert hits >= 0.5 * len(pieces) and wrong <= 0.3 * len(pieces), (hits, wrong, len(pieces))


def test_personal_data_rows(spark, texts):
    for r in pii.find_personal_data(spark.read.parquet(f"{SF_DIR}/documents.parquet")).collect():
        base = reference_spans(texts[r.doc_id])
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))


@pytest.mark.parametrize("length", [5, 35])
def test_substrings(spark, texts, length):
    words = {d: WORD.findall(t.encode()) for d, t in texts.items()}
    seen = Counter(tuple(w[i : i + length]) for w in words.values() for i in range(len(w) - length + 1))
    for r in substring_dedup.remove_repeats(spark.read.parquet(f"{SF_DIR}/documents.parquet"), length).collect():
        w = words[r.doc_id]
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = True
        assert (r.n_words, r.n_removed, r.kept) == (len(w), gone.sum(), b" ".join(x for x, g in zip(w, gone, strict=True) if not g))


@pytest.mark.parametrize("bits", [21, 3])
def test_windows_met_again_by_one_task(bits, monkeypatch):
    """Runs of texts that one task reads after another, with room for all hashes or for eight."""
    import pandas as pd
    import pyarrow as pa

    monkeypatch.setattr(substring_dedup._Sent.__init__, "__defaults__", (bits,))
    rng = np.random.default_rng(15)
    passage = [f"p{i}" for i in range(12)]
    texts = [" ".join([*(str(x) for x in rng.integers(0, 400, 20)), *(passage if i % 3 == 0 else []), *(str(x) for x in rng.integers(0, 400, 9))]) for i in range(60)]
    texts += texts[:5]
    batches = [pa.RecordBatch.from_arrays([pa.array([hash(t) for t in part]), pa.array([len(t) for t in part]), pa.array(part)], ["t1", "t2", "text"]) for part in (texts[i : i + 4] for i in range(0, len(texts), 4))]
    sent = pd.concat([b.to_pandas() for b in substring_dedup._send(5, 4)(iter(batches))])
    masks = pd.concat([substring_dedup._count(part) for _, part in sent.groupby("bucket")])
    got = {(t1, start + bit) for t1, start, mask in zip(masks["t1"], masks["start"], masks["mask"], strict=True) for bit in range(substring_dedup.RUN) if mask >> bit & 1}
    words = [t.split() for t in texts]
    seen = Counter(tuple(w[i : i + 5]) for w in words for i in range(len(w) - 4))
    assert got == {(hash(t), i) for t, w in zip(texts, words, strict=True) for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1}
    if bits == 21:  # the shared passage's windows reach their buckets twice at most
        assert Counter(np.frombuffer(b"".join(sent["hashes"]), "<u8").tolist()).most_common(1)[0][1] == 2


def brute_components(sets, need, of):
    part = {d: d for d in sets}

    def find(d):
        while part[d] != d:
            d = part[d]
        return d

    holds: dict = {}
    for d, s in sets.items():
        both = Counter(e for g in s for e in holds.get(g, ()))
        for e, n in both.items():
            if of * n >= need * (len(s) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                part[b] = a
        for g in s:
            holds.setdefault(g, []).append(d)
    return {d: find(d) for d in sets}


def shingles(text, k):
    w = WORD.findall(text.translate(LOWER).encode())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k,need,partitions", [(4, 85, 1), (5, 80, 1), (5, 80, 60)])
def test_similarity_join(spark, texts, k, need, partitions):
    """Groups of more than PAIRED members, met in one run of texts (one partition) or only in their bucket (sixty)."""
    rng = np.random.default_rng(8)
    own = dict(texts)
    base = [str(x) for x in rng.integers(0, 50, 60)]
    for i in range(150):  # a chain of edits, sizes from one word on, and a group with more members than PAIRED
        base = [*base[:-1], str(rng.integers(0, 50))] if i % 3 else [str(rng.integers(0, 50)), *base[1:]]
        own[10_000 + i] = " ".join(base)
        own[20_000 + i] = " ".join(f"x{j}" for j in range(i % 40))
        own[30_000 + i] = " ".join(f"y{j}" if j != i else "z" for j in range(200))
    sets = {d: shingles(t, k) for d, t in own.items()}
    want = brute_components(sets, need, 100)
    rows = ngram_join.similarity_classes(spark.createDataFrame(list(own.items()), "doc_id long, text string").repartition(partitions), k, need, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {d: (len(sets[d]), want[d]) for d in own}


@pytest.mark.parametrize("partitions", [1, 50])
def test_similarity_join_of_a_hot_piece(spark, partitions):
    """A third of all sets have most pieces in common with a text, in three families that are apart; 31 to 34 copies lie on both sides of PAIRED."""
    rng = np.random.default_rng(12)
    own = {i: " ".join(str(x) for x in rng.integers(0, 3000, 60)) for i in range(500)}
    for f in range(3):
        base = [f"hot{j}" for j in range(200)]
        base[f * 66 : f * 66 + 60] = [f"f{f}w{j}" for j in range(60)]
        for i in range(90):
            text = list(base)
            for at in rng.integers(0, 200, i % 5):
                text[at] = f"e{i}"
            own[1000 + 100 * f + i] = " ".join(text)
    for n in range(31, 35):
        for i in range(n):
            own[5000 + 100 * n + i] = " ".join([f"p{n}x{j}" for j in range(120)] + [f"q{i}"])
    sets = {d: shingles(t, 4) for d, t in own.items()}
    want = brute_components(sets, 85, 100)
    docs = spark.createDataFrame(list(own.items()), "doc_id long, text string").repartition(partitions)
    assert {r.doc_id: r.component_id for r in ngram_join.similarity_classes(docs).collect()} == want


def test_similarity_join_of_a_common_passage(spark, monkeypatch):
    """Texts that have two thirds of their n-grams in common, which links none of them, aren't grouped by them; one in ten has a linked copy."""
    passage = " ".join(f"c{j}" for j in range(16))
    own = {i: f"{passage} " + " ".join(f"d{i}x{j}" for j in range(6)) for i in range(400)}
    own |= {1000 + i: own[i].rsplit(" ", 1)[0] + " z" for i in range(0, 400, 10)}
    compared = []

    def spy(df, cut=ngram_join.cut):
        out = cut(df)
        if "hub_component" in out.columns:
            compared.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "cut", spy)
    sets = {d: shingles(t, 4) for d, t in own.items()}
    rows = ngram_join.similarity_classes(spark.createDataFrame(list(own.items()), "doc_id long, text string").repartition(8)).collect()
    assert {r.doc_id: r.component_id for r in rows} == brute_components(sets, 85, 100)
    assert sum(compared) < len(own) // 4


def test_licenses(spark, texts):
    for r in QUERIES["op10_license_scan"](spark, SF_DIR).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id].translate(LOWER))
        places = [(i, label) for label, p in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        names = sorted({x for _, x in places})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(names))
        assert set(names) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_edited_license(spark):
    text = "x Redistribution and use in source and binary forms, with or without any modification, are permitted y"
    row = license_scan.scan_licenses(spark.createDataFrame([(1, text), (2, "use in forms")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert row[0].labels == "bsd" and row[0].score > 0.8 and row[1].labels == ""


def test_pipeline(spark):
    import corpus_pipeline

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    good = corpus_pipeline.good_documents(spark, docs, SF_DIR)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert np.mean([(d in kept) == bool(q) for d, q in labels.items()]) > 0.9
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert 0 < len(rows) and sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)


def test_passages_see_the_words():
    """Two texts of one shape and other words have other passages."""
    import pyarrow as pa

    from verbatim.llm.textkit import chunks

    (c,) = chunks(pa.array(["plain words stand here", "other terms came there"]))
    n, x = quality.passages(c)
    assert n.tolist() == [1, 1] and np.abs(x[0, quality.SHAPE :] - x[1, quality.SHAPE :]).max() > 0.2


def test_similarity_join_keeps_no_room(spark, monkeypatch):
    """Candidate pairs are told apart by sketches before n-grams are moved, cells are counted in bounded rows, and what was written on the way is deleted."""
    from pathlib import Path

    import pyarrow as pa

    common = [f"c{i}" for i in range(60)]
    own = {i: " ".join([f"v{i}x{j}" for j in range(40)] + common) for i in range(48)}
    own |= {100 + i: own[i] + " end" for i in range(4)}
    asked, seen, grams = [], [], ngram_join._sets
    monkeypatch.setattr(ngram_join, "_sets", lambda k: asked.append(k) or grams(k))

    def spy(df, cut=ngram_join.cut):
        out = cut(df)
        seen.append((df.columns, out.count(), out.inputFiles()))
        return out

    monkeypatch.setattr(ngram_join, "cut", spy)
    rows = ngram_join.similarity_classes(spark.createDataFrame(list(own.items()), "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: i % 100 for i in own}
    moved = [n for columns, n, _ in seen if columns == ["node", "members"]]
    assert moved and max(moved) <= len(own)
    exact = [n for columns, n, _ in seen if columns == ["a", "b"]]
    assert max(exact[1:]) <= len(own)  # the first are the candidates, before sketches
    counts = list(ngram_join._count_cells([pa.RecordBatch.from_arrays([pa.array([list(range(0, 1 << 24, 37))], pa.list_(pa.int64()))], ["members"])]))
    assert sum(len(batch) for batch in counts) <= 256
    left = [columns for columns, _, files in seen if any(Path(f.removeprefix("file:")).exists() for f in files)]
    assert not any({"members", "sketch", "text"} & set(columns) for columns in left)


@pytest.mark.parametrize("together", [1 << 20, 10])
def test_components(spark, monkeypatch, together):
    """Chains, stars, rings and pairs, with names dealt at random, brought together by one task or in rounds."""
    from verbatim.llm import components

    rng = np.random.default_rng(3)
    names = rng.permutation(np.arange(-500, 500)).tolist()
    links = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 300)] + [(i, 300 + (i + 1 - 300) % 50) for i in range(300, 350)] + [(i, i + 1) for i in range(400, 600, 2)] + [(700, 700)]
    links = [(names[a], names[b]) if i % 2 else (names[b], names[a]) for i, (a, b) in enumerate(links)] * 2
    monkeypatch.setattr(components, "TOGETHER", together)
    found = components.connected(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()
    least = {x: x for link in links for x in link if link[0] != link[1]}
    while True:
        after = dict(least)
        for a, b in links:
            if a != b:
                after[a] = after[b] = min(after[a], after[b])
        if after == least:
            break
        least = after
    assert len(found) == len(least) and {r.node: r.component for r in found} == least


def test_links_are_reduced_in_parts(monkeypatch):
    """More links than a task holds at once: what is handed on connects the same nodes."""
    import pyarrow as pa

    from verbatim.llm import components

    monkeypatch.setattr(components, "TOGETHER", 64)
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 3000, 2000), rng.integers(0, 3000, 2000)
    batches = list(components._fewer(pa.RecordBatch.from_arrays([pa.array(a[i : i + 150]), pa.array(b[i : i + 150])], ["a", "b"]) for i in range(0, 2000, 150)))
    left = [np.concatenate([x.column(i).to_numpy() for x in batches]) for i in (0, 1)]
    assert len(batches) > 1 and (left[0] > left[1]).all()
    nodes, least = components.least_reached(a[a != b], b[a != b])
    again = components.least_reached(*left)
    assert nodes.tolist() == again[0].tolist() and least.tolist() == again[1].tolist()
    assert len(list(components._together(iter([])))[0]) == 0


def test_components_of_few_links_are_not_shuffled(spark):
    """Their tasks don't grow with the number of shuffle partitions."""
    from verbatim.llm import components

    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {x: spark.conf.get(x) for x in settings}
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    try:
        for x, value in settings.items():
            spark.conf.set(x, value)
        context.setJobGroup("few links", "")
        assert components.connected(spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long").repartition(4)).count() == 301
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for x, value in before.items():
            spark.conf.set(x, value)
    stages = {s for j in tracker.getJobIdsForGroup("few links") for s in tracker.getJobInfo(j).stageIds}
    ran = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    assert 0 < ran < 40
