"""Nulls, empty and repeated rows, ties, long texts, empty tables and clashing columns, for every operator."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatim.llm import decontaminate, license_scan, mixing, ngram_join, pii, quality, substring_dedup, token_table, toxicity, vector_search

LONG = "word " * 30_000 + "end"
ROWS = [(1, "alpha beta gamma delta epsilon", "s"), (1, "alpha beta gamma delta epsilon", "s"), (2, None, None), (3, "", "t"), (None, "zeta eta theta", "t"), (4, LONG, "s"), (5, " \t\n ", "s"), (6, "é ß 中文 \U0001f600 naïve", "t")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    # Names that the operators use inside.
    for name in ("tie", "n", "node", "component", "_tie", "start", "row", "words", "t1", "bucket", "size", "score", "lang"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None), (9, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "beta gamma delta epsilon"), (2, None), (3, ""), (4, "zeta eta"), (None, "beta gamma delta epsilon")], "item_id long, text string")


def test_mixing(docs):
    rows = mixing.balanced_take(docs).collect()
    assert len(rows) == len(ROWS) and all(r.copies <= 3 for r in rows)
    assert mixing.balanced_take(docs.limit(0)).count() == 0
    assert mixing.mix(docs).columns == docs.columns


def test_tokens(docs):
    rows = token_table.token_table(docs).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6]
    assert [r.n_tokens for r in rows if r.doc_id in (2, 3, 5)] == [1, 1, 1]
    assert token_table.token_table(docs.limit(0)).count() == 0


def test_substrings(docs):
    rows = substring_dedup.remove_repeats(docs).collect()
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in rows)
    assert got == [(0, 3, 0), (1, 5, 0), (1, 5, 0), (2, 0, 0), (3, 0, 0), (4, 30001, 30000), (5, 0, 0), (6, 5, 0)]
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0
    short = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.remove_repeats(docs, 3).collect())
    assert [n for d, n in short if d == 1] == [5, 5]


def test_ngram_join(docs):
    rows = ngram_join.similarity_classes(docs).collect()
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in rows)
    assert got == [(0, 1, None), (1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3), (4, 2, 4), (5, 0, 5), (6, 2, 6)]
    assert ngram_join.similarity_classes(docs.limit(0)).count() == 0
    kept = ngram_join.keep_one_each(docs)
    assert kept.columns == docs.columns and kept.count() == 7


def test_decontamination(docs, benchmark):
    rows = decontaminate.find_items(docs, benchmark).collect()
    assert sorted((r.doc_id, r.item_id or 0, r.score, r.first_word, r.last_word) for r in rows) == [(1, 0, 1.0, 1, 4), (1, 1, 1.0, 1, 4)]
    assert decontaminate.find_items(docs.limit(0), benchmark).count() == 0
    assert decontaminate.find_items(docs, benchmark.limit(0)).count() == 0
    kept = decontaminate.remove_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == 6


@pytest.mark.parametrize("module,score", [(toxicity, "score_toxicity"), (quality, "score_quality")])
def test_classifiers(docs, labels, module, score):
    model = module.train(docs, labels)
    rows = getattr(module, score)(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 5)}) == 1
    bare = getattr(module, score)(docs, module.train(docs, labels.limit(0)))
    assert bare.count() == len(ROWS) and getattr(module, score)(docs.limit(0), model).count() == 0


def test_keep_good(docs, labels):
    assert quality.keep_good(docs, quality.train(docs, labels)).columns == docs.columns
    assert quality.keep_good(docs, None).count() == len(ROWS)


def test_personal_data(docs):
    rows = pii.find_personal_data(docs, pii.Tagger()).collect()
    assert len(rows) == len(ROWS) and all(r.n_email == 0 for r in rows)
    assert pii.find_personal_data(docs.limit(0), pii.Tagger()).count() == 0


def test_licenses(docs):
    rows = license_scan.scan_licenses(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.labels) for r in rows)[2] == (1, 5, 0, None, "")
    assert len(rows) == len(ROWS) and license_scan.scan_licenses(docs.limit(0)).count() == 0


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [-1.0, 0.5]), (None, [1.0, 1.0]), (8, [float("inf"), 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("clash"))
    got = vector_search.search(vectors, vectors.filter("vec_id = 0")).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 7, -1.0)]
    assert vector_search.search(vectors.limit(0), vectors).count() == 0


def test_vectors_of_several_lengths_and_repeated_queries(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 30)] + [(40, [1.0, 2.0, 3.0]), (41, [1.0]), (5, [5.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.search(vectors, vectors.filter("vec_id in (5, 40)"), top=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(5, 1, 29, 146.0), (5, 2, 28, 141.0), (5, 3, 27, 136.0)]


def test_vectors_in_few_visited_lists(spark):
    """A query whose visited lists hold too few rows is run again over all."""
    rows = [(i, [1.0, 0.001 * i]) for i in range(64)] + [(100 + i, [-1.0, 0.001 * i]) for i in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.search(vectors, vectors.filter("vec_id = 1"), top=100, probes=1, lists=2).collect()
    assert len(got) == 100 and sum(r.vec_id < 100 for r in got) == 63


def test_index_of_many_lists_needs_little_memory():
    """The driver fits it: all distances of the sample to all lists would take 200 MB a copy."""
    x = np.random.default_rng(5).normal(size=(20_000, 8))
    tracemalloc.start()
    try:
        index = vector_search.Index(x, 1250)
        index.encode(x)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(index.coarse) == 1250 and most < 150e6


def test_fitting_sample_takes_different_rows_with_the_least_hashes(spark):
    vectors = spark.createDataFrame([(i % 500, [float(i % 500), 1.0]) for i in range(3000)], "vec_id long, embedding array<double>")
    least = vectors.distinct().orderBy(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 32)), "vec_id").limit(100).collect()
    assert vector_search.fitting_sample(vectors, 3000, 100).tolist() == [r.embedding for r in least]
    assert len(vector_search.fitting_sample(vectors, 3000, 1000)) == 500


def test_shards_hold_all_rows_of_all_lists():
    sizes = np.array([3, 0, 25, 4, 4, 10, 9, 1])
    first, n = vector_search.shards_of(sizes, 10)
    held = [set(range(a, a + m)) for a, m in zip(first, n, strict=True)]
    small = {}
    for size, shards in zip(sizes, held, strict=True):
        if len(shards) == 1:
            small[min(shards)] = small.get(min(shards), 0) + size
    assert list(n) == [1, 1, 3, 1, 1, 1, 1, 1] and max(small.values()) <= 10
    assert not held[2] & set(small)


@pytest.mark.parametrize("copies", [1, 3000])
def test_best_of_a_shard(copies):
    """Rows of unvisited lists and the query's own left out, ties of many copies to the smaller identifier."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(5000, 8)), np.repeat([[9.0, 0, 0, 0, 0, 0, 0, 0]], copies, axis=0)])
    ids = np.arange(len(x)) * 3
    index = vector_search.Index(x[rng.permutation(len(x))[:2000]], 20)
    lists, codes = index.encode(x)
    q = np.concatenate([x[:40], x[-1:]])
    query_ids = np.append(ids[:40], ids[-1])
    seen = rng.random((len(q), len(index.coarse))) < 0.6
    seen[-1] = True
    got = {}
    for a, b, c in zip(*vector_search.best_of_shard(index, ids, lists, codes, x, query_ids, q, np.packbits(seen, axis=1), 20, 100), strict=True):
        got.setdefault(a, []).append((-c, b))
    hits = 0
    for i, key in enumerate(query_ids):
        score = (x * q[i]).sum(axis=1)
        want = sorted((-score[j], ids[j]) for j in np.flatnonzero(seen[i][lists]) if ids[j] != key)[:20]
        assert len(got[key]) == 20 and got[key] == sorted(got[key])
        hits += len({*got[key]} & {*want})
    assert hits >= 0.98 * 20 * len(q)
    if copies > 1:
        assert [b for _, b in got[ids[-1]]] == ids[5000:5020].tolist()


def test_encoder_forgets_all_but_the_words_met_most(monkeypatch):
    import pyarrow as pa

    from verbatim.llm.textkit import chunks

    monkeypatch.setattr(token_table, "REMEMBERED", 60)
    monkeypatch.setattr(token_table.TextEncoder.forget, "__defaults__", (30,))
    own = token_table.TextEncoder(token_table.vocabulary_path())
    texts = [f"often seldom{i} again{i % 3} été {i}.5" for i in range(400)]
    got = []
    for at in range(0, 400, 20):
        for c in chunks(pa.array(texts[at : at + 20])):
            ids, n = own.encode(c)
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [own.whole.encode(t, add_special_tokens=False).ids for t in texts]
    own.forget(5)
    assert set(own.of_word) == {b"often", "été".encode(), b"again0", b"again1", b"again2"}
    assert len(own.met) == 5 and len(own.begin) == 6 and own.begin[-1] == len(own.flat)
    c = next(chunks(pa.array(texts[:20])))
    ids, n = own.encode(c)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == got[:20]
    own.forget(0)
    assert not own.of_word and not own.flat
