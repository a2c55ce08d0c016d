"""Registered queries of the library's own operators, and their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dates, keys, text
from .operators import census, cluster, dedup, evidence, intervals, nested, panels, reconcile, sampling, search, segment, snapshot, stats

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def keep(query):
        QUERIES[query.__name__] = query
        if sql:
            ORACLE_SQL[query.__name__] = sql
        return query

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOLDED = "strip_accents(coalesce(text, ''))"
_WORDS = r"len(regexp_extract_all(strip_accents(coalesce(text, '')), '\p{L}[\p{L}\p{N}_]*'))"


def _has(term: str) -> str:
    words = r"\s+".join(term.split())
    return rf"regexp_matches({_FOLDED}, '(?i)(^|[^\p{{L}}\p{{N}}_]){words}($|[^\p{{L}}\p{{N}}_])')"


@registered(
    f"""
    WITH d AS (SELECT lang, {_WORDS} AS w, (({_has('the')}) OR ({_has('de la')})) AND NOT ({_has('den')}) AS hit FROM documents)
    SELECT lang, count(*) AS documents, CAST(sum(w) AS BIGINT) AS words, count(*) FILTER (hit) AS hits,
           count(*) FILTER (hit) / count(*) AS per_document,
           CASE WHEN sum(w) > 0 THEN 1000.0 * count(*) FILTER (hit) / sum(w) ELSE 0.0 END AS per_1000_words
    FROM d GROUP BY lang
    """
)
def search_yearly_metrics(spark, sf_dir):
    return search.yearly_metrics(table(spark, sf_dir, "documents"), 'the -den OR "de la"', "lang")


@registered(f"SELECT doc_id, lang FROM documents WHERE {_has('of the')} ORDER BY n_chars DESC, doc_id")
def search_phrase(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.filter(search.matches(text.strip_accents(F.col("text")), '"of the"')).select("doc_id", "lang")


@registered("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang ILIKE '%e%' AND source ILIKE '%src1%' ORDER BY doc_id DESC NULLS LAST LIMIT 100")
def filtered_topk(spark, sf_dir):
    rows, _ = search.filtered(table(spark, sf_dir, "documents"), {"lang": "e", "source": "src1", "nowhere": "x"})
    return search.top(search.compact(rows, ["doc_id", "lang", "source", "n_chars", "text"], text="text"), "doc_id")


@registered("SELECT DISTINCT source AS value FROM documents WHERE source <> '' ORDER BY 1")
def filter_options(spark, sf_dir):
    return search.options(table(spark, sf_dir, "documents"), "source")


@registered(
    f"""
    SELECT doc_id, {_WORDS} AS n_words, {_FOLDED} AS folded, strlen(text) AS n_bytes, length(text) AS n_letters, sha256(text) AS text_sha256
    FROM documents
    """
)
def text_measures(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.word_count(t).alias("n_words"), text.strip_accents(t).alias("folded"), F.octet_length(t).cast("long").alias("n_bytes"),
        F.length(t).cast("long").alias("n_letters"), F.sha2(t, 256).alias("text_sha256"),
    )


@registered(
    """
    SELECT doc_id, substr(text, 1, 100) || substr(text, greatest(length(text) - 199, 1)) AS excerpt, length(text) - 300 AS omitted
    FROM documents WHERE length(text) > 300
    """
)
def long_text_excerpts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 300)
    cut = text.head_tail(F.col("text"), 300)
    return docs.select("doc_id", cut["excerpt"].alias("excerpt"), cut["omitted"].cast("long").alias("omitted"))


@registered(
    """
    SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, count(*) FILTER (o_orderkey IS NULL) AS n_missing,
           min(o_orderdate) AS first_day, max(o_orderdate) AS last_day,
           count(*) FILTER (o_orderstatus IS DISTINCT FROM 'F') AS not_o_orderstatus
    FROM orders
    """
)
def base_census(spark, sf_dir):
    return census.base_census(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate", {"o_orderstatus": "F"})


@registered("SELECT coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, count(*) AS n_rows FROM documents GROUP BY ALL")
def language_source_census(spark, sf_dir):
    return census.counts_by(table(spark, sf_dir, "documents"), "lang", "source")


@registered(
    """
    SELECT 'l_returnflag' AS dimension, l_returnflag AS value, count(*) AS n_rows FROM lineitem GROUP BY ALL
    UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY ALL
    """
)
def category_frequencies(spark, sf_dir):
    return census.category_frequencies(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@registered("SELECT count(DISTINCT k) AS n_keys FROM (SELECT CAST(doc_id AS VARCHAR) k FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR) FROM labels)")
def global_distinct_ids(spark, sf_dir):
    return census.distinct_over([table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")], "doc_id")


@registered("SELECT count(*) AS n_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_extra FROM (SELECT text, count(*) n FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicate_texts(spark, sf_dir):
    return census.duplicate_keys(table(spark, sf_dir, "documents"), "text")


@registered(
    """
    WITH k AS (SELECT DISTINCT event_type g, user_id k FROM events)
    SELECT a.g AS left_group, b.g AS right_group, count(*) AS n_keys FROM k a JOIN k b ON a.k = b.k AND a.g < b.g GROUP BY ALL
    """
)
def pairwise_overlap(spark, sf_dir):
    return census.pairwise_overlap(table(spark, sf_dir, "events"), "event_type", "user_id")


@registered(
    """
    SELECT o_orderpriority, count(*) AS n_rows, count(*) FILTER (d BETWEEN DATE '1994-01-01' AND DATE '1996-12-31') AS within,
           count(*) FILTER (d < DATE '1994-01-01') AS before, count(*) FILTER (d > DATE '1996-12-31') AS after, count(*) FILTER (d IS NULL) AS invalid
    FROM (SELECT *, CAST(o_orderdate AS DATE) d FROM orders) GROUP BY ROLLUP (o_orderpriority)
    """
)
def date_cut_conservation(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    _, where = census.date_cut(orders, "o_orderdate", "1994-01-01", "1996-12-31")
    return census.conservation(orders, where, "o_orderpriority")


@registered(
    """
    SELECT doc_id, concat_ws(',', CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN contains(text, '@') THEN 'address' END) AS flags
    FROM documents
    """
)
def quality_flags(spark, sf_dir):
    flags = census.quality_flags(short=F.length("text") < 200, foreign=F.col("lang") != "en", address=F.contains("text", F.lit("@")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(flags, ",").alias("flags"))


@registered(
    """
    WITH s AS (SELECT unnest(generate_series(1990, 2000)) y)
    SELECT CAST(y AS BIGINT) AS year, count(o_orderkey) FILTER (o_orderstatus = 'F') AS "F", count(o_orderkey) FILTER (o_orderstatus = 'O') AS "O"
    FROM s LEFT JOIN orders ON year(o_orderdate) = y GROUP BY y
    """
)
def coverage_matrix(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return census.coverage_matrix(orders, "year", "o_orderstatus", ["F", "O"], 1990, 2000)


@registered(
    """
    WITH s AS (SELECT unnest(generate_series(1990, 2000)) y), g AS (SELECT unnest(['F', 'O']) g)
    SELECT CAST(y AS BIGINT) AS year, g AS "group", count(o_orderkey) AS n_rows FROM s CROSS JOIN g LEFT JOIN orders ON year(o_orderdate) = y AND o_orderstatus = g
    GROUP BY y, g HAVING count(o_orderkey) = 0
    """
)
def missing_coverage(spark, sf_dir):
    return census.missing_coverage(coverage_matrix(spark, sf_dir), "year")


@registered(
    """
    SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_subjects, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
           round(stddev_samp(value), 6) AS deviation, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90
    FROM events GROUP BY event_type
    """
)
def descriptive_panel(spark, sf_dir):
    panel = panels.descriptive_panel(table(spark, sf_dir, "events"), "value", "user_id", "event_type")
    return panel.select("event_type", "n_rows", "n_subjects", *[F.round(c, 4 if c == "total" else 6).alias(c) for c in ("total", "mean", "median", "deviation", "p25", "p75", "p90")])


@registered(
    """
    WITH p AS (SELECT o_orderpriority, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY ALL)
    SELECT o_orderpriority, CAST(year AS INT) AS year, n, n - lag(n) OVER (PARTITION BY o_orderpriority ORDER BY year) AS difference,
           1000.0 * n / sum(n) OVER (PARTITION BY year) AS share, n - median(n) OVER (PARTITION BY o_orderpriority) AS from_median FROM p
    """
)
def period_changes(spark, sf_dir):
    panel = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    out = panels.deviation_from_median(census.share_of_total(panels.period_difference(panel, "n", "year", "o_orderpriority"), "n", "year"), "n", "o_orderpriority")
    return out.select("o_orderpriority", "year", "n", "difference", "share", F.col("from_median"))


@registered(
    """
    SELECT o_orderpriority, count(*) AS n, round(regr_slope(c, y), 6) AS slope, round(regr_intercept(c, y), 3) AS intercept
    FROM (SELECT o_orderpriority, year(o_orderdate) y, count(*) c FROM orders GROUP BY ALL) GROUP BY o_orderpriority
    """
)
def trend_slope(spark, sf_dir):
    panel = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("c"))
    out = panels.trend(panel, "y", "c", "o_orderpriority")
    return out.select("o_orderpriority", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"))


@registered("SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id DESC) = 1")
def keep_first_dedup(spark, sf_dir):
    return dedup.keep_first(table(spark, sf_dir, "documents"), "text", F.col("n_chars").desc(), F.col("doc_id").desc()).select("doc_id", "lang", "source")


@registered("SELECT sha256(text) AS content_sha256, min(doc_id) AS first_key, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return dedup.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@registered(
    """
    SELECT user_id, event_id, ts, value, n AS occurrences FROM (
      SELECT *, count(*) OVER (PARTITION BY user_id) n, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) r FROM events) WHERE r = 1
    """
)
def priority_dedup(spark, sf_dir):
    best = dedup.keep_best(table(spark, sf_dir, "events"), "user_id", F.col("value").desc(), F.col("event_id").desc())
    return best.select("user_id", "event_id", "ts", "value", "occurrences")


@registered(
    """
    SELECT o.* FROM (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders) o
    JOIN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1) USING (o_custkey)
    """
)
def identifier_conflicts(spark, sf_dir):
    return census.conflicting_keys(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus").select("o_custkey", "o_orderkey", "o_orderstatus")


@registered(
    r"""
    WITH d AS (SELECT doc_id, source, lang, list_distinct(regexp_extract_all(lower(strip_accents(text)), '\p{L}[\p{L}\p{N}_]*')) w FROM documents)
    SELECT * FROM (SELECT a.source, a.lang, a.doc_id AS left_key, b.doc_id AS right_key,
      len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS similarity
      FROM d a JOIN d b ON a.source = b.source AND a.lang = b.lang AND a.doc_id < b.doc_id)
    WHERE similarity >= 0.3 AND similarity < 1
    """
)
def near_duplicates_all(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("words", text.word_set(F.col("text")))
    return dedup.near_duplicates(docs, "doc_id", ["source", "lang"], "words", least=0.3, most_in_block=None)


_STATES = """
    daily AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1),
    spans AS (SELECT user_id, day AS valid_from, coalesce(lead(day) OVER (PARTITION BY user_id ORDER BY day) - 1, DATE '9999-12-31') AS valid_to, event_type,
              lead(day) OVER (PARTITION BY user_id ORDER BY day) IS NOT NULL AS inferred_end FROM daily)
"""


def _states(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return intervals.derive_intervals(events, "user_id", "day", "ts", "event_id").select("user_id", "valid_from", "valid_to", "event_type", "inferred_end")


@registered(f"WITH {_STATES} SELECT user_id, CAST(valid_from AS DATE) AS valid_from, CAST(valid_to AS DATE) AS valid_to, event_type, inferred_end FROM spans")
def interval_from_events(spark, sf_dir):
    return _states(spark, sf_dir)


@registered(
    f"""
    WITH {_STATES}, q AS (SELECT event_id, user_id, CAST(ts AS DATE) d FROM events)
    SELECT q.event_id, spans.event_type AS state, CAST(count(spans.event_type) AS BIGINT) AS n_candidates, CASE WHEN count(spans.event_type) = 0 THEN 'unmatched' ELSE 'matched' END AS status
    FROM q LEFT JOIN spans ON q.user_id = spans.user_id AND q.d BETWEEN valid_from AND valid_to GROUP BY q.event_id, spans.event_type
    """
)
def interval_join_inclusive(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("d"))
    joined = intervals.interval_join(asked, _states(spark, sf_dir), ["user_id"], "event_id", "d", "valid_from", "valid_to")
    return joined.select("event_id", F.col("interval_event_type").alias("state"), "n_candidates", "status")


@registered(
    f"""
    WITH {_STATES}, q AS (SELECT event_id, user_id, CAST(ts AS DATE) d FROM events), c AS (
      SELECT q.event_id, s.event_type, s.valid_from, rank() OVER (PARTITION BY q.event_id ORDER BY (day(s.valid_from) % 3) + 1) r
      FROM q JOIN spans s ON q.user_id = s.user_id AND q.d >= s.valid_from AND q.d < s.valid_from + 10)
    SELECT event_id, event_type, CAST(valid_from AS DATE) AS valid_from FROM c WHERE r = 1
    """
)
def interval_join_halfopen_ties(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("d"))
    spans = _states(spark, sf_dir).select("user_id", "event_type", "valid_from", F.date_add("valid_from", 10).alias("valid_end"), (F.day("valid_from") % 3 + 1).alias("prio"))
    best = intervals.best_candidates(asked, spans, ["user_id"], "event_id", "d", "valid_from", "valid_end", "prio")
    return best.select("event_id", F.col("interval_event_type").alias("event_type"), F.col("interval_valid_from").alias("valid_from"))


@registered(
    """
    SELECT l_orderkey, greatest(min(CAST(l_shipdate AS DATE)), DATE '1995-01-01') AS clip_start, max(least(CAST(l_shipdate AS DATE) + 30, DATE '1995-06-30')) AS clip_end, count(*) AS n_intervals
    FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '1995-06-30' AND CAST(l_shipdate AS DATE) + 30 >= DATE '1995-01-01' GROUP BY l_orderkey
    """
)
def window_overlap_clip(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("s", F.to_date("l_shipdate")).withColumn("e", F.date_add("s", 30))
    return intervals.overlap_clip(lines, "l_orderkey", "s", "e", "1995-01-01", "1995-06-30")


@registered(
    """
    WITH s AS (SELECT l_orderkey, l_linenumber, min(CAST(l_shipdate AS DATE)) AS d FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, EXISTS (SELECT 1 FROM s b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber <> a.l_linenumber AND b.d < a.d + 5 AND b.d + 5 > a.d) AS overlaps FROM s a
    """
)
def overlapping_spans(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.to_date("l_shipdate")).alias("s")).withColumn("e", F.date_add("s", 5))
    return intervals.overlapping_spans(lines, "l_orderkey", "l_linenumber", "s", "e").select("l_orderkey", "l_linenumber", "overlaps")


@registered(
    """
    SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS in_raw, l.doc_id IS NOT NULL AS in_labelled, t.doc_id IS NOT NULL AS in_toxic, d.source,
      CASE WHEN d.doc_id IS NOT NULL AND l.doc_id IS NULL THEN 'labelled' WHEN t.doc_id IS NULL THEN 'toxic' END AS lost_at
    FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) t ON t.doc_id = l.doc_id
    """
)
def layer_reconciliation(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return reconcile.layer_presence({"raw": table(spark, sf_dir, "documents"), "labelled": labels, "toxic": labels.filter("toxic = 1")}, "doc_id", ["source"])


@registered(
    """
    SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'added' WHEN a.s IS DISTINCT FROM b.s THEN 'changed' ELSE 'equal' END AS state
    FROM (SELECT o_orderkey k, o_orderstatus s FROM orders) a FULL JOIN (SELECT l_orderkey k, max(l_linestatus) s FROM lineitem GROUP BY 1) b ON a.k = b.k
    """
)
def baseline_changes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("o_orderstatus"))
    return reconcile.baseline_changes(table(spark, sf_dir, "orders"), lines, "o_orderkey", ["o_orderstatus"]).select("o_orderkey", "state")


@registered(
    """
    WITH a AS (SELECT o_orderkey k, count(*) n, min(o_orderstatus) v FROM orders GROUP BY 1), b AS (SELECT l_orderkey k, count(*) n, min(l_linestatus) v FROM lineitem GROUP BY 1),
    j AS (SELECT a.k ak, b.k bk, (coalesce(a.n, 0) > 1 OR coalesce(b.n, 0) > 1) m, a.v av, b.v bv FROM a FULL JOIN b ON a.k = b.k)
    SELECT count(*) FILTER (NOT m AND ak IS NOT NULL AND bk IS NOT NULL) AS matched, count(*) FILTER (m) AS ambiguous, count(*) FILTER (NOT m AND bk IS NULL) AS only_left,
      count(*) FILTER (NOT m AND ak IS NULL) AS only_right, count(*) FILTER (NOT m AND ak IS NOT NULL AND bk IS NOT NULL AND av = bv) AS equal, count(*) FILTER (NOT m AND ak IS NOT NULL AND bk IS NOT NULL AND av <> bv) AS different
    FROM j
    """
)
def linked_records(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"))
    return reconcile.linked_records(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), lines, "o_orderkey", "o_orderstatus")


@registered(
    """
    SELECT o.o_orderkey, CASE WHEN n = 1 THEN t END AS l_partkey, coalesce(n, 0) AS n_targets, CASE WHEN n IS NULL THEN 'absent' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS bridge_status
    FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) n, min(l_partkey) t FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.l_orderkey
    """
)
def unique_bridge(spark, sf_dir):
    targets = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return reconcile.unique_bridge(table(spark, sf_dir, "orders").select("o_orderkey"), targets, "o_orderkey", "l_partkey").select("o_orderkey", "l_partkey", "n_targets", "bridge_status")


@registered(
    """
    SELECT doc_id, source, lang, sha256('seed-1' || chr(0) || CAST(doc_id AS VARCHAR)) AS selection_key FROM documents
    QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY sha256('seed-1' || chr(0) || CAST(doc_id AS VARCHAR)), doc_id)
      <= greatest(1, ceil(CAST(count(*) OVER (PARTITION BY source, lang) AS DECIMAL(18, 0)) * 0.07))
    """
)
def exact_rate_sample(spark, sf_dir):
    return sampling.exact_rate(table(spark, sf_dir, "documents"), ["source", "lang"], "doc_id", "seed-1", "0.07").select("doc_id", "source", "lang", "selection_key")


@registered(
    """
    SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha1('k' || CAST(doc_id AS VARCHAR)), doc_id) r, count(*) OVER (PARTITION BY lang) n FROM documents)
    WHERE r <= greatest(3, ceil(n * 0.05))
    """
)
def stratified_hash_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sampling.hash_sample(docs, ["lang"], F.concat(F.lit("k"), F.col("doc_id").cast("string")), "doc_id", 0.05, 3).select("doc_id", "lang")


@registered(
    """
    WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('rr' || chr(0) || CAST(doc_id AS VARCHAR)), doc_id) k FROM documents)
    SELECT doc_id, source FROM r ORDER BY k, source, doc_id LIMIT 37
    """
)
def round_robin_sample(spark, sf_dir):
    return sampling.round_robin(table(spark, sf_dir, "documents"), "source", "doc_id", "rr", 37).select("doc_id", "source")


@registered(
    """
    WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) k, count(*) OVER (PARTITION BY lang) n FROM documents)
    SELECT doc_id, lang FROM r WHERE n <= 5 OR k IN (SELECT CAST(round_even(i * (n - 1) / 4.0, 0) AS BIGINT) + 1 FROM (SELECT unnest([0, 1, 2, 3, 4]) i))
    """
)
def even_spread(spark, sf_dir):
    return sampling.even_spread(table(spark, sf_dir, "documents"), ["lang"], "doc_id", 5).select("doc_id", "lang")


@registered(
    """
    SELECT DISTINCT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) a, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) b FROM documents) WHERE a = 1 OR b = 1
    """
)
def representative_sample(spark, sf_dir):
    return sampling.representatives(table(spark, sf_dir, "documents"), "source", "n_chars", "doc_id").select("doc_id", "source")


@registered()
def greedy_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sampling.greedy_batches(docs, ["source"], "doc_id", "n_chars", 20, 20_000)


@registered(
    """
    WITH c AS (SELECT l_returnflag, l_linestatus, count(*) o FROM lineitem GROUP BY ALL), r AS (SELECT l_returnflag, sum(o) t FROM c GROUP BY 1), k AS (SELECT l_linestatus, sum(o) t FROM c GROUP BY 1), n AS (SELECT sum(o) t FROM c)
    SELECT r.l_returnflag, k.l_linestatus, coalesce(c.o, 0) AS observed, CAST(r.t AS DOUBLE) * k.t / n.t AS expected, coalesce(c.o, 0) / (CAST(r.t AS DOUBLE) * k.t / n.t) AS ratio, CAST(n.t AS BIGINT) AS total
    FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN c ON c.l_returnflag = r.l_returnflag AND c.l_linestatus = k.l_linestatus
    """
)
def contingency_table(spark, sf_dir):
    return stats.contingency(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@registered()
def contingency_chi2(spark, sf_dir):
    return stats.chi_square(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@registered(
    """
    WITH t AS (SELECT p_partkey, (p_partkey * 7919 % 1000) / 1000.0 AS p FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p, p_partkey) k, count(*) OVER () n FROM t)
    SELECT p_partkey, CAST(p AS DOUBLE) AS p, least(1.0, min(p * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r
    """
)
def bh_adjust(spark, sf_dir):
    tests = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") * 7919 % 1000) / 1000.0).alias("p"), F.lit(0).alias("family"))
    return stats.bh_adjust(tests, "p", "family", order="p_partkey").select("p_partkey", "p", "q")


@registered(
    """
    WITH r AS (SELECT l_returnflag f, l_quantity x, l_extendedprice y, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 rx,
      rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 ry FROM lineitem)
    SELECT f AS l_returnflag, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY f
    """
)
def pearson_spearman(spark, sf_dir):
    out = stats.correlations(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")
    return out.select("l_returnflag", "n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@registered(
    """
    WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) tp, count(*) FILTER (quality = 0 AND toxic = 1) fp, count(*) FILTER (quality = 1 AND toxic = 0) fn, count(*) FILTER (quality = 0 AND toxic = 0) tn FROM labels)
    SELECT tp, fp, fn, tn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1,
      round(((tp + tn) / n - e) / (1 - e), 9) AS kappa FROM (SELECT *, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) e FROM (SELECT *, (tp + fp + fn + tn) n FROM c))
    """
)
def label_agreement(spark, sf_dir):
    out = stats.label_agreement(table(spark, sf_dir, "labels"), "quality", "toxic")
    return out.withColumn("kappa", F.round("kappa", 9))


@registered()
def hac_trend(spark, sf_dir):
    panel = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("c"))
    return stats.hac_trend(panel, "y", "c", "o_orderpriority")


@registered()
def cluster_bootstrap(spark, sf_dir):
    return stats.cluster_bootstrap(table(spark, sf_dir, "events"), "user_id", "value", 200, seed=3)


@registered()
def permutation_test(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return stats.permutation_test(rows, "lang", "quality", "n_chars", "doc_id", 99, seed=5)


@registered()
def kmeans_sweep(spark, sf_dir):
    return cluster.kmeans_sweep(table(spark, sf_dir, "embeddings"), "embedding", range(2, 9))


@registered(
    """
    SELECT conv_id, turn, CASE WHEN r1 = 'assistant' THEN t1 WHEN r2 = 'assistant' THEN t2 WHEN r3 = 'assistant' THEN t3 END AS response_turn
    FROM (SELECT *, lead(role, 1) OVER w r1, lead(turn, 1) OVER w t1, lead(role, 2) OVER w r2, lead(turn, 2) OVER w t2, lead(role, 3) OVER w r3, lead(turn, 3) OVER w t3
          FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'
    """
)
def turn_response_pairs(spark, sf_dir):
    return segment.responses(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "user", "assistant")


@registered(
    """
    SELECT doc_id, CAST(i AS BIGINT) AS line_number, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line) <> ''
    """
)
def text_lines(spark, sf_dir):
    return segment.lines(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("line_number", F.col("line_number").cast("long"))


@registered("SELECT doc_id, text FROM documents WHERE text <> ''")
def text_blocks_joined(spark, sf_dir):
    """The blocks of each text, put together again: the text itself."""
    parts = segment.text_blocks(table(spark, sf_dir, "documents"), "doc_id", "text", 300)
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "part_text"))), lambda x: x["part_text"]), "")
    return parts.groupBy("doc_id").agg(one.alias("text"))


@registered()
def speaker_turns(spark, sf_dir):
    return segment.speaker_turns(table(spark, sf_dir, "documents"), "doc_id", "text")


@registered()
def page_texts(spark, sf_dir):
    return segment.page_texts(table(spark, sf_dir, "pages")).select("page_id", "url", "text")


@registered(
    """
    WITH f AS (SELECT event_type, '$' AS path, 'object' AS t, props <> '{}' AS filled, len(json_keys(props)) AS n FROM events WHERE json_type(props) = 'OBJECT'
      UNION ALL SELECT event_type, '$.k', CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') THEN 'integer' ELSE lower(json_type(props, '$.k')) END, true, NULL FROM events WHERE json_exists(props, '$.k')),
    u AS (SELECT event_type, count(*) AS n_records FROM events GROUP BY 1)
    SELECT event_type, path, count(*) AS present, count(*) FILTER (filled) AS filled, count(*) FILTER (NOT filled) AS empty, CAST(0 AS BIGINT) AS nulls, string_agg(DISTINCT t, ',' ORDER BY t) AS types,
      CAST(min(n) AS BIGINT) AS least_length, quantile_cont(n, 0.5) AS median_length, CAST(max(n) AS BIGINT) AS most_length, any_value(n_records) AS n_records, any_value(n_records) - count(*) AS absent,
      count(*) FILTER (filled) / any_value(n_records) AS fill_rate, count(DISTINCT t) > 1 AS type_conflict
    FROM f JOIN u USING (event_type) GROUP BY event_type, path
    """
)
def json_field_profile(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    flat = nested.flatten(events, "props", "event_id", "event_type")
    out = nested.field_profile(flat, "event_id", "event_type", events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_records")))
    return out.withColumn("types", F.array_join("types", ","))


@registered(
    """
    SELECT event_type, user_id, n_rows, rank FROM (SELECT event_type, user_id, count(*) n_rows, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS rank, count(*) OVER (PARTITION BY event_type) d
    FROM events GROUP BY event_type, user_id) WHERE d <= 1000
    """
)
def value_frequencies(spark, sf_dir):
    return nested.value_frequencies(table(spark, sf_dir, "events"), "event_type", "user_id", 1000).withColumn("rank", F.col("rank").cast("long"))


@registered(
    """
    WITH d AS (SELECT DISTINCT l_returnflag, sha256(CAST(l_orderkey AS VARCHAR)) h FROM lineitem), n AS (SELECT l_returnflag, count(*) n FROM d GROUP BY 1),
    k AS (SELECT l_returnflag, ('0x' || h[1:13])::UBIGINT / 16.0 ** 13 AS edge FROM d QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY h) = 256)
    SELECT n.l_returnflag, round(CASE WHEN n <= 500 THEN n ELSE 255 / edge END, 3) AS cardinality, n <= 500 AS is_exact FROM n LEFT JOIN k ON n.l_returnflag = k.l_returnflag
    """
)
def kmv_cardinality(spark, sf_dir):
    out = nested.kmv_cardinality(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_orderkey", 500, 256)
    return out.withColumn("cardinality", F.round("cardinality", 3))


@registered("SELECT doc_id, substr(sha1(concat_ws('|', source, lang, CAST(doc_id AS VARCHAR))), 1, 24) AS stable_id, substr(sha256(concat_ws('|', 'ns', source, CAST(doc_id AS VARCHAR))), 1, 24) AS namespaced FROM documents")
def stable_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", keys.stable_id(F.col("source"), F.col("lang"), F.col("doc_id")).alias("stable_id"), keys.namespaced_id("ns", F.col("source"), F.col("doc_id")).alias("namespaced"))


@registered(
    """
    SELECT CAST(greatest(m, DATE '2020-02-10') AS DATE) AS window_start, CAST(least(m + INTERVAL 3 MONTH - INTERVAL 1 DAY, DATE '2021-05-20') AS DATE) AS window_end
    FROM (SELECT unnest(generate_series(TIMESTAMP '2020-01-01', TIMESTAMP '2021-05-20', INTERVAL 3 MONTH)) m)
    """
)
def calendar_windows(spark, sf_dir):
    return dates.windows(spark, "2020-02-10", "2021-05-20", "quarter")


@registered(
    """
    SELECT o_orderkey, l_linenumber, score, CASE WHEN score >= 8 AND margin >= 2 THEN 'exact' WHEN score IS NULL THEN 'absent' WHEN margin < 2 THEN 'ambiguous' ELSE 'probable' END AS bridge_status
    FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, score, score - coalesce(lead(score) OVER w, 0) margin, row_number() OVER w r FROM (
      SELECT l_orderkey, l_linenumber, 6 * CAST(l_returnflag = 'R' AS INT) + 3 * CAST(l_quantity > 25 AS INT) + CAST(l_discount > 0.05 AS INT) score FROM lineitem) WHERE score > 0 WINDOW w AS (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber)) ON l_orderkey = o_orderkey AND r = 1
    """
)
def score_margin_bridge(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("o_orderkey", F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount")
    evidence = [(F.col("l_returnflag") == "R", 6), (F.col("l_quantity") > 25, 3), (F.col("l_discount") > 0.05, 1)]
    out = intervals.score_bridge(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", "l_linenumber", ["o_orderkey"], evidence)
    return out.select("o_orderkey", "l_linenumber", "score", "bridge_status")


# --- snapshots, control blocks, catalogs


@registered("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INTEGER) AS year, upper(o_orderstatus) AS status FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1994-02-01' AND DATE '1996-11-30'")
def snapshot_select(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    columns = {"id": F.col("o_orderkey"), "day": F.col("day"), "year": F.year("day"), "status": F.upper("o_orderstatus")}
    return snapshot.snapshot_select(orders, "day", "1994-02-01", "1996-11-30", "id", columns)


@registered(
    """
    SELECT o_orderkey, CASE WHEN d IS NULL THEN 'invalid_date' WHEN d < DATE '1994-02-01' THEN 'before_window' ELSE 'after_window' END AS reason
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS d FROM orders) WHERE d IS NULL OR d NOT BETWEEN DATE '1994-02-01' AND DATE '1996-11-30'
    """
)
def exclusion_select(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("day", F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")))
    return snapshot.exclusion_select(orders, "day", "1994-02-01", "1996-11-30", ["o_orderkey"])


@registered(
    """
    SELECT o_orderkey, o_totalprice >= 1000 AS words_1000, o_totalprice >= 100000 AS words_100000, trim(o_orderpriority) <> '' AS has_summary, year(o_orderdate) BETWEEN 1993 AND 1996 AS in_years,
      CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-06-30' AS in_year_to_date FROM orders
    """
)
def eligibility_flags(spark, sf_dir):
    flags = snapshot.eligibility_flags(table(spark, sf_dir, "orders"), F.col("o_totalprice"), F.col("o_orderpriority"), F.to_date("o_orderdate"), {"words_1000": 1000, "words_100000": 100000}, (1993, 1996), "1996-06-30")
    return flags.select("o_orderkey", "words_1000", "words_100000", "has_summary", "in_years", "in_year_to_date")


@registered("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, median(n_chars) AS median FROM documents GROUP BY ALL")
def speaker_summary(spark, sf_dir):
    return snapshot.speaker_summary(table(spark, sf_dir, "documents"), ["lang", "party", "source"], "n_chars")


@registered(
    """
    WITH e AS (SELECT ts::DATE AS d, CASE WHEN event_type <> 'view' THEN user_id END AS k, props AS t FROM events)
    SELECT CAST(year(d) AS INTEGER) AS year, count(*) AS n_rows, count(DISTINCT k) AS unique_ids, CAST(count(k) - count(DISTINCT k) AS BIGINT) AS duplicate_ids, count(*) FILTER (k IS NULL) AS missing_ids,
      count(*) FILTER (regexp_matches(t, '[^\x00-\x7F]')) AS diacritic_rows, count(*) FILTER (contains(t, chr(65533))) AS replacement_rows, min(d) AS first_day, max(d) AS last_day FROM e GROUP BY 1
    """
)
def control_block(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("k", F.when(F.col("event_type") != "view", F.col("user_id")))
    return snapshot.control_block(events, "k", "props", F.to_date("ts"))


@registered(
    """
    WITH t AS (SELECT doc_id, CASE WHEN doc_id < 50 THEN source ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents)
    SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN regexp_full_match(id, '[0-9]+') THEN CAST(id AS DECIMAL(38,0)) END NULLS LAST, id, doc_id) AS place FROM t
    """
)
def numeric_id_order(spark, sf_dir):
    """One window over the table, as an order of all identifiers is what is asked."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") < 50, F.col("source")).otherwise(F.col("doc_id").cast("string")).alias("id"))
    return docs.select("doc_id", F.row_number().over(Window.orderBy(*snapshot.numeric_first(F.col("id")), "doc_id")).cast("long").alias("place"))


@registered(
    """
    SELECT source, doc_id, CAST(r AS INTEGER) AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars > 500 DESC, lang = 'en' DESC, sha256('7:' || doc_id), doc_id) r FROM documents) WHERE r <= 5
    """
)
def eligible_first(spark, sf_dir):
    return snapshot.eligible_first(table(spark, sf_dir, "documents"), "source", F.col("n_chars") > 500, F.col("lang") == "en", "doc_id", "7", 5).select("source", "doc_id", "rank")


@registered("SELECT source, n_chars, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) = 1")
def smallest_per_category(spark, sf_dir):
    return snapshot.smallest_per_category(table(spark, sf_dir, "documents"), "source", "n_chars", "doc_id")


@registered("SELECT lang, source, count(*) AS items, CAST(sum(n_chars) AS BIGINT) AS bytes, true AS reconciled FROM documents GROUP BY ALL")
def universe_groups(spark, sf_dir):
    return snapshot.universe_groups(table(spark, sf_dir, "documents"), ["lang", "source"], "n_chars")


@registered("SELECT lower(source) AS name, n_chars AS size, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY CAST(doc_id AS VARCHAR)) AS paths FROM documents GROUP BY ALL HAVING count(*) > 1")
def potential_duplicates(spark, sf_dir):
    return snapshot.potential_duplicates(table(spark, sf_dir, "documents"), F.col("source"), "n_chars", "doc_id")


@registered("SELECT event_id, coalesce(abs(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) <= 300000000, false) AS near FROM events")
def near_in_time(spark, sf_dir):
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(snapshot.near_in_time(F.col("ts"), before), F.lit(False)).alias("near"))


@registered(
    """
    SELECT conv_id, turn, 'T' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS VARCHAR), 6, '0') AS number,
      CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS INTEGER) AS order_in_role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INTEGER) AS order_overall FROM conversations
    """
)
def turn_numbers(spark, sf_dir):
    order = [F.col("turn"), F.col("role"), F.col("text")]
    rows = snapshot.role_orders(snapshot.numbered(table(spark, sf_dir, "conversations"), "conv_id", order, "T", 6), "conv_id", "role", order)
    return rows.select("conv_id", "turn", "number", "order_in_role", "order_overall")


@registered(
    """
    SELECT page_id, nullif(regexp_extract(url, '([0-9]+)/?$', 1), '') AS trailing_id FROM pages
    """
)
def page_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", snapshot.trailing_id(F.col("url")).alias("trailing_id"))


@registered(
    """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) - 1 AS day_before, CAST(o_orderdate AS DATE) + 1 AS day_after, CASE o_orderstatus WHEN 'F' THEN false END AS truth, o_orderstatus <> 'F' AS invalid,
      CAST(o_custkey AS BIGINT) * 1024 AS bytes, coalesce(nullif(trim(CASE WHEN o_orderstatus = 'O' THEN ' ' ELSE CAST(o_custkey AS VARCHAR) END), ''), lower(o_orderpriority)) AS speaker,
      o_orderstatus IN ('O', 'P') AND trim(o_orderpriority) <> '' AS segmentable FROM orders
    """
)
def order_scalars(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    value, invalid = snapshot.truth(F.col("o_orderstatus"))
    person = F.when(F.col("o_orderstatus") == "O", " ").otherwise(F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", snapshot.day_before(day).alias("day_before"), snapshot.day_after(day).alias("day_after"), value.alias("truth"), invalid.alias("invalid"),
        snapshot.byte_size(F.concat(F.col("o_custkey").cast("string"), F.lit(" KiB"))).alias("bytes"), snapshot.speaker_key(person, F.col("o_orderpriority")).alias("speaker"),
        snapshot.segmentable(F.col("o_orderstatus"), F.col("o_orderpriority"), ["O", "P"]).alias("segmentable"),
    )


@registered(
    """
    WITH p(l_returnflag, i, c, o, d) AS (VALUES ('A', 2.0, 0.5, 8.0, 0.5), ('N', 1.25, NULL, 10.0, 0.0), ('R', 0.25, 0.025, 2.0, 0.25)),
    u AS (SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_partkey AS DOUBLE) a, CAST(l_suppkey AS DOUBLE) c0, CAST(l_quantity AS BIGINT)::DOUBLE b FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((greatest(a - c0, 0) * i + c0 * coalesce(c, i) + b * o) / 1e6 * (1 - d), 12) AS cost FROM u JOIN p USING (l_returnflag)
    """
)
def usage_cost(spark, sf_dir):
    prices = spark.createDataFrame([("A", 2.0, 0.5, 8.0, 0.5), ("N", 1.25, None, 10.0, 0.0), ("R", 0.25, 0.025, 2.0, 0.25)], "l_returnflag string, input_price double, cached_price double, output_price double, discount double")
    usage = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_partkey").alias("input"), F.col("l_suppkey").alias("cached"), F.col("l_quantity").cast("long").alias("output"))
    return evidence.usage_cost(usage, prices, "l_returnflag").select("l_orderkey", "l_linenumber", F.round("cost", 12).alias("cost"))


_LABELLED = "a AS (SELECT doc_id AS id, lang FROM documents WHERE n_chars > 300), b AS (SELECT doc_id AS id, CASE WHEN n_chars > 600 THEN lang ELSE source END AS lang FROM documents WHERE n_chars < 1500)"


@registered(
    f"""
    WITH {_LABELLED} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'surprise' WHEN b.id IS NULL THEN 'missing' WHEN a.lang IS NOT DISTINCT FROM b.lang THEN 'equal' ELSE 'different' END AS status
    FROM a FULL JOIN b ON a.id = b.id
    """
)
def verified_destination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    observed = docs.filter("n_chars < 1500").withColumn("lang", F.when(F.col("n_chars") > 600, F.col("lang")).otherwise(F.col("source")))
    return evidence.verified_destination(docs.filter("n_chars > 300"), observed, "id", ["lang"])


@registered(
    """
    WITH e AS (SELECT c_custkey AS k FROM customer), r AS (SELECT o_custkey AS k, count(*) n, bool_and(o_orderstatus IN ('F', 'O')) ok FROM orders WHERE o_totalprice > 250000 GROUP BY 1)
    SELECT coalesce(e.k, r.k) AS k, CASE WHEN e.k IS NULL THEN 'unexpected' WHEN r.k IS NULL THEN 'absent' WHEN n > 1 THEN 'repeated' WHEN ok THEN 'ok' ELSE 'rejected' END AS status FROM e FULL JOIN r ON e.k = r.k
    """
)
def marker_status(spark, sf_dir):
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    reported = table(spark, sf_dir, "orders").filter("o_totalprice > 250000").withColumnRenamed("o_custkey", "k")
    return evidence.marker_status(expected, reported, "k", "o_orderstatus", ["F", "O"])


@registered(
    """
    WITH r AS (SELECT url AS source, regexp_replace(url, '[0-9]+$', '') || CAST(page_id % 97 AS VARCHAR) AS destination FROM pages),
    s AS (SELECT source, count(*) AS n FROM r GROUP BY 1), t AS (SELECT destination, count(DISTINCT source) AS n FROM r GROUP BY 1)
    SELECT r.source, r.destination, CASE WHEN r.source IS NULL THEN 'excluded' WHEN s.n > 1 THEN 'source_collision' WHEN t.n > 1 THEN 'destination_collision' ELSE 'copy' END AS action
    FROM r LEFT JOIN s USING (source) LEFT JOIN t USING (destination)
    """
)
def copy_plan(spark, sf_dir):
    destination = F.concat(F.regexp_replace("url", "[0-9]+$", ""), (F.col("page_id") % 97).cast("string"))
    return evidence.copy_plan(table(spark, sf_dir, "pages"), "url", destination, [])


@registered("SELECT page_id, CASE WHEN list_contains(string_split(lower(coalesce(url, '')), '/'), 'raw') OR page_id % 5 = 0 THEN 'preserve' ELSE 'archive_candidate' END AS action FROM pages")
def archive_actions(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", evidence.archive_action(F.col("url"), F.when(F.col("page_id") % 5 == 0, " RAW ")).alias("action"))


@registered(
    """
    WITH m AS (SELECT CAST(unnest(generate_series(DATE '1994-03-01', DATE '1996-02-10', INTERVAL 1 MONTH)) AS DATE) AS mo), l AS (SELECT unnest(['F', 'O', 'X']) AS layer), g AS (SELECT DISTINCT o_orderpriority FROM orders),
    s AS (SELECT o_orderpriority, o_orderstatus, date_trunc('month', CAST(o_orderdate AS DATE)) AS mo, count(*) n FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1994-03-05' AND DATE '1996-02-10' GROUP BY ALL)
    SELECT g.o_orderpriority, CAST(year(m.mo) AS INT) AS year, CAST(month(m.mo) AS INT) AS month, l.layer, coalesce(n, 0) AS n_rows FROM g CROSS JOIN m CROSS JOIN l
    LEFT JOIN s ON s.o_orderpriority = g.o_orderpriority AND s.mo = m.mo AND s.o_orderstatus = l.layer
    """
)
def layer_months(spark, sf_dir):
    return evidence.layer_months(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", F.to_date("o_orderdate"), "1994-03-05", "1996-02-10", ["F", "O", "X"])


@registered(
    """
    WITH u AS (SELECT event_type, user_id, count(*) n, bool_or(value > 50) t, bool_or(contains(props, '1')) m FROM events GROUP BY ALL)
    SELECT event_type, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS units, count(*) FILTER (t) AS with_text, count(*) FILTER (m) AS with_media, count(*) FILTER (t OR m) AS covered,
      count(*) FILTER (t) / count(*) AS text_rate, count(*) FILTER (m) / count(*) AS media_rate FROM u GROUP BY 1
    """
)
def media_coverage(spark, sf_dir):
    return evidence.media_coverage(table(spark, sf_dir, "events"), "event_type", "user_id", F.col("value") > 50, F.contains("props", F.lit("1")))


@registered(
    """
    WITH c AS (SELECT o_orderpriority, year(o_orderdate) AS year, count(*) AS n, CAST(sum((o_orderstatus = 'F')::INT) AS BIGINT) AS present, avg((o_orderstatus = 'F')::INT) AS share FROM orders GROUP BY ALL)
    SELECT o_orderpriority, CAST(year AS INT) AS year, n, present, round(share, 9) AS share, round(median(share) OVER (PARTITION BY o_orderpriority), 9) AS usual,
      round(share - median(share) OVER (PARTITION BY o_orderpriority), 9) AS from_usual FROM c
    """
)
def prevalence_from_median(spark, sf_dir):
    out = evidence.prevalence_from_median(table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate")), ["o_orderpriority"], "year", F.col("o_orderstatus") == "F")
    return out.withColumns({c: F.round(c, 9) for c in ("share", "usual", "from_usual")})


@registered(
    """
    WITH a AS (SELECT lang, source, CAST(doc_id % 7 - 1 AS BIGINT) AS topic FROM documents), c AS (SELECT lang, source, topic, count(*) n FROM a GROUP BY ALL)
    SELECT lang, source, topic, n, round(n / sum(n) OVER (PARTITION BY lang, source), 9) AS share, topic = -1 AS outlier FROM c
    """
)
def topic_prevalence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("topic", F.col("doc_id") % 7 - 1)
    return evidence.topic_prevalence(docs, ["lang", "source"], "topic").withColumn("share", F.round("share", 9))


@registered(
    """
    SELECT lang, source, count(*) AS "rows", count(*) FILTER (trim(text) <> '') AS summaries, count(*) FILTER (n_chars > 400) AS sampled, count(*) FILTER (n_chars > 400 AND n_chars % 7 = 0) AS outliers,
      count(*) FILTER (trim(text) <> '') / count(*) AS summary_coverage, count(*) FILTER (n_chars > 400 AND n_chars % 7 = 0) / nullif(count(*) FILTER (n_chars > 400), 0) AS outlier_rate FROM documents GROUP BY ALL
    """
)
def topic_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sample = docs.filter("n_chars > 400")
    out = evidence.topic_coverage(docs, sample, sample.withColumn("topic", F.col("n_chars") % 7 - 1), ["lang", "source"], "text", "topic")
    return out.withColumns({c: F.col(c).cast("long") for c in ("rows", "summaries", "sampled", "outliers")})


@registered(
    """
    WITH b AS (SELECT o_orderkey, o_custkey AS target, CASE WHEN o_orderstatus = 'F' THEN 'matched' WHEN o_orderstatus = 'O' THEN 'probable' ELSE 'none' END AS status FROM orders),
    g AS (SELECT l_orderkey AS o_orderkey, min(l_suppkey) AS gold FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
    q AS (SELECT count(*) AS n, count(*) FILTER (status <> 'none') AS linked, count(*) FILTER (status <> 'none') / count(*) AS coverage, count(gold) AS n_gold,
      count(*) FILTER (status <> 'none' AND target = gold) / nullif(count(*) FILTER (status <> 'none' AND gold IS NOT NULL), 0) AS precision FROM b LEFT JOIN g USING (o_orderkey))
    SELECT n, linked, coverage, n_gold, precision, coalesce(precision >= 0.95 AND coverage >= 0.8, false) AS authorized FROM q
    """
)
def bridge_quality(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "matched").when(F.col("o_orderstatus") == "O", "probable").otherwise("none")
    bridge = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("target"), status.alias("status"))
    gold = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("target"))
    return evidence.authorized(evidence.bridge_quality(bridge, gold, "o_orderkey", "target", "status"))


@registered(
    """
    WITH r AS (SELECT o_orderpriority AS c, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS v, o_totalprice > 200000 AS done FROM orders),
    k AS (SELECT count(*) FILTER (ok) AS approved FROM (SELECT c, bool_and(coalesce(v, false)) ok FROM r WHERE done AND c IN ('1-URGENT', '2-HIGH') GROUP BY c))
    SELECT count(*) FILTER (done) AS reviewed, count(*) FILTER (done AND v IS NULL) AS invalid, count(*) FILTER (done AND v) / nullif(count(*) FILTER (done AND v IS NOT NULL), 0) AS precision, any_value(approved) AS approved_cases,
      coalesce(count(*) FILTER (done) >= 100 AND count(*) FILTER (done AND v IS NULL) = 0 AND count(*) FILTER (done AND v) >= 0.9 * count(*) FILTER (done AND v IS NOT NULL) AND any_value(approved) = 2, false) AS opens FROM r CROSS JOIN k
    """
)
def review_gates(spark, sf_dir):
    verdict = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return evidence.review_gates(table(spark, sf_dir, "orders"), verdict, F.col("o_totalprice") > 200000, "o_orderpriority", ["1-URGENT", "2-HIGH"], 100, 0.9)


@registered(
    """
    SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F' AND l_discount > 0.05) AS accepted_F, count(*) FILTER (l_linestatus = 'F' AND NOT l_discount > 0.05) AS incorrect_F, CAST(coalesce(sum(l_partkey) FILTER (l_linestatus = 'F'), 0) AS BIGINT) AS tokens_F,
      count(*) FILTER (l_linestatus = 'O' AND l_discount > 0.05) AS accepted_O, count(*) FILTER (l_linestatus = 'O' AND NOT l_discount > 0.05) AS incorrect_O, CAST(coalesce(sum(l_partkey) FILTER (l_linestatus = 'O'), 0) AS BIGINT) AS tokens_O
    FROM lineitem GROUP BY 1
    """
)
def compare_conditions(spark, sf_dir):
    return evidence.compare_conditions(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linestatus", "F", "O", F.col("l_discount") > 0.05, "l_partkey")


@registered("SELECT doc_id, sha256('s|' || doc_id) AS selection_key, CAST(row_number() OVER (PARTITION BY source, lang ORDER BY sha256('s|' || doc_id), doc_id) AS INT) AS rank FROM documents")
def ranked_candidates(spark, sf_dir):
    return evidence.ranked_candidates(table(spark, sf_dir, "documents"), ["source", "lang"], "s", "doc_id").select("doc_id", "selection_key", "rank")


@registered(
    """
    WITH d AS (SELECT source, doc_id, n_chars > 1200 AS c, count(*) OVER (PARTITION BY source, n_chars > 1200) AS n, row_number() OVER (PARTITION BY source, n_chars > 1200 ORDER BY doc_id) - 1 AS i FROM documents),
    z AS (SELECT source, count(*) FILTER (c) AS cs, count(*) FILTER (NOT c) AS os FROM d GROUP BY 1),
    q AS (SELECT d.*, CASE WHEN c THEN least(cs, 9 - least(os, 9 - least(cs, 5))) ELSE least(os, 9 - least(cs, 5)) END AS k FROM d JOIN z USING (source))
    SELECT source, doc_id, c AS conflict FROM q WHERE (i + 1) * k // n > i * k // n
    """
)
def conflicts_first(spark, sf_dir):
    return evidence.conflicts_first(table(spark, sf_dir, "documents"), "source", F.col("n_chars") > 1200, ["doc_id"], 9).select("source", "doc_id", "conflict")


@registered("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def last_unknown(spark, sf_dir):
    return evidence.last_unknown(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus"), ["", "o"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_orderpriority"])


@registered("SELECT o_orderpriority, o_custkey, array_to_string(list_sort(list_distinct(list(year(o_orderdate)))), ',') AS years, CAST(0 AS BIGINT) AS undated FROM orders GROUP BY ALL")
def code_years(spark, sf_dir):
    out = evidence.code_years(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey", F.lit(None).cast("date"), F.to_date("o_orderdate"))
    return out.withColumn("years", F.array_join(F.transform("years", lambda y: y.cast("string")), ","))


@registered("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer UNION SELECT CAST(o_custkey AS VARCHAR) FROM orders UNION SELECT CAST(user_id AS VARCHAR) FROM events")
def known_ids(spark, sf_dir):
    return evidence.known_ids(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_custkey"), table(spark, sf_dir, "events").select("user_id"))


@registered("SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority || '|' || o_orderkey AS identity, year(o_orderdate) = 1995 AS in_stratum FROM orders")
def identity_checked(spark, sf_dir):
    return evidence.identity_checked(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_orderkey"], F.col("o_orderdate"), 1995).select("o_orderkey", "identity", "in_stratum")


@registered(
    """
    WITH c AS (SELECT lang, count(*) a, count(*) FILTER (n_chars > 200) b, count(*) FILTER (n_chars > 900) c FROM documents GROUP BY 1)
    SELECT lang, CAST(0 AS INT) AS number, 'all' AS stage, a AS n_rows, CAST(0 AS BIGINT) AS lost FROM c UNION ALL SELECT lang, 1, 'some', b, a - b FROM c UNION ALL SELECT lang, 2, 'long', c, b - c FROM c
    """
)
def stage_counts(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("n_chars") > 200).alias("some"), F.count_if(F.col("n_chars") > 900).alias("long"))
    return evidence.stage_counts(counts, "lang", ["all", "some", "long"])


@registered(
    """
    SELECT * FROM (SELECT 'repeated' AS metric, count(*) - count(DISTINCT text) AS n, 'warning' AS severity FROM documents UNION ALL SELECT 'empty', count(*) FILTER (trim(text) = ''), 'error' FROM documents
      UNION ALL SELECT 'long', count(*) FILTER (n_chars > 1000), 'note' FROM documents) WHERE n > 0
    """
)
def summary_issues(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").groupBy("text").agg((F.count(F.lit(1)) - 1).alias("r"), F.count_if(F.trim("text") == "").alias("e"), F.count_if(F.col("n_chars") > 1000).alias("l"))
    return evidence.issues(texts.agg(F.sum("r").alias("repeated"), F.sum("e").alias("empty"), F.sum("l").alias("long")), {"repeated": "warning", "empty": "error", "long": "note"})


@registered(
    r"""
    WITH t AS (SELECT doc_id, lang, source, trim(regexp_replace(text, '[\s\x0B\x{0085}\p{Z}]+', ' ', 'g')) AS f FROM documents)
    SELECT doc_id, CASE WHEN length(f) > 500 THEN substr(f, 1, 497) || '...' ELSE f END AS preview, CASE WHEN lang = 'en' THEN source ELSE '__list__' END AS declared, lang || '||' || doc_id AS composite FROM t
    """
)
def record_scalars(spark, sf_dir):
    kind = F.when(F.col("lang") == "en", "object").otherwise("list")
    return table(spark, sf_dir, "documents").select("doc_id", evidence.preview(F.col("text")).alias("preview"), evidence.declared_type(kind, F.col("source")).alias("declared"), evidence.composite_key(F.col("lang"), F.lit(None).cast("string"), F.col("doc_id")).alias("composite"))


@registered(
    """
    WITH l AS (SELECT n, make_date(2011 + (n - 54) * 4, 2, 1) AS a, make_date(2015 + (n - 54) * 4, 1, 31) AS b FROM (SELECT unnest(generate_series(1, 99)) AS n)),
    p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(o_custkey % 3000 AS INT) AS e FROM orders)
    SELECT o_orderkey, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS terms FROM p JOIN l ON a <= e AND b >= d GROUP BY 1
    """
)
def terms_in_period(spark, sf_dir):
    day = F.to_date("o_orderdate")
    terms = evidence.terms_in(day, F.date_add(day, (F.col("o_custkey") % 3000).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(terms, lambda n: n.cast("string")), ",").alias("terms"))


@registered("SELECT event_id, '$.k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def values_under_key(spark, sf_dir):
    return nested.under_key(table(spark, sf_dir, "events"), "props", "k", "event_id").select("event_id", "path", "value")


@registered()
def paired_jaccard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.split("text", " ").alias("all"), F.split(F.substring("text", 1, 200), " ").alias("head"), F.split(F.substring("text", 101, 200), " ").alias("next"))
    return stats.paired_jaccard_bootstrap(docs, "source", "all", "head", "next", 200)


@registered()
def compatible_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.compatible_hash(F.col("text")).alias("hash"))
