"""The registered queries of this subpackage, and their SQL where SQL can state them."""

from __future__ import annotations

from .decontaminate import op4_decontaminate
from .license_scan import op10_license_scan
from .mixing import op1_mix_sources
from .ngram_join import op9_ngram_join
from .pii import op7_personal_data
from .quality import op6_quality
from .substring_dedup import op8_substring_dedup
from .token_table import op3_token_table
from .toxicity import op5_toxicity
from .vector_search import op2_vector_search

QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_vector_search, op3_token_table, op4_decontaminate, op5_toxicity, op6_quality, op7_personal_data, op8_substring_dedup, op9_ngram_join, op10_license_scan)}
ORACLE_SQL = {
    "op8_substring_dedup": r"""
        WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        win AS (SELECT r, i, array_to_string(words[i:i + 34], ' ') AS k FROM (SELECT r, words, unnest(generate_series(1, len(words) - 34)) AS i FROM w WHERE len(words) >= 35)),
        twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1),
        gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS p FROM twice),
        word AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (r)
    """,
    "op9_ngram_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        long AS (SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 4)),
        s AS (SELECT DISTINCT doc_id, g FROM (FROM long UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT x, y FROM pair JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * m >= 85 * (nx.n + ny.n - m)),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN link ON x = other)
        SELECT documents.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id
        FROM documents JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY documents.doc_id
    """,
}
