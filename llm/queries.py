"""The registered queries of this folder, and their SQL counterparts where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from llm.chat_format import op11_chat_formatting
from llm.decontamination import op5_decontamination
from llm.fill_in_middle import op13_fill_in_middle
from llm.html_text import op10_html_extraction
from llm.jaccard_join import op3_jaccard_join
from llm.language_id import op2_language_id
from llm.lexical_search import op12_ranked_search
from llm.lm_scoring import op8_lm_scoring
from llm.mixing import op4_source_mixing
from llm.quality import op9_quality
from llm.suffix_dedup import op7_suffix_dedup
from llm.topk_search import op1_topk_search
from llm.toxicity import op6_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk_search": op1_topk_search,
        "op2_language_id": op2_language_id,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_source_mixing": op4_source_mixing,
        "op5_decontamination": op5_decontamination,
        "op6_toxicity": op6_toxicity,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_quality": op9_quality,
        "op10_html_extraction": op10_html_extraction,
        "op11_chat_formatting": op11_chat_formatting,
        "op12_ranked_search": op12_ranked_search,
        "op13_fill_in_middle": op13_fill_in_middle,
        "pipeline": corpus_pipeline.run,
    }


TOPK_SQL = """
WITH valid AS MATERIALIZED (
    SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
    SELECT q.row_id, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM valid q JOIN valid c ON q.row_id <> c.row_id
    WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

JACCARD_SQL = """
WITH RECURSIVE spoken AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, list_sort(list_distinct(CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
    FROM spoken
), known AS MATERIALIZED (
    SELECT doc_id, s, len(s) AS n, md5(array_to_string(s, '|')) AS set_id FROM sets
), shingles AS MATERIALIZED (
    SELECT doc_id, hash(shingle) AS h FROM (SELECT doc_id, unnest(s) AS shingle FROM known)
), shared AS MATERIALIZED (
    SELECT doc_id, h FROM shingles WHERE h IN (SELECT h FROM shingles GROUP BY h HAVING count(*) > 1)
), pairs AS MATERIALIZED (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM shared a JOIN shared b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), similar_pairs AS MATERIALIZED (
    SELECT p.x, p.y, a.set_id AS sx, b.set_id AS sy
    FROM pairs p JOIN known a ON a.doc_id = p.x JOIN known b ON b.doc_id = p.y
    WHERE p.c >= 0.8 * (a.n + b.n - p.c)
), links AS MATERIALIZED (
    SELECT x, y, sx, sy FROM similar_pairs UNION ALL SELECT y, x, sy, sx FROM similar_pairs
), reached AS (
    SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
), classes AS (SELECT x, min(y) AS least FROM reached GROUP BY x),
counts AS (
    SELECT x, count(*) AS n_links, count(DISTINCT sy) FILTER (sx <> sy) AS n_texts FROM links GROUP BY x
)
SELECT d.doc_id, least(d.doc_id, coalesce(k.least, d.doc_id)) AS class_id, coalesce(c.n_links, 0) AS n_links,
       coalesce(c.n_texts, 0) AS n_texts
FROM documents d LEFT JOIN classes k ON k.x = d.doc_id LEFT JOIN counts c ON c.x = d.doc_id
"""


CHAT_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(regexp_replace(regexp_replace(text, '(<)(\\*/?s>)', '\1\\\2', 'g'),
                                 '(\[)(\\*(?:SYS|/?INST|/?ROLE)\])', '\1\\\2', 'g'))
           + CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 13 WHEN 'assistant' THEN 14 ELSE 20 + length(role) END)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

RANKED_SQL = r"""
WITH said AS MATERIALIZED (
    SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM documents
), asked AS (
    SELECT row_number() OVER () AS item_row, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), wanted AS (
    SELECT item_row, item_id, term, count(*) AS times FROM asked GROUP BY ALL
), totals AS (
    SELECT count(*) FILTER (len(words) > 0) AS n_docs, sum(len(words))::BIGINT AS length FROM said
), held AS MATERIALIZED (
    SELECT row_id, doc_id, n, term, count(*) AS tf
    FROM (SELECT row_id, doc_id, len(words) AS n, unnest(words) AS term FROM said) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), weighed AS (
    SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, totals GROUP BY term
), impacts AS (
    SELECT row_id, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // length))) AS impact FROM held, totals
), scored AS (
    SELECT item_row, item_id, row_id, doc_id, sum(w * times * impact)::BIGINT AS score
    FROM wanted JOIN weighed USING (term) JOIN impacts USING (term) GROUP BY ALL
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
    FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""

MIDDLE_SQL = r"""
WITH draws AS (
    SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents
), cuts AS (
    SELECT *, len(units)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
           ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM draws
), parts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
                THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cuts
), spans AS (
    SELECT doc_id, n, form, text, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
           array_to_string(units[b + 1:n], '') AS suffix FROM parts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM spans
"""


def oracle_sql() -> dict[str, str]:
    """The others rest on hash draws, learned weights, byte ranges or parsing that SQL lacks; tests/llm checks them against brute
    force and held-out accuracy."""
    return {"op1_topk_search": TOPK_SQL, "op3_jaccard_join": JACCARD_SQL, "op11_chat_formatting": CHAT_SQL,
            "op12_ranked_search": RANKED_SQL, "op13_fill_in_middle": MIDDLE_SQL}
