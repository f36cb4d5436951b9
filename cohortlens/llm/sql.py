"""DuckDB twins of the queries that SQL can express.

Left out, and held against brute force in ``tests/llm`` instead: keyed
rounding, greedy placement, seeded merges, boosted trees, lexing, hashed
n-gram models, maximal periodic runs and fingerprints (XXH64) are not SQL.
"""

from __future__ import annotations

from cohortlens.llm.quality_rules import RepetitionRules

WORD = r"[^\x20\x09-\x0D]+"


def _op1() -> str:
    rules = RepetitionRules()
    ngrams = sorted(rules.max_ngram_share)
    ctes, joins, cols, bad = [], [], [], []
    for n in sorted({3, *ngrams}):
        ctes.append(f"""g{n} AS (
            SELECT doc_id, j, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
                SELECT doc_id, j, array_to_string(ws[j:j + {n - 1}], ' ') AS g
                FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n} + 2)) AS j FROM d WHERE len(ws) >= {n}))),
        r{n} AS (SELECT DISTINCT doc_id, unnest(range(j, j + {n})) AS i FROM g{n} WHERE c > 1),
        c{n} AS (SELECT doc_id, count(*) AS words, sum(length(w)) AS chars FROM r{n} JOIN w USING (doc_id, i) GROUP BY doc_id)""")
        joins.append(f"LEFT JOIN c{n} USING (doc_id)")
        if n in ngrams:
            cols.append(f"coalesce(c{n}.chars, 0)::BIGINT AS cover_{n}")
            bad.append(f"cover_{n} > {rules.max_ngram_share[n]}::DOUBLE * word_chars")
    return f"""
    WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t,
                                   regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
    w AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
    lines AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id, l ORDER BY i) AS nth FROM (
                SELECT doc_id, unnest(string_split(t, chr(10))) AS l,
                       generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)
              WHERE regexp_matches(l, '{WORD}')),
    dup AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS chars
            FROM lines WHERE nth > 1 GROUP BY doc_id),
    {", ".join(ctes)},
    m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words,
                 coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars,
                 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                 coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(c3.words, 0)::BIGINT AS n_repeat_words,
                 coalesce(dup.chars, 0)::BIGINT AS dup_line_chars, {", ".join(cols)}
          FROM d LEFT JOIN dup USING (doc_id) {" ".join(joins)}),
    f AS (SELECT *, n_words < {rules.min_words}
                    OR 100 * n_repeat_words > {int(100 * rules.max_repeat_word_share)} * n_words AS base_failed FROM m)
    SELECT *, NOT base_failed AND NOT (dup_line_chars > {rules.max_dup_line_share}::DOUBLE * word_chars
                  OR n_symbols > {rules.max_symbols_per_word}::DOUBLE * n_words OR {" OR ".join(bad)}) AS kept FROM f"""


_OP2 = """
    WITH RECURSIVE v AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0
          AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
          AND len([x for x in embedding if x <> 0]) > 0),
    n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS r FROM v),
    link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b
             ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            AND list_dot_product(a.e, b.e) / (a.r * b.r) >= 0.9),
    reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
    deg AS (SELECT a, count(*) AS n FROM link GROUP BY a),
    low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
    SELECT vec_id, coalesce(deg.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id,
           vec_id = least(vec_id, coalesce(low.b, vec_id)) AS kept
    FROM embeddings LEFT JOIN deg ON deg.a = vec_id LEFT JOIN low ON low.a = vec_id"""

# Texts as hex digits, two for each byte.
_OP9 = """
    WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    win AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s
            FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d WHERE len(h) >= 200)),
    gone AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM win)
             WHERE k > 1),
    edge AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS fresh FROM gone),
    run AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM edge),
    span AS (SELECT doc_id, k, min(p) AS lo, max(p) + 100 AS hi FROM run GROUP BY doc_id, k),
    part AS (SELECT doc_id, k, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY k), 0) AS prev,
                    lead(hi) OVER (PARTITION BY doc_id ORDER BY k) IS NULL AS last FROM span),
    text AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans,
                    string_agg(substr(h, 2 * prev + 1, 2 * (lo - prev)) || CASE WHEN last THEN substr(h, 2 * hi + 1) ELSE '' END,
                               '' ORDER BY k) AS kept
             FROM part JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
           coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
    FROM d LEFT JOIN text USING (doc_id)"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_OP11 = f"""
    WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    d AS (SELECT doc_id, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM low),
    p AS MATERIALIZED (SELECT doc_id, term, count(*)::BIGINT AS tf FROM d GROUP BY doc_id, term),
    len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
    total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM len),
    m AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // terms) AS m FROM len, total),
    w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, total GROUP BY term),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark),
    s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
          FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
    r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
          FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""

SQL: dict[str, str] = {"op1_quality_rules": _op1(), "op2_embedding_dedup": _OP2, "op9_suffix_dedup": _OP9,
                       "op11_lexical_search": _OP11}
