"""Registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from callsight.llm import (
    bpe,
    chat,
    divergence,
    line_templates,
    near_duplicates,
    near_vectors,
    neighbours,
    packing,
    quality,
    rules,
    runs,
    url_lists,
    wrappers,
)

QUERIES = {
    "op1_packing": packing.query,
    "op2_chat_rotation": chat.query,
    "op3_permutation_index": neighbours.query,
    "op4_quality_rules": rules.query,
    "op5_line_templates": line_templates.query,
    "op6_url_lists": url_lists.query,
    "op7_wrappers": wrappers.query,
    "op8_quality_classifier": quality.query,
    "op9_byte_bpe": bpe.query,
    "op10_jaccard_join": near_duplicates.query,
    "op11_source_divergence": divergence.query,
    "op12_near_vectors": near_vectors.query,
    "op13_periodic_runs": runs.query,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op4_quality_rules": rf"""
        WITH base AS (
            SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)),
                               lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents),
        windows AS (
            SELECT row_id, i, list_slice(words, i, i + 2) AS w
            FROM (SELECT row_id, words, unnest(range(1, len(words) - 1)) AS i FROM base)),
        often AS (SELECT *, count(*) OVER (PARTITION BY row_id, w) AS c FROM windows),
        covered AS (
            SELECT row_id, count(DISTINCT pos) AS n
            FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS pos FROM often WHERE c > 1) GROUP BY row_id),
        counts AS (
            SELECT doc_id, len(words)::BIGINT AS n_words,
                   coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
                   (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                   (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                   len(lines)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
            FROM base LEFT JOIN covered USING (row_id)),
        judged AS (
            SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
                     + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
                     + CASE WHEN 3 * n_symbols > n_words THEN 4 ELSE 0 END
                     + CASE WHEN 10 * n_dup_lines > 6 * n_lines THEN 8 ELSE 0 END
                     + CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END
                     + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
                     + CASE WHEN n_words > 2000 AND n_lines = 1 THEN 64 ELSE 0 END)::BIGINT AS failures
            FROM counts)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               failures & 3 <> 0 AS base_failed, failures & 63 = 0 AS kept, failures
        FROM judged
    """,
    "op2_chat_rotation": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker,
                   replace(coalesce(text, ''), '<|im_', '< |im_') AS said,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role IS NOT NULL,
                       coalesce(role, 'unknown'), text IS NOT NULL, coalesce(text, '')) - 1 AS place
            FROM conversations),
        voices AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
        heads AS (
            SELECT s.*, perspective, speaker = perspective AS mine,
                   '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN speaker
                       ELSE 'user name=' || speaker END || chr(10) AS head
            FROM said s JOIN voices v ON s.conv_id IS NOT DISTINCT FROM v.conv_id),
        segments AS (SELECT *, head || said || '<|im_end|>' || chr(10) AS segment FROM heads),
        placed AS (
            SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY place
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
            FROM segments)
        SELECT conv_id, perspective, turn, place::BIGINT AS "at", speaker, segment, start,
               CASE WHEN mine THEN start + length(head) ELSE start END::BIGINT AS mask_start,
               CASE WHEN mine THEN start + length(segment) ELSE start END::BIGINT AS mask_end
        FROM placed
    """,
    "op6_url_lists": r"""
        WITH caps AS (
            SELECT page_id, url,
                   1704067200 + (('0x' || substr(md5(page_id::VARCHAR), 1, 7))::BIGINT % 1440) * 3600 AS fetched_at,
                   lower(nullif(regexp_extract(url, '^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) AS host
            FROM pages),
        marks AS (
            SELECT domain, ('0x' || substr(md5(domain), 1, 7))::BIGINT AS m
            FROM (SELECT DISTINCT host AS domain FROM caps WHERE host IS NOT NULL)),
        listed AS (
            SELECT domain, CASE m % 3 WHEN 0 THEN 'spam' ELSE 'adult' END AS list,
                   (m // 7) % 60 AS d, (m // 11) % 20 + 1 AS stay, m % 5 AS kind
            FROM marks WHERE m % 3 < 2),
        entries AS (
            SELECT list, domain, 1704067200 + d * 86400 AS pos, 'add' AS action FROM listed
            UNION ALL
            SELECT list, domain, 1704067200 + (d + stay) * 86400, 'remove' FROM listed WHERE kind <> 0
            UNION ALL
            SELECT list, domain, 1704067200 + (d + 2 * stay) * 86400, 'add' FROM listed WHERE kind = 1),
        spans AS (
            SELECT *, coalesce(lead(pos) OVER (PARTITION BY list, domain ORDER BY pos), 253402300800) AS until FROM entries),
        hits AS (
            SELECT host, fetched_at, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, min(pos) AS since
            FROM (SELECT DISTINCT host, fetched_at FROM caps) c
            JOIN spans s ON action = 'add' AND (host = domain OR ends_with(host, '.' || domain))
                        AND pos <= fetched_at AND fetched_at < until
            GROUP BY host, fetched_at)
        SELECT page_id, url, fetched_at, coalesce(lists, '') AS lists, since, lists IS NULL AS allowed
        FROM caps LEFT JOIN hits USING (host, fetched_at)
    """,
    "op10_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sets AS (
            SELECT DISTINCT doc_id, s
            FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) END) AS s
                  FROM words)),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
            WHERE 100 * c >= 90 * (p.n + q.n - c)),
        reach AS (
            SELECT DISTINCT x AS doc_id, x AS other FROM links
            UNION
            SELECT reach.doc_id, y FROM reach JOIN links ON x = other),
        roots AS (SELECT doc_id, min(other) AS root FROM reach GROUP BY doc_id),
        degrees AS (SELECT x AS doc_id, count(*) AS d FROM links GROUP BY x)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(d, 0)::BIGINT AS n_links
        FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id) LEFT JOIN degrees USING (doc_id)
    """,
    "op11_source_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents),
        words AS (
            SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
        kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 10),
        places AS (SELECT DISTINCT lang, source FROM docs),
        counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        dense AS (
            SELECT lang, source, term, coalesce(n, 0) AS n
            FROM places JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
        shares AS (
            SELECT *, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER g + 2 * count(*) OVER g) AS p
            FROM dense WINDOW g AS (PARTITION BY lang, source)),
        whole AS (SELECT lang, term, sum(n) AS n FROM dense GROUP BY ALL),
        lang_shares AS (
            SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER g + 2 * count(*) OVER g) AS q
            FROM whole WINDOW g AS (PARTITION BY lang)),
        sums AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM places a JOIN places b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
        terms AS (
            SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
            FROM shares JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q)
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
        FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
        QUALIFY part = 'pair' OR rank <= 10
    """,
    "op12_near_vectors": r"""
        WITH RECURSIVE good AS (
            SELECT row_number() OVER () AS id, vec_id, embedding::DOUBLE[] AS v,
                   embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                   AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
            FROM embeddings),
        links AS (
            SELECT a.id AS x, b.id AS y
            FROM good a JOIN good b ON a.id <> b.id AND a.usable AND b.usable AND len(a.v) = len(b.v)
            WHERE CASE WHEN a.usable AND b.usable THEN list_cosine_similarity(a.v, b.v) >= 0.9 ELSE false END),
        reach AS (
            SELECT DISTINCT x AS id, x AS other FROM links
            UNION
            SELECT reach.id, y FROM reach JOIN links ON x = other),
        roots AS (SELECT reach.id, min(vec_id) AS root FROM reach JOIN good ON good.id = other GROUP BY reach.id),
        degrees AS (SELECT x AS id, count(*) AS d FROM links GROUP BY x)
        SELECT vec_id, coalesce(d, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id,
               vec_id IS NOT DISTINCT FROM coalesce(root, vec_id) AS kept
        FROM good LEFT JOIN roots USING (id) LEFT JOIN degrees USING (id)
    """,
}
