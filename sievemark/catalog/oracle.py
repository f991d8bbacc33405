"""DuckDB SQL for each registered query, written without the Spark expressions.

Patterns here are RE2, those of the library are Java: ``(?U)`` means different things
in the two, RE2 has no Unicode ``\\b`` and no possessive quantifiers.
"""

from __future__ import annotations

from sievemark import constants as C
from sievemark.catalog.tables import LABEL_DESCRIPTIONS, TITLES

WS = (
    r"[\t\n\x0B\f\r \x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}]"
)
LB = r"[\n\r\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}]"
EDGE_L = r"(^|[^\p{L}\p{N}_])"
EDGE_R = r"($|[^\p{L}\p{N}_])"


def lit(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def not_blank(c: str) -> str:
    return f"({c} IS NOT NULL AND length({strip(c)}) > 0)"


TITLE_LIST = "[" + ", ".join(lit(t) for t in TITLES) + "]"

POSTINGS = f"""
postings AS (
  SELECT doc_id AS job_posting_id,
         {TITLE_LIST}[CAST(n_chars % {len(TITLES)} AS INT) + 1] AS title,
         CASE WHEN n_chars % 13 = 0 THEN NULL
              WHEN n_chars % 17 = 0 THEN chr(9) || chr(10) || ' '
              ELSE text END AS description,
         source AS location
  FROM documents)"""

RAW_POSTINGS = f"""
raw AS (
  SELECT doc_id AS job_posting_id,
         {TITLE_LIST}[CAST(n_chars % {len(TITLES)} AS INT) + 1] AS title,
         CASE n_chars % 4
           WHEN 0 THEN '<p>R&amp;D ' || replace(text, chr(10), '</p><p>') || '</p>'
           WHEN 1 THEN '## Role' || chr(10) || '* ' || replace(text, chr(10), chr(10) || '* ')
           WHEN 2 THEN '**Tasks**' || chr(10) || '1. ' || replace(text, chr(10), chr(10) || '2. ')
                       || ' [apply](http://x) `code`'
           ELSE CASE WHEN n_chars % 3 = 0 THEN '<p> </p>' || chr(10) ELSE text END END
           AS description,
         source AS location
  FROM documents)"""

LABELS = """
matrix AS (SELECT doc_id AS job_posting_id, quality, toxic FROM labels),
long_labels AS (
  SELECT job_posting_id, 'quality' AS category, quality AS label FROM matrix
  UNION ALL SELECT job_posting_id, 'toxic', toxic FROM matrix)"""

SUBSETS = POSTINGS + "," + LABELS + """,
subsets AS (
  SELECT p.*, m.quality, m.toxic, l.category
  FROM postings p JOIN matrix m USING (job_posting_id)
  JOIN long_labels l USING (job_posting_id) WHERE l.label = 1)"""

RESPONSES = """
answers AS (
  SELECT doc_id AS job_posting_id,
    CASE doc_id % 7
      WHEN 0 THEN '{"quality":' || quality || ',"toxic":' || toxic || '}'
      WHEN 1 THEN '```json' || chr(10) || '{"quality": ' ||
                  CASE WHEN quality = 1 THEN 'true' ELSE 'false' END || '}' || chr(10) || '```'
      WHEN 2 THEN 'Sure: {"quality":"' || quality || '","toxic":[]} ok'
      WHEN 3 THEN 'no json'
      WHEN 4 THEN '{quality:1} {"quality":1}'
      WHEN 5 THEN '{"x":{"toxic":' || toxic || '},"quality":1}'
      ELSE '{"quality":0.0,"toxic":null}' END AS raw
  FROM labels),
objects AS (
  SELECT job_posting_id,
    CASE WHEN json_valid(nullif(regexp_extract(raw, '\\{[^{}]*\\}'), ''))
         THEN regexp_extract(raw, '\\{[^{}]*\\}') END AS obj
  FROM answers)"""


def truthy(key: str) -> str:
    path = f"obj, '$.{key}'"
    return f"""coalesce(CASE json_type({path})
      WHEN 'VARCHAR' THEN CAST(json_extract_string({path}) <> '' AS INT)
      WHEN 'BOOLEAN' THEN CAST(json_extract_string({path}) = 'true' AS INT)
      WHEN 'ARRAY' THEN CAST(json_array_length({path}) > 0 AS INT)
      WHEN 'NULL' THEN 0
      ELSE CAST(CAST(json_extract_string({path}) AS DOUBLE) <> 0 AS INT) END, 0)"""


def clean(c: str) -> str:
    """The cleaning steps, HTML pass only where a tag is found."""
    seam = "chr(64976)"

    def sub(x: str, pattern: str, to: str = "''") -> str:
        return f"regexp_replace({x}, {lit(pattern)}, {to}, 'g')"

    html = sub(
        sub(c, r"(?is)<!\[CDATA\[(.*?)\]\]>", f"{seam} || '\\1' || {seam}"),
        r"(?is)<!--.*?-->"
        r"|<script(?:[\s/][^>]*)?>.*?(?:</script\s*>|\z)"
        r"|<style(?:[\s/][^>]*)?>.*?(?:</style\s*>|\z)"
        r"|<template(?:[\s/][^>]*)?>.*?</template\s*>"
        r"|<r[tp](?:[\s/][^>]*)?>.*?</r[tp]\s*>"
        r"|<![a-z\[][^>]*>|<\?[^>]*>",
        seam,
    )
    html = sub(
        html,
        r"(?i)(<(?:br|p|li|h[1-6])(?:[\s/][^>]*)?>)",
        f"{seam} || chr(10) || '\\1'",
    )
    html = sub(
        html,
        r"<[a-zA-Z][^\s/>]*(?:[^>=]|=\s*(?:" + '"[^"]*"' + r"|'[^']*')?)*>|<[a-zA-Z/][^>]*>",
        seam,
    )
    # A reference may lack its semicolon where no name character follows. Twice, because
    # a match takes the character that may start the next reference.
    for _ in range(2):
        html = sub(html, r"&(quot|copy|middot|amp)([^-.;a-zA-Z0-9])", r"'&\1;\2'")
    for name, char in (("quot", "'\"'"), ("copy", "chr(169)"), ("middot", "chr(183)"), ("amp", "'&'")):
        html = f"replace({html}, '&{name};', {char})"
    html = sub(html, r"^\x{FDD0}+|\x{FDD0}+$")
    html = sub(html, r"\x{FDD0}+", "' '")
    out = f"CASE WHEN regexp_matches({c}, '<[a-zA-Z/][^>]*>') THEN {html} ELSE {c} END"
    out = sub(out, r"\\(.)", r"'\1'")
    out = sub(out, r"(?m)^[=\-]{2,}" + WS + r"*$")
    out = sub(out, r"(?m)^#{1,6}" + WS + r"+")
    out = sub(out, r"(?s)\*{1,3}(.+?)\*{1,3}", r"'\1'")
    out = sub(out, r"(?s)_{1,2}(.+?)_{1,2}", r"'\1'")
    out = sub(out, r"\[([^\]]*)\]\([^\)]*\)", r"'\1'")
    out = sub(out, r"`([^`]*)`", r"'\1'")
    out = sub(out, r"(?m)^" + WS + r"*[*\-+]" + WS + r"+")
    out = sub(out, r"(?m)^" + WS + r"*\p{Nd}+\." + WS + r"+")
    out = sub(out, WS + "*" + LB + WS + "*", "' '")
    out = sub(out, " {2,}", "' '")
    return strip(out)


def any_of(phrases: list[str]) -> str:
    return "(?:" + "|".join(phrases) + ")"


def has(c: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({c}, {lit('(?i)' + pattern)}), false)"


def word(phrases: list[str]) -> str:
    return EDGE_L + any_of(phrases) + EDGE_R


RULES = {
    "entry_level": (
        f"({has('title', any_of(C.ENTRY_LEVEL_SUBSTRINGS))}"
        f" OR {has('title', word(C.ENTRY_LEVEL_WORDS))})"
        f" AND NOT {has('title', any_of(C.ENTRY_LEVEL_EXCLUDED_SUBSTRINGS))}"
    ),
    "data_business_analytics": has("title", word(C.DATA_BUSINESS_WORDS)),
    "finance_analytics": has("title", word(C.FINANCE_WORDS)),
    "marketing_analytics": has("title", word(C.MARKETING_WORDS)),
}
TITLE_LABELS = "title_labels AS (" + " UNION ALL ".join(
    f"SELECT job_posting_id, title, '{name}' AS category FROM postings WHERE {cond}"
    for name, cond in RULES.items()
) + ")"

ORDER_KEY = "md5('42:' || job_posting_id)"
POSITIONS = POSTINGS + f""",
numbered AS (
  SELECT *, row_number() OVER (ORDER BY {ORDER_KEY}, job_posting_id) - 1 AS position,
         count(*) OVER () AS n_total
  FROM postings)"""


def keep_first(source: str, keys: str, order: str) -> str:
    return (
        f"SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY {keys} ORDER BY {order}) AS place FROM {source}) WHERE place = 1"
    )


VECTORS = """
vecs AS (SELECT vec_id AS job_posting_id, 'label_' || label AS category, embedding FROM embeddings),
norms AS (
  SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n64,
    sqrt(list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE * x::DOUBLE))) AS n32
  FROM vecs),
units AS (
  SELECT job_posting_id, category,
    list_transform(embedding, lambda x: x::DOUBLE / CASE WHEN n64 > 0 THEN n64 ELSE 1 END) AS u64,
    list_transform(embedding[1:32], lambda x: x::DOUBLE / CASE WHEN n32 > 0 THEN n32 ELSE 1 END) AS u32
  FROM norms),
asked AS (
  SELECT * FROM units WHERE job_posting_id IN (SELECT min(job_posting_id) FROM units GROUP BY category)),
corpus AS (SELECT * FROM units WHERE job_posting_id NOT IN (SELECT job_posting_id FROM asked))"""


def hits(k: int) -> str:
    """Hits of both models: at most ``k`` per (model, category)."""
    return VECTORS + f""",
scored AS (
  SELECT 'unit_64d' AS model, a.category, c.job_posting_id, c.category AS own,
         list_inner_product(a.u64, c.u64)::FLOAT AS score FROM asked a, corpus c
  UNION ALL
  SELECT 'unit_32d', a.category, c.job_posting_id, c.category,
         list_inner_product(a.u32, c.u32)::FLOAT FROM asked a, corpus c),
hits AS (
  SELECT *, CAST(own = category AS INT) AS rel FROM (
    SELECT *, row_number() OVER (PARTITION BY model, category ORDER BY score DESC, job_posting_id)
      AS rank FROM scored) WHERE rank <= {k})"""


def metrics(ks: list[int]) -> str:
    depths = ", ".join(f"({k})" for k in ks)
    return hits(max(ks)) + f""",
ranked AS (
  SELECT *, avg(rel) OVER (PARTITION BY model, category, score) AS gain,
    row_number() OVER (PARTITION BY model, category ORDER BY rel DESC, rank) AS ideal
  FROM hits),
depths(k) AS (VALUES {depths}),
sizes AS (SELECT category, count(*) AS n FROM corpus GROUP BY category),
sums AS (
  SELECT model, category, k,
    sum(CASE WHEN rank <= k THEN rel ELSE 0 END) AS n_hits,
    sum(CASE WHEN rank <= k THEN gain / log2(rank + 1) ELSE 0 END) AS dcg,
    sum(CASE WHEN ideal <= k THEN rel / log2(ideal + 1) ELSE 0 END) AS idcg
  FROM ranked, depths GROUP BY ALL),
rates AS (
  SELECT s.*, s.n_hits / z.n AS r, s.n_hits / s.k AS p FROM sums s JOIN sizes z USING (category)),
metrics AS (
  SELECT model, category, k, CAST(n_hits AS BIGINT) AS n_hits,
    round(r, 6) AS recall, round(p, 6) AS precision,
    round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1,
    round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg
  FROM rates)"""


def encoded(source: str, id_col: str, text: str) -> str:
    """Hash-bucket token counts of unit length: (id, position, value), zeros left out."""
    return f"""
  SELECT id, position, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS value FROM (
    SELECT id, ('0x' || left(md5(t), 8))::BIGINT % 64 AS position, count(*)::DOUBLE AS c FROM (
      SELECT {id_col} AS id, unnest(regexp_split_to_array(lower({text}), '{WS}+')) AS t
      FROM {source}) WHERE t <> '' GROUP BY ALL)"""


FEATURE_TEXT_CLEAN = (
    f"concat_ws(' ', nullif({strip('title')}, ''), nullif({strip('description')}, ''))"
)

REQUESTS = """
requests AS (
  SELECT item_id AS request_id, 'label_' || (item_id % 12) AS category,
         ' ' || text || chr(10) AS query_text FROM benchmark),
stored_queries AS (
  SELECT category, arg_min(query_text, request_id) AS query FROM requests
  WHERE category IN (SELECT category FROM vecs) GROUP BY category),
stored_vectors AS (
  SELECT category, 'embedding1' AS slot,
    CASE WHEN category IN ('label_3', 'label_5', 'label_7') THEN 'demo/Other'
         ELSE 'DEMO/hash_64' END AS model_name,
    arg_min(embedding, job_posting_id) AS vector
  FROM vecs GROUP BY category),
reusable AS (
  SELECT r.request_id, v.vector FROM requests r
  JOIN stored_queries q ON q.category = r.category AND q.query = r.query_text
  JOIN stored_vectors v ON v.category = r.category AND v.model_name = 'DEMO/hash_64')"""


def _sql() -> dict[str, str]:
    p = f"WITH {POSTINGS} "
    out = {
        "drop_null": p + "SELECT * FROM postings WHERE description IS NOT NULL",
        "drop_blank": p + f"SELECT * FROM postings WHERE {not_blank('description')}",
        "regex_contains": (
            f"SELECT doc_id, CAST({has('text', word(['est', 'the', 'und', 'los']))} AS INT) AS hit "
            "FROM documents"
        ),
        "include_exclude": (
            f"SELECT doc_id, lang FROM documents WHERE {has('text', 'tion')} "
            f"AND NOT {has('text', 'queque|ing' + EDGE_R)}"
        ),
        "positive_labels": f"WITH {LABELS} SELECT * FROM long_labels WHERE label = 1",
        "completeness": p
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count({c}) AS n_present, count(*) AS n_total FROM postings"
            for c in C.POSTING_COLUMNS
        ),
        "select_existing": p + "SELECT job_posting_id, location, title FROM postings",
        "require_columns": p + "SELECT job_posting_id, title, location FROM postings",
        "label_cast": f"WITH {POSTINGS}, {LABELS} "
        "SELECT job_posting_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic "
        "FROM postings LEFT JOIN matrix USING (job_posting_id)",
        "dedup_title_desc": p + keep_first("postings", "title, description", "job_posting_id"),
        "dedup_title_desc_loc": p
        + keep_first(
            "postings", "title, description, location", f"{ORDER_KEY}, job_posting_id"
        ),
        "unique_id_check": "SELECT conv_id, count(*) AS n_rows FROM conversations "
        "GROUP BY conv_id HAVING count(*) > 1",
        "seeded_shuffle": f"WITH {POSITIONS} SELECT job_posting_id, position FROM numbered",
        "first_rows": p + f"SELECT * FROM postings ORDER BY {ORDER_KEY}, job_posting_id LIMIT 100",
        "positional_slice": f"WITH {POSITIONS} SELECT job_posting_id, title, position "
        "FROM numbered WHERE position >= 300 AND position < 1000",
        "batch_assign": f"WITH {POSITIONS} SELECT job_posting_id, position, "
        "position // 60 AS batch, (n_total + 59) // 60 AS n_batches FROM numbered",
        "prep_postings": p
        + "SELECT * FROM ("
        + keep_first("postings", "title, description, location", f"{ORDER_KEY}, job_posting_id")
        + f") WHERE {not_blank('description')}",
        "clean_postings": f"WITH {RAW_POSTINGS}, kept AS ("
        + keep_first("raw", "title, description", "job_posting_id")
        + f"), cleaned AS (SELECT job_posting_id, title, {clean('description')} AS description, "
        + f"location FROM kept WHERE {not_blank('description')}) "
        + f"SELECT * FROM cleaned WHERE {not_blank('description')}",
        "clean_description": f"SELECT page_id, {clean('html')} AS description FROM pages",
        "clean_description_markdown": f"WITH {RAW_POSTINGS} "
        f"SELECT job_posting_id, {clean('description')} AS description FROM raw",
        "feature_concat_clean": p
        + f"SELECT job_posting_id, {FEATURE_TEXT_CLEAN} AS feature_text FROM postings",
        "truncate_chars": p
        + "SELECT job_posting_id, substring(description, 1, 1500) AS description FROM postings",
        "render_prompt": p
        + "SELECT job_posting_id, 'Title: ' || coalesce(title, '') || chr(10) || 'Text: ' || "
        "coalesce(description, '') || chr(10) || 'Answer {\"quality\": 0}' "
        "AS prompt FROM postings",
        "render_summary_prompt": p
        + "SELECT job_posting_id, 'Summarize ' || coalesce(title, '') || ' as {{json}}:' || "
        "chr(10) || coalesce(description, '') AS prompt FROM postings",
        "normalize_model_id": "SELECT p_partkey, lower(replace("
        "p_name || '_/' || p_type, '_', '-')) AS model_id FROM part",
        "model_name_from_path": "SELECT p_partkey, 'title_' || p_partkey || 'd' AS model FROM part",
        "text_stats": p + "SELECT job_posting_id, coalesce(length(description), -1) AS original_chars, "
        f"coalesce(length({strip('description')}), -1) AS stripped_chars FROM postings",
        "strip_equals": p + "SELECT job_posting_id, 1 AS same_text, "
        f"CAST(NOT {not_blank('description')} AS INT) AS empty_text FROM postings",
        "rulebook_labels": f"WITH {POSTINGS}, words AS (SELECT DISTINCT job_posting_id, "
        "unnest(regexp_extract_all(lower(description), '[\\p{L}\\p{N}_]+')) AS word FROM postings) "
        "SELECT job_posting_id, word AS category FROM words a "
        "WHERE regexp_full_match(word, '[a-z]{2}tion') AND NOT EXISTS (SELECT 1 FROM words b "
        "WHERE b.job_posting_id = a.job_posting_id AND b.word = a.word[1:2] || 'ing')",
        "regex_multilabel": f"WITH {POSTINGS}, {TITLE_LABELS} SELECT * FROM title_labels",
        "parse_binary_label": "SELECT doc_id AS job_posting_id, CAST(quality = 1 AS INT) AS label, "
        "0 AS odd_label FROM labels",
        "extract_json": f"WITH {RESPONSES} SELECT job_posting_id, "
        "CAST(obj IS NOT NULL AS INT) AS has_json, "
        "CASE WHEN json_type(obj, '$.quality') = 'DOUBLE' THEN '0' "
        "ELSE json_extract_string(obj, '$.quality') END AS quality_text FROM objects",
        "parse_multilabel": f"WITH {RESPONSES} SELECT job_posting_id, {truthy('quality')} AS quality, "
        f"{truthy('toxic')} AS toxic FROM objects",
        "mutual_exclusion": f"WITH {RESPONSES}, parsed AS (SELECT job_posting_id, "
        f"{truthy('quality')} AS quality, {truthy('toxic')} AS toxic FROM objects) "
        "SELECT job_posting_id, CASE WHEN toxic = 1 THEN 0 ELSE quality END AS quality, toxic "
        "FROM parsed",
        "labels_left_join": f"WITH {POSTINGS}, {LABELS} SELECT job_posting_id, title, "
        "coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic "
        "FROM postings LEFT JOIN matrix USING (job_posting_id)",
        "review_join": f"WITH {POSTINGS}, {LABELS} SELECT job_posting_id, title, location, quality, "
        "toxic FROM matrix LEFT JOIN postings USING (job_posting_id)",
        "posting_category_pairs": p
        + "SELECT job_posting_id, unnest(["
        + ", ".join(lit(c) for c in C.MODEL_CATEGORIES)
        + "]) AS category FROM postings",
        "pairs_to_wide": "SELECT doc_id AS job_posting_id, quality, toxic FROM labels",
        "category_lookup": f"WITH {POSTINGS}, {TITLE_LABELS} SELECT job_posting_id, category, "
        f"CASE category WHEN 'entry_level' THEN {lit(C.MODEL_CATEGORIES['entry_level'])} ELSE '' END "
        "AS description FROM title_labels",
        "labels_to_subsets": f"WITH {SUBSETS} "
        "SELECT job_posting_id, title, category, quality, toxic FROM subsets",
        "category_counts": f"WITH {SUBSETS}, dim(category, description) AS (VALUES "
        + ", ".join(f"({lit(k)}, {lit(v)})" for k, v in LABEL_DESCRIPTIONS.items())
        + ") SELECT d.category, d.description, count(s.category) AS n_rows "
        "FROM dim d LEFT JOIN subsets s USING (category) GROUP BY ALL",
        "category_ids": f"WITH {SUBSETS}, placed AS (SELECT category, job_posting_id, row_number() OVER ("
        "PARTITION BY category ORDER BY left(md5(job_posting_id::VARCHAR), 3), job_posting_id) - 1 AS place "
        "FROM subsets) SELECT category, place // 100 AS chunk, count(*) AS n_ids, "
        "string_agg(job_posting_id::VARCHAR, ',' ORDER BY job_posting_id) AS ids FROM placed GROUP BY 1, 2",
        "pending_anti_join": f"WITH {POSTINGS}, {LABELS} SELECT job_posting_id, title, location "
        "FROM postings WHERE job_posting_id NOT IN (SELECT job_posting_id FROM matrix)",
        "union_append": "SELECT doc_id AS id, length(text) AS n_chars FROM documents "
        "UNION ALL SELECT page_id, length(html) FROM pages",
        "upsert_by_id": "SELECT d.doc_id AS job_posting_id, coalesce(l.quality, -1) AS quality, "
        "coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) "
        "UNION ALL SELECT NULL, min(quality), max(toxic) FROM labels",
    }
    merged = (
        "SELECT d.doc_id AS job_posting_id, CAST(CASE WHEN l.doc_id % 3 = 0 THEN l.quality + 10 "
        "ELSE coalesce(l.quality, -1) END AS {0}) AS quality, CAST(coalesce(l.toxic, -1) AS {0}) AS toxic "
        "FROM documents d FULL JOIN labels l USING (doc_id)"
    )
    out["upsert_bucketed"] = merged.format("INTEGER")
    out["streaming_upsert"] = merged.format("BIGINT")
    out["lifecycle_diff"] = (
        "WITH o AS (SELECT doc_id, text, lang FROM documents), n AS ("
        "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text, lang "
        "FROM o WHERE doc_id % 7 <> 0 UNION ALL "
        "SELECT -1 - doc_id, text, lang FROM o WHERE doc_id % 11 = 0) "
        "SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' "
        "WHEN n.doc_id IS NULL THEN 'inactive' WHEN o.text IS NOT DISTINCT FROM n.text "
        "AND o.lang IS NOT DISTINCT FROM n.lang THEN 'same' ELSE 'changed' END AS outcome, "
        "count(o.doc_id) AS old_rows, count(n.doc_id) AS new_rows "
        "FROM o FULL JOIN n ON o.doc_id = n.doc_id GROUP BY ALL"
    )
    out["prep_postings_limited"] = (
        out["prep_postings"] + f" ORDER BY {ORDER_KEY}, job_posting_id LIMIT 100"
    )
    out["feature_concat"] = p + (
        "SELECT job_posting_id, "
        + strip("coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(location, '')")
        + " AS feature_text FROM postings"
    )
    combos = []
    for name, columns in C.COLUMN_COMBINATIONS.items():
        joined = " || ' ' || ".join(f"coalesce({c}, '')" for c in columns)
        combos.append(f"{strip(joined)} AS {name}")
    out["feature_combinations"] = (
        f"WITH {POSTINGS}, s AS (SELECT *, {strip('description')} AS summary FROM postings) "
        f"SELECT job_posting_id, {', '.join(combos)} FROM s"
    )
    for key, category in (
        ("regex_entry_level", "entry_level"),
        ("regex_data_business", "data_business_analytics"),
        ("regex_finance", "finance_analytics"),
        ("regex_marketing", "marketing_analytics"),
    ):
        out[key] = p + f"SELECT job_posting_id, title FROM postings WHERE {RULES[category]}"

    old = "CASE WHEN description IS NULL THEN 'old ' || job_posting_id END"
    inside = "position >= 100 AND position < 700"
    out["fill_range"] = (
        f"WITH {POSITIONS} SELECT job_posting_id, "
        f"CASE WHEN {inside} THEN upper(title) ELSE {old} END AS summary FROM numbered"
    )
    out["fill_range_keep_old"] = (
        f"WITH {POSITIONS} SELECT job_posting_id, "
        f"CASE WHEN {inside} AND title IS NOT NULL THEN upper(title) ELSE {old} END AS summary "
        "FROM numbered"
    )
    prompt = "'Summary: ' || coalesce(title, '') || ' | ' || coalesce(description, '')"
    out["summary_fill_job"] = (
        f"WITH {POSITIONS} SELECT job_posting_id, CASE WHEN position >= 700 AND position < 1000 "
        f"THEN {strip(prompt)} "
        f"ELSE {old} END AS summary FROM numbered"
    )
    out["query_vector_lookup"] = (
        f"WITH {VECTORS}, {REQUESTS} SELECT r.request_id, r.category, 'embedding1' AS slot, "
        "CAST(u.request_id IS NULL AS INT) AS needs_encoding, "
        "round(coalesce(u.vector[1]::DOUBLE, 0), 6) AS first_value "
        "FROM requests r LEFT JOIN reusable u USING (request_id)"
    )
    out["query_cache_upsert"] = (
        f"WITH {VECTORS}, {REQUESTS} SELECT v.category, v.slot, "
        "CASE WHEN v.model_name = 'demo/Other' OR q.query IS NULL THEN v.model_name "
        "ELSE 'demo/Hash-64' END AS model_name, "
        "round(CASE WHEN v.model_name = 'demo/Other' OR q.query IS NULL THEN v.vector[1]::DOUBLE "
        "ELSE r.request_id END, 6) AS first_value "
        "FROM stored_vectors v LEFT JOIN stored_queries q USING (category) "
        "LEFT JOIN requests r ON r.category = v.category AND r.query_text = q.query"
    )
    exploded = (
        "SELECT job_posting_id, unnest(range(len({u}))) AS position, "
        "round(unnest({u}), 6) AS value FROM units"
    )
    out["l2_normalize"] = f"WITH {VECTORS} " + exploded.format(u="u64")
    out["truncate_dim"] = f"WITH {VECTORS} " + exploded.format(u="u32")
    out["inner_product"] = (
        f"WITH {VECTORS} SELECT u.job_posting_id, u.category, "
        "round(list_inner_product(u.u64, a.u64), 6) AS score "
        "FROM units u JOIN asked a USING (category)"
    )
    out["dim_check"] = (
        "SELECT vec_id AS job_posting_id, CASE label WHEN 3 THEN -1 ELSE 40 END AS found_dim "
        "FROM embeddings WHERE label IN (3, 5)"
    )
    out["valid_vectors"] = (
        "SELECT vec_id AS job_posting_id, 'label_' || label AS category FROM embeddings "
        "WHERE label NOT IN (3, 5) AND len(embedding) = 64"
    )
    out["dim_to_model_slot"] = (
        "SELECT vec_id AS job_posting_id, CASE len(embedding) WHEN 64 THEN 'embedding1' END AS slot, "
        "CASE len(embedding) WHEN 64 THEN 'demo/Hash-64' END AS model_name FROM embeddings"
    )
    full = "WHERE model = 'unit_64d'"
    score = "round(score::DOUBLE, 6) AS score"
    out["cosine_topk"] = (
        f"WITH {hits(10)} SELECT category, rank, job_posting_id, {score} FROM hits {full}"
    )
    out["cosine_topk_blocks"] = out["cosine_topk"]
    out["cosine_topk_grid"] = (
        f"WITH {VECTORS}, pairs AS (SELECT a.job_posting_id AS query_id, c.job_posting_id, "
        "list_inner_product(a.u64, c.u64)::FLOAT AS score FROM units a, units c), "
        "best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, "
        "job_posting_id) AS rank FROM pairs) "
        "SELECT query_id, rank, job_posting_id, round(score::DOUBLE, 6) AS score FROM best WHERE rank <= 5"
    )
    out["rank_hits"] = f"WITH {hits(100)} SELECT category, rank, job_posting_id FROM hits {full}"
    out["hit_flag"] = (
        f"WITH {hits(100)} SELECT category, rank, job_posting_id, rel AS correct_output "
        f"FROM hits {full}"
    )
    out["true_match_total"] = (
        f"WITH {hits(100)} SELECT model, category, count(*) AS n_retrieved, "
        f"CAST(sum(rel) AS BIGINT) AS n_true FROM hits {full} GROUP BY model, category"
    )
    out["hits_with_metadata"] = (
        f"WITH {POSTINGS}, {hits(10)} SELECT category, rank, job_posting_id, {score}, title, "
        f"location FROM hits LEFT JOIN postings USING (job_posting_id) {full}"
    )
    for key, column in (
        ("recall_at_k", "recall"),
        ("precision_at_k", "precision"),
        ("f1_at_k", "f1"),
        ("ndcg_at_k", "ndcg"),
    ):
        out[key] = f"WITH {metrics(C.DEFAULT_KS)} SELECT category, k, {column} FROM metrics {full}"
    out["multi_k_from_one_search"] = (
        f"WITH {metrics(C.COMPARISON_KS)} SELECT category, k, n_hits FROM metrics {full}"
    )
    out["model_comparison"] = (
        f"WITH {metrics(C.COMPARISON_KS)} "
        "SELECT model, category, k, recall, precision, f1, ndcg FROM metrics"
    )
    wide = ", ".join(
        f'max(CASE WHEN k = {k} THEN {column} END) AS "{name}@{k}"'
        for k in C.COMPARISON_KS
        for name, column in (
            ("Recall", "recall"), ("Precision", "precision"), ("F1", "f1"), ("NDCG", "ndcg"),
        )
    )
    out["metrics_wide"] = (
        f"WITH {metrics(C.COMPARISON_KS)} SELECT model, category, {wide} FROM metrics GROUP BY ALL"
    )
    from sievemark.jobs.labeller import BINARY_TEMPLATE, MULTILABEL_TEMPLATE

    n_text = (
        "length(coalesce(title, '')) + length(coalesce(description, ''))"
    )
    # Lengths of the templates without their fields, braces undoubled.
    n_multi = len(MULTILABEL_TEMPLATE.format(title="", description=""))
    n_binary = len(BINARY_TEMPLATE.format(title="", description="", category=""))
    zeros = ", ".join(
        f"0 AS {c}" for c in C.MODEL_CATEGORIES if c not in ("internship", "entry_level", "marketing")
    )
    out["model_label_job"] = p + (
        f"SELECT job_posting_id, ({n_text} + {n_multi}) % 2 AS internship, "
        f"1 - ({n_text} + {n_multi}) % 2 AS entry_level, 1 AS marketing, {zeros} FROM postings"
    )
    out["model_label_once"] = p + (
        "SELECT job_posting_id, CAST((7 + length(coalesce(title, ''))) % 2 AS INTEGER) AS label FROM postings"
    )
    out["model_label_resume"] = p + (
        f"SELECT job_posting_id, ({n_text} + {n_multi}) % 2 AS internship, "
        f"CAST(({n_text} + {n_multi}) % 3 <> 0 AS INTEGER) AS in_first_run FROM postings"
    )
    out["model_label_job_per_category"] = p + (
        f"SELECT job_posting_id, ({n_text} + {n_binary + len('internship')}) % 2 AS internship, "
        f"({n_text} + {n_binary + len('marketing')}) % 2 AS marketing FROM postings"
    )
    texts = f"texts AS (SELECT job_posting_id, {FEATURE_TEXT_CLEAN} AS t FROM postings)"
    out["text_encode_job"] = (
        f"WITH {POSTINGS}, {texts}, enc AS ({encoded('texts', 'job_posting_id', 't')}) "
        "SELECT id AS job_posting_id, position, round(value, 6) AS value FROM enc"
    )
    out["retrieve_by_text"] = (
        f"WITH {VECTORS}, {POSTINGS}, {texts}, {REQUESTS}, "
        f"enc AS ({encoded('texts', 'job_posting_id', 't')}), "
        "stored_units AS (SELECT request_id AS id, unnest(range(64)) AS position, "
        "unnest(vector)::DOUBLE AS value FROM reusable), "
        "stored_norm AS (SELECT id, position, value / sqrt(sum(value * value) OVER (PARTITION BY id)) "
        "AS value FROM stored_units), "
        f"asked_texts AS ({encoded('requests', 'request_id', 'query_text')}), "
        "q AS (SELECT * FROM stored_norm UNION ALL SELECT * FROM asked_texts "
        "WHERE id NOT IN (SELECT request_id FROM reusable)), "
        "pairs AS (SELECT q.id AS request_id, e.id AS job_posting_id, "
        "sum(q.value * e.value)::FLOAT AS score FROM q JOIN enc e USING (position) GROUP BY ALL), "
        "every_pair AS (SELECT r.request_id, t.job_posting_id, coalesce(p.score, 0::FLOAT) AS score "
        "FROM requests r CROSS JOIN texts t LEFT JOIN pairs p "
        "ON p.request_id = r.request_id AND p.job_posting_id = t.job_posting_id), "
        "best AS (SELECT *, row_number() OVER (PARTITION BY request_id "
        "ORDER BY score DESC, job_posting_id) AS rank FROM every_pair) "
        "SELECT request_id, rank, job_posting_id, round(score::DOUBLE, 6) AS score, location "
        "FROM best JOIN postings USING (job_posting_id) WHERE rank <= 10"
    )
    out["csv_round_trip"] = "SELECT doc_id, '\"q\" ' || text AS text, lang FROM documents"
    out["category_subsets_written"] = (
        f"WITH {SUBSETS} SELECT job_posting_id, title, location, category FROM subsets"
    )
    out["manifest_written"] = (
        f"WITH {SUBSETS}, dim(category, description) AS (VALUES "
        + ", ".join(f"({lit(k)}, {lit(v)})" for k, v in LABEL_DESCRIPTIONS.items())
        + ") SELECT d.category, d.description, count(s.category) AS n_rows, "
        "'category=' || d.category AS file, 0::BIGINT AS chunk, "
        "coalesce(string_agg(s.job_posting_id::VARCHAR, ',' ORDER BY s.job_posting_id), '') AS ids, "
        "'labels' AS method, '42' AS shuffle_seed "
        "FROM dim d LEFT JOIN subsets s USING (category) GROUP BY d.category, d.description"
    )
    out["vector_append"] = (
        "SELECT coalesce(vec_id, doc_id) AS job_posting_id, "
        "CASE WHEN vec_id IS NULL THEN 'stale' ELSE 'label_' || label END AS category, "
        "CASE WHEN vec_id IS NULL THEN -1 ELSE len(embedding) END AS dim "
        "FROM documents FULL JOIN embeddings ON doc_id = vec_id"
    )
    out["source_fallback"] = "SELECT doc_id, quality, toxic FROM labels"
    return out


# Columns that Spark counts in 32 bits and DuckDB in 64.
INT_COLUMNS = {
    "text_stats": ["original_chars", "stripped_chars"],
    "category_ids": ["n_ids"],
    "union_append": ["n_chars"],
    "l2_normalize": ["position"],
    "truncate_dim": ["position"],
    "cosine_topk": ["rank"],
    "cosine_topk_blocks": ["rank"],
    "cosine_topk_grid": ["rank"],
    "model_label_resume": ["internship"],
    "rank_hits": ["rank"],
    "hit_flag": ["rank"],
    "hits_with_metadata": ["rank"],
    "retrieve_by_text": ["rank"],
    "text_encode_job": ["position"],
    "vector_append": ["dim"],
    "model_label_job": ["internship", "entry_level"],
    "model_label_job_per_category": ["internship", "marketing"],
}


def _with_int_columns(name: str, sql: str) -> str:
    columns = INT_COLUMNS.get(name)
    if not columns:
        return sql
    casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({casts}) FROM ({sql})"


ORACLE_SQL = {name: _with_int_columns(name, sql) for name, sql in _sql().items()}
