"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm import (
    bpe,
    collocations,
    decontaminate,
    merkle,
    mixing,
    page_text,
    quality,
    repeats,
    secret_scan,
    simhash,
    sketch,
    toxicity,
    warc,
)

LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_decontaminate(spark, sf_dir):
    """Every document that holds a benchmark passage, with the item."""
    return decontaminate.overlaps(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


# Windows with two replaced tokens keep a run of four equal ones, so runs of four are anchors.
ORACLE_SQL["op1_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM documents
), i AS (
  SELECT item_id, t, len(t) AS n, least(13, len(t)) AS length
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM benchmark)
  WHERE len(t) >= 5
), dg AS (
  SELECT doc_id, p, array_to_string(t[p:p+3], ' ') AS g
  FROM (SELECT doc_id, t, unnest(generate_series(1, len(t) - 3)) AS p FROM d WHERE len(t) >= 4)
), ig AS (
  SELECT item_id, p, array_to_string(t[p:p+3], ' ') AS g
  FROM (SELECT item_id, t, unnest(generate_series(1, len(t) - 3)) AS p FROM i)
), hits AS (
  SELECT DISTINCT doc_id, item_id, dg.p - ig.p AS shift FROM dg JOIN ig USING (g)
), w AS (
  SELECT doc_id, item_id, shift, length, d.t AS dt, i.t AS it, unnest(generate_series(0, n - length)) AS s
  FROM hits JOIN d USING (doc_id) JOIN i USING (item_id)
), e AS (
  SELECT doc_id, item_id, s + shift AS first, length,
    list_sum(list_transform(generate_series(1, length),
      lambda j: CASE WHEN j + s + shift >= 1 AND dt[j + s + shift] = it[j + s] THEN 1 ELSE 0 END)) AS n_equal
  FROM w
)
SELECT doc_id, item_id, CAST(max(n_equal) AS INTEGER) AS best_equal,
  CAST(min(greatest(first, 0)) AS BIGINT) AS first_token,
  CAST(max(first + length - 1) AS BIGINT) AS last_token
FROM e WHERE n_equal >= CASE WHEN length < 13 THEN length ELSE 11 END
GROUP BY doc_id, item_id
"""


@register
def op9_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op6_secret_scan(spark, sf_dir):
    """Spans of secrets in every document."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@register
def op8_warc(spark, sf_dir):
    """Every page through a deduplicated archive and back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLE_SQL["op8_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


@register
def op4_mixing(spark, sf_dir):
    """Words that the mix takes from every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@register
def op5_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op10_quality(spark, sf_dir):
    """Quality score of every document."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op3_sketch(spark, sf_dir):
    """Threshold-scaled sketch of every document and of its edited text."""
    return sketch.sketches_with_edits(table(spark, sf_dir, "documents"))


def _sketch_sql(text: str) -> str:
    """Sorted kept hashes of the text column."""
    return f"""(
  SELECT CASE WHEN len(b) > 0 THEN b ELSE h[1:1] END FROM (
    SELECT h, list_filter(h, lambda x: x < '4000000000000000') AS b FROM (
      SELECT list_sort(list_distinct(list_transform(
        generate_series(1, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END),
        lambda i: substr(md5(array_to_string(w[i:i+4], ' ')), 1, 16)))) AS h
      FROM (SELECT regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+') AS w))))"""


ORACLE_SQL["op3_sketch"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), n AS (
  SELECT doc_id, text, length(text) AS n,
    coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next,
    lead(doc_id) OVER (ORDER BY doc_id DESC) AS next_id
  FROM d
), e AS (
  SELECT *, left(text, n - n // 2) || left(next, n // 2) AS edited FROM n
), s AS (
  SELECT doc_id, n, sha256(edited) AS edited_sha256, {_sketch_sql("text")} AS a,
    {_sketch_sql("edited")} AS b, {_sketch_sql("next")} AS c
  FROM e
)
SELECT doc_id, n AS n_chars, edited_sha256, array_to_string(a, '') AS fingerprint,
  array_to_string(b, '') AS edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE
    / len(list_distinct(list_concat(a, b))) END AS near_edited,
  CASE WHEN len(a) + len(c) = 0 THEN 1.0 ELSE len(list_intersect(a, c))::DOUBLE
    / len(list_distinct(list_concat(a, c))) END AS near_next,
  CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / len(a) END AS in_edited
FROM s
"""


@register
def op2_page_text(spark, sf_dir):
    """Main text of every page."""
    return page_text.extract(table(spark, sf_dir, "pages"))


@register
def op7_repeats(spark, sf_dir):
    """Every document without passages that smaller documents have."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def merkle_rows(docs: DataFrame) -> DataFrame:
    """Manifest rows of ``docs`` in which every fifth row, by the hash of its id, is tampered with."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lowered = [F.col(c) if c != "text" else F.translate("text", CAPITALS, SMALL) for c in LEAF_FIELDS]
    claimed = F.when(tampered, merkle.leaf(*lowered))
    rows = merkle.manifest(docs, LEAF_FIELDS, carry={"claimed": claimed})
    folded = merkle.fold(F.coalesce("claimed", "leaf"), F.col("proof"))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings_text(F.col("proof")), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@register
def op13_merkle(spark, sf_dir):
    """Leaf, roots and checked proof of every document."""
    return merkle_rows(table(spark, sf_dir, "documents"))


def _merkle_sql() -> str:
    """Levels written out: five of leaves (a million a source), three of sources."""

    def framed(value: str) -> str:
        return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(framed(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def levels(name: str, many: int) -> str:
        """Tables name1, name2, ... above name0 (k, i, n, h)."""
        return "".join(
            f"""), {name}{j} AS (
  SELECT k, i // 16 AS i, max(n) AS n,
    CASE WHEN max(n) > {16 ** (j - 1)} THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h
  FROM {name}{j - 1} GROUP BY k, i // 16
"""
            for j in range(1, many + 1)
        )

    def beside(name: str, many: int) -> str:
        """Tables name_b0, ...: digests before and after each node in its run; null if no level."""
        run = "PARTITION BY k, i // 16 ORDER BY i ROWS BETWEEN"
        return "".join(
            f"""), {name}_b{j} AS (
  SELECT k, i,
    CASE WHEN n > {16**j} THEN coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS b,
    CASE WHEN n > {16**j} THEN coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS a
  FROM {name}{j}
"""
            for j in range(many)
        )

    def crc(value: str) -> str:
        """CRC-32 of ASCII text, bit by bit."""
        bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
        byte = f"lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: {bit})"
        codes = f"list_transform(string_split({value}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
        return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), {byte}), 4294967295)"

    steps, before = [], "f0"
    on_levels = [f"l_b{j} x ON x.k = f.k AND x.i = f.i // {16**j}" for j in range(5)]
    on_levels += [f"s_b{j} x ON x.i = f.si // {16**j}" for j in range(3)]
    for j, on in enumerate(on_levels, 1):
        steps.append(f"""), f{j} AS (
  SELECT f.* EXCLUDE (found, proof), coalesce(sha256(x.b || found || x.a), found) AS found,
    proof || coalesce(x.b || x.a, '') AS proof
  FROM {before} f JOIN {on}
""")
        before = f"f{j}"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS k, {leaf("text")} AS h,
    {leaf(f"translate(text, '{CAPITALS}', '{SMALL}')")} AS lowered
  FROM documents
), l0 AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
    count(*) OVER (PARTITION BY k) AS n FROM d
{levels("l", 5)}), s0 AS (
  SELECT 0 AS k, k AS name, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n, h FROM l5
{levels("s", 3)}{beside("l", 5)}{beside("s", 3)}), f0 AS (
  SELECT l0.*, s0.i AS si, s0.h AS subroot, s3.h AS root, '' AS proof,
    CASE WHEN {crc("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN lowered ELSE l0.h END AS found
  FROM l0 JOIN s0 ON s0.name = l0.k CROSS JOIN s3
{"".join(steps)})
SELECT doc_id, h AS leaf, subroot, root, sha256(proof) AS proof_sha256, found AS folded_root, found = root AS verified
FROM {before}
"""


ORACLE_SQL["op13_merkle"] = _merkle_sql()


def bpe_rows(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids of every document and of the text that they decode to."""
    vocabulary = bpe.read_vocabulary(path)
    coded = docs.select("doc_id", bpe.encode(F.col("text"), vocabulary).alias("ids"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), vocabulary), 256).alias("decoded_sha256"),
    )


@register
def op12_bpe(spark, sf_dir):
    """Token ids of every document, and back."""
    return bpe_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register
def op11_collocations(spark, sf_dir):
    """The best phrases of two and three words in every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL["op11_collocations"] = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[.,;:!?
-]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p
), g AS (
  SELECT lang, size, w[i:i+size-1] AS words FROM (
    SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
    FROM w, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size)
), f AS (
  SELECT lang, size, words, count(*) AS f FROM g GROUP BY lang, size, words
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang
), c AS (
  SELECT * FROM f WHERE size > 1 AND f >= 10
), cuts AS (
  SELECT lang, words, size, f, unnest(generate_series(1, size - 1)) AS k FROM c
), scored AS (
  SELECT c.lang, c.words, c.f AS a, c.k, x.f AS l, y.f AS r,
    (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.words = c.words[1:c.k]
  JOIN f y ON y.lang = c.lang AND y.words = c.words[c.k+1:c.size]
), best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, k) AS place FROM scored) WHERE place = 1
), part AS (
  SELECT lang, words[1:2] AS words, f FROM c WHERE size = 3
  UNION ALL SELECT lang, words[2:3], f FROM c WHERE size = 3
), longer AS (
  SELECT lang, words, max(f) AS f FROM part GROUP BY lang, words
), kept AS (
  SELECT b.lang, array_to_string(b.words, ' ') AS phrase, b.a, b.l, b.r, CAST(b.score AS BIGINT) AS score
  FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.words = b.words
  WHERE o.f IS NULL OR 100 * o.f < 50 * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT r.lang, rank, phrase, a, l, r.r, n, score FROM ranked r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""
