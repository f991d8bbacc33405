"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sievemark import constants as C
from sievemark.catalog import tables as T
from sievemark.catalog.tables import ID, LABEL_CATEGORIES
from sievemark.functions import markup, names, responses, strings
from sievemark.functions import vectors as V
from sievemark.jobs.answers import answer_distinct
from sievemark.jobs.encode import hashing_encoder, run_encode_job
from sievemark.jobs.labeller import (
    apply_exclusion,
    label_per_category,
    run_label_job,
    with_prompt,
)
from sievemark.jobs.summary import fill_summaries
from sievemark.operators import dedup, filters, joins, labels, metrics, ordering, rulebook, sets, snapshots, topk
from sievemark.plans.evaluation import compare_models, search_models
from sievemark.plans.prep import clean_postings, prep_postings
from sievemark.plans.retrieval import retrieve_by_text
from sievemark.session import materialize, scratch_path
from sievemark.sources import buckets, readers, sinks
from sievemark.streaming.upserts import upsert_new_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


# --- filters, projections, casts -------------------------------------------------


@register
def drop_null(spark, sf):
    return filters.drop_null(T.postings(spark, sf), "description")


@register
def drop_blank(spark, sf):
    return filters.drop_blank(T.postings(spark, sf), "description")


@register
def regex_contains(spark, sf):
    docs = T.table(spark, sf, "documents")
    pattern = labels.any_word(["est", "the", "und", "los"])
    return docs.select(
        "doc_id", filters.contains_pattern(F.col("text"), pattern).cast("int").alias("hit")
    )


@register
def include_exclude(spark, sf):
    docs = T.table(spark, sf, "documents")
    hit = filters.include_exclude(F.col("text"), "tion", "queque|ing\\b")
    return docs.where(hit).select("doc_id", "lang")


@register
def positive_labels(spark, sf):
    long = labels.labels_to_long(T.label_matrix(spark, sf), ID, LABEL_CATEGORIES)
    return filters.positive_labels(long)


@register
def completeness(spark, sf):
    return filters.completeness(T.postings(spark, sf), C.POSTING_COLUMNS)


@register
def select_existing(spark, sf):
    return filters.select_existing(T.postings(spark, sf), [ID, "salary", "location", "title"])


@register
def require_columns(spark, sf):
    return filters.require_columns(T.postings(spark, sf), [ID, "title", "location"])


@register
def label_cast(spark, sf):
    wide = joins.labels_left_join(T.postings(spark, sf), T.label_matrix(spark, sf), ID)
    return wide.select(ID, *[responses.label_cast(F.col(c)).alias(c) for c in LABEL_CATEGORIES])


# --- dedup, order, slices ------------------------------------------------------------


@register
def dedup_title_desc(spark, sf):
    return dedup.keep_first(T.postings(spark, sf), ["title", "description"], [ID])


@register
def dedup_title_desc_loc(spark, sf):
    keyed = ordering.with_order_key(T.postings(spark, sf), ID)
    return dedup.keep_first(
        keyed, ["title", "description", "location"], [ordering.ORDER_COL, ID]
    ).drop(ordering.ORDER_COL)


@register
def unique_id_check(spark, sf):
    """Repeated ids of the conversation table, whose conversations have many turns."""
    return dedup.duplicate_ids(T.table(spark, sf, "conversations"), "conv_id")


@register
def seeded_shuffle(spark, sf):
    """Ids in seeded order, with the place at which the sorted table holds them."""
    path = scratch_path(spark, "shuffled")
    ordering.seeded_shuffle(T.postings(spark, sf).select(ID), ID).withColumn(
        "place", F.monotonically_increasing_id()
    ).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("part", F.shiftright("place", 33))
    # As many sizes as the sort had partitions.
    sizes = sorted((r.part, r["count"]) for r in rows.groupBy("part").count().collect())
    before, offsets = 0, []
    for part, size in sizes:
        offsets += [F.lit(part), F.lit(before)]
        before += size
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.select(ID, (F.create_map(*offsets)[F.col("part")] + inside).alias("position"))


@register
def first_rows(spark, sf):
    return ordering.first_rows(T.postings(spark, sf), ID, 100)


@register
def positional_slice(spark, sf):
    return ordering.slice_rows(T.postings(spark, sf), ID, 300, 1000).select(
        ID, "title", "position"
    )


@register
def batch_assign(spark, sf):
    return ordering.with_batch(T.postings(spark, sf).select(ID), ID, 60)


@register
def prep_postings_(spark, sf):
    return prep_postings(T.postings(spark, sf), ID)


@register
def prep_postings_limited(spark, sf):
    return prep_postings(T.postings(spark, sf), ID, n=100)


@register
def clean_postings_(spark, sf):
    return clean_postings(T.marked_up_postings(spark, sf), ID)


# --- text ------------------------------------------------------------------------------


@register
def clean_description(spark, sf):
    pages = T.table(spark, sf, "pages").select("page_id", F.col("html").alias("description"))
    return markup.clean_description(pages, "description")


@register
def clean_description_markdown(spark, sf):
    raw = T.marked_up_postings(spark, sf).select(ID, "description")
    return markup.clean_description(raw, "description")


@register
def feature_concat(spark, sf):
    columns = C.COLUMN_COMBINATIONS["combination3"]
    return T.postings(spark, sf).select(ID, strings.join_columns(columns).alias("feature_text"))


@register
def feature_concat_clean(spark, sf):
    columns = ["title", "description"]
    return T.postings(spark, sf).select(
        ID, strings.join_columns_clean(columns).alias("feature_text")
    )


@register
def feature_combinations(spark, sf):
    """All five column combinations; the summary is the cleaned description."""
    df = T.postings(spark, sf).withColumn("summary", strings.strip(F.col("description")))
    return df.select(
        ID, *[strings.join_columns(cols).alias(n) for n, cols in C.COLUMN_COMBINATIONS.items()]
    )


@register
def truncate_chars(spark, sf):
    return T.postings(spark, sf).select(
        ID, strings.truncate_chars(F.col("description")).alias("description")
    )


@register
def render_prompt(spark, sf):
    template = 'Title: {title}\nText: {description}\nAnswer {{"quality": 0}}'
    return with_prompt(T.postings(spark, sf), template).select(ID, "prompt")


@register
def render_summary_prompt(spark, sf):
    template = "Summarize {title} as {{json}}:\n{description}"
    values = {"title": F.col("title"), "description": F.col("description")}
    return T.postings(spark, sf).select(
        ID, strings.render_replace(template, values).alias("prompt")
    )


@register
def normalize_model_id(spark, sf):
    """Part types and names stand in for model ids."""
    part = T.table(spark, sf, "part")
    raw = F.concat(F.lit(" "), "p_brand", F.lit("/"), "p_name", F.lit("_/"), "p_type", F.lit(" "))
    return part.select("p_partkey", names.normalize_model_id(raw).alias("model_id"))


@register
def model_name_from_path(spark, sf):
    part = T.table(spark, sf, "part")
    path = F.concat(
        F.lit("models/embeddings_title_"),
        F.col("p_size").cast("string"),
        F.lit("_"),
        F.col("p_partkey").cast("string"),
        F.lit("d_v2.pkl"),
    )
    return part.select("p_partkey", names.model_name_from_path(path).alias("model"))


@register
def text_stats(spark, sf):
    df = T.postings(spark, sf)
    return df.select(
        ID,
        F.coalesce(strings.text_length(F.col("description")), F.lit(-1)).alias("original_chars"),
        F.coalesce(strings.text_length(strings.strip(F.col("description"))), F.lit(-1)).alias(
            "stripped_chars"
        ),
    )


@register
def strip_equals(spark, sf):
    df = T.postings(spark, sf)
    padded = F.concat(F.lit("\n "), F.col("description"), F.lit("\t"))
    return df.select(
        ID,
        strings.strip_equals(F.col("description"), padded).cast("int").alias("same_text"),
        strings.strip_equals(F.col("description"), F.lit(None)).cast("int").alias("empty_text"),
    )


# --- labels ----------------------------------------------------------------------------


def _rule_query(rule: labels.Rule) -> Query:
    def run(spark, sf):
        return labels.matching_rows(T.postings(spark, sf), rule).select(ID, "title")

    return run


QUERIES["regex_entry_level"] = _rule_query(labels.ENTRY_LEVEL)
QUERIES["regex_data_business"] = _rule_query(labels.DATA_BUSINESS)
QUERIES["regex_finance"] = _rule_query(labels.FINANCE)
QUERIES["regex_marketing"] = _rule_query(labels.MARKETING)


@register
def regex_multilabel(spark, sf):
    return labels.label_by_rules(T.postings(spark, sf)).select(ID, "title", "category")


@register
def rulebook_labels(spark, sf):
    """Whole descriptions under 676 rules: a word "..tion" of six letters, but not its "..ing"."""
    starts = [a + b for a in ascii_lowercase for b in ascii_lowercase]
    rules = [labels.Rule(f"{x}tion", rf"\b{x}tion\b", rf"\b{x}ing\b") for x in starts]
    found = rulebook.label_by_rulebook(T.postings(spark, sf), rules, "description")
    return found.select(ID, "category")


@register
def parse_binary_label(spark, sf):
    raw = F.concat(F.lit(" "), F.col("quality").cast("string"), F.lit("\n"))
    odd = F.concat(F.lit("0"), F.col("quality").cast("string"))
    return T.label_matrix(spark, sf).select(
        ID,
        responses.parse_binary(raw).alias("label"),
        responses.parse_binary(odd).alias("odd_label"),
    )


@register
def extract_json(spark, sf):
    df = T.responses(spark, sf).withColumn("obj", responses.extract_json(F.col("raw")))
    return df.select(
        ID,
        F.col("obj").isNotNull().cast("int").alias("has_json"),
        F.try_variant_get("obj", "$.quality", "string").alias("quality_text"),
    )


@register
def parse_multilabel(spark, sf):
    return responses.parse_multilabel(T.responses(spark, sf), "raw", LABEL_CATEGORIES)


@register
def mutual_exclusion(spark, sf):
    parsed = parse_multilabel(spark, sf)
    return apply_exclusion(parsed, winner="toxic", loser="quality")


@register
def labels_left_join(spark, sf):
    wide = joins.labels_left_join(T.postings(spark, sf), T.label_matrix(spark, sf), ID)
    return wide.select(ID, "title", *[F.coalesce(c, F.lit(-1)).alias(c) for c in LABEL_CATEGORIES])


@register
def review_join(spark, sf):
    """Labelled rows with their posting, in the review columns."""
    rows = T.label_matrix(spark, sf).join(T.postings(spark, sf), ID, "left")
    return rows.select(ID, "title", "location", *LABEL_CATEGORIES)


@register
def posting_category_pairs(spark, sf):
    return joins.posting_category_pairs(
        T.postings(spark, sf).select(ID), list(C.MODEL_CATEGORIES)
    )


@register
def pairs_to_wide(spark, sf):
    long = labels.labels_to_long(T.label_matrix(spark, sf), ID, LABEL_CATEGORIES)
    return joins.pairs_to_wide(long, ID, LABEL_CATEGORIES)


@register
def category_lookup(spark, sf):
    found = labels.label_by_rules(T.postings(spark, sf)).select(ID, "category")
    return joins.with_category_description(found).select(
        ID, "category", F.coalesce("description", F.lit("")).alias("description")
    )


@register
def labels_to_subsets(spark, sf):
    return labels.labels_to_subsets(
        T.postings(spark, sf), T.label_matrix(spark, sf), ID, LABEL_CATEGORIES
    ).select(ID, "title", "category", *LABEL_CATEGORIES)


def _subsets(spark, sf):
    return labels.labels_to_subsets(
        T.postings(spark, sf), T.label_matrix(spark, sf), ID, LABEL_CATEGORIES
    )


@register
def category_counts(spark, sf):
    dim = joins.category_dim(spark, T.LABEL_DESCRIPTIONS)
    return labels.category_counts(_subsets(spark, sf), dim)


@register
def category_ids(spark, sf):
    chunks = labels.category_ids(_subsets(spark, sf), ID, ids_per_chunk=100)
    return chunks.select(
        "category", "chunk", "n_ids", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")
    )


# --- tables that grow --------------------------------------------------------------------


@register
def pending_anti_join(spark, sf):
    return joins.pending_rows(T.postings(spark, sf), T.label_matrix(spark, sf), ID).select(
        ID, "title", "location"
    )


@register
def union_append(spark, sf):
    docs = T.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    pages = T.table(spark, sf, "pages").select(F.col("html").alias("text"), F.col("page_id").alias("id"))
    both = sets.union_append(docs, pages)
    return both.select("id", F.char_length("text").alias("n_chars"))


@register
def upsert_by_id(spark, sf):
    """Label table, its first rows twice and with a null id, over the document table."""
    old = T.table(spark, sf, "documents").select(
        F.col("doc_id").alias(ID), F.lit(-1).alias("quality"), F.lit(-1).alias("toxic")
    )
    new = T.label_matrix(spark, sf)
    again = new.where(F.col(ID) % 3 == 0).withColumn("quality", F.col("quality") + 10)
    nameless = new.groupBy().agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    nameless = nameless.withColumn(ID, F.lit(None).cast("long")).select(*new.columns)
    once = sets.upsert(old, new.unionByName(again).unionByName(nameless), [ID])
    return sets.upsert(once, nameless, [ID])


@register
def upsert_bucketed(spark, sf):
    """Labels merged into the stored document table, then a third of them again."""
    path = scratch_path(spark, "bucketed")
    old = T.table(spark, sf, "documents").select(
        F.col("doc_id").alias(ID), F.lit(-1).alias("quality"), F.lit(-1).alias("toxic")
    )
    buckets.write_bucketed(old, path, [ID], 32)
    new = T.label_matrix(spark, sf)
    buckets.merge_bucketed(spark, path, new, [ID], 32)
    again = new.where(F.col(ID) % 3 == 0).withColumn("quality", F.col("quality") + 10)
    buckets.merge_bucketed(spark, path, again, [ID], 32)
    return buckets.read_bucketed(spark, path)


@register
def lifecycle_diff(spark, sf):
    """Documents against a copy in which some are gone, some changed and some new."""
    old = T.table(spark, sf, "documents").select("doc_id", "text", "lang")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    later = old.where(F.col("doc_id") % 11 == 0).withColumn("doc_id", -1 - F.col("doc_id"))
    new = old.where(F.col("doc_id") % 7 != 0).withColumn("text", text).unionByName(later)
    return snapshots.lifecycle_diff(old, new, ["doc_id"])


@register
def streaming_upsert(spark, sf):
    """Documents, then labels, then a third of the labels again arrive as files."""
    base = scratch_path(spark, "stream")
    docs = T.table(spark, sf, "documents").select(
        F.col("doc_id").alias(ID), F.lit(-1).alias("quality"), F.lit(-1).alias("toxic")
    )
    new = T.label_matrix(spark, sf)
    again = new.where(F.col(ID) % 3 == 0).withColumn("quality", F.col("quality") + 10)
    for arrived in (docs, new, again):
        arrived.select(*[F.col(c).cast("long") for c in docs.columns]).write.mode("append").parquet(f"{base}/in")
        schema = spark.read.parquet(f"{base}/in").schema
        upsert_new_files(spark, f"{base}/in", schema, f"{base}/table", f"{base}/seen", [ID], 16).awaitTermination()
    return buckets.read_bucketed(spark, f"{base}/table")


def _summary_master(spark, sf):
    return T.postings(spark, sf).withColumn(
        "summary",
        F.when(F.col("description").isNull(), F.concat(F.lit("old "), F.col(ID).cast("string"))),
    )


@register
def fill_range(spark, sf):
    master = _summary_master(spark, sf)
    rows = ordering.slice_rows(master, ID, 100, 700)
    values = rows.select(ID, F.upper("title").alias("summary"))
    return sets.fill_values(master, values, ID, "summary").select(ID, "summary")


@register
def fill_range_keep_old(spark, sf):
    master = _summary_master(spark, sf)
    rows = ordering.slice_rows(master, ID, 100, 700)
    values = rows.select(ID, F.upper("title").alias("summary"))
    return sets.fill_values(master, values, ID, "summary", keep_old_on_null=True).select(
        ID, "summary"
    )


def _requests(spark, sf):
    """Every benchmark text as a search request of one of ten categories."""
    bench = T.table(spark, sf, "benchmark")
    return bench.select(
        F.col("item_id").alias("request_id"),
        F.concat(F.lit("label_"), (F.col("item_id") % 12).cast("string")).alias("category"),
        F.concat(F.lit(" "), F.col("text"), F.lit("\n")).alias("query_text"),
        F.lit(64).alias("dim"),
    )


def _stored_queries(spark, sf):
    """The first request of each of the ten known categories is its stored query."""
    cats = T.query_vectors(spark, sf).select("category")
    first = (
        _requests(spark, sf)
        .groupBy("category")
        .agg(F.min_by("query_text", "request_id").alias("query"))
    )
    return first.join(cats, "category", "left_semi")


def _stored_vectors(spark, sf):
    """Slot embedding1 of every category, in three categories owned by another model."""
    q = T.query_vectors(spark, sf)
    other = F.col("category").isin("label_3", "label_5", "label_7")
    return q.select(
        "category",
        F.lit("embedding1").alias("slot"),
        F.when(other, "demo/Other").otherwise("DEMO/hash_64").alias("model_name"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


@register
def query_vector_lookup(spark, sf):
    found = joins.query_vector_lookup(
        _requests(spark, sf), _stored_queries(spark, sf), _stored_vectors(spark, sf), T.SLOTS
    )
    return found.select(
        "request_id",
        "category",
        "slot",
        F.col("needs_encoding").cast("int").alias("needs_encoding"),
        F.round(F.coalesce(F.get("vector", F.lit(0)), F.lit(0.0)), 6).alias("first_value"),
    )


@register
def query_cache_upsert(spark, sf):
    encoded = _requests(spark, sf).select(
        "category",
        F.lit("embedding1").alias("slot"),
        F.lit("demo/Hash-64").alias("model_name"),
        "query_text",
        F.array(F.col("request_id").cast("double")).alias("vector"),
    )
    stored = sets.query_cache_upsert(
        _stored_queries(spark, sf), _stored_vectors(spark, sf), encoded
    )
    return stored.select(
        "category", "slot", "model_name", F.round(F.get("vector", F.lit(0)), 6).alias("first_value")
    )


# --- vectors, search, metrics ------------------------------------------------------------


@register
def l2_normalize(spark, sf):
    unit = T.vectors(spark, sf).select(ID, V.l2_normalize(F.col("embedding")).alias("u"))
    return unit.select(ID, F.posexplode("u").alias("position", "value")).select(
        ID, "position", r6("value")
    )


@register
def truncate_dim(spark, sf):
    unit = T.vectors(spark, sf).select(ID, V.truncate_dim(F.col("embedding"), 32).alias("u"))
    return unit.select(ID, F.posexplode("u").alias("position", "value")).select(
        ID, "position", r6("value")
    )


@register
def inner_product(spark, sf):
    """Each vector with the query of its own category."""
    q = T.query_vectors(spark, sf).select("category", F.col("embedding").alias("query"))
    pairs = T.vectors(spark, sf).join(q, "category")
    cosine = V.inner_product(
        V.l2_normalize(F.col("embedding")), V.l2_normalize(F.col("query"))
    )
    return pairs.select(ID, "category", F.round(cosine, 6).alias("score"))


def _mixed_vectors(spark, sf):
    """All vectors, those of one category cut short and those of another missing."""
    v, category = F.col("embedding"), F.col("category")
    cut = F.when(category == "label_3", None).when(category == "label_5", F.slice(v, 1, 40))
    cut = F.when(category.isin("label_3", "label_5"), cut).otherwise(v)
    return T.vectors(spark, sf).withColumn("embedding", cut)


@register
def dim_check(spark, sf):
    bad = filters.rejected_vectors(_mixed_vectors(spark, sf), "embedding", 64)
    return bad.select(ID, F.coalesce("found_dim", F.lit(-1)).alias("found_dim"))


@register
def valid_vectors(spark, sf):
    return filters.valid_vectors(_mixed_vectors(spark, sf), "embedding", 64).select(ID, "category")


@register
def dim_to_model_slot(spark, sf):
    wide = T.vectors(spark, sf).withColumn("dim", F.size("embedding"))
    slot, model = V.slot_for_dim(F.col("dim"), T.SLOTS)
    return wide.select(ID, slot.alias("slot"), model.alias("model_name"))


def _models(spark, sf, names=("unit_64d", "unit_32d")):
    """({model: (corpus, queries)}, truth)."""
    queries = T.query_vectors(spark, sf)
    corpus = T.corpus_vectors(spark, sf, queries)
    # The search scales vectors itself, so the cut vectors need no normalising here.
    half = F.slice("embedding", 1, T.MODEL_DIMS["unit_32d"])
    models = {
        "unit_64d": (corpus, queries),
        "unit_32d": (corpus.withColumn("embedding", half), queries.withColumn("embedding", half)),
    }
    return {n: models[n] for n in names}, corpus.select("category", ID)


def _hits(spark, sf, k=100):
    """(hits of the 64-wide model, truth)."""
    models, truth = _models(spark, sf, ["unit_64d"])
    hits, _ = search_models(models, k, id_col=ID)
    return hits, truth


@register
def cosine_topk(spark, sf):
    queries = T.query_vectors(spark, sf)
    return topk.cosine_topk(
        T.corpus_vectors(spark, sf, queries),
        queries,
        10,
        id_col=ID,
        query_cols=["category"],
    ).select("category", "rank", ID, r6("score"))


@register
def cosine_topk_blocks(spark, sf):
    """The same search with three queries at a time."""
    queries = T.query_vectors(spark, sf)
    corpus = T.corpus_vectors(spark, sf, queries)
    hits = topk.cosine_topk(corpus, queries, 10, id_col=ID, query_cols=["category"], block_queries=3)
    return hits.select("category", "rank", ID, r6("score"))


@register
def cosine_topk_grid(spark, sf):
    """The five vectors nearest to every vector, 64 queries in a block."""
    corpus = T.vectors(spark, sf)
    queries = corpus.select(F.col(ID).alias("query_id"), "embedding")
    hits = topk.cosine_topk(corpus, queries, 5, id_col=ID, query_cols=["query_id"], block_queries=64)
    return hits.select("query_id", "rank", ID, r6("score"))


@register
def rank_hits(spark, sf):
    hits, _ = _hits(spark, sf)
    return hits.select("category", "rank", ID)


@register
def hit_flag(spark, sf):
    hits, truth = _hits(spark, sf)
    flagged = metrics.flag_hits(hits, truth, ["category", ID], hits.count())
    return flagged.select(
        "category", "rank", ID, F.col("correct_output").cast("int").alias("correct_output")
    )


@register
def true_match_total(spark, sf):
    hits, truth = _hits(spark, sf)
    flagged = metrics.flag_hits(hits, truth, ["category", ID], hits.count())
    return metrics.match_totals(flagged)


@register
def hits_with_metadata(spark, sf):
    hits, _ = _hits(spark, sf, 10)
    rows = joins.with_metadata(hits, T.postings(spark, sf), ID, hits.count())
    return rows.select("category", "rank", ID, r6("score"), "title", "location")


def _metrics(spark, sf, ks):
    models, truth = _models(spark, sf, ["unit_64d"])
    return compare_models(models, truth, ks, id_col=ID)


@register
def recall_at_k(spark, sf):
    return _metrics(spark, sf, C.DEFAULT_KS).select("category", "k", r6("recall"))


@register
def precision_at_k(spark, sf):
    return _metrics(spark, sf, C.DEFAULT_KS).select("category", "k", r6("precision"))


@register
def f1_at_k(spark, sf):
    return _metrics(spark, sf, C.DEFAULT_KS).select("category", "k", r6("f1"))


@register
def ndcg_at_k(spark, sf):
    return _metrics(spark, sf, C.DEFAULT_KS).select("category", "k", r6("ndcg"))


@register
def multi_k_from_one_search(spark, sf):
    return _metrics(spark, sf, C.COMPARISON_KS).select("category", "k", "n_hits")


@register
def model_comparison(spark, sf):
    found = compare_models(*_models(spark, sf), id_col=ID)
    return found.select(
        "model", "category", "k", r6("recall"), r6("precision"), r6("f1"), r6("ndcg")
    )


@register
def metrics_wide(spark, sf):
    found = compare_models(*_models(spark, sf), id_col=ID)
    wide = metrics.metrics_wide(found)
    values = [c for c in wide.columns if "@" in c]
    return wide.select("model", "category", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in values])


# --- jobs with user functions --------------------------------------------------------------


def demo_labeller(prompts: list[str]) -> list[str]:
    """Stand-in for a labelling model: answers from the length of the prompt."""
    return [
        "```json\n{" + f'"internship": {len(p) % 2}, "entry_level": 1, "marketing": "x"' + "}\n```"
        for p in prompts
    ]


def demo_binary_labeller(prompts: list[str]) -> list[str]:
    return [f" {len(p) % 2}\n" for p in prompts]


def demo_summarizer(prompts: list[str]) -> list[str | None]:
    return ["Summary: " + p for p in prompts]


@register
def model_label_job(spark, sf):
    path = scratch_path(spark, "label-job")
    return run_label_job(T.postings(spark, sf), demo_labeller, path, ID)


@register
def model_label_job_per_category(spark, sf):
    labelled = label_per_category(
        T.postings(spark, sf), demo_binary_labeller, ID, ["internship", "marketing"]
    )
    return labelled.select(ID, "internship", "marketing")


def _flaky(fn, chance=3):
    """``fn`` that fails on every prompt whose length is a multiple of ``chance``."""

    def call(prompts):
        if any(len(p) % chance == 0 for p in prompts):
            raise RuntimeError("model down")
        return fn(prompts)

    return call


@register
def model_label_resume(spark, sf):
    """Two runs into one folder; the first one's model fails for a third of the prompts."""
    path = scratch_path(spark, "label-resume")
    posts = T.postings(spark, sf)
    first = run_label_job(posts, _flaky(demo_labeller), path, ID, retries=0, batch_size=16)
    before = materialize(first.select(F.col(ID).alias("first_id")), "first-run")
    both = run_label_job(posts, demo_labeller, path, ID, n_slices=3)
    joined = both.join(before, F.col(ID) == F.col("first_id"), "left")
    return joined.select(ID, "internship", F.col("first_id").isNotNull().cast("int").alias("in_first_run"))


@register
def model_label_once(spark, sf):
    """Titles labelled by one call per distinct prompt; the second run finds all answers stored."""
    path = scratch_path(spark, "answers")
    prompts = with_prompt(T.postings(spark, sf), "Label: {title}").select(ID, "prompt")
    some = prompts.where(F.col(ID) % 2 == 0)
    answer_distinct(some, "prompt", demo_binary_labeller, path, model="demo")
    answered = answer_distinct(prompts, "prompt", demo_binary_labeller, path, model="demo", n_slices=2)
    return answered.select(ID, responses.parse_binary(F.col("answer")).alias("label"))


@register
def summary_fill_job(spark, sf):
    filled = fill_summaries(
        _summary_master(spark, sf), demo_summarizer, ID, 700, 1000, "{title} | {description}"
    )
    return filled.select(ID, "summary")


@register
def text_encode_job(spark, sf):
    path = scratch_path(spark, "encode-job")
    stored = run_encode_job(T.postings(spark, sf), hashing_encoder(64), path, ID, n_slices=1)
    return (
        stored.select(ID, F.posexplode("embedding").alias("position", "value"))
        .where("value <> 0")
        .select(ID, "position", r6("value"))
    )


@register
def retrieve_by_text_(spark, sf):
    encode = hashing_encoder(64)
    posts = T.postings(spark, sf)
    stored = run_encode_job(posts, encode, scratch_path(spark, "corpus-vectors"), ID)
    hits = retrieve_by_text(
        _requests(spark, sf),
        stored,
        posts,
        _stored_queries(spark, sf),
        _stored_vectors(spark, sf),
        encode,
        id_col=ID,
        slots=T.SLOTS,
    )
    return hits.select("request_id", "rank", ID, r6("score"), "location")


# --- sources and sinks -------------------------------------------------------------------


@register
def csv_round_trip(spark, sf):
    """Whole texts with line breaks and quotes through a CSV file and back."""
    path = scratch_path(spark, "csv")
    docs = T.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit('"q" '), "text").alias("text"), "lang"
    )
    sinks.write_csv(docs, path)
    schema = StructType(
        [
            StructField("doc_id", LongType()),
            StructField("text", StringType()),
            StructField("lang", StringType()),
        ]
    )
    return readers.read_csv(spark, path, schema)


@register
def category_subsets_written(spark, sf):
    path = scratch_path(spark, "subsets")
    sinks.write_subsets(_subsets(spark, sf), path, [ID, "title", "salary", "location"])
    return readers.read_subsets(spark, path)


@register
def manifest_written(spark, sf):
    path = scratch_path(spark, "manifest")
    records = sinks.manifest(
        _subsets(spark, sf),
        joins.category_dim(spark, T.LABEL_DESCRIPTIONS),
        ID,
        source="documents",
        method="labels",
        preprocessing={"shuffle_seed": "42"},
    )
    sinks.write_manifest(records, path)
    back = spark.read.schema(records.schema).json(path)
    return back.select(
        "category",
        "description",
        F.col("count").alias("n_rows"),
        "file",
        "chunk",
        F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"),
        "method",
        F.col("preprocessing.shuffle_seed").alias("shuffle_seed"),
    )


@register
def vector_append(spark, sf):
    """Two tables: first all documents, then all vectors over them."""
    base = scratch_path(spark, "vectors")
    old = T.table(spark, sf, "documents").select(
        F.col("doc_id").alias(ID), F.lit("stale").alias("category"), F.lit(-1).alias("dim")
    )
    rows = T.vectors(spark, sf).select(ID, "category", F.size("embedding").alias("dim"))
    stored = sinks.write_vectors(old, f"{base}/1")
    return sinks.write_vectors(sets.upsert(stored, rows, [ID]), f"{base}/2")


@register
def source_fallback(spark, sf):
    """The first source does not exist, so the stored table is read."""
    schema = T.table(spark, sf, "labels").schema
    return readers.read_with_fallback(
        spark,
        lambda: spark.read.schema(schema).parquet(f"{sf}/no_such_table.parquet"),
        lambda: T.table(spark, sf, "labels"),
        schema,
    )
