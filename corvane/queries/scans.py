"""Filters, search, sets and aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.text import clean_list, merged_csv, merged_lists, split_values, token_count
from ..functions.vectors import cosine, norm
from ..operators import evaluation, ranking, search
from ..operators.chunking import texts
from ..operators.filters import Condition, build_plan, filter_rows, instant, to_column
from ..operators.search import SearchSpec
from .base import CTE, asked_vector, bare_entities, chunks, register, relations, score, table, vectors

QUERIES: dict = {}
SQL: dict = {}
W = "WITH " + CTE


# --- filters -----------------------------------------------------------------------------------------


@register(QUERIES, SQL, W + "SELECT id, document_id FROM chunks WHERE status IN ('F', 'P') AND priority IN ('1-URGENT', '5-LOW')")
def p1_metadata_equals(spark, sf_dir):
    plan = build_plan({"status": ["F", " P "], "priority": ["1-URGENT", ["5-LOW"]]})
    return filter_rows(chunks(spark, sf_dir), plan).select("id", "document_id")


@register(QUERIES, SQL, W + "SELECT id FROM chunks WHERE status = 'O' AND priority IN ('2-HIGH', '3-MEDIUM')")
def p2_eq_in(spark, sf_dir):
    return filter_rows(chunks(spark, sf_dir), build_plan(conditions=[Condition("status", "EQ", "O"), Condition("priority", "IN", ["2-HIGH", "3-MEDIUM"])])).select("id")


@register(QUERIES, SQL, W + "SELECT id, totalprice::DOUBLE AS totalprice FROM chunks WHERE totalprice >= 100000.5 AND totalprice < 250000")
def p3_number_comparisons(spark, sf_dir):
    found = filter_rows(chunks(spark, sf_dir), build_plan(conditions=[Condition("totalprice", "GTE", "100000.5"), Condition("totalprice", "LT", 250000)]))
    return found.select("id", ranking.meta("totalprice").cast("double").alias("totalprice"))


@register(QUERIES, SQL, W + "SELECT id FROM chunks WHERE orderdate > TIMESTAMP '1996-03-01' AND orderdate < TIMESTAMP '1998-06-01 12:00:00'")
def p4_time_comparisons(spark, sf_dir):
    return filter_rows(chunks(spark, sf_dir), build_plan(conditions=[Condition("orderdate", "AFTER", "1996-03-01"), Condition("orderdate", "BEFORE", "1998-06-01T12:00:00Z")])).select("id")


@register(QUERIES, SQL, "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events WHERE ts > TIMESTAMP '2024-01-10'")
def p4_event_times(spark, sf_dir):
    """Times as text of milliseconds, read back."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("m", F.create_map(F.lit("at"), F.unix_millis("ts").cast("string")))
    return e.where(to_column(build_plan(conditions=[Condition("at", "AFTER", "2024-01-10")]), "m")).select("event_id", F.unix_millis(instant(F.col("m")["at"])).alias("ms"))


@register(QUERIES, SQL, "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality >= 1 AND l.toxic < 1 AND d.lang IN ('en', 'de')")
def p5_labels_as_metadata(spark, sf_dir):
    """A document without labels lacks the fields, so no comparison holds."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    m = F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string")), lambda _, v: v.isNotNull())
    plan = build_plan({"lang": ["en", "de"]}, [Condition("quality", "GTE", 1), Condition("toxic", "LT", "1")])
    return filter_rows(d.withColumn("metadata", m), plan).select("doc_id")


P6 = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000"


@register(QUERIES, SQL, P6)
def p6_pushdown_split(spark, sf_dir):
    """The part that the table's own columns can answer goes to the scan; the whole filter again on what it gives."""
    plan = build_plan({"status": "F"}, [Condition("totalprice", "GT", 200000)])
    early = {"status": F.col("o_orderstatus"), "totalprice": F.col("o_totalprice")}
    rows = table(spark, sf_dir, "orders").where(to_column(plan, F.lit(None).cast("map<string,string>"), early, native=True))
    metadata = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("totalprice"), F.col("o_totalprice").cast("decimal(15,2)").cast("string"))
    return filter_rows(rows.withColumn("metadata", metadata), plan).select("o_orderkey", "o_totalprice")


P7 = W + "SELECT v.id, round(list_dot_product(vector, q), 6) AS score FROM vectors v JOIN chunks c ON c.id = v.id, asked WHERE namespace = 'chunks' AND c.status = 'F' ORDER BY list_dot_product(vector, q) DESC, v.id LIMIT 10"


@register(QUERIES, SQL, P7)
def p7_filtered_search(spark, sf_dir):
    passing = filter_rows(chunks(spark, sf_dir), build_plan({"status": "F"})).select("id")
    own = vectors(spark, sf_dir).where("namespace = 'chunks'").join(passing, "id", "left_semi")
    return score(search.semantic_search(own, asked_vector(spark, sf_dir), 10).select("id", "score"))


P9 = "SELECT doc_id, CASE WHEN trim(coalesce(source, '')) <> '' THEN source ELSE doc_id::VARCHAR END AS reference FROM documents"


@register(QUERIES, SQL, P9)
def p9_reference_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("document_id"), F.create_map(F.lit("source"), F.col("source")).alias("metadata"))
    return d.select("doc_id", ranking.source_of_chunk().alias("reference"))


P10 = W + "SELECT r.id, r.src_id, r.tgt_id, r.keywords, r.weight, count(chunk_id) AS n_chunks FROM relations r LEFT JOIN relation_chunks USING (id) GROUP BY ALL"


@register(QUERIES, SQL, P10)
def p10_structured_relations(spark, sf_dir):
    return relations(spark, sf_dir).select("id", "src_id", "tgt_id", "keywords", "weight", F.size("source_chunk_ids").cast("long").alias("n_chunks"))


# --- search ------------------------------------------------------------------------------------------

V1 = "SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) a ORDER BY list_dot_product(e.embedding::DOUBLE[], a.embedding::DOUBLE[]) DESC, vec_id LIMIT 20"


@register(QUERIES, SQL, V1)
def v1_semantic_top_k(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return score(search.semantic_search(e, asked_vector(spark, sf_dir), 20).select(F.col("id").alias("vec_id"), "score"))


V2 = "SELECT e.vec_id, round(list_dot_product(e.v, a.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(a.v, a.v))), 6) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) e, (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 11) a ORDER BY list_dot_product(e.v, a.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(a.v, a.v))) DESC, vec_id LIMIT 20"


@register(QUERIES, SQL, V2)
def v2_cosine_top_k(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return score(search.semantic_search(e, asked_vector(spark, sf_dir, 11), 20, metric="cosine").select(F.col("id").alias("vec_id"), "score"))


KEYWORDS = "SELECT p_partkey, (contains(lower(p_name || ' ' || p_type), 'small')::INT + contains(lower(p_name || ' ' || p_type), 'ring')::INT + contains(lower(p_name || ' ' || p_type), 'brand#2')::INT + contains(lower(p_name || ' ' || p_type), 'economy')::INT + (lower(p_brand) IN ('small', 'ring', 'brand#2', 'economy'))::INT + (lower(p_type) IN ('small', 'ring', 'brand#2', 'economy'))::INT)::DOUBLE AS score FROM part"


def _parts(spark, sf_dir):
    text, words = F.concat_ws(" ", "p_name", "p_type"), F.array("p_brand", "p_type")
    tokens = search.query_tokens(F.lit("Small ring"), F.array(F.lit("Brand#2"), F.lit("economy "), F.lit("")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), search.keyword_score(text, words, tokens).alias("score"))


@register(QUERIES, SQL, KEYWORDS + " ORDER BY score DESC, p_partkey LIMIT 50")
def v3_keyword_scores(spark, sf_dir):
    return search.top_k(_parts(spark, sf_dir), 50).select(F.col("id").alias("p_partkey"), "score")


V4 = "WITH k AS (" + KEYWORDS + ") SELECT p_partkey, round(k.score + list_dot_product(embedding::DOUBLE[], q), 6) AS score FROM k JOIN embeddings ON vec_id = p_partkey, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7) ORDER BY score DESC, p_partkey LIMIT 50"


@register(QUERIES, SQL, V4)
def v4_hybrid_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    both = _parts(spark, sf_dir).join(e, "id").withColumn("score", F.col("score") + search.dot("vector", search.vector_literal(asked_vector(spark, sf_dir))))
    return search.top_k(score(both), 50).select(F.col("id").alias("p_partkey"), "score")


V5 = "SELECT p_partkey::VARCHAR AS key, CASE WHEN trim(p_brand) = '' OR p_size % 3 = 0 THEN 'SEMANTIC' WHEN p_size % 3 = 1 THEN 'HYBRID' ELSE 'KEYWORD' END AS mode FROM part"


@register(QUERIES, SQL, V5)
def v5_search_modes(spark, sf_dir):
    """Parts as searches: a third without keywords, a third without a vector, a third with both."""
    n = F.col("p_size") % 3
    words = F.when(n == 0, F.array(F.lit(" "))).otherwise(F.array("p_brand"))
    vector = F.when(n == 2, F.array().cast("array<double>")).otherwise(F.array(F.lit(1.0)))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), search.mode_column(vector, words).alias("mode"))


V6 = """WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-zà-öø-ÿœß0-9]+')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM t WHERE w <> '' GROUP BY ALL),
k AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS k FROM c)
SELECT doc_id, count(*) AS n_terms, round(max(1 + ln(n)), 6) AS heaviest, round(min(1 + ln(n)), 6) AS lightest, round(sum(1 + ln(n)), 4) AS weight FROM k WHERE k <= 256 GROUP BY doc_id"""


@register(QUERIES, SQL, V6)
def v6_sparse_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    t = search.sparse_vectors(d, text="text").where("size(terms) > 0")
    total = F.aggregate("weights", F.lit(0.0), lambda s, x: s + x)
    return t.select(F.col("id").alias("doc_id"), F.size("terms").cast("long").alias("n_terms"), F.round(F.array_max("weights"), 6).alias("heaviest"), F.round(F.array_min("weights"), 6).alias("lightest"), F.round(total, 4).alias("weight"))


def _sparse_and_dense(spark, sf_dir):
    """Benchmark passages as queries over documents: by sparse terms, and by the vectors of the same numbers."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    sparse = search.sparse_search(search.sparse_vectors(d, text="text"), search.sparse_vectors(q, text="text"), search.CANDIDATES)
    dense = search.dense_search(e.join(d.select("id"), "id", "left_semi"), e.join(q.select("id"), "id", "left_semi"), search.CANDIDATES)
    return sparse, dense


def _fused(rows):
    return score(rows.select(F.col("key").alias("item_id"), F.col("id").alias("doc_id"), "score"))


@register(QUERIES, SQL)
def v7_sparse_and_dense_fused(spark, sf_dir):
    """Ten documents for each passage, by reciprocal ranks in both lists."""
    return _fused(search.fuse_ranks(_sparse_and_dense(spark, sf_dir), 10))


@register(QUERIES, SQL)
def v7_weighted_scores(spark, sf_dir):
    """Ten documents for each passage, by half of each list's score."""
    sparse, dense = _sparse_and_dense(spark, sf_dir)
    return _fused(search.fuse_scores(dense, sparse, 10))


V8 = W + """SELECT key, id, round(score, 6) AS score, rank::INT AS rank FROM (
    SELECT s.key, v.id, list_dot_product(v.vector, a.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY s.key ORDER BY list_dot_product(v.vector, a.embedding::DOUBLE[]) DESC, v.id) AS rank, s.k
    FROM (VALUES ('a', 'chunks', 3, 5), ('b', 'entities', 4, 7), ('c', 'relations', 5, 3), ('d', 'chunks', 5, 4)) s(key, namespace, asked, k)
    JOIN embeddings a ON a.vec_id = s.asked JOIN vectors v ON v.namespace = s.namespace) WHERE rank <= k"""


@register(QUERIES, SQL, V8)
def v8_batch_search(spark, sf_dir):
    v = lambda n: asked_vector(spark, sf_dir, n)
    specs = [SearchSpec("a", "chunks", v(3), k=5), SearchSpec("b", "entities", v(4), k=7), SearchSpec("c", "relations", v(5), k=3), SearchSpec("d", "chunks", v(5), k=4)]
    return score(search.batch_search(vectors(spark, sf_dir), specs))


V9 = "SELECT key, vec_id, round(s, 6) AS score FROM (SELECT q.label AS key, e.vec_id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s, row_number() OVER (PARTITION BY q.label ORDER BY list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS k FROM embeddings e, (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) q) WHERE k <= 5"


@register(QUERIES, SQL, V9)
def v9_many_queries(spark, sf_dir):
    """The first vector of each label as a query; there are few labels, so the queries are few."""
    e = table(spark, sf_dir, "embeddings")
    none = F.array().cast("array<string>")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).select(F.col("label").cast("string").alias("key"), F.lit("chunks").alias("namespace"), F.col("v").cast("array<double>").alias("query_vector"), F.lit("").alias("query_text"), none.alias("query_keywords"), F.lit(5).alias("k"), F.lit("SEMANTIC").alias("mode"))
    own = e.select(F.lit("chunks").alias("namespace"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.lit("").alias("searchable_text"), none.alias("keywords"))
    found = search.batch_search(own, q)
    return score(found.select(F.col("key").cast("int").alias("key"), F.col("id").alias("vec_id"), "score"))


V10 = "SELECT p_partkey, array_to_string(list_distinct_ordered, '|') AS words FROM (SELECT p_partkey, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM (SELECT p_partkey, list_filter(string_split(p_name, ' ') || [p_brand, p_type, p_type], lambda x: x <> '') AS l FROM part))"


@register(QUERIES, SQL, V10)
def v10_merged_keywords(spark, sf_dir):
    words = search.merged_keyword_lists(F.split(F.concat("p_name", F.lit("  ")), " "), F.array(F.concat(F.lit(" "), "p_brand"), F.col("p_type"), F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(words, "|").alias("words"))


V11 = W + "SELECT id, name || chr(10) || type || chr(10) || description || chr(10) AS searchable_text, CASE WHEN name = type THEN name ELSE name || '|' || type END AS keywords FROM entities"


@register(QUERIES, SQL, V11)
def v11_entity_payloads(spark, sf_dir):
    return search.entity_payloads(bare_entities(spark, sf_dir)).select("id", "searchable_text", F.array_join("keywords", "|").alias("keywords"))


@register(QUERIES, SQL, W + "SELECT id, src_id || chr(10) || keywords || chr(10) || tgt_id || chr(10) AS searchable_text FROM relations")
def v11_relation_payloads(spark, sf_dir):
    return search.relation_payloads(relations(spark, sf_dir)).select("id", "searchable_text")


U1 = "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_acctbal FROM supplier"


@register(QUERIES, SQL, U1)
def u1_upsert(spark, sf_dir):
    """Customers' balances replaced by those of suppliers of the same number."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return search.upsert(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), s, ["c_custkey"])


@register(QUERIES, SQL, "SELECT CASE WHEN vec_id < 100 THEN 'new' ELSE 'old' END AS version, count(*) AS n FROM embeddings GROUP BY 1")
def v12_vector_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.lit("chunks").alias("namespace"), F.col("vec_id").alias("id"), "embedding", F.lit("old").alias("version"))
    return search.upsert(e, e.where("id < 100").withColumn("version", F.lit("new")), ["namespace", "id"]).groupBy("version").agg(F.count(F.lit(1)).alias("n"))


# --- sets ---------------------------------------------------------------------------------------------

SETS = "SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS parts, list_sort(list(DISTINCT l_suppkey)) AS supps FROM lineitem GROUP BY l_orderkey"


def _sets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"), F.array_sort(F.collect_set("l_suppkey")).alias("supps"))


@register(QUERIES, SQL, f"SELECT l_orderkey, array_to_string(list_sort(list_distinct(parts || supps)), ',') AS ids FROM ({SETS})")
def u2_union_of_ids(spark, sf_dir):
    rows = _sets(spark, sf_dir)
    return rows.select("l_orderkey", F.array_join(F.array_sort(merged_lists(F.col("parts").cast("array<string>"), F.col("supps").cast("array<string>")).cast("array<bigint>")).cast("array<string>"), ",").alias("ids"))


@register(QUERIES, SQL, f"SELECT l_orderkey, array_to_string(list_filter(parts, lambda x: NOT list_contains(supps, x)), ',') AS missing, array_to_string(list_filter(supps, lambda x: NOT list_contains(parts, x)), ',') AS orphan FROM ({SETS})")
def u3_missing_and_orphan(spark, sf_dir):
    d = ranking.differences(_sets(spark, sf_dir), "parts", "supps")
    return d.select("l_orderkey", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("missing", "orphan")])


@register(QUERIES, SQL, f"SELECT l_orderkey, list_has_any(parts, supps) AS shared FROM ({SETS})")
def u4_intersects(spark, sf_dir):
    return _sets(spark, sf_dir).select("l_orderkey", ranking.intersects("parts", "supps").alias("shared"))


U5 = "SELECT c_custkey, c_name || '<SEP>' || c_mktsegment AS joined, 2::INT AS n FROM customer"


@register(QUERIES, SQL, U5)
def u5_join_and_split(spark, sf_dir):
    from ..functions.text import join_values

    joined = join_values(F.array("c_name", F.concat(F.lit(" "), "c_mktsegment"), F.lit("  "), F.col("c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", joined.alias("joined"), F.size(split_values(F.concat(joined, F.lit("<SEP> ")))).alias("n"))


@register(QUERIES, SQL, "SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || ',' || p_type END AS merged FROM part")
def u6_merged_csv(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", merged_csv("p_brand", F.concat_ws(" , ", "p_type", "p_brand")).alias("merged"))


# --- aggregates and windows ----------------------------------------------------------------------------


@register(QUERIES, SQL, "SELECT l_suppkey, max(l_extendedprice) AS score FROM lineitem GROUP BY l_suppkey")
def a1_best_scores(spark, sf_dir):
    return ranking.best_scores(table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("score")), "l_suppkey")


A3 = "SELECT row_number() OVER (ORDER BY n DESC, first)::VARCHAR AS reference_id, source, n FROM (SELECT source, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source)"


@register(QUERIES, SQL, A3)
def a3_references(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), F.create_map(F.lit("source"), F.col("source")).alias("metadata"), F.col("doc_id").cast("string").alias("document_id"))
    return ranking.references(d)


A7 = "SELECT conv_id::VARCHAR AS id, count(*) AS n_chunks, sha256(string_agg(text, chr(10) ORDER BY turn)) AS content_sha256 FROM conversations GROUP BY conv_id"


@register(QUERIES, SQL, A7)
def a7_prechunked_documents(spark, sf_dir):
    from ..sources.files import grouped_chunks

    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), F.concat_ws(":", "conv_id", "turn").alias("id"), "text", F.col("turn").alias("chunk_order"))
    return grouped_chunks(c).select("id", F.col("n_chunks").cast("long").alias("n_chunks"), F.sha2("content", 256).alias("content_sha256"))


@register(QUERIES, SQL, "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events) WHERE k = 1")
def a9_latest_event(spark, sf_dir):
    return ranking.latest(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


CASES = """SELECT d.source AS question, coalesce(list_sort(list(DISTINCT doc_id) FILTER (WHERE lang = 'en')), []) AS want, list(doc_id ORDER BY n_chars DESC, doc_id)[:5] AS got FROM documents d GROUP BY d.source"""
A10 = f"""WITH c AS ({CASES}), r AS (SELECT question, coalesce(list_contains(want, got[1]), false) AS top1_hit, list_has_any(want, got[:3]) AS top3_hit, len(want) > 0 AND list_has_all(got, want) AS all_hops_hit,
    CASE WHEN len(want) = 0 THEN 0 ELSE round(len(list_intersect(want, got))::DOUBLE / len(want), 4) END AS recall FROM c)"""


def _results(spark, sf_dir, longest: bool = True):
    d = table(spark, sf_dir, "documents")
    packed = F.sort_array(F.collect_list(F.struct((-F.col("n_chars") if longest else F.col("n_chars")).alias("n"), "doc_id")))
    cases = d.groupBy(F.col("source").alias("question")).agg(F.collect_set(F.when(F.col("lang") == "en", F.col("doc_id").cast("string"))).alias("relevant_doc_ids"), F.transform(F.slice(packed, 1, 5), lambda x: x["doc_id"].cast("string")).alias("matched_doc_ids"))
    return evaluation.evaluate(cases.withColumn("hop_doc_ids", F.lit(None).cast("array<array<string>>")))


@register(QUERIES, SQL, A10 + " SELECT * FROM r")
def a10_retrieval_metrics(spark, sf_dir):
    return _results(spark, sf_dir)


@register(QUERIES, SQL, A10 + " SELECT count(*) AS total_cases, round(avg(top1_hit::INT), 4) AS top1_hit_rate, round(avg(top3_hit::INT), 4) AS top3_hit_rate, round(avg(all_hops_hit::INT), 4) AS all_hops_hit_rate, round(avg(recall), 4) AS average_recall FROM r")
def a10_retrieval_summary(spark, sf_dir):
    return evaluation.summarize(_results(spark, sf_dir))


A11 = A10 + ", o AS (SELECT * FROM (" + A10.replace("n_chars DESC", "n_chars ASC") + " SELECT * FROM r)) SELECT count(*) AS shared_case_count, " + ", ".join(f"round(round(avg(r.{c}::DOUBLE), 4) - round(avg(o.{c}::DOUBLE), 4), 4) AS {c}_delta" for c in ("top1_hit", "top3_hit", "all_hops_hit", "recall")) + " FROM r JOIN o USING (question)"


@register(QUERIES, SQL, A11)
def a11_baseline_deltas(spark, sf_dir):
    return evaluation.compare(_results(spark, sf_dir), _results(spark, sf_dir, False))


@register(QUERIES, SQL, "SELECT round(avg(value), 6) AS average, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events")
def a12_latency_percentiles(spark, sf_dir):
    s = evaluation.latencies(table(spark, sf_dir, "events"), "value")
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


A12 = "SELECT label AS key, (sum((relevant AND k <= 10)::INT) / 10.0)::DOUBLE AS precision_at_k, round(coalesce(1.0 / min(CASE WHEN relevant THEN k END), 0), 6)::DOUBLE AS reciprocal_rank FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, vec_id % 3 = 0 AS relevant FROM embeddings) GROUP BY label"


@register(QUERIES, SQL, A12)
def a12_ranking_quality(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    found = evaluation.ranking_quality(table(spark, sf_dir, "embeddings").select(F.col("label").alias("key"), rank.alias("rank"), (F.col("vec_id") % 3 == 0).alias("relevant")))
    return found.select("key", F.col("precision_at_k").cast("double").alias("precision_at_k"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


W1 = W + "SELECT id FROM (SELECT id, sum(len(string_split_regex('- ' || id || ' | ' || name || ' | x', '\\s+'))) OVER (ORDER BY c_acctbal DESC, id ROWS UNBOUNDED PRECEDING) AS spent FROM entities JOIN customer ON id = 'customer-' || c_custkey) WHERE spent <= 500"


@register(QUERIES, SQL, W1)
def w1_entity_budget(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"))
    return ranking.limit_entities(c, 500).select("id")


@register(QUERIES, SQL, W + "SELECT id, token_count::INT AS token_count FROM (SELECT *, sum(token_count) OVER (ORDER BY totalprice DESC, id ROWS UNBOUNDED PRECEDING) AS spent FROM chunks) WHERE spent <= 700")
def w2_chunk_budget(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("score", ranking.meta("totalprice").cast("double"))
    return ranking.limit_chunks(c, 700).select("id", "token_count")


W3 = "SELECT doc_id, greatest(0, 500 - 12 - len(list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) - 16)::INT AS remaining FROM documents"


@register(QUERIES, SQL, W3)
def w3_remaining_budget(spark, sf_dir):
    """What a document as a query leaves of 500 tokens, with a prompt of 12."""
    return table(spark, sf_dir, "documents").select("doc_id", ranking.remaining_tokens(F.lit(500), F.lit(12), token_count("text")).cast("int").alias("remaining"))


@register(QUERIES, SQL, W + "SELECT id, '- ' || src_id || ' -> ' || tgt_id || ' | ' || keywords || ' | ' || CASE WHEN weight = 1 THEN '1.000' ELSE weight::INT || '.000' END AS line FROM relations")
def w4_row_formats(spark, sf_dir):
    return relations(spark, sf_dir).withColumn("score", F.col("weight")).select("id", ranking.relation_line().alias("line"))


@register(QUERIES, SQL, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def w5_top_k(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return search.top_k(o, 25).select(F.col("id").alias("o_orderkey"), F.col("score").alias("o_totalprice"))


W6 = "SELECT conv_id, turn, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"


@register(QUERIES, SQL, W6)
def w6_neighbours(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("id"), F.col("turn").alias("chunk_order"))
    return ranking.neighbours(c).select(F.col("document_id").alias("conv_id"), F.col("id").alias("turn"), F.col("prev_id").alias("prev_turn"), F.col("next_id").alias("next_turn"))


W7 = """WITH d AS (SELECT label, vec_id, 1 - list_dot_product(v, n) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(n, n))) AS distance FROM (
    SELECT label, vec_id, embedding::DOUBLE[] AS v, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n IS NOT NULL)
SELECT label, vec_id, round(distance, 6) AS distance, round((coalesce(lead(distance) OVER w, distance) - coalesce(lag(distance) OVER w, distance)) / CASE WHEN lag(distance) OVER w IS NULL AND lead(distance) OVER w IS NULL THEN 1 WHEN lag(distance) OVER w IS NULL OR lead(distance) OVER w IS NULL THEN 1 ELSE 2 END, 6) AS gradient FROM d WINDOW w AS (PARTITION BY label ORDER BY vec_id)"""


def _distances(rows):
    """vec_id and distance of each vector but the last of a label's rows, by the chunker's own functions."""
    rows = rows.sort_values("vec_id")
    return rows["vec_id"].tolist()[:-1], [texts.cosine_distance(a, b) for a, b in zip(rows["v"], rows["v"][1:])]


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v")).groupBy("label")


@register(QUERIES, SQL, W7)
def w7_distances_and_gradient(spark, sf_dir):
    """Distances between neighbours of each label's vectors, and their slope, as the semantic chunker takes them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, distances = _distances(rows)
        slope = texts.threshold(distances, "gradient")[0] if distances else []
        return pd.DataFrame({"label": rows["label"].iloc[:1].tolist() * len(ids), "vec_id": ids, "distance": distances, "gradient": slope})

    found = _labelled(spark, sf_dir).applyInPandas(run, "label long, vec_id long, distance double, gradient double")
    return found.select("label", "vec_id", F.round("distance", 6).alias("distance"), F.round("gradient", 6).alias("gradient"))


W8 = "WITH d AS (" + W7.split("WITH d AS (")[1].split(")\nSELECT")[0] + """)
SELECT label, round(quantile_cont(distance, 0.95), 6) AS p95, round(avg(distance) + 3 * stddev_pop(distance), 6) AS deviation, round(avg(distance) + 1.5 * (quantile_cont(distance, 0.75) - quantile_cont(distance, 0.25)), 6) AS interquartile FROM d GROUP BY label"""


@register(QUERIES, SQL, W8)
def w8_thresholds(spark, sf_dir):
    """The chunker's thresholds over each label's distances."""
    kinds = {"p95": "percentile", "deviation": "standard_deviation", "interquartile": "interquartile"}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        distances = _distances(rows)[1]
        return pd.DataFrame([{"label": rows["label"].iloc[0], **{n: texts.threshold(distances, k)[1] for n, k in kinds.items()}}] if distances else [], columns=["label", *kinds])

    found = _labelled(spark, sf_dir).applyInPandas(run, "label long, " + ", ".join(f"{n} double" for n in kinds))
    return found.select("label", *[F.round(n, 6).alias(n) for n in kinds])


@register(QUERIES, SQL, W + "SELECT entity_id, relation_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY relation_id) AS k FROM both_ways) WHERE k <= 5")
def w9_expansion_cap(spark, sf_dir):
    from ..operators import graph

    r = relations(spark, sf_dir)
    near = graph.adjacent(r, graph.both_ways(r).select("entity_id"))
    return near.where("position <= 5").select("entity_id", "relation_id")


@register(QUERIES, SQL, W + "SELECT id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_order, id) - 1 AS chunk_order FROM chunks")
def w10_renumbered(spark, sf_dir):
    return ranking.renumbered(chunks(spark, sf_dir)).select("id", F.col("chunk_order").cast("long").alias("chunk_order"))


@register(QUERIES, SQL, "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def w11_page(spark, sf_dir):
    return ranking.page(table(spark, sf_dir, "events").select("event_id", "ts"), 3, 20, F.desc("ts"), F.asc("event_id"))


@register(QUERIES, SQL, "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def f1_vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm("embedding"), 6).alias("norm"))


@register(QUERIES, SQL, "SELECT doc_id, len(list_distinct(list_filter(string_split(text, ' '), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> ''))) AS n FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents)")
def f2_clean_lists(spark, sf_dir):
    words = clean_list(F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " "))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n"))
