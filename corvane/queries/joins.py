"""Joins by id, neighbourhoods, parents, captions, and the merging of branches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, ranking
from .base import CTE, bare_entities, chunks, entity_chunks, register, relations, score, table, workspace

QUERIES: dict = {}
SQL: dict = {}
W = "WITH " + CTE


@register(QUERIES, SQL, W + "SELECT e.id, e.name FROM entities e JOIN (SELECT 'part-' || vec_id AS id FROM embeddings) USING (id)")
def j1_load_by_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("part-"), F.col("vec_id").cast("string")).alias("id"))
    return ranking.load_by_ids(ids, bare_entities(spark, sf_dir)).select("id", "name")


@register(QUERIES, SQL, W + "SELECT entity_id, neighbour_id, relation_id, row_number() OVER (PARTITION BY entity_id ORDER BY relation_id) AS position FROM both_ways WHERE entity_id IN (SELECT id FROM entities WHERE type = 'supplier')")
def j2_adjacent_relations(spark, sf_dir):
    asked = bare_entities(spark, sf_dir).where("type = 'supplier'").select(F.col("id").alias("entity_id"))
    return graph.adjacent(relations(spark, sf_dir), asked).select("entity_id", "neighbour_id", "relation_id", F.col("position").cast("long").alias("position"))


J3 = W + "SELECT chunk_id AS id, max(p_retailprice) AS score FROM entity_chunks JOIN part ON id = 'part-' || p_partkey GROUP BY chunk_id"


@register(QUERIES, SQL, J3)
def j3_chunks_of_entities(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_retailprice").alias("score"))
    own = entity_chunks(spark, sf_dir).join(p, "id").select(F.array("chunk_id").alias("source_chunk_ids"), "score")
    return ranking.chunk_scores([own])


def _family(spark, sf_dir):
    """Turns as chunks, each child of its conversation's first turn."""
    c = table(spark, sf_dir, "conversations")
    key = lambda t: F.concat_ws("-", F.col("conv_id"), t)
    m = F.when(F.col("turn") > 0, F.create_map(F.lit(ranking.PARENT), key(F.lit("0")))).otherwise(F.create_map().cast("map<string,string>"))
    rows = c.select(key(F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("document_id"), "text", F.char_length("text").alias("token_count"), F.col("turn").cast("int").alias("chunk_order"), m.alias("metadata"))
    return rows


J4 = """SELECT p.conv_id || '-0' AS id, round(sum(length(c.text)) / 100.0, 6)::DOUBLE AS score FROM conversations c JOIN (SELECT DISTINCT conv_id FROM conversations WHERE turn = 0) p USING (conv_id) GROUP BY p.conv_id ORDER BY score DESC, id LIMIT 40"""


@register(QUERIES, SQL, J4)
def j4_parents_for_children(spark, sf_dir):
    c = _family(spark, sf_dir)
    matched = c.withColumn("score", F.col("token_count") / 100.0)
    return score(ranking.expand_parents(matched, c, 40).select("id", "score"))


A2 = J4.replace("round(sum(length(c.text)) / 100.0, 6)::DOUBLE AS score", "round(sum(length(c.text)) / 100.0, 6)::DOUBLE AS score, count(*) AS children")


@register(QUERIES, SQL, A2)
def a2_summed_scores(spark, sf_dir):
    c = _family(spark, sf_dir)
    matched = c.withColumn("score", F.col("token_count") / 100.0)
    n = c.groupBy(F.concat(F.col("document_id"), F.lit("-0")).alias("id")).agg(F.count(F.lit(1)).alias("children"))
    return score(ranking.expand_parents(matched, c, 40).select("id", "score").join(n, "id"))


J5 = """WITH t AS (SELECT *, CASE WHEN turn % 3 = 2 THEN 'caption' ELSE 'text' END AS kind, lag(text) OVER w AS before, lead(text) OVER w AS after, (turn + 1) % 3 = 2 AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id || '-' || turn AS id, CASE WHEN kind = 'caption' THEN length(array_to_string(list_distinct(list_filter([before, text, after], lambda x: trim(x) <> '')), chr(10))) ELSE length(text) END AS n FROM t"""


@register(QUERIES, SQL, J5)
def j5_caption_neighbourhood(spark, sf_dir):
    """Every third turn as a caption of the turns around it."""
    near = ranking.neighbours(_family(spark, sf_dir))
    m = F.create_map(
        F.lit(ranking.CONTENT), F.when(F.col("chunk_order") % 3 == 2, "caption").otherwise("text"), F.lit(ranking.SECTION), F.col("document_id"),
        F.lit(ranking.PREVIOUS), F.coalesce("prev_id", F.lit("")), F.lit(ranking.NEXT), F.coalesce("next_id", F.lit("")),
    )
    c = near.withColumn("metadata", m).drop("prev_id", "next_id")
    return ranking.expand_captions(c.withColumn("score", F.lit(1.0)), c).select("id", F.char_length("text").cast("long").alias("n"))


@register(QUERIES, SQL, W + "SELECT id FROM chunks WHERE id IN (SELECT chunk_id FROM entity_chunks WHERE id IN ('supplier-1', 'supplier-2')) OR id IN (SELECT chunk_id FROM relation_chunks JOIN relations USING (id) WHERE tgt_id = 'supplier-3')")
def j6_retained_chunks(spark, sf_dir):
    ws = workspace(spark, sf_dir)
    return ranking.retain_chunks(ws.chunks, [ws.entities.where("id IN ('supplier-1', 'supplier-2')"), ws.relations.where("tgt_id = 'supplier-3'")]).select("id")


@register(QUERIES, SQL, W + "SELECT id FROM relations WHERE src_id NOT IN (SELECT id FROM entities WHERE description LIKE '%ECONOMY')")
def j7_anti_join(spark, sf_dir):
    gone = bare_entities(spark, sf_dir).where("description LIKE '%ECONOMY'").select(F.col("id").alias("src_id"))
    return relations(spark, sf_dir).join(gone, "src_id", "left_anti").select("id")


J8 = "SELECT id, score, CASE WHEN score = s THEN 'supplier' ELSE 'customer' END AS branch FROM (SELECT coalesce(s_suppkey, c_custkey) AS id, greatest(coalesce(s_acctbal, -1e9), coalesce(c_acctbal, -1e9)) AS score, s_acctbal AS s FROM supplier FULL JOIN customer ON s_suppkey = c_custkey)"


@register(QUERIES, SQL, J8)
def j8_best_of_both(spark, sf_dir):
    one = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"), F.lit("supplier").alias("branch"))
    two = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"), F.lit("customer").alias("branch"))
    return ranking.pick_best([one, two])


J9 = """WITH a AS (SELECT lower(p_name) AS k, min(p_partkey) AS id, count(*) AS n FROM part GROUP BY 1), o AS (SELECT lower(c_name) AS k, c_custkey AS id FROM customer)
SELECT name, coalesce(o.id, CASE WHEN n = 1 THEN a.id END)::VARCHAR AS id, CASE WHEN o.id IS NOT NULL OR n = 1 THEN NULL WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS problem
FROM (SELECT DISTINCT p_name AS name FROM part UNION SELECT c_name FROM customer UNION SELECT s_name FROM supplier) LEFT JOIN o ON o.k = lower(name) LEFT JOIN a ON a.k = lower(name)"""


@register(QUERIES, SQL, J9)
def j9_names_resolved(spark, sf_dir):
    """Customers by their names, parts by their names as aliases, suppliers not at all."""
    none = F.array().cast("array<string>")
    c, p, s = (table(spark, sf_dir, n) for n in ("customer", "part", "supplier"))
    e = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), none.alias("aliases"))
    e = e.unionByName(p.select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("#"), F.col("p_partkey").cast("string")).alias("name"), F.array("p_name").alias("aliases")))
    names = p.select(F.col("p_name").alias("name")).union(c.select("c_name")).union(s.select("s_name")).distinct()
    return graph.resolve_names(e, names)


J10 = "SELECT doc_id AS id, (row_number() OVER (ORDER BY p NULLS LAST, doc_id))::INT AS reranked FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN -n_chars END AS p FROM documents) ORDER BY reranked LIMIT 30"


@register(QUERIES, SQL, J10)
def j10_reranked(spark, sf_dir):
    """English documents by length as the reranker's order; the others after them."""
    d = table(spark, sf_dir, "documents")
    results = d.where("lang = 'en'").select(F.col("doc_id").alias("id"), (-F.col("n_chars") * 1_000_000 + F.col("doc_id")).alias("pos"), F.lit(1.0).alias("score"))
    return ranking.reranked(d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("position")), results, 30).select("id", "reranked")
