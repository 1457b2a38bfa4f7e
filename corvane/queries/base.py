"""The star schema as a workspace: customers, suppliers, parts, nations and regions are entities, orders are chunks.

Embeddings are the vectors of orders, parts, and of customers' relations to their nations, by number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import relation_id, token_count
from ..plans.retrieve import Workspace

#: The vector that queries ask for.
ASKED = 7


def register(queries: dict, sqls: dict, sql: str | None = None) -> Callable:
    """Puts a query into a module's tables, under its own name."""

    def put(f):
        queries[f.__name__] = f
        if sql is not None:
            sqls[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(kind: str, column: str):
    return F.concat(F.lit(f"{kind}-"), F.col(column).cast("string"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    words = [F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of customer "), F.col("o_custkey").cast("string"), F.lit(" has status "), "o_orderstatus", F.lit(" and priority "), "o_orderpriority"]
    metadata = F.create_map(
        F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"),
        F.lit("totalprice"), F.col("o_totalprice").cast("decimal(15,2)").cast("string"), F.lit("orderdate"), F.date_format("o_orderdate", "yyyy-MM-dd"),
    )
    rows = o.select(F.col("o_orderkey").cast("string").alias("id"), _key("customer", "o_custkey").alias("document_id"), F.concat(*words).alias("text"), F.col("o_orderkey").cast("int").alias("chunk_order"), metadata.alias("metadata"))
    return rows.select("id", "document_id", "text", token_count("text").alias("token_count"), "chunk_order", "metadata")


def entity_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and chunk_id of what orders mention."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    # a branch for each kind, not an explode: a filter by id reaches the scans
    of = lambda rows, kind, key, order: rows.select(_key(kind, key).alias("id"), F.col(order).cast("string").alias("chunk_id"))
    return of(line, "part", "l_partkey", "l_orderkey").unionByName(of(line, "supplier", "l_suppkey", "l_orderkey")).unionByName(of(orders, "customer", "o_custkey", "o_orderkey")).distinct()


def bare_entities(spark: SparkSession, sf_dir: str, kinds=("region", "nation", "customer", "supplier", "part"), *more: str) -> DataFrame:
    """Entities without their chunks, and more columns of their tables."""
    none = F.lit("")
    about = {"region": ("r_regionkey", "r_name", none), "nation": ("n_nationkey", "n_name", none), "customer": ("c_custkey", "c_name", F.col("c_mktsegment")), "supplier": ("s_suppkey", "s_name", none), "part": ("p_partkey", "p_name", F.concat_ws(" ", "p_brand", "p_type"))}
    rows = None
    for kind in kinds:
        key, label, text = about[kind]
        e = table(spark, sf_dir, kind).select(_key(kind, key).alias("id"), F.col(label).alias("name"), F.lit(kind).alias("type"), text.alias("description"), *more)
        rows = e if rows is None else rows.unionByName(e)
    return rows.withColumn("aliases", F.array().cast("array<string>"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with their chunks.  Orders are gathered by number and joined by number, kind by kind: one shuffle, and filters by id reach the scans."""
    none = F.array().cast("array<string>")
    rows = bare_entities(spark, sf_dir, ("region", "nation")).withColumn("source_chunk_ids", none)
    for kind, key, name, own, order in (("customer", "c_custkey", "orders", "o_custkey", "o_orderkey"), ("supplier", "s_suppkey", "lineitem", "l_suppkey", "l_orderkey"), ("part", "p_partkey", "lineitem", "l_partkey", "l_orderkey")):
        held = table(spark, sf_dir, name).groupBy(own).agg(F.collect_set(order).alias("c"))
        e = bare_entities(spark, sf_dir, (kind,), key).join(held, F.col(key) == F.col(own), "left")
        rows = rows.unionByName(e.select("id", "name", "type", "description", "aliases", F.coalesce(F.array_sort(F.col("c").cast("array<string>")), none).alias("source_chunk_ids")))
    return rows


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    none = F.array().cast("array<string>")
    placed = lambda rows, a, b: rows.select(a.alias("src_id"), b.alias("tgt_id"), F.lit("located_in").alias("keywords"), F.lit(1.0).alias("weight"), none.alias("source_chunk_ids"))
    rows = placed(t("nation"), _key("nation", "n_nationkey"), _key("region", "n_regionkey"))
    rows = rows.unionByName(placed(t("customer"), _key("customer", "c_custkey"), _key("nation", "c_nationkey")))
    rows = rows.unionByName(placed(t("supplier"), _key("nation", "s_nationkey"), _key("supplier", "s_suppkey")))
    sold = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.array_sort(F.collect_set(F.col("l_orderkey").cast("string"))).alias("source_chunk_ids"))
    rows = rows.unionByName(sold.select(_key("part", "l_partkey").alias("src_id"), _key("supplier", "l_suppkey").alias("tgt_id"), F.lit("supplied_by").alias("keywords"), "weight", "source_chunk_ids"))
    return rows.select(relation_id("src_id", "tgt_id").alias("id"), "src_id", "tgt_id", "keywords", F.lit("").alias("description"), "weight", "source_chunk_ids", none.alias("file_paths"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    none = F.array().cast("array<string>")
    o = chunks(spark, sf_dir).select(F.col("id").alias("o"), "text")
    of_chunks = e.join(o, e["vec_id"].cast("string") == o["o"]).select(F.lit("chunks").alias("namespace"), F.col("o").alias("id"), "vector", F.col("text").alias("searchable_text"), none.alias("keywords"))
    p = table(spark, sf_dir, "part")
    of_parts = e.join(p, e["vec_id"] == p["p_partkey"]).select(F.lit("entities").alias("namespace"), _key("part", "p_partkey").alias("id"), "vector", F.concat_ws("\n", "p_name", F.lit("part"), "p_brand").alias("searchable_text"), F.array("p_name", "p_brand").alias("keywords"))
    c = table(spark, sf_dir, "customer")
    ends = (_key("customer", "c_custkey"), _key("nation", "c_nationkey"))
    of_ends = e.join(c, e["vec_id"] == c["c_custkey"]).select(F.lit("relations").alias("namespace"), relation_id(*ends).alias("id"), "vector", F.concat_ws("\n", ends[0], F.lit("located_in"), ends[1]).alias("searchable_text"), F.array(ends[0], ends[1]).alias("keywords"))
    return of_chunks.unionByName(of_parts).unionByName(of_ends)


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The tables of a stored workspace, here made from the star schema where they are read: filters by id reach its scans."""
    return Workspace(chunks(spark, sf_dir), entities(spark, sf_dir), relations(spark, sf_dir), vectors(spark, sf_dir))


def asked_vector(spark: SparkSession, sf_dir: str, vec_id: int = ASKED) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding]


#: The same tables as common table expressions; arrays of chunks are tables of their own.
CTE = """
chunks AS (
    SELECT o_orderkey::VARCHAR AS id, 'customer-' || o_custkey AS document_id,
           'Order ' || o_orderkey || ' of customer ' || o_custkey || ' has status ' || o_orderstatus || ' and priority ' || o_orderpriority AS text,
           o_orderkey::INT AS chunk_order, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice::DECIMAL(15,2) AS totalprice, o_orderdate AS orderdate,
           len(string_split('Order ' || o_orderkey || ' of customer ' || o_custkey || ' has status ' || o_orderstatus || ' and priority ' || o_orderpriority, ' ')) AS token_count
    FROM orders
), entities AS (
    SELECT 'region-' || r_regionkey AS id, r_name AS name, 'region' AS type, '' AS description FROM region
    UNION ALL SELECT 'nation-' || n_nationkey, n_name, 'nation', '' FROM nation
    UNION ALL SELECT 'customer-' || c_custkey, c_name, 'customer', c_mktsegment FROM customer
    UNION ALL SELECT 'supplier-' || s_suppkey, s_name, 'supplier', '' FROM supplier
    UNION ALL SELECT 'part-' || p_partkey, p_name, 'part', p_brand || ' ' || p_type FROM part
), entity_chunks AS (
    SELECT 'part-' || l_partkey AS id, l_orderkey::VARCHAR AS chunk_id FROM lineitem
    UNION SELECT 'supplier-' || l_suppkey, l_orderkey::VARCHAR FROM lineitem
    UNION SELECT 'customer-' || o_custkey, o_orderkey::VARCHAR FROM orders
), relations AS (
    SELECT 'rel-' || md5(src_id || tgt_id) AS id, * FROM (
        SELECT 'nation-' || n_nationkey AS src_id, 'region-' || n_regionkey AS tgt_id, 'located_in' AS keywords, 1.0::DOUBLE AS weight FROM nation
        UNION ALL SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey, 'located_in', 1.0 FROM customer
        UNION ALL SELECT 'nation-' || s_nationkey, 'supplier-' || s_suppkey, 'located_in', 1.0 FROM supplier
        UNION ALL SELECT 'part-' || l_partkey, 'supplier-' || l_suppkey, 'supplied_by', count(*)::DOUBLE FROM lineitem GROUP BY l_partkey, l_suppkey)
), relation_chunks AS (
    SELECT DISTINCT 'rel-' || md5('part-' || l_partkey || 'supplier-' || l_suppkey) AS id, l_orderkey::VARCHAR AS chunk_id FROM lineitem
), both_ways AS (
    SELECT src_id AS entity_id, tgt_id AS neighbour_id, id AS relation_id FROM relations
    UNION ALL SELECT tgt_id, src_id, id FROM relations
), vectors AS (
    SELECT 'chunks' AS namespace, o_orderkey::VARCHAR AS id, embedding::DOUBLE[] AS vector, vec_id FROM embeddings JOIN orders ON vec_id = o_orderkey
    UNION ALL SELECT 'entities', 'part-' || p_partkey, embedding::DOUBLE[], vec_id FROM embeddings JOIN part ON vec_id = p_partkey
    UNION ALL SELECT 'relations', 'rel-' || md5('customer-' || c_custkey || 'nation-' || c_nationkey), embedding::DOUBLE[], vec_id FROM embeddings JOIN customer ON vec_id = c_custkey
), asked AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7)
"""


def score(rows: DataFrame) -> DataFrame:
    """Scores as oracles compare them."""
    return rows.withColumn("score", F.round("score", 6))
