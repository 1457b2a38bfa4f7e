"""Building, merging, managing and checking graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import canonical_keywords, merged_keywords, relation_id
from ..operators import extraction, graph, materialization
from ..sources.models import cache_id, generate_cached
from .base import CTE, bare_entities, chunks, entities, register, relations, table, vectors, workspace

QUERIES: dict = {}
SQL: dict = {}
W = "WITH " + CTE


def _mentions(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.concat(F.lit(" Supplier-"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("PART-"), F.col("l_partkey").cast("string"), F.lit(" ")).alias("tgt"),
        F.concat_ws(", ", F.lit("sold By"), F.concat(F.lit("flag-"), "l_returnflag")).alias("keywords"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit("line "), F.col("l_linenumber").cast("string"))).otherwise("").alias("description"),
        F.col("l_quantity").alias("weight"), F.col("l_orderkey").cast("string").alias("chunk_id"), F.struct("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice").alias("pos"),
    )


A5 = """WITH m AS (SELECT 'part-' || l_partkey AS src_id, 'supplier-' || l_suppkey AS tgt_id, l_quantity, l_orderkey, l_linenumber, l_returnflag FROM lineitem)
SELECT 'rel-' || md5(src_id || tgt_id) AS id, src_id, tgt_id, max(l_quantity) AS weight, count(DISTINCT l_orderkey) AS n_chunks FROM m GROUP BY ALL"""


@register(QUERIES, SQL, A5)
def a5_merged_relations(spark, sf_dir):
    r = graph.merge_relations(_mentions(spark, sf_dir))
    return r.select("id", "src_id", "tgt_id", "weight", F.size("source_chunk_ids").cast("long").alias("n_chunks"))


A5K = """WITH m AS (SELECT l_partkey, l_suppkey, l_returnflag, min((l_orderkey, l_linenumber, l_shipdate, l_extendedprice)) AS pos, count(*) OVER (PARTITION BY l_partkey, l_suppkey) FROM lineitem GROUP BY l_partkey, l_suppkey, l_returnflag)
SELECT 'part-' || l_partkey AS src_id, 'supplier-' || l_suppkey AS tgt_id, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY ALL"""


@register(QUERIES, SQL, A5K)
def a5_merged_keywords(spark, sf_dir):
    """Each mention's flag is a keyword once: the first in canonical form, the others as they come."""
    r = graph.merge_relations(_mentions(spark, sf_dir))
    words = F.filter(F.split("keywords", ", "), lambda k: F.startswith(F.lower(k), F.lit("flag_")))
    return r.select("src_id", "tgt_id", F.size(F.array_distinct(F.transform(words, F.lower))).cast("long").alias("flags"))


A6 = W + """SELECT e.id, CASE WHEN description = '' THEN 'seen' ELSE description END AS description, n + CASE WHEN e.type = 'supplier' THEN 1 ELSE 0 END AS n_chunks FROM entities e JOIN (SELECT e.id, count(chunk_id) AS n FROM entities e LEFT JOIN entity_chunks c ON c.id = e.id GROUP BY e.id) USING (id) WHERE type IN ('supplier', 'part')"""


@register(QUERIES, SQL, A6)
def a6_upserted_entities(spark, sf_dir):
    """What is stored stays; an update of suppliers adds a description and a chunk."""
    stored = entities(spark, sf_dir).where("type IN ('supplier', 'part')")
    new = stored.where("type = 'supplier'").withColumn("description", F.lit("seen")).withColumn("source_chunk_ids", F.concat(F.slice("source_chunk_ids", 1, 1), F.array(F.lit("new"))))
    return graph.upsert_entities(stored, new).select("id", "description", F.size("source_chunk_ids").cast("long").alias("n_chunks"))


@register(QUERIES, SQL, W + "SELECT r.id, r.keywords, r.weight + 1 AS weight, count(chunk_id) + 1 AS n_chunks FROM relations r LEFT JOIN relation_chunks USING (id) GROUP BY ALL")
def a6_upserted_relations(spark, sf_dir):
    """Stored keywords stay; an update of every relation adds weight and a chunk beside one it has already."""
    stored = relations(spark, sf_dir)
    chunk_ids = F.concat(F.slice("source_chunk_ids", 1, 1), F.array(F.lit("new")))
    new = stored.withColumn("keywords", F.lit("other")).withColumn("weight", F.col("weight") + 1).withColumn("source_chunk_ids", chunk_ids)
    return graph.upsert_relations(stored, new).select("id", "keywords", "weight", F.size("source_chunk_ids").cast("long").alias("n_chunks"))


A13 = W + "SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM relations) AS relations, (SELECT count(*) FROM relations r WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.id = r.src_id)) AS dangling"


@register(QUERIES, SQL, A13)
def a13_graph_counts(spark, sf_dir):
    e, r = bare_entities(spark, sf_dir), relations(spark, sf_dir)
    dangling = r.join(e.select(F.col("id").alias("src_id")), "src_id", "left_anti")
    one = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name)).withColumn("k", F.lit(1))
    return one(e, "entities").join(one(r, "relations"), "k").join(one(dangling, "dangling"), "k").drop("k")


def _extractions(spark, sf_dir):
    """Each order as a chunk that names its parts and suppliers."""
    none = F.array().cast("array<string>")
    name = lambda kind, key: F.concat(F.lit(kind), key.cast("string"))
    ent = lambda n, t: F.struct(n.alias("name"), F.lit(t).alias("type"), F.lit("").alias("description"), none.alias("aliases"))
    both = lambda m: F.array(ent(name("Part-", m["l_partkey"]), "part"), ent(name("Supplier-", m["l_suppkey"]), "supplier"))
    rel = lambda m: F.struct(name("Supplier-", m["l_suppkey"]).alias("source"), name("Part-", m["l_partkey"]).alias("target"), F.lit("sells").alias("keywords"), F.lit("").alias("description"), m["l_discount"].alias("weight"))
    # numbers are gathered, names are made of them afterwards
    m = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_discount")).alias("m"))
    g = m.select("l_orderkey", F.flatten(F.transform("m", both)).alias("entities"), F.transform("m", rel).alias("relations"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("document_id"))
    return g.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("document_id", F.col("l_orderkey").cast("string").alias("chunk_id"), F.col("l_orderkey").cast("int").alias("chunk_order"), "entities", "relations")


A4 = """SELECT 'customer-' || o_custkey AS document_id, 'part-' || l_partkey AS id, 'part' AS type, count(DISTINCT l_orderkey) AS n_chunks FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
UNION ALL SELECT 'customer-' || o_custkey, 'supplier-' || l_suppkey, 'supplier', count(DISTINCT l_orderkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"""


@register(QUERIES, SQL, A4)
def a4_assembled_entities(spark, sf_dir):
    return graph.assemble_entities(_extractions(spark, sf_dir)).select("document_id", "id", "type", F.size("source_chunk_ids").cast("long").alias("n_chunks"))


G6 = """SELECT 'customer-' || o_custkey AS document_id, 'rel-' || md5('part-' || l_partkey || 'supplier-' || l_suppkey) AS id, max(l_discount) AS weight, count(DISTINCT l_orderkey) AS n_chunks FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey, l_suppkey"""


@register(QUERIES, SQL, G6)
def g6_assembled_relations(spark, sf_dir):
    return graph.assemble_relations(_extractions(spark, sf_dir)).select("document_id", "id", "weight", F.size("source_chunk_ids").cast("long").alias("n_chunks"))


def answer(prompt: str) -> str:
    """A stand-in for a model: capitalised words are entities, each related to the next."""
    import json
    import re

    words = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]{3,}\b", prompt.split("Text:\n", 1)[1].split("\nAlready found", 1)[0])))[:8]
    return "```json\n" + json.dumps({"entities": [{"name": w, "type": "word"} for w in words], "relations": [{"source": a, "target": b, "keywords": "next to", "confidence": "0.5"} for a, b in zip(words, words[1:])]}) + "\n```"


@register(QUERIES, SQL)
def g1_extraction(spark, sf_dir):
    """Benchmark passages through a model, here a rule."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("document_id"), F.concat(F.col("item_id").cast("string"), F.lit(":0")).alias("id"), "text", F.lit(0).alias("chunk_order"))
    found = extraction.extract(b, answer)
    return found.select("chunk_id", F.size("entities").alias("n_entities"), F.size("relations").alias("n_relations"))


G3 = "SELECT event_id, least(greatest(CASE WHEN event_type = 'view' THEN value ELSE value / 100 END, 0), 1) AS weight FROM events"


@register(QUERIES, SQL, G3)
def g3_weights(spark, sf_dir):
    """Weights as text, and where they are none, confidences."""
    e = table(spark, sf_dir, "events")
    w = F.when(F.col("event_type") == "view", F.col("value").cast("string")).otherwise("high")
    return e.select("event_id", graph.clean_weight(w, (F.col("value") / 100).cast("string")).alias("weight"))


G4 = """WITH m AS (SELECT o_custkey AS chunk_id, o_orderpriority AS name, o_orderkey AS pos, o_orderstatus AS type, repeat('x', (o_orderkey % 5)::INT) AS description FROM orders)
SELECT chunk_id, name, arg_min(type, pos) AS type, max(length(description)) AS n_description, count(DISTINCT type) AS n_aliases FROM m GROUP BY chunk_id, name"""


@register(QUERIES, SQL, G4)
def g4_gleaned_entities(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = o.select(F.col("o_custkey").alias("chunk_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("type"), F.expr("repeat('x', cast(o_orderkey % 5 as int))").alias("description"), F.array("o_orderstatus").alias("aliases"))
    return graph.merge_gleaned_entities(m).select("chunk_id", "name", "type", F.char_length("description").cast("long").alias("n_description"), F.size("aliases").cast("long").alias("n_aliases"))


@register(QUERIES, SQL, "SELECT o_custkey AS chunk_id, least(lower(o_orderpriority), lower(o_orderstatus)) AS src_id, greatest(lower(o_orderpriority), lower(o_orderstatus)) AS tgt_id, max(o_totalprice) AS weight FROM orders GROUP BY ALL")
def g4_gleaned_relations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    flip = F.col("o_orderkey") % 2 == 0
    m = o.select(F.col("o_custkey").alias("chunk_id"), F.when(flip, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus")).alias("src"), F.when(flip, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority")).alias("tgt"), F.when(flip, "Has state").otherwise("has_state ").alias("keywords"), F.col("o_totalprice").alias("weight"))
    return graph.merge_gleaned_relations(m).drop("keywords")


G5 = "SELECT 'd' || n_nationkey AS document_id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'other' ELSE 'other,' || r_name END AS aliases FROM nation JOIN region ON n_regionkey = r_regionkey"


@register(QUERIES, SQL, G5)
def g5_alias_conflicts(spark, sf_dir):
    """A nation's region as alias goes where a relation names both; its own name always does."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("d", F.concat(F.lit("d"), F.col("n_nationkey").cast("string")))
    e = n.select(F.col("d").alias("document_id"), F.col("n_name").alias("name"), F.array(F.lit("other"), F.lower("n_name"), F.col("r_name")).alias("aliases"))
    r = n.where("n_nationkey % 2 = 0").select(F.col("d").alias("document_id"), F.lower("r_name").alias("src"), F.concat(F.lit(" "), "n_name").alias("tgt"))
    return graph.drop_conflicting_aliases(e, r).select("document_id", "name", F.array_join("aliases", ",").alias("aliases"))


@register(QUERIES, SQL, W + "SELECT tgt_id AS id, count(DISTINCT chunk_id) AS n_chunks FROM relations LEFT JOIN relation_chunks USING (id) WHERE tgt_id LIKE 'supplier-%' GROUP BY tgt_id")
def g7_missing_endpoints(spark, sf_dir):
    """Suppliers are left out of the entities, and come back from the relations."""
    e = bare_entities(spark, sf_dir).where("type <> 'supplier'")
    return graph.missing_endpoints(e, relations(spark, sf_dir)).select("id", F.size("source_chunk_ids").cast("long").alias("n_chunks"))


@register(QUERIES, SQL, "SELECT DISTINCT 'rel-' || md5(least(a, b) || greatest(a, b)) AS id, least(a, b) AS src_id, greatest(a, b) AS tgt_id FROM (SELECT c_mktsegment AS a, n_name AS b FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def g8_canonical_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    flip = F.col("c_custkey") % 2 == 0
    pairs = c.select(F.when(flip, F.col("c_mktsegment")).otherwise(F.col("n_name")).alias("src_id"), F.when(flip, F.col("n_name")).otherwise(F.col("c_mktsegment")).alias("tgt_id"))
    return graph.canonical_edges(pairs).distinct()


G9 = "SELECT p_partkey, array_to_string(list_sort(list_distinct([replace(p_name, ' ', '_'), lower(p_type), replace(lower(p_brand), '-', '_')])), ', ') AS keywords, array_to_string(CASE WHEN replace(p_name, ' ', '_') = p_type THEN [p_type] ELSE [replace(p_name, ' ', '_'), p_type] END, ', ') AS merged FROM part"


@register(QUERIES, SQL, G9)
def g9_keywords(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit(" "), "p_name", F.lit(" ,"), "p_type", F.lit(", "), "p_brand", F.lit(",,"), "p_type")
    return p.select("p_partkey", canonical_keywords(text).alias("keywords"), merged_keywords("p_name", F.concat("p_type", F.lit(","), "p_name")).alias("merged"))




@register(QUERIES, SQL, "SELECT o_orderkey, o_orderstatus = 'F' AS gap FROM orders")
def g10_extraction_gaps(spark, sf_dir):
    """Texts that end in an open word, with two entities and no relation."""
    o = table(spark, sf_dir, "orders")
    text = F.concat("o_orderpriority", F.when(F.col("o_orderstatus") == "F", "通过 ").otherwise("."))
    return o.select("o_orderkey", extraction.has_gap(text, F.array(F.lit(1), F.lit(2)), F.array().cast("array<int>")).alias("gap"))


G11 = """WITH t AS (SELECT conv_id, turn, length(regexp_replace(coalesce(lag(text) OVER w, '') || text || '通过' || coalesce(lead(text) OVER w, ''), '\\s', '', 'g')) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
u AS (SELECT conv_id, turn, n + (SELECT 0) + 2 * ((SELECT count(*) FROM conversations c WHERE c.conv_id = t.conv_id AND c.turn IN (t.turn - 1, t.turn + 1))) AS n FROM t)
SELECT conv_id::VARCHAR AS document_id, min(turn)::VARCHAR AS chunk_id FROM u WHERE n <= 1200 GROUP BY conv_id"""


@register(QUERIES, SQL, G11)
def g11_refinement_windows(spark, sf_dir):
    """Every turn breaks off; the first one with short neighbours is asked about again."""
    c = table(spark, sf_dir, "conversations")
    none = F.array().cast("array<string>")
    x = c.select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("string").alias("chunk_id"), F.col("turn").cast("int").alias("chunk_order"), F.array(F.lit("a"), F.lit("b")).alias("entities"), none.alias("relations"), F.concat("text", F.lit("通过")).alias("text"))
    return extraction.refinement_windows(x).select("document_id", "chunk_id")


@register(QUERIES, SQL, W + "SELECT c.id AS chunk_id FROM chunks c WHERE contains(lower(text), 'status f') AND contains(lower(text), '5-low')")
def g12_attribution(spark, sf_dir):
    """One refined relation, given to all chunks that hold both its ends."""
    own = chunks(spark, sf_dir)
    item = own.select(F.lit("d").alias("document_id"), F.array("id").alias("chunk_ids"), F.array().cast("array<int>").alias("indexes"), F.lit("Status F").alias("source"), F.lit("5-LOW").alias("target"), F.lit("k").alias("keywords"), F.lit("").alias("description"), F.lit(1.0).alias("weight"))
    return extraction.attribute(item, own).select("chunk_id")


@register(QUERIES, SQL, W + "SELECT id, src_id || chr(10) || keywords || chr(10) || tgt_id || chr(10) AS text FROM relations")
def g14_embedding_texts(spark, sf_dir):
    from ..operators.search import relation_text

    return relations(spark, sf_dir).select("id", relation_text().alias("text"))


RENAMED = W + """, r AS (SELECT least(s, t) AS src_id, greatest(s, t) AS tgt_id, weight, id FROM (SELECT CASE WHEN src_id IN ('nation-1', 'nation-2') THEN 'nation-0' ELSE src_id END AS s, CASE WHEN tgt_id IN ('nation-1', 'nation-2') THEN 'nation-0' ELSE tgt_id END AS t, weight, id FROM relations) WHERE s <> t)
SELECT 'rel-' || md5(r.src_id || r.tgt_id) AS id, r.src_id, r.tgt_id, max(weight) AS weight, count(DISTINCT chunk_id) AS n_chunks FROM r LEFT JOIN relation_chunks c ON c.id = r.id GROUP BY r.src_id, r.tgt_id"""


@register(QUERIES, SQL, RENAMED)
def g17_merged_entities(spark, sf_dir):
    """Two nations merged into a third: their relations move, and meet."""
    ws = workspace(spark, sf_dir)
    old = spark.createDataFrame([("nation-1",), ("nation-2",)], "id string")
    _, r = graph.merge_entities(ws.entities, ws.relations, old, "nation-0")
    return r.select("id", "src_id", "tgt_id", "weight", F.size("source_chunk_ids").cast("long").alias("n_chunks"))


@register(QUERIES, SQL, W + "SELECT 'nation-0' AS id, string_agg(name, ',' ORDER BY id) AS aliases FROM entities WHERE id IN ('nation-1', 'nation-2')")
def g16_merged_names(spark, sf_dir):
    """The merged entity's aliases are the others' names."""
    ws = workspace(spark, sf_dir)
    e, _ = graph.merge_entities(ws.entities, ws.relations, spark.createDataFrame([("nation-1",), ("nation-2",)], "id string"), "nation-0")
    return e.where("id = 'nation-0'").select("id", F.array_join("aliases", ",").alias("aliases"))


G18 = W + ", gone AS (SELECT id FROM entities WHERE lower(name) IN ('supplier#000000003', 'red ring')) SELECT 'entity' AS kind, id FROM entities WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'relation', id FROM relations WHERE src_id NOT IN (SELECT id FROM gone) AND tgt_id NOT IN (SELECT id FROM gone)"


@register(QUERIES, SQL, G18)
def g18_delete_by_entity(spark, sf_dir):
    """All entities of a name go, with their relations."""
    names = spark.createDataFrame([("Supplier#000000003",), (" RED ring ",)], "name string")
    e, r, _ = graph.delete_entities(bare_entities(spark, sf_dir), relations(spark, sf_dir), vectors(spark, sf_dir), names)
    return e.select(F.lit("entity").alias("kind"), "id").unionByName(r.select(F.lit("relation").alias("kind"), "id"))


@register(QUERIES, SQL, W + "SELECT id FROM relations WHERE NOT (src_id = 'nation-3' AND tgt_id = 'region-3')")
def g19_delete_by_relation(spark, sf_dir):
    return graph.delete_relation(relations(spark, sf_dir), vectors(spark, sf_dir), "region-3", "nation-3")[0].select("id")


G20 = W + """, mine AS (SELECT id FROM chunks WHERE document_id = 'customer-7'), e AS (SELECT id FROM entities WHERE NOT (id IN (SELECT id FROM entity_chunks) AND id NOT IN (SELECT id FROM entity_chunks WHERE chunk_id NOT IN (SELECT id FROM mine)))),
r AS (SELECT id, src_id, tgt_id FROM relations WHERE NOT (id IN (SELECT id FROM relation_chunks) AND id NOT IN (SELECT id FROM relation_chunks WHERE chunk_id NOT IN (SELECT id FROM mine))))
SELECT 'chunk' AS kind, id FROM chunks WHERE document_id <> 'customer-7' UNION ALL SELECT 'entity', id FROM e UNION ALL SELECT 'relation', id FROM r WHERE src_id IN (SELECT id FROM e) AND tgt_id IN (SELECT id FROM e)"""


@register(QUERIES, SQL, G20)
def g20_delete_document(spark, sf_dir):
    """A customer's orders go, and what only they mention."""
    ws = workspace(spark, sf_dir)
    left = graph.delete_document(ws.chunks, ws.entities, ws.relations, ws.vectors, "customer-7")
    kind = lambda n, k: left[n].select(F.lit(k).alias("kind"), "id")
    return kind("chunks", "chunk").unionByName(kind("entities", "entity")).unionByName(kind("relations", "relation"))


G22 = """WITH x AS (SELECT 'customer-' || o_custkey AS document_id, 'rel-' || md5('part-' || l_partkey || 'supplier-' || l_suppkey) AS id, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT document_id, 'part-' || l_partkey AS id, true AS held FROM x GROUP BY ALL UNION ALL SELECT document_id, 'supplier-' || l_suppkey, l_suppkey >= 10 FROM x GROUP BY ALL),
n AS (SELECT document_id, sum((NOT held)::INT) AS missing FROM e GROUP BY document_id)
SELECT document_id, CASE WHEN missing = 0 THEN 'MERGED' ELSE 'PARTIAL' END AS status, CASE WHEN missing = 0 THEN 'AUTO' ELSE 'REPAIR' END AS mode, missing::INT AS missing FROM n"""


@register(QUERIES, SQL, G22)
def g22_materialization_status(spark, sf_dir):
    """Documents whose suppliers below ten are not in the graph."""
    x = _extractions(spark, sf_dir)
    keys = materialization.chunk_keys(x).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("snapshots"), F.array_distinct(F.flatten(F.collect_list("expected_entities"))).alias("expected_entities"), F.array_distinct(F.flatten(F.collect_list("expected_relations"))).alias("expected_relations"), F.lit(None).cast("string").alias("last_status"),
    )
    e = entities(spark, sf_dir).where("type IN ('part', 'supplier') AND NOT (type = 'supplier' AND cast(substring(id, 10) AS int) < 10)")
    r = relations(spark, sf_dir).where("keywords = 'supplied_by'")
    return materialization.status(keys, materialization.actual_keys(e, r, chunks(spark, sf_dir))).select("document_id", "status", "mode", F.size("missing_entities").alias("missing"))


G26 = """SELECT o.chunk_id, n_entities::INT AS n_entities, n_relations::INT AS n_relations FROM (SELECT l_orderkey::VARCHAR AS chunk_id, count(DISTINCT l_partkey) + count(DISTINCT l_suppkey) AS n_entities, count(DISTINCT (l_partkey, l_suppkey)) AS n_relations FROM lineitem GROUP BY 1) o"""


@register(QUERIES, SQL, G26)
def g26_chunk_keys(spark, sf_dir):
    k = materialization.chunk_keys(_extractions(spark, sf_dir))
    return k.select("chunk_id", F.size("expected_entities").alias("n_entities"), F.size("expected_relations").alias("n_relations"))


G25 = W + """SELECT c.id AS chunk_id, printf('%x', list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c.text, ''), lambda x: unicode(x)::BIGINT)), lambda h, u: (h * 31 + u) % 4294967296)) AS content_hash, 'SUCCEEDED' AS extract_status, n::INT AS n_relations
FROM chunks c JOIN (SELECT l_orderkey::VARCHAR AS id, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) GROUP BY 1) USING (id)"""


@register(QUERIES, SQL, G25)
def g25_chunk_snapshots(spark, sf_dir):
    x = _extractions(spark, sf_dir)
    pairs = F.size(F.array_distinct(F.transform("relations", lambda r: F.struct(r["source"], r["target"]))))
    return materialization.snapshots(x, chunks(spark, sf_dir)).select("chunk_id", "content_hash", "extract_status", pairs.alias("n_relations"))


G27 = W + "SELECT document_id, CASE WHEN document_id = 'customer-5' THEN 'FAILED' ELSE 'PROCESSED' END AS status, count(*)::INT AS chunks_count, sha256(string_agg(id, ',' ORDER BY chunk_order, id)) AS chunks_sha FROM chunks GROUP BY document_id"


@register(QUERIES, SQL, G27)
def g27_document_status(spark, sf_dir):
    failed = spark.createDataFrame([("customer-5", "no answer")], "document_id string, message string")
    s = materialization.document_states(chunks(spark, sf_dir), failed)
    return s.select("document_id", "status", "chunks_count", F.sha2(F.array_join("chunks_list", ","), 256).alias("chunks_sha"))


G28 = W + "SELECT DISTINCT 'c' || status AS cache_id FROM chunks WHERE document_id = 'customer-9'"


@register(QUERIES, SQL, G28)
def g28_cache_ids(spark, sf_dir):
    """Cache ids put into chunks' metadata, and collected again for a document."""
    c = chunks(spark, sf_dir)
    used = c.select(F.col("id").alias("chunk_id"), F.lit(0).alias("pos"), F.concat(F.lit("c"), F.col("metadata")["status"]).alias("cache_id"))
    return materialization.cache_ids_of(materialization.attach_cache_ids(c, used), "customer-9")


S20 = "SELECT o_orderpriority AS prompt, CASE WHEN o_orderpriority < '3' THEN 'kept' ELSE 'asked for ' || o_orderpriority END AS response, 'default:extraction:' || sha256(o_orderpriority) AS cache_id, count(*) AS n FROM orders GROUP BY 1"


@register(QUERIES, SQL, S20)
def s20_cache_misses(spark, sf_dir):
    """Orders' priorities as requests to a model; the cache holds two of them."""
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("prompt"))
    cache = asked.where("prompt < '3'").distinct().select(cache_id("extraction", F.col("prompt")).alias("id"), F.lit("kept").alias("value"))
    done, _ = generate_cached(asked, cache, lambda p: f"asked for {p}")
    return done.groupBy("prompt", "response", "cache_id").agg(F.count(F.lit(1)).alias("n"))


@register(QUERIES, SQL, "SELECT DISTINCT 'rel-' || md5('nation-' || n_nationkey || 'region-' || n_regionkey) AS id FROM nation")
def g8_relation_ids(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(relation_id(F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")), F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string"))).alias("id"))
