"""The query modes, and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.filters import Condition
from ..plans import engine, paths, retrieve
from ..plans.retrieve import QueryRequest
from .base import CTE, asked_vector, register, score, table, workspace

QUERIES: dict = {}
SQL: dict = {}
REQUEST = QueryRequest("what is known of part 7", mode="MIX", top_k=10, chunk_top_k=10, max_entity_tokens=600, max_relation_tokens=800)
#: Steps of LOCAL, GLOBAL and their merge as tables: (local|global|hybrid)_(entities|relations|chunks) with id and score.
STEPS = (
    CTE
    + """, seed AS (
    SELECT *, row_number() OVER (ORDER BY score DESC, id) AS k FROM (
        SELECT id, list_dot_product(vector, q) AS score FROM vectors, asked WHERE namespace = 'entities' ORDER BY score DESC, id LIMIT 10)
), reach AS (
    SELECT id, k, score FROM seed
    UNION
    SELECT t.id, t.k, r.score FROM reach r JOIN both_ways b ON b.entity_id = r.id JOIN seed t ON t.id = b.neighbour_id AND t.k > r.k
), eff AS (
    SELECT id, max(score) AS score FROM reach GROUP BY id
), local_all AS (
    SELECT id, max(score) AS score FROM (
        SELECT id, score FROM eff UNION ALL SELECT neighbour_id, score FROM eff JOIN both_ways ON entity_id = id) GROUP BY id
), local_entities AS (
    SELECT id, name, score FROM (
        SELECT l.id, e.name, l.score, sum(len(string_split_regex('- ' || l.id || ' | ' || e.name || ' | x', '\\s+'))) OVER (ORDER BY l.score DESC, l.id ROWS UNBOUNDED PRECEDING) AS spent
        FROM local_all l JOIN entities e USING (id)) WHERE spent <= 600
), local_rel AS (
    SELECT relation_id AS id, max(score) AS score FROM eff JOIN both_ways ON entity_id = id GROUP BY relation_id
), local_relations AS (
    SELECT id, score FROM (SELECT l.id, l.score, sum(len(string_split_regex('- ' || r.src_id || ' -> ' || r.tgt_id || ' | ' || r.keywords || ' | x', '\\s+'))) OVER (ORDER BY l.score DESC, l.id ROWS UNBOUNDED PRECEDING) AS spent
        FROM local_rel l JOIN relations r USING (id)) WHERE spent <= 800
), local_chunks AS (
    SELECT chunk_id AS id, max(score) AS score FROM (
        SELECT chunk_id, score FROM local_entities JOIN entity_chunks USING (id)
        UNION ALL SELECT chunk_id, score FROM local_relations JOIN relation_chunks USING (id))
    WHERE chunk_id IN (SELECT id FROM chunks) GROUP BY chunk_id ORDER BY score DESC, id LIMIT 10
), global_rel AS (
    SELECT id, list_dot_product(vector, q) AS score FROM vectors, asked WHERE namespace = 'relations' ORDER BY score DESC, id LIMIT 10
), global_relations AS (
    SELECT id, score FROM (SELECT g.id, g.score, sum(len(string_split_regex('- ' || r.src_id || ' -> ' || r.tgt_id || ' | ' || r.keywords || ' | x', '\\s+'))) OVER (ORDER BY g.score DESC, g.id ROWS UNBOUNDED PRECEDING) AS spent
        FROM global_rel g JOIN relations r USING (id)) WHERE spent <= 800
), global_all AS (
    SELECT id, max(score) AS score FROM (
        SELECT src_id AS id, score FROM global_rel JOIN relations USING (id) UNION ALL SELECT tgt_id, score FROM global_rel JOIN relations USING (id)) GROUP BY id
), global_entities AS (
    SELECT id, name, score FROM (
        SELECT l.id, e.name, l.score, sum(len(string_split_regex('- ' || l.id || ' | ' || e.name || ' | x', '\\s+'))) OVER (ORDER BY l.score DESC, l.id ROWS UNBOUNDED PRECEDING) AS spent
        FROM global_all l JOIN entities e USING (id)) WHERE spent <= 600
), global_chunks AS (
    SELECT chunk_id AS id, max(score) AS score FROM global_relations JOIN relation_chunks USING (id) WHERE chunk_id IN (SELECT id FROM chunks) GROUP BY chunk_id ORDER BY score DESC, id LIMIT 10
), hybrid_all AS (
    SELECT id, max(score) AS score FROM (SELECT id, score FROM local_entities UNION ALL SELECT id, score FROM global_entities) GROUP BY id
), hybrid_entities AS (
    SELECT id, name, score FROM (
        SELECT l.id, e.name, l.score, sum(len(string_split_regex('- ' || l.id || ' | ' || e.name || ' | x', '\\s+'))) OVER (ORDER BY l.score DESC, l.id ROWS UNBOUNDED PRECEDING) AS spent
        FROM hybrid_all l JOIN entities e USING (id)) WHERE spent <= 600
), hybrid_rel AS (
    SELECT id, max(score) AS score FROM (SELECT id, score FROM local_relations UNION ALL SELECT id, score FROM global_relations) GROUP BY id
), hybrid_relations AS (
    SELECT id, score FROM (SELECT g.id, g.score, sum(len(string_split_regex('- ' || r.src_id || ' -> ' || r.tgt_id || ' | ' || r.keywords || ' | x', '\\s+'))) OVER (ORDER BY g.score DESC, g.id ROWS UNBOUNDED PRECEDING) AS spent
        FROM hybrid_rel g JOIN relations r USING (id)) WHERE spent <= 800
), hybrid_chunks AS (
    SELECT id, max(score) AS score FROM (SELECT * FROM local_chunks UNION ALL SELECT * FROM global_chunks) GROUP BY id ORDER BY score DESC, id LIMIT 10
), direct AS (
    SELECT id, list_dot_product(vector, q) AS score FROM vectors, asked WHERE namespace = 'chunks' ORDER BY score DESC, id LIMIT 10
), mix_chunks AS (
    SELECT id, max(score) AS score FROM (SELECT * FROM hybrid_chunks UNION ALL SELECT id, score FROM direct) GROUP BY id ORDER BY score DESC, id LIMIT 10
)
"""
)
ALL = "SELECT '{0}' AS kind, id, round(score, 6) AS score FROM {1}_{2}"


def _context_sql(mode: str, chunks: str | None = None) -> str:
    parts = [ALL.format("entity", mode, "entities"), ALL.format("relation", mode, "relations"), ALL.format("chunk", chunks or mode, "chunks")]
    return "WITH RECURSIVE " + STEPS + " UNION ALL ".join(parts)


def _rows(c: retrieve.Context):
    kind = lambda rows, name: rows.select(F.lit(name).alias("kind"), "id", "score")
    return score(kind(c.entities, "entity").unionByName(kind(c.relations, "relation")).unionByName(kind(c.chunks, "chunk")))


NAIVE_SQL = "WITH " + CTE + "SELECT v.id, c.document_id, round(list_dot_product(vector, q), 6) AS score FROM vectors v JOIN chunks c ON c.id = v.id, asked WHERE namespace = 'chunks' ORDER BY list_dot_product(vector, q) DESC, v.id LIMIT 10"


@register(QUERIES, SQL, NAIVE_SQL)
def q1_naive(spark, sf_dir):
    return score(retrieve.naive(workspace(spark, sf_dir), REQUEST, asked_vector(spark, sf_dir)).select("id", "document_id", "score"))


@register(QUERIES, SQL, _context_sql("local"))
def q2_local(spark, sf_dir):
    return _rows(retrieve.local(workspace(spark, sf_dir), REQUEST, asked_vector(spark, sf_dir)))


@register(QUERIES, SQL, _context_sql("global"))
def q3_global(spark, sf_dir):
    return _rows(retrieve.global_(workspace(spark, sf_dir), REQUEST, asked_vector(spark, sf_dir)))


@register(QUERIES, SQL, _context_sql("hybrid"))
def q4_hybrid(spark, sf_dir):
    return _rows(retrieve.hybrid(workspace(spark, sf_dir), REQUEST, asked_vector(spark, sf_dir)))


@register(QUERIES, SQL, _context_sql("hybrid", "mix"))
def q5_mix(spark, sf_dir):
    return _rows(retrieve.mix(workspace(spark, sf_dir), REQUEST, asked_vector(spark, sf_dir)))


@register(QUERIES, SQL)
def q6_one_shot_mix(spark, sf_dir):
    v = asked_vector(spark, sf_dir)
    return _rows(retrieve.one_shot_mix(workspace(spark, sf_dir), REQUEST, {"entities": v, "relations": v, "chunks": v}))


PREFILTERED = "WITH " + CTE + "SELECT v.id, round(list_dot_product(vector, q), 6) AS score FROM (SELECT * FROM vectors, asked WHERE namespace = 'chunks' ORDER BY list_dot_product(vector, q) DESC, id LIMIT 10) v JOIN chunks c ON c.id = v.id WHERE c.status IN ('F', 'O') AND c.totalprice > 1000"


@register(QUERIES, SQL, PREFILTERED)
def p8_filter_after_search(spark, sf_dir):
    """A filter applies to the k that the search found, so fewer may be left."""
    request = QueryRequest("x", mode="NAIVE", filters={"status": ["F", "O"]}, conditions=[Condition("totalprice", "GT", "1000")])
    return score(retrieve.naive(workspace(spark, sf_dir), request, asked_vector(spark, sf_dir)).select("id", "score"))


MULTI_HOP_PATHS = (
    "WITH RECURSIVE "
    + STEPS
    + """, start AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS k FROM hybrid_entities ORDER BY k LIMIT 3),
hop1 AS (
    SELECT * FROM (SELECT s.id AS a, b.neighbour_id AS b, s.k, b.relation_id AS r1, row_number() OVER (PARTITION BY s.k ORDER BY b.relation_id) AS n1
        FROM start s JOIN both_ways b ON b.entity_id = s.id WHERE b.neighbour_id <> s.id) WHERE n1 <= 5
), hop2 AS (
    SELECT * FROM (SELECT h.*, w.neighbour_id AS c, w.relation_id AS r2, row_number() OVER (PARTITION BY k, n1 ORDER BY w.relation_id) AS n2
        FROM hop1 h JOIN both_ways w ON w.entity_id = h.b WHERE w.neighbour_id NOT IN (h.a, h.b)) WHERE n2 <= 5
), found AS (
    SELECT a || '->' || b AS path, 1 AS hops, [r1] AS rels, k, n1, 0 AS n2, a AS first, b AS last FROM hop1
    UNION ALL SELECT a || '->' || b || '->' || c, 2, [r1, r2], k, n1, n2, a, c FROM hop2
), evidence AS (
    SELECT path, count(DISTINCT chunk_id) AS n_chunks FROM (SELECT path, unnest(rels) AS id FROM found) JOIN relation_chunks USING (id) GROUP BY path
), edges AS (
    SELECT path, sum(coalesce(h.score, 0)) AS s, sum(CASE WHEN h.id IS NULL THEN 0 ELSE r.weight END) AS w FROM (SELECT path, unnest(rels) AS id FROM found) JOIN relations r USING (id) LEFT JOIN hybrid_relations h USING (id) GROUP BY path
), words AS (
    SELECT f.path, e1.score AS s1, e2.score AS s2, e2.name,
        CASE WHEN e2.name IS NULL THEN 0 WHEN contains('what is known of part 7', lower(e2.name)) THEN 1
             ELSE len(list_filter(string_split_regex(lower(e2.name), '[^a-z0-9]+'), lambda x: x <> '' AND contains('what is known of part 7', x)))::DOUBLE / greatest(1, len(list_filter(string_split_regex(lower(e2.name), '[^a-z0-9]+'), lambda x: x <> ''))) END AS lex
    FROM found f LEFT JOIN hybrid_entities e1 ON e1.id = f.first LEFT JOIN hybrid_entities e2 ON e2.id = f.last
)
"""
)


@register(QUERIES, SQL, MULTI_HOP_PATHS + "SELECT path, hops, coalesce(n_chunks, 0) AS n_chunks FROM found LEFT JOIN evidence USING (path)")
def q9_paths(spark, sf_dir):
    ws = workspace(spark, sf_dir)
    return _paths(ws, retrieve.mix(ws, REQUEST, asked_vector(spark, sf_dir))).select(F.array_join("entity_ids", "->").alias("path"), "hops", F.size("chunk_ids").cast("long").alias("n_chunks"))


def _paths(ws, seed):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    return paths.expand(ws.relations, seed.entities.orderBy(F.desc("score"), "id").limit(3).select("id", rank.alias("rank")))


SCORED = MULTI_HOP_PATHS + """SELECT path, round(greatest(0, 0.30 * coalesce(s1, 0) + 0.08 * coalesce(s2, 0) + 0.22 * s / hops + 0.18 * w / hops + 0.20 * least(1.0, coalesce(n_chunks, 0)::DOUBLE / hops) + 0.18 * lex + 0.10 * least(hops, 2) - 0.02 * (hops - 1)), 6) AS score
FROM found LEFT JOIN evidence USING (path) LEFT JOIN edges USING (path) LEFT JOIN words USING (path)"""


@register(QUERIES, SQL, SCORED)
def q10_path_scores(spark, sf_dir):
    ws = workspace(spark, sf_dir)
    seed = retrieve.mix(ws, REQUEST, asked_vector(spark, sf_dir)).kept()
    found = paths.score(_paths(ws, seed), seed.entities, seed.relations, REQUEST.query)
    return score(found.select(F.array_join("entity_ids", "->").alias("path"), "score"))


@register(QUERIES, SQL)
def q8_multi_hop(spark, sf_dir):
    found, _ = paths.multi_hop(workspace(spark, sf_dir), REQUEST, asked_vector(spark, sf_dir))
    return _rows(found)


@register(QUERIES, SQL)
def q11_supporting_chunks(spark, sf_dir):
    ws = workspace(spark, sf_dir)
    seed = retrieve.mix(ws, REQUEST, asked_vector(spark, sf_dir)).kept()
    best = paths.score(_paths(ws, seed), seed.entities, seed.relations, REQUEST.query).where("rank <= 3").persist()
    return paths.supporting_chunks(best, ws.relations, ws.chunks, seed.chunks).select("id", "position")


INTENT = """SELECT doc_id, CASE WHEN contains(t, '关系') OR contains(t, 'relationship') THEN 'RELATION'
    WHEN regexp_matches(t, '通过|经过|间接|多跳|through|via|indirect|multi-hop') OR regexp_matches(t, '(?s)first.*then') OR regexp_matches(t, '(?s)先.*再') THEN 'MULTI_HOP' ELSE 'FACT' END AS intent
FROM (SELECT doc_id, lower(text) AS t FROM documents)"""


@register(QUERIES, SQL, INTENT)
def q13_intent(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", paths.intent(F.col("text")).alias("intent"))


Q16 = """SELECT 'entities' AS section, coalesce(string_agg('- ' || id || ' | ' || name, chr(10) ORDER BY round(score, 6) DESC, id), '(none)') AS text FROM local_entities
UNION ALL SELECT 'relations', coalesce(string_agg('- ' || src_id || ' -> ' || tgt_id || ' | ' || keywords, chr(10) ORDER BY round(score, 6) DESC, id), '(none)') FROM local_relations JOIN relations USING (id)
UNION ALL SELECT 'chunks', coalesce(string_agg('- ' || id || ' | ' || text, chr(10) ORDER BY round(score, 6) DESC, id), '(none)') FROM local_chunks JOIN chunks USING (id)"""


@register(QUERIES, SQL, "WITH RECURSIVE " + STEPS + Q16)
def q16_context_text(spark, sf_dir):
    """All three sections of LOCAL's context; scores, which the lines show as well, are left out here."""
    found = retrieve.local(workspace(spark, sf_dir), REQUEST, asked_vector(spark, sf_dir))
    bar = F.lit(" | ")
    lines = {
        "entities": (found.entities, F.concat(F.lit("- "), "id", bar, "name")), "relations": (found.relations, F.concat(F.lit("- "), "src_id", F.lit(" -> "), "tgt_id", bar, "keywords")),
        "chunks": (found.chunks, F.concat(F.lit("- "), "id", bar, "text")),
    }
    parts = [engine.assembled(score(rows), line).select(F.lit(name).alias("section"), "text") for name, (rows, line) in lines.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ONE_SHOT = STEPS + """, os_seed AS (SELECT id, score FROM seed), os_near AS (SELECT b.neighbour_id, b.relation_id, s.score FROM os_seed s JOIN both_ways b ON b.entity_id = s.id
), os_rel AS (SELECT id, max(score) AS score FROM (SELECT relation_id AS id, score FROM os_near UNION ALL SELECT id, score FROM global_rel) GROUP BY id
), os_ent AS (SELECT id, max(score) AS score FROM (SELECT neighbour_id AS id, score FROM os_near UNION ALL SELECT id, score FROM os_seed UNION ALL SELECT id, score FROM global_all) GROUP BY id
), one_entities AS (SELECT id, name, score FROM (SELECT l.id, e.name, l.score, sum(len(string_split_regex('- ' || l.id || ' | ' || e.name || ' | x', '\\s+'))) OVER (ORDER BY l.score DESC, l.id ROWS UNBOUNDED PRECEDING) AS spent FROM os_ent l JOIN entities e USING (id)) WHERE spent <= 600
), one_relations AS (SELECT id, score FROM (SELECT g.id, g.score, sum(len(string_split_regex('- ' || r.src_id || ' -> ' || r.tgt_id || ' | ' || r.keywords || ' | x', '\\s+'))) OVER (ORDER BY g.score DESC, g.id ROWS UNBOUNDED PRECEDING) AS spent FROM os_rel g JOIN relations r USING (id)) WHERE spent <= 800
), one_chunks AS (SELECT id, max(score) AS score FROM (SELECT chunk_id AS id, score FROM one_entities JOIN entity_chunks USING (id) UNION ALL SELECT chunk_id, score FROM one_relations JOIN relation_chunks USING (id) UNION ALL SELECT id, score FROM direct) WHERE id IN (SELECT id FROM chunks) GROUP BY id ORDER BY score DESC, id LIMIT 10
) """
SQL["q6_one_shot_mix"] = "WITH RECURSIVE " + ONE_SHOT + " UNION ALL ".join(ALL.format(k, "one", n) for k, n in (("entity", "entities"), ("relation", "relations"), ("chunk", "chunks")))
