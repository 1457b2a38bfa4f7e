"""Multi-hop paths: expansion, scores, supporting chunks, and the questions they are for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexical_match
from ..operators.ranking import LITERALS, few
from .retrieve import Context, QueryRequest, Workspace, mix

PER_HOP = 5
LEAST_PATH_SCORE = 0.60
#: Words that make a question one of relations, or of several steps.
RELATION_WORDS = ("关系", "relationship")
PATH_WORDS = ("通过", "经过", "间接", "多跳", "through", "via", "indirect", "multi-hop")
#: Weights of a path's score.
SEED, TERMINAL, RELATION, WEIGHT, COVERAGE, LEXICAL, PER_HOP_BONUS, PER_HOP_COST, REPEATED = 0.30, 0.08, 0.22, 0.18, 0.20, 0.18, 0.10, 0.02, 0.20


def intent(query: Column) -> Column:
    """RELATION, MULTI_HOP or FACT; words of relations are looked for first."""
    q = F.lower(query)
    has = lambda words: F.greatest(*[F.contains(q, F.lit(w)) for w in words])
    first = q.rlike("(?s)first.*then") | q.rlike("(?s)先.*再")
    return F.when(has(RELATION_WORDS), "RELATION").when(has(PATH_WORDS) | first, "MULTI_HOP").otherwise("FACT")


def expand(relations: DataFrame, seeds: DataFrame, max_hop: int = 2, per_hop: int = PER_HOP) -> DataFrame:
    """Simple paths from seeds (id, rank): order, entity_ids, ends, chunk_ids, hops.

    From a path's end, the first `per_hop` relations by id that lead to an entity not on the path are
    followed; every step makes a path.  `order` sorts them depth first.
    """
    ends = F.struct("src_id", "tgt_id")
    one = relations.select("id", F.col("src_id").alias("here"), F.col("tgt_id").alias("there"), ends.alias("ends"), "source_chunk_ids")
    steps = one.unionByName(relations.select("id", F.col("tgt_id").alias("here"), F.col("src_id").alias("there"), ends.alias("ends"), "source_chunk_ids"))
    none = F.array().cast("array<string>")
    now = seeds.select(F.array(F.col("rank").cast("int")).alias("order"), F.array("id").alias("entity_ids"), F.array().cast("array<struct<src_id:string,tgt_id:string>>").alias("ends"), none.alias("chunk_ids"), F.lit(0).alias("hops"))
    found = None
    for _ in range(max_hop):
        last = F.try_element_at("entity_ids", F.lit(-1))
        # paths are few: their ends filter the relations, in the scan where it can
        now = now.persist()
        here = [r.here for r in now.select(last.alias("here")).distinct().limit(LITERALS + 1).collect()]
        p, s = now.withColumn("here", last).alias("p"), (steps.where(F.col("here").isin(here)) if len(here) <= LITERALS else steps).alias("s")
        near = p.join(s, F.col("p.here") == F.col("s.here")).where(~F.array_contains("entity_ids", F.col("s.there")))
        rank = F.row_number().over(Window.partitionBy("order").orderBy("s.id"))
        capped = near.withColumn("n", rank).where(F.col("n") <= per_hop)
        now = capped.select(
            F.concat("order", F.array("n")).alias("order"), F.concat("entity_ids", F.array("s.there")).alias("entity_ids"),
            F.concat("p.ends", F.array("s.ends")).alias("ends"), F.array_union("chunk_ids", "source_chunk_ids").alias("chunk_ids"), (F.col("hops") + 1).alias("hops"),
        )
        found = now if found is None else found.unionByName(now)
    # entities alone name a path: the first in order stays
    first = F.row_number().over(Window.partitionBy("entity_ids").orderBy("order"))
    return found.withColumn("__n", first).where("__n = 1").drop("__n")


def score(paths: DataFrame, entities: DataFrame, relations: DataFrame, query: str, max_hop: int = 2) -> DataFrame:
    """paths with score and rank, best first; entities and relations are those found, with score.

    Ends and relations that were not found count 0.
    """
    e = F.map_from_entries(F.collect_list(F.struct("id", F.struct("score", "name"))))
    r = F.map_from_entries(F.collect_list(F.struct(F.struct("src_id", "tgt_id"), F.struct("score", "weight"))))
    # what was found is bounded by the token budgets of the request
    known = entities.agg(e.alias("__e")).withColumn("__k", F.lit(1)).join(relations.agg(r.alias("__r")).withColumn("__k", F.lit(1)), "__k")
    p = paths.withColumn("__k", F.lit(1)).join(F.broadcast(known), "__k")
    first, last = F.col("entity_ids")[0], F.try_element_at("entity_ids", F.lit(-1))
    of = lambda m, k, c: F.coalesce(F.try_element_at(m, k)[c], F.lit(0.0))
    mean = lambda c: F.aggregate("ends", F.lit(0.0), lambda s, x: s + of(F.col("__r"), x, c)) / F.greatest(F.col("hops"), F.lit(1))
    name = F.try_element_at("__e", last)["name"]
    total = (
        SEED * of(F.col("__e"), first, "score") + TERMINAL * of(F.col("__e"), last, "score") + RELATION * mean("score") + WEIGHT * mean("weight")
        + COVERAGE * F.least(F.lit(1.0), F.size("chunk_ids") / F.greatest(F.col("hops"), F.lit(1))) + LEXICAL * F.coalesce(lexical_match(F.lit(query), name), F.lit(0.0))
        + PER_HOP_BONUS * F.least(F.col("hops"), F.lit(max_hop)) - PER_HOP_COST * F.greatest(F.col("hops") - 1, F.lit(0))
        - F.when(F.size(F.array_distinct("entity_ids")) < F.size("entity_ids"), REPEATED).otherwise(0.0)
    )
    scored = p.withColumn("score", F.greatest(total, F.lit(0.0))).drop("__e", "__r", "__k")
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("hops"), "order")))


def supporting_chunks(paths: DataFrame, relations: DataFrame, chunks: DataFrame, fallback: DataFrame) -> DataFrame:
    """Chunks for ranked paths, score 1: the first stored chunk of each edge, then all of each path, then the fallback."""
    have = chunks.select(F.col("id").alias("chunk_id"))
    edges = paths.select("rank", F.posexplode("ends").alias("edge", "e")).select("rank", "edge", F.col("e.src_id").alias("src_id"), F.col("e.tgt_id").alias("tgt_id"))
    asked = [r.src_id for r in edges.select("src_id").distinct().limit(LITERALS + 1).collect()]
    named = (relations.where(F.col("src_id").isin(asked)) if len(asked) <= LITERALS else relations).join(few(edges.select("src_id", "tgt_id").distinct()), ["src_id", "tgt_id"], "left_semi")
    of = few(edges.join(named.select("src_id", "tgt_id", F.posexplode("source_chunk_ids").alias("pos", "chunk_id")), ["src_id", "tgt_id"])).join(have, "chunk_id")
    n = F.row_number().over(Window.partitionBy("rank", "edge").orderBy("pos"))
    key = lambda tier, a, b, c: F.struct(F.lit(tier).alias("tier"), a.cast("int").alias("a"), b.cast("int").alias("b"), c.cast("int").alias("c"))
    first = of.withColumn("n", n).where("n = 1").select("chunk_id", key(0, F.col("rank"), F.col("edge"), F.lit(0)).alias("key"))
    every = few(paths.select("rank", F.posexplode("chunk_ids").alias("pos", "chunk_id"))).join(have, "chunk_id").select("chunk_id", key(1, F.col("rank"), F.lit(0), F.col("pos")).alias("key"))
    rest = fallback.select(F.col("id").alias("chunk_id"), key(2, F.row_number().over(Window.orderBy(F.desc("score"), "id")), F.lit(0), F.lit(0)).alias("key"))
    keyed = first.unionByName(every).unionByName(rest).groupBy("chunk_id").agg(F.min("key").alias("key"))
    placed = keyed.withColumn("position", F.row_number().over(Window.orderBy("key")))
    return few(placed.select(F.col("chunk_id").alias("id"), "position", F.lit(1.0).alias("score"))).join(chunks, "id")


def multi_hop(ws: Workspace, request: QueryRequest, vector) -> tuple[Context, DataFrame | None]:
    """MIX as seeds, and the best paths from them; no paths where none is good enough."""
    seed = mix(ws, request, vector).kept()
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    starts = seed.entities.orderBy(F.desc("score"), "id").limit(max(1, request.path_top_k)).select("id", rank.alias("rank"))
    ranked = score(expand(ws.relations, starts, request.max_hop), seed.entities, seed.relations, request.query, request.max_hop)
    best = ranked.where(F.col("rank") <= request.path_top_k).persist()
    top = best.where("rank = 1").select("score", "hops", F.size("chunk_ids").alias("n")).collect()
    if not top or top[0].score < LEAST_PATH_SCORE or top[0].n < top[0].hops:
        return seed, None
    chunks = supporting_chunks(best, ws.relations, ws.chunks, seed.chunks)
    return Context(seed.entities, seed.relations, chunks), best


def reasoning_text(paths: DataFrame, entities: DataFrame, relations: DataFrame, chunks: DataFrame) -> str:
    """Paths as numbered text with their steps and evidence.  Paths are at most path_top_k rows."""
    found = paths.orderBy("rank").collect()
    ids = sorted({x for p in found for x in p.entity_ids})
    names = {r.id: r.name for r in entities.where(F.col("id").isin(ids)).select("id", "name").collect()} if ids else {}
    ends = {(e.src_id, e.tgt_id) for p in found for e in p.ends}
    about = {(r.src_id, r.tgt_id): r for r in relations.where(F.col("src_id").isin([a for a, _ in ends])).select("src_id", "tgt_id", "keywords", "description").collect() if (r.src_id, r.tgt_id) in ends} if ends else {}
    cited = sorted({c for p in found for c in p.chunk_ids})
    texts = {r.id: r.text for r in chunks.where(F.col("id").isin(cited)).select("id", "text").collect()} if cited else {}
    out = []
    for n, p in enumerate(found, 1):
        out.append(f"Reasoning Path {n}")
        for h, (a, b, e) in enumerate(zip(p.entity_ids, p.entity_ids[1:], p.ends), 1):
            r = about.get((e.src_id, e.tgt_id))
            out.append(f"Hop {h}: {names.get(a, a)} -> {names.get(b, b)}" + (f" | keywords: {r.keywords}" if r else ""))
            if r and r.description:
                out.append(f"Relation detail: {r.description}")
        out += [f"Evidence [{c}]: {texts[c]}" for c in p.chunk_ids if c in texts]
    return "\n".join(out)
