"""Query modes as DataFrame plans over a workspace's tables.

Ids and scores that are bounded come to the driver: seeds (at most top_k), what searches find, the relations
among seeds, and the entities and relations that a budget can hold.  From there they are filters
by id, which reach the scans, so that tables are neither shuffled nor kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranking
from ..operators.filters import Condition, FilterPlan, build_plan, filter_rows
from ..operators.search import SearchSpec, batch_search, merge_keywords, search

MODES = ("NAIVE", "LOCAL", "GLOBAL", "HYBRID", "MIX", "BYPASS")


@dataclass(frozen=True)
class QueryRequest:
    query: str
    mode: str = "MIX"
    top_k: int = 10
    chunk_top_k: int = 10
    max_entity_tokens: int = 6000
    max_relation_tokens: int = 8000
    max_total_tokens: int = 30000
    max_hop: int = 2
    path_top_k: int = 3
    multi_hop: bool = True
    response_type: str = "Multiple Paragraphs"
    rerank: bool = True
    only_context: bool = False
    only_prompt: bool = False
    include_references: bool = False
    stream: bool = False
    model: object = None
    user_prompt: str = ""
    hl_keywords: Sequence[str] = ()
    ll_keywords: Sequence[str] = ()
    history: Sequence[tuple[str, str]] = ()
    filters: dict = field(default_factory=dict)
    conditions: Sequence[Condition] = ()

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"no such mode: {self.mode}")
        for name in ("top_k", "chunk_top_k", "max_entity_tokens", "max_relation_tokens", "max_total_tokens", "max_hop", "path_top_k"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")

    def plan(self) -> FilterPlan:
        return build_plan(self.filters, self.conditions)


@dataclass
class Workspace:
    """The tables of one workspace."""

    chunks: DataFrame
    entities: DataFrame
    relations: DataFrame
    vectors: DataFrame

    @property
    def spark(self):
        return self.vectors.sparkSession


@dataclass
class Context:
    """Scored entities, relations and chunks; each within its budget."""

    entities: DataFrame
    relations: DataFrame
    chunks: DataFrame

    def kept(self) -> Context:
        """The same, computed once however often it is used."""
        return Context(self.entities.persist(), self.relations.persist(), self.chunks.persist())


def _search(ws: Workspace, namespace: str, vector: Sequence[float], text: str, keywords: Sequence[str], k: int) -> DataFrame:
    spec = SearchSpec("q", namespace, vector, text, merge_keywords(keywords, []), k)
    return search(ws.vectors, spec)


def _found(rows: DataFrame) -> dict[str, float]:
    """A search's at most k rows."""
    return {r.id: r.score for r in rows.collect()}


def _entities(ws: Workspace, scores: DataFrame, tokens: int) -> DataFrame:
    """The best of the stored entities with scores (id, score), within the budget."""
    held = ranking.load_by_ids(scores, ws.entities.select("id"))
    return ranking.limit_entities(ranking.with_ids(ws.entities, ranking.best_ids(held, tokens, ranking.ENTITY_LEAST)), tokens).persist()


def _relations(rows: DataFrame, tokens: int) -> DataFrame:
    """The best of scored relations, within the budget."""
    return ranking.limit_relations(rows, tokens).persist()


def _chunks(ws: Workspace, sources: Sequence[DataFrame]) -> DataFrame:
    """The chunks that scored rows come from."""
    return ranking.load_by_ids(ranking.few(ranking.chunk_scores(sources)), ws.chunks)


def _near(ws: Workspace, seeds: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """(entities as id and score, relations with score) that are reached from seeds within a step, the seeds included."""
    start = ws.spark.createDataFrame(list(seeds.items()), "n string, s double")
    ends = ws.relations
    if len(seeds) <= ranking.LITERALS:
        ends = ends.where(F.col("src_id").isin(list(seeds)) | F.col("tgt_id").isin(list(seeds)))
    for end, score in (("src_id", "__src"), ("tgt_id", "__tgt")):
        ends = ends.join(F.broadcast(start.select(F.col("n").alias(end), F.col("s").alias(score))), end, "left")
    near = ends.where("__src IS NOT NULL OR __tgt IS NOT NULL")
    relations = near.select(*ws.relations.columns, F.greatest("__src", "__tgt").alias("score"))
    to = lambda end, score: near.select(F.col(end).alias("id"), F.col(score).alias("score")).where("score IS NOT NULL")
    entities = to("tgt_id", "__src").unionByName(to("src_id", "__tgt")).unionByName(start.select(F.col("n").alias("id"), F.col("s").alias("score")))
    return ranking.best_scores(entities), relations


def _filtered(ws: Workspace, chunks: DataFrame, plan: FilterPlan, k: int) -> DataFrame:
    """Filter, the best k with parents for children, filter again."""
    kept = filter_rows(chunks, plan)
    best = kept.orderBy(F.desc("score"), "id").limit(k) if not plan.empty else kept
    return filter_rows(ranking.expand_parents(best, ws.chunks, k), plan)


def naive(ws: Workspace, request: QueryRequest, vector: Sequence[float]) -> DataFrame:
    """The chunks nearest to the query; filters apply to the k found, as they come."""
    found = _found(_search(ws, "chunks", vector, request.query, (), request.chunk_top_k))
    return _filtered(ws, ranking.with_ids(ws.chunks, found), request.plan(), request.chunk_top_k)


def seed_scores(seeds: Sequence[tuple[str, float]], pairs: set[tuple[str, str]]) -> dict[str, float]:
    """Scores with which seeds, in rank order, reach their neighbours: a seed passes on what it got from better seeds."""
    out: dict[str, float] = {}
    for i, (name, score) in enumerate(seeds):
        near = [out[other] for other, _ in seeds[:i] if (min(name, other), max(name, other)) in pairs]
        out[name] = max([score, *near])
    return out


def local_scores(ws: Workspace, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities as id and score, relations with score), reached from the seeds (id, score) within a step."""
    ranked = [(r.id, r.score) for r in seeds.orderBy(F.desc("score"), "id").collect()]
    names = [n for n, _ in ranked]
    inner = ws.relations.where(F.col("src_id").isin(names) & F.col("tgt_id").isin(names)).select("src_id", "tgt_id")
    return _near(ws, seed_scores(ranked, {(min(r.src_id, r.tgt_id), max(r.src_id, r.tgt_id)) for r in inner.collect()}))


def local(ws: Workspace, request: QueryRequest, vector: Sequence[float]) -> Context:
    """Entities nearest to the query, and what is one step away."""
    seeds = _search(ws, "entities", vector, request.query, request.ll_keywords, request.top_k)
    entity_scores, near = local_scores(ws, seeds)
    entities, relations = _entities(ws, entity_scores, request.max_entity_tokens), _relations(near, request.max_relation_tokens)
    return Context(entities, relations, _filtered(ws, _chunks(ws, [entities, relations]), request.plan(), request.chunk_top_k))


def global_(ws: Workspace, request: QueryRequest, vector: Sequence[float]) -> Context:
    """Relations nearest to the query, and their ends."""
    found = _found(_search(ws, "relations", vector, request.query, request.hl_keywords, request.top_k))
    loaded = ranking.with_ids(ws.relations, found).persist()  # at most top_k rows
    relations = _relations(loaded, request.max_relation_tokens)
    ends = loaded.select(F.explode(F.array("src_id", "tgt_id")).alias("id"), "score")
    entities = _entities(ws, ranking.best_scores(ends), request.max_entity_tokens)
    return Context(entities, relations, _filtered(ws, _chunks(ws, [relations]), request.plan(), request.chunk_top_k))


def hybrid(ws: Workspace, request: QueryRequest, local_vector: Sequence[float], global_vector: Sequence[float] | None = None) -> Context:
    """LOCAL and GLOBAL, the better score of each id."""
    a, b = local(ws, request, local_vector), global_(ws, request, local_vector if global_vector is None else global_vector)
    chunks = filter_rows(ranking.pick_best([a.chunks, b.chunks]), request.plan()).orderBy(F.desc("score"), "id").limit(request.chunk_top_k)
    entities = ranking.limit_entities(ranking.pick_best([a.entities, b.entities]), request.max_entity_tokens)
    relations = ranking.limit_relations(ranking.pick_best([a.relations, b.relations]), request.max_relation_tokens)
    return Context(entities, relations, chunks)


def mix(ws: Workspace, request: QueryRequest, query_vector: Sequence[float], local_vector: Sequence[float] | None = None, global_vector: Sequence[float] | None = None, prefilter: bool = False) -> Context:
    """HYBRID and chunks nearest to the query.

    With a filter, the search asks for twice as many until k pass, or none are left.  prefilter
    searches among passing chunks alone instead, which may find more.
    """
    plan, k = request.plan(), request.chunk_top_k
    found = hybrid(ws, request, query_vector if local_vector is None else local_vector, global_vector)
    words = merge_keywords(request.ll_keywords, request.hl_keywords)
    vectors = ws
    if prefilter and not plan.empty:
        passing = filter_rows(ws.chunks, plan).select("id")
        vectors = replace(ws, vectors=ws.vectors.where("namespace = 'chunks'").join(passing, "id", "left_semi"))
    asked, before = k, -1
    while True:
        direct = _found(_search(vectors, "chunks", query_vector, request.query, words, asked))
        merged = filter_rows(ranking.pick_best([found.chunks, ranking.with_ids(ws.chunks, direct)]), plan)
        chunks = merged.orderBy(F.desc("score"), "id").limit(k)
        if plan.empty or prefilter:
            break
        matched = len(direct)
        if chunks.count() >= k or matched < asked or matched <= before:
            break
        asked, before = 2 * asked, matched
    entities = ranking.limit_entities(found.entities, request.max_entity_tokens)
    return Context(entities, ranking.limit_relations(found.relations, request.max_relation_tokens), chunks)


def one_shot_mix(ws: Workspace, request: QueryRequest, vectors: dict[str, Sequence[float]]) -> Context:
    """MIX with all three searches in one batch: scores flow one step from every seed, by the plain maximum."""
    keys = {"entities": request.ll_keywords, "relations": request.hl_keywords, "chunks": merge_keywords(request.ll_keywords, request.hl_keywords)}
    specs = [SearchSpec(n, n, vectors[n], request.query, merge_keywords(w, []), request.chunk_top_k if n == "chunks" else request.top_k) for n, w in keys.items()]
    hits = batch_search(ws.vectors, specs).collect()  # at most k for each
    of = lambda n: {r.id: r.score for r in hits if r.key == n}
    entity_scores, near = _near(ws, of("entities"))
    loaded = ranking.with_ids(ws.relations, of("relations")).select(*near.columns).persist()
    relations = _relations(ranking.pick_best([near, loaded]), request.max_relation_tokens)
    ends = loaded.select(F.explode(F.array("src_id", "tgt_id")).alias("id"), "score")
    entities = _entities(ws, ranking.best_scores(entity_scores.unionByName(ends)), request.max_entity_tokens)
    from_graph = _chunks(ws, [entities, relations])
    chunks = filter_rows(ranking.pick_best([from_graph, ranking.with_ids(ws.chunks, of("chunks"))]), request.plan()).orderBy(F.desc("score"), "id").limit(request.chunk_top_k)
    return Context(entities, relations, chunks)
