"""Questions to answers: keywords, mode, retrieval, reranking, budgets, prompt and model."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranking
from ..operators.filters import filter_rows
from ..operators.extraction import json_object
from . import paths, retrieve
from .retrieve import Context, QueryRequest, Workspace

SHORT_LITERAL = 8
#: What a short literal question must not hold.
DELIMITERS = ",，.。?？!！;；:：/\\\"'()[]{}<>、"
QUESTION_CUES, QUESTION_ENDS = ("什么", "怎么", "如何", "为什么", "是否", "多少", "哪些", "谁", "哪"), ("吗", "呢")
KEYWORD_PROMPT = "Give the broad themes and the specific names of the question as JSON {\"high_level_keywords\": [], \"low_level_keywords\": []}.\nQuestion: "
SYSTEM = "Answer from the context below alone, as {response_type}. Say so if the context does not tell.\n{user_prompt}\n\n{context}"
NAIVE_SYSTEM = "Answer from the passages below alone, as {response_type}.\n{user_prompt}\n\n{context}"
PATH_NOTE = "Follow the numbered reasoning paths; name the evidence of each step."
DRAFT_NOTE, FINAL_NOTE = "First write down the steps of reasoning and their evidence.", "Now write the final answer from this draft:\n"


def is_short_literal(query: str) -> bool:
    return len(query) <= SHORT_LITERAL and not any(c.isspace() or c in DELIMITERS for c in query) and not any(w in query for w in QUESTION_CUES) and not query.endswith(QUESTION_ENDS)


def _han(text: str) -> bool:
    return bool(re.search(r"[㐀-䶿一-鿿豈-﫿]", text))


def resolve_keywords(request: QueryRequest, chat: Callable | None, automatic: bool = True) -> QueryRequest:
    """The request with keywords: given ones stay, short literals are their own, else the model's, else the question."""
    if not automatic or request.mode not in ("LOCAL", "GLOBAL", "HYBRID", "MIX") or request.hl_keywords or request.ll_keywords:
        return request
    high, low = request.mode != "LOCAL", request.mode != "GLOBAL"
    query = request.query.strip()
    if query and is_short_literal(query):
        return replace(request, hl_keywords=[query] * high, ll_keywords=[query] * low)
    hl: list[str] = []
    ll: list[str] = []
    if chat is not None:
        try:
            found = json_object(chat(KEYWORD_PROMPT + request.query))
            take = lambda k: retrieve.merge_keywords([x for x in found.get(k) or [] if isinstance(x, str)], [])
            hl, ll = take("high_level_keywords"), take("low_level_keywords")
        except ValueError:
            hl, ll = [], []
    if _han(request.query):
        hl, ll = [k for k in hl if _han(k)], [k for k in ll if _han(k)]
    if request.mode in ("HYBRID", "MIX"):
        hl, ll = hl or ll, ll or hl
    if hl or ll:
        return replace(request, hl_keywords=hl, ll_keywords=ll)
    return replace(request, hl_keywords=[request.query]) if request.mode == "GLOBAL" else replace(request, ll_keywords=[request.query])


def context_text(entities: Sequence[str], relations: Sequence[str], chunks: Sequence[str]) -> str:
    """The three lists of formatted rows under their headings."""
    part = lambda name, rows: f"{name}:\n" + ("\n".join(rows) if rows else "(none)")
    return "\n\n".join((part("Entities", entities), part("Relations", relations), part("Chunks", chunks)))


def assembled(rows: DataFrame, line, empty: str = "(none)") -> DataFrame:
    """The formatted rows, best first, as one text in a one-row table.  Rows are within a token budget."""
    packed = rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"), line.alias("l")))).alias("r"))
    return packed.select(F.when(F.size("r") == 0, empty).otherwise(F.array_join(F.transform("r", lambda x: x["l"]), "\n")).alias("text"))


def count_tokens(text: str) -> int:
    return len(text.split())


@dataclass
class Answer:
    answer: str = ""
    contexts: list[dict] = field(default_factory=list)
    references: list[dict] = field(default_factory=list)
    stream: Iterator[str] | None = None
    structured: dict | None = None


@dataclass
class Engine:
    """Answers questions over a workspace.  Models are callables; embed takes a list of texts."""

    workspace: Workspace
    embed: Callable[[list[str]], list]
    chat: Callable[..., str] | None = None
    keyword_chat: Callable[[str], str] | None = None
    reranker: Callable[[str, list[tuple[str, str]]], list[tuple[str, float]]] | None = None
    rerank_factor: int = 2
    least_rerank_score: float = 0.0
    automatic_keywords: bool = True
    stream_chat: Callable[..., Iterator[str]] | None = None

    def _vector(self, text: str) -> list[float]:
        return [float(x) for x in self.embed([text])[0]]

    def retrieve(self, request: QueryRequest) -> tuple[Context, DataFrame | None]:
        """The context of a request, and its reasoning paths if it took any."""
        ws, none = self.workspace, self.workspace
        words = lambda k: ", ".join(k) if k else request.query
        query = self._vector(request.query)
        if request.mode == "NAIVE":
            return Context(none.entities.limit(0).withColumn("score", F.lit(0.0)), none.relations.limit(0).withColumn("score", F.lit(0.0)), retrieve.naive(ws, request, query)), None
        local, wide = self._vector(words(request.ll_keywords)), self._vector(words(request.hl_keywords))
        if request.mode == "LOCAL":
            return retrieve.local(ws, request, local), None
        if request.mode == "GLOBAL":
            return retrieve.global_(ws, request, wide), None
        if request.mode == "HYBRID":
            return retrieve.hybrid(ws, request, local, wide), None
        if request.multi_hop and self._intent(request.query) == "MULTI_HOP":
            return paths.multi_hop(ws, request, query)
        return retrieve.mix(ws, request, query, local, wide), None

    def _intent(self, query: str) -> str:
        return self.workspace.spark.range(1).select(paths.intent(F.lit(query)).alias("i")).first().i

    def query(self, request: QueryRequest) -> Answer:
        chat = request.model or self.chat
        if request.mode == "BYPASS":
            return self._generate(request, chat, request.user_prompt, [], [])
        request = resolve_keywords(request, self.keyword_chat or self.chat, self.automatic_keywords)
        rerank = request.rerank and self.reranker is not None
        wider = replace(request, chunk_top_k=request.chunk_top_k * self.rerank_factor) if rerank else request
        found, steps = self.retrieve(wider)
        order = Window.orderBy("position") if "position" in found.chunks.columns else Window.orderBy(F.desc("score"), "id")
        chunks = found.chunks.withColumn("position", F.row_number().over(order))
        if rerank and steps is None:
            rows = chunks.select("id", "text").collect()  # at most chunk_top_k times the factor
            scores = self.reranker(request.query, [(r.id, r.text) for r in rows])
            ranked = self.workspace.spark.createDataFrame([(i, n, float(s)) for n, (i, s) in enumerate(scores)], "id string, pos int, score double")
            chunks = ranking.reranked(chunks, ranked, request.chunk_top_k, self.least_rerank_score).withColumn("position", F.col("reranked")).drop("reranked")
        chunks = filter_rows(chunks, request.plan())
        lines = lambda rows, line: [r.l for r in rows.select("score", "id", line.alias("l")).orderBy(F.desc("score"), "id").collect()]
        entities, relations = lines(found.entities, ranking.entity_line()), lines(found.relations, ranking.relation_line())
        reasoning = paths.reasoning_text(steps, self.workspace.entities, self.workspace.relations, self.workspace.chunks) if steps is not None else ""
        prompt = self._system(request, reasoning or context_text(entities, relations, []), bool(reasoning))
        budget = ranking.remaining_budget(request.max_total_tokens, count_tokens(prompt), count_tokens(request.query))
        spent = F.sum(ranking.chunk_cost()).over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
        kept = chunks.withColumn("__spent", spent).where(F.col("__spent") <= budget).drop("__spent")
        rows = kept.select("position", "id", ranking.chunk_line().alias("l"), "text", "document_id", ranking.source_of_chunk().alias("source"), "score").orderBy("position").collect()
        text = (reasoning + "\n\n" if reasoning else "") + context_text(entities, relations, [r.l for r in rows])
        names: dict[str, int] = {}
        for r in rows:
            names[r.source] = names.get(r.source, 0) + 1
        ids = {s: str(n) for n, s in enumerate(sorted(names, key=lambda s: (-names[s], list(names).index(s))), 1)}
        contexts = [{"source_id": r.id, "text": r.text} | ({"reference_id": ids[r.source], "source": r.source} if request.include_references else {}) for r in rows]
        references = [{"reference_id": n, "source": s} for s, n in ids.items()] if request.include_references else []
        answer = self._generate(request, chat, self._system(request, text, bool(reasoning)), contexts, references, text, bool(reasoning))
        answer.structured = {"entities": entities, "relations": relations, "chunks": [{"id": r.id, "document_id": r.document_id, "score": r.score, "text": r.text} for r in rows]}
        return answer

    def query_structured(self, request: QueryRequest) -> dict:
        if request.stream:
            raise ValueError("a structured answer can't be streamed")
        found = self.query(request)
        return {"answer": found.answer, "references": found.references, **(found.structured or {})}

    @staticmethod
    def _system(request: QueryRequest, context: str, reasoned: bool) -> str:
        form = NAIVE_SYSTEM if request.mode == "NAIVE" else SYSTEM
        note = "\n".join(x for x in (PATH_NOTE if reasoned else "", request.user_prompt) if x)
        return form.format(response_type=request.response_type, user_prompt=note, context=context)

    def _generate(self, request, chat, system, contexts, references, context="", reasoned=False) -> Answer:
        if request.only_prompt:
            return Answer(system + "\n\n" + request.query, contexts, references)
        if request.only_context:
            return Answer(context, contexts, references)
        if request.stream:
            pieces = self.stream_chat(request.query, system, request.history) if self.stream_chat else iter([chat(request.query, system, request.history)])
            return Answer("", contexts, references, pieces)
        if reasoned:
            draft = chat(request.query, system + "\n" + DRAFT_NOTE, request.history)
            return Answer(chat(request.query, system + "\n" + FINAL_NOTE + draft, request.history), contexts, references)
        return Answer(chat(request.query, system, request.history), contexts, references)


def events_of(answer: Answer, query: str) -> Iterator[dict]:
    """A streamed answer as events: meta, one for each chunk, the pieces, complete; or error."""
    yield {"event": "meta", "data": json.dumps({"query": query, "references": answer.references})}
    for c in answer.contexts:
        yield {"event": "chunk", "data": json.dumps(c)}
    try:
        for piece in answer.stream or [answer.answer]:
            yield {"event": "answer", "data": piece}
    except Exception as e:  # the reader is told, as the stream has begun
        yield {"event": "error", "data": str(e)}
        return
    yield {"event": "complete", "data": ""}
