"""The library in one object: ingest, manage and query a workspace."""

from __future__ import annotations

from collections.abc import Callable
from copy import copy
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import extraction, graph, materialization, search
from .operators.chunking import frames
from .operators.chunking.windows import contract_errors, searchable
from .plans.engine import Answer, Engine
from .plans.retrieve import QueryRequest, Workspace
from .sources.models import embed_column
from .sources.store import WorkspaceStore
from .schemas import TASK_EVENT
from .streaming.events import TaskLog, TaskRunner

VECTOR_COLUMNS = ["namespace", "id", "vector", "searchable_text", "keywords", "metadata"]


class Corvane:
    """A workspace with its models.  Every change is a new version of its tables; readers keep the old one."""

    def __init__(self, spark: SparkSession, root: str, workspace_id: str = "default", embed: Callable | None = None, chat: Callable | None = None, extract_chat: Callable | None = None, reranker: Callable | None = None, chunking: frames.ChunkOptions | None = None, refine: bool = False, children: bool = False):
        self.spark, self.store = spark, WorkspaceStore(spark, root, workspace_id)
        self.embed, self.chat, self.extract_chat, self.reranker = embed, chat, extract_chat or chat, reranker
        self.chunking, self.refine, self.children = chunking or frames.ChunkOptions(), refine, children
        self.tasks = TaskLog()
        self.runner = TaskRunner(spark, self.tasks)

    def tables(self) -> Workspace:
        return Workspace(*[self.store.load(n) for n in ("chunks", "entities", "relations", "vectors")])

    def ingest(self, documents: DataFrame, process_options: str = "", replace_stored: bool = False) -> int:
        """Chunks, vectors and graph of documents (id, title, content, metadata), merged into the workspace.

        A document whose id is stored and processed, or that comes twice, is an error; with replace_stored all that came from the
        stored one goes first.  Documents are noted as PENDING, and as FAILED if the ingest fails, for resume().
        """
        with self.tasks.task("ingest"):
            keyed = documents.withColumn("id", F.col("id").cast("string"))
            twice = keyed.groupBy("id").count().where("count > 1").limit(1).collect()
            if twice:
                raise ValueError(f"{twice[0].id} comes twice")
            stored = self.store.load("document_status").where("status = 'PROCESSED'").select(F.col("document_id").alias("id"))
            known = keyed.join(stored, "id", "left_semi").select("id")
            if not replace_stored and (found := known.limit(1).collect()):
                raise ValueError(f"{found[0].id} is stored")
            work = self._staged()
            if replace_stored:
                work._without_documents(known)
            return self._finish(work, keyed, lambda: work._ingest(keyed, process_options))

    def _staged(self) -> Corvane:
        """The same workspace with commits that are published together."""
        other = copy(self)
        other.store = self.store.staged()
        return other

    def _finish(self, work: Corvane, documents: DataFrame, step: Callable[[], int]) -> int:
        """A step in a staged workspace, published when it is done; until then its documents are PENDING, then FAILED if it fails."""
        waiting = documents.select(F.col("id").alias("document_id"), "title", "content", "metadata")

        def note(state: str, message: str | None) -> None:
            marks = waiting.select("document_id", F.lit(state).alias("status"), F.lit("").alias("summary"), F.lit(message).cast("string").alias("error_message"), F.lit(0).alias("chunks_count"), F.array().cast("array<string>").alias("chunks_list"))
            texts = waiting.select(F.col("document_id").alias("id"), "title", "content", "metadata")
            self.store.commit({"document_status": search.upsert(self.store.load("document_status"), marks, ["document_id"]), "documents": search.upsert(self.store.load("documents"), texts, ["id"])}, state.lower())

        note("PENDING", None)
        try:
            version = step()
        except Exception as e:
            note("FAILED", str(e)[:2000])
            self.tasks.publish("", "DOCUMENT_FAILED", "DOCUMENT", message=str(e)[:500])
            raise
        self.store.publish(version)
        return version

    def _ingest(self, documents: DataFrame, process_options: str = "") -> int:
        options = frames.ProcessOptions.parse(process_options)
        chosen = self.chunking if options.strategy == "AUTO" else replace(self.chunking, strategy=options.strategy)
        chunks = frames.chunk_documents(documents, chosen)
        if self.children:
            chunks = frames.parents_and_children(chunks)
        return self._commit(documents, chunks, options.graph)

    def _without_documents(self, ids: DataFrame) -> None:
        """Commit the workspace without some documents (one column, id)."""
        ws, store = self.tables(), self.store
        rest = graph.delete_documents(ws.chunks, ws.entities, ws.relations, ws.vectors, ids.select(F.col("id").alias("document_id")))
        gone = ids.select(F.col("id").alias("document_id"))
        rest |= {n: store.load(n).join(gone, "document_id", "left_anti") for n in ("document_status", "chunk_snapshots", "journals")}
        rest["documents"] = store.load("documents").join(ids.select("id"), "id", "left_anti")
        store.commit(rest, "without documents")

    def resume(self) -> int | None:
        """Documents that are not PROCESSED are ingested again; graphs that lack parts their snapshots have are materialized.  The version, or None."""
        with self.tasks.task("resume"):
            states = self.status().select("document_id", "status").join(self.inspect().select("document_id", F.col("status").alias("graph_status"), "snapshots"), "document_id", "left")
            todo = materialization.resume_action(states).where("action <> 'NONE'").select("document_id", "action").persist()
            again = self.store.load("documents").join(todo.where("action = 'INGEST'").select(F.col("document_id").alias("id")), "id", "left_semi").persist()
            version = None
            if again.limit(1).collect():
                work = self._staged()
                work._without_documents(again.select("id"))
                version = self._finish(work, again, lambda: work._ingest(again))
            graphs = todo.where("action = 'MATERIALIZE'").select("document_id")
            return self.materialize(graphs, mode="RESUME") if graphs.limit(1).collect() else version

    def ingest_chunks(self, chunks: DataFrame) -> int:
        """Pre-chunked documents; the chunks must keep the contract of chunkers."""
        from .sources.files import grouped_chunks

        with self.tasks.task("ingest chunks"):
            docs = grouped_chunks(chunks).select("id", F.lit("").alias("title"), "content", F.create_map().cast("map<string,string>").alias("metadata"))
            broken = contract_errors(chunks, docs).limit(1).collect()
            if broken:
                raise ValueError(f"{broken[0].document_id}: {broken[0].problem}")
            return self._commit(docs, chunks, True)

    def _commit(self, documents: DataFrame, chunks: DataFrame, with_graph: bool) -> int:
        store, changed = self.store, {}
        chunks = chunks.persist()  # chunkers and models run once
        held = [chunks]
        changed["documents"] = search.upsert(store.load("documents"), documents.select(F.col("id").cast("string").alias("id"), "title", "content", "metadata"), ["id"])
        changed["chunks"] = search.upsert(store.load("chunks"), chunks, ["id"])
        payloads = [search.chunk_payloads(searchable(chunks))]
        if with_graph and self.extract_chat is not None:
            found = extraction.extract(searchable(chunks), self.extract_chat).persist()
            held.append(found)
            if self.refine:
                found = extraction.refine(found.join(chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id"), chunks, self.extract_chat).persist()
                held.append(found)
            order = F.col("document_id")
            graphs = graph.assemble_documents(found).persist()
            held.append(graphs)
            entities, relations = graph.entities_of(graphs), graph.relations_of(graphs)
            e_new = _across_documents(entities, order)
            r_new = graph.fold_relations(relations.drop("document_id"))
            changed["entities"] = graph.upsert_entities(store.load("entities"), e_new)
            changed["relations"] = graph.upsert_relations(store.load("relations"), r_new)
            changed["chunk_snapshots"] = search.upsert(store.load("chunk_snapshots"), materialization.snapshots(found, chunks), ["chunk_id"])
            changed["journals"] = search.upsert(store.load("journals"), materialization.journals(materialization.chunk_keys(found), 1, "AUTO", True), ["chunk_id"])
            payloads += [search.entity_payloads(e_new), search.relation_payloads(r_new)]
        if self.embed is not None:
            texts = payloads[0]
            for p in payloads[1:]:
                texts = texts.unionByName(p)
            changed["vectors"] = search.upsert(store.load("vectors"), self._vectors(texts), ["namespace", "id"])
        failures = self.spark.createDataFrame([], "document_id string, message string")
        changed["document_status"] = search.upsert(store.load("document_status"), materialization.document_states(chunks, failures), ["document_id"])
        try:
            return store.commit(changed, "ingest")
        finally:
            for rows in held:
                rows.unpersist()

    def delete_document(self, document_id: str) -> int:
        with self.tasks.task("delete document"):
            ws, store = self.tables(), self.store
            rest = graph.delete_document(ws.chunks, ws.entities, ws.relations, ws.vectors, document_id)
            other = F.col("document_id") != document_id
            gone = materialization.cache_ids_of(ws.chunks, document_id)
            rest |= {n: store.load(n).where(other) for n in ("document_status", "chunk_snapshots", "journals")}
            rest["documents"] = store.load("documents").where(F.col("id") != document_id)
            rest["llm_cache"] = store.load("llm_cache").join(gone.withColumnRenamed("cache_id", "id"), "id", "left_anti")
            return store.commit(rest, f"delete {document_id}")

    def delete_entity(self, name: str) -> int:
        ws = self.tables()
        e, r, v = graph.delete_entities(ws.entities, ws.relations, ws.vectors, self.spark.createDataFrame([(name,)], "name string"))
        gone = ws.entities.select("id").join(e.select("id"), "id", "left_anti")
        return self.store.commit({"entities": e, "relations": r, "vectors": v, **self._cascade(gone, None)}, f"delete entity {name}")

    def delete_relation(self, a: str, b: str) -> int:
        ws = self.tables()
        ends = self._resolve(a), self._resolve(b)
        r, v = graph.delete_relation(ws.relations, ws.vectors, *ends)
        return self.store.commit({"relations": r, "vectors": v, **self._cascade(None, ends)}, f"delete relation {a} {b}")

    def _cascade(self, entities: DataFrame | None, ends: tuple[str, str] | None) -> dict[str, DataFrame]:
        """Snapshots and journals without deleted entities (one column, id) and their relations, or without the relation of two ends."""
        gone = sorted(r.id for r in entities.collect()) if entities is not None else []  # those of one name
        pairs = [tuple(sorted(ends))] if ends else []
        return materialization.without_keys(self.store.load("chunk_snapshots"), self.store.load("journals"), gone, pairs)

    def _resolve(self, name: str) -> str:
        found = graph.resolve_names(self.store.load("entities"), self.spark.createDataFrame([(name,)], "name string")).first()
        if found.problem:
            raise ValueError(f"{name}: {found.problem} entity")
        return found.id

    def create_entity(self, name: str, type: str = "", description: str = "", aliases: list[str] = ()) -> int:  # noqa: A002
        """A new entity; its name and aliases must be nobody else's."""
        keys = self.spark.createDataFrame([(n,) for n in (name, *aliases)], "name string")
        taken = graph.resolve_names(self.store.load("entities"), keys).where("problem IS NULL OR problem = 'ambiguous'").limit(1).collect()
        if taken:
            raise ValueError(f"{taken[0].name} is taken")
        row = self.spark.createDataFrame([(name.strip().lower(), name.strip(), type, description, list(aliases), [])], "id string, name string, type string, description string, aliases array<string>, source_chunk_ids array<string>")
        return self.store.commit({"entities": self.store.load("entities").unionByName(row), **self._embedded(search.entity_payloads(row))}, f"create {name}")

    def create_relation(self, a: str, b: str, keywords: str, description: str = "", weight: float = 1.0) -> int:
        edge = self.spark.createDataFrame([(self._resolve(a), self._resolve(b), keywords, description, float(weight), [], [])], "src_id string, tgt_id string, keywords string, description string, weight double, source_chunk_ids array<string>, file_paths array<string>")
        edge = graph.canonical_edges(edge)
        if edge.join(self.store.load("relations"), "id", "left_semi").limit(1).collect():
            raise ValueError(f"{a} and {b} are related already")
        return self.store.commit({"relations": self.store.load("relations").unionByName(edge), **self._embedded(search.relation_payloads(edge))}, f"relate {a} {b}")

    def edit_entity(self, name: str, new_name: str | None = None, type: str | None = None, description: str | None = None) -> int:  # noqa: A002
        """An entity with another name, type or description; a new name, nobody else's name or alias, moves its relations.  Vectors follow."""
        old, ws = self._resolve(name), self.tables()
        new = (new_name or "").strip().lower() or old
        if new != old:
            found = graph.resolve_names(ws.entities.where(F.col("id") != old), self.spark.createDataFrame([(new_name,)], "name string")).first()
            if found.problem != "missing":
                raise ValueError(f"{new_name} is taken")
        mine = F.col("id") == old
        pick = lambda c, v: F.when(mine, F.lit(v)).otherwise(F.col(c)).alias(c) if v is not None else F.col(c)
        entities = ws.entities.select(pick("id", new), pick("name", new_name and new_name.strip()), pick("type", type), pick("description", description), "aliases", "source_chunk_ids")
        relations = graph.rename_ends(ws.relations, self.spark.createDataFrame([(old, new)], "old string, new string")) if new != old else ws.relations
        return self._regraph(entities, relations, f"edit {name}")

    def update_relation(self, a: str, b: str, keywords: str | None = None, description: str | None = None, weight: float | None = None) -> int:
        """The relation of two entities with other keywords, description or weight; its vector follows."""
        one, two = sorted((self._resolve(a), self._resolve(b)))
        ws = self.tables()
        mine = (F.col("src_id") == one) & (F.col("tgt_id") == two)
        if not ws.relations.where(mine).limit(1).collect():
            raise ValueError(f"{a} and {b} are not related")
        new = {"keywords": keywords, "description": description, "weight": None if weight is None else float(weight)}
        changed = [F.when(mine, F.lit(new[c])).otherwise(F.col(c)).alias(c) if new.get(c) is not None else F.col(c) for c in ws.relations.columns]
        return self._regraph(ws.entities, ws.relations.select(*changed), f"update {a} {b}")

    def merge_entities(self, sources: list[str], target: str) -> int:
        ws = self.tables()
        into = self._resolve(target)
        old = self.spark.createDataFrame([(self._resolve(s),) for s in sources], "id string")
        return self._regraph(*graph.merge_entities(ws.entities, ws.relations, old, into), f"merge into {target}")

    def _regraph(self, entities: DataFrame, relations: DataFrame, message: str, more: dict[str, DataFrame] | None = None) -> int:
        """Commit a changed graph, and vectors of what is new or reads otherwise; vectors of what is gone go."""
        ws, changed = self.tables(), {"entities": entities, "relations": relations, **(more or {})}
        now = search.entity_payloads(entities).unionByName(search.relation_payloads(relations))
        before = search.entity_payloads(ws.entities).unionByName(search.relation_payloads(ws.relations))
        key = ["namespace", "id"]
        other = now.join(before.select(*key, "searchable_text"), [*key, "searchable_text"], "left_anti")
        gone = before.select(*key).join(now.select(*key), key, "left_anti")
        vectors = ws.vectors.join(gone, key, "left_anti")
        changed["vectors"] = search.upsert(vectors, self._vectors(other), key) if self.embed is not None else vectors
        return self.store.commit(changed, message)

    def _vectors(self, payloads: DataFrame) -> DataFrame:
        return embed_column(payloads, "searchable_text", self.embed).withColumn("metadata", F.create_map().cast("map<string,string>")).select(*VECTOR_COLUMNS)

    def _embedded(self, payloads: DataFrame) -> dict[str, DataFrame]:
        if self.embed is None:
            return {}
        return {"vectors": search.upsert(self.store.load("vectors"), self._vectors(payloads), ["namespace", "id"])}

    def rebuild(self) -> int:
        """All stored documents ingested anew, from nothing; readers see the current version until all is done, and if it fails."""
        with self.tasks.task("rebuild"):
            work, documents = self._staged(), self.store.load("documents")
            work.store.commit({n: self.spark.createDataFrame([], s) for n, s in _emptied().items()}, "cleared")
            version = work._ingest(documents)
            self.store.publish(version)
            return version

    def inspect(self) -> DataFrame:
        """Each document's graph state, and what to do about it."""
        ws = self.tables()
        snaps = self.store.load("chunk_snapshots")
        keys = materialization.chunk_keys(snaps)
        merged = keys.groupBy("document_id").agg(
            F.count(F.lit(1)).alias("snapshots"), F.array_distinct(F.flatten(F.collect_list("expected_entities"))).alias("expected_entities"),
            F.array_distinct(F.flatten(F.collect_list("expected_relations"))).alias("expected_relations"), F.lit(None).cast("string").alias("last_status"),
        )
        return materialization.status(merged, materialization.actual_keys(ws.entities, ws.relations, ws.chunks))

    def materialize(self, documents: DataFrame | list[str] | None = None, chunk_ids: list[str] | None = None, mode: str = "AUTO") -> int:
        """The graph of kept extractions merged again from their snapshots: of all, of some documents, or of some chunks.

        What the chosen chunks gave to the graph goes first with mode REBUILD or REPAIR, so orphans go too; with others it is only added
        to.  Entities and relations that have other sources, or none, stay.  Journals note the mode and count versions up.
        """
        store, ws = self.store, self.tables()
        snaps = store.load("chunk_snapshots")
        if documents is not None:
            ids = documents.select("document_id") if isinstance(documents, DataFrame) else self.spark.createDataFrame([(d,) for d in documents], "document_id string")
            snaps = snaps.join(ids.distinct(), "document_id", "left_semi")
        if chunk_ids is not None:
            snaps = snaps.where(F.col("chunk_id").isin(chunk_ids))
        found = snaps.select("document_id", "chunk_id", "chunk_order", "entities", "relations")
        graphs = graph.assemble_documents(found).persist()
        entities, relations = ws.entities, ws.relations
        if mode in ("REBUILD", "REPAIR"):
            entities, relations = graph.without_chunks(entities, relations, found.select(F.col("chunk_id").alias("id")))
        entities = graph.upsert_entities(entities, _across_documents(graph.entities_of(graphs), F.col("document_id")))
        relations = graph.upsert_relations(relations, graph.fold_relations(graph.relations_of(graphs).drop("document_id")))
        journals = store.load("journals")
        past = journals.groupBy("chunk_id").agg(F.max("snapshot_version").alias("__past"))
        new = materialization.journals(materialization.chunk_keys(found), 1, mode, True).join(past, "chunk_id", "left")
        new = new.withColumn("snapshot_version", F.coalesce(F.col("__past") + 1, F.lit(1))).drop("__past").select(*journals.columns)
        try:
            return self._regraph(entities, relations, f"materialize {mode}", {"journals": search.upsert(journals, new, ["chunk_id"])})
        finally:
            graphs.unpersist()

    # tasks in the background

    def submit(self, name: str, step: Callable[[], object]) -> str:
        """A step in a thread of its own; its events are kept in the workspace when it ends.  The task's id."""

        def run() -> object:
            try:
                return step()
            finally:
                self.save_events()

        return self.runner.submit(name, run)

    def submit_ingest(self, documents: DataFrame, process_options: str = "") -> str:
        return self.submit("ingest", lambda: self.ingest(documents, process_options))

    def submit_rebuild(self) -> str:
        return self.submit("rebuild", self.rebuild)

    def submit_delete(self, document_id: str) -> str:
        return self.submit("delete document", lambda: self.delete_document(document_id))

    def submit_resume(self) -> str:
        return self.submit("resume", self.resume)

    def submit_materialize(self, documents: list[str] | None = None, chunk_ids: list[str] | None = None, mode: str = "AUTO") -> str:
        return self.submit("materialize", lambda: self.materialize(documents, chunk_ids, mode))

    def task(self, task_id: str) -> dict:
        return self.runner.poll(task_id)

    def cancel_task(self, task_id: str) -> None:
        self.runner.cancel(task_id)

    def save_events(self) -> int | None:
        """Events that are not stored yet, into task_events."""
        new = self.tasks.take()
        if not new:
            return None
        rows = self.spark.createDataFrame([tuple(e[k] for k in ("event_id", "task_id", "scope", "event_type", "occurred_at", "attributes")) for e in new], TASK_EVENT)
        return self.store.commit({"task_events": self.store.load("task_events").unionByName(rows)}, "events")

    def status(self) -> DataFrame:
        return self.store.load("document_status")

    def clear_cache(self) -> int:
        return self.store.commit({"llm_cache": self.store.load("llm_cache").limit(0)}, "clear cache")

    def engine(self) -> Engine:
        return Engine(self.tables(), self.embed, self.chat, reranker=self.reranker)

    def query(self, request: QueryRequest) -> Answer:
        return self.engine().query(request)

    def query_structured(self, request: QueryRequest) -> dict:
        return self.engine().query_structured(request)


def _emptied() -> dict[str, str]:
    from .sources.store import TABLES

    return {n: s for n, s in TABLES.items() if n not in ("documents", "llm_cache", "task_events")}


def _across_documents(entities: DataFrame, order) -> DataFrame:
    """One entity for each id of several documents' graphs, merged in the documents' order."""
    m = entities.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "name", "type", "description", "aliases", "source_chunk_ids"))).alias("m"))
    first = lambda c: F.coalesce(F.try_element_at(F.filter(F.transform("m", lambda x: x[c]), lambda v: v != ""), F.lit(1)), F.lit("")).alias(c)
    every = lambda c: F.array_distinct(F.flatten(F.transform("m", lambda x: x[c]))).alias(c)
    return m.select("id", F.col("m")[0]["name"].alias("name"), first("type"), first("description"), every("aliases"), every("source_chunk_ids"))
