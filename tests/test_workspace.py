"""A workspace from ingest to deletion."""

import pytest
from pyspark.sql import functions as F

from corvane.api import Corvane
from corvane.operators.chunking.frames import ChunkOptions
from corvane.plans.retrieve import QueryRequest
from corvane.queries.graphs import answer
from corvane.sources import files, models
from corvane.sources.store import WorkspaceStore
from corvane.streaming.events import TaskLog, TaskRunner, document_stream, event_counts, ingest_stream

DOCS = [("d1", "One", "Alice works with Robert. They live in Paris.", {"region": "west"}), ("d2", "Two", "Robert reports to Carol in Berlin.", {"region": "east"})]
SCHEMA = "id string, title string, content string, metadata map<string,string>"


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("work")
    w = Corvane(spark, f"file://{root}", embed=models.hashing_embedder(64), chat=lambda q, s="", h=(): "fine", extract_chat=answer, chunking=ChunkOptions("F"))
    w.ingest(spark.createDataFrame(DOCS, SCHEMA))
    return w


def names(rows):
    return sorted(r.id for r in rows.select("id").collect())


def test_ingest_and_query(work):
    assert names(work.store.load("chunks")) == ["d1:0", "d2:0"] and "alice" in names(work.store.load("entities"))
    assert {r.status for r in work.inspect().collect()} == {"MERGED"} and {r.status for r in work.status().collect()} == {"PROCESSED"}
    got = work.query(QueryRequest("Carol Berlin", "NAIVE", chunk_top_k=1))
    assert [c["source_id"] for c in got.contexts] == ["d2:0"] and got.answer == "fine"
    assert work.query(QueryRequest("Alice Robert", "MIX", rerank=False)).contexts


def test_manage_and_restore(work, tmp_path):
    before = work.store.current()
    work.store.save_snapshot(f"file://{tmp_path}/snap")
    work.create_entity("Zoe", "person", aliases=["Z"])
    with pytest.raises(ValueError):
        work.create_entity("z")
    work.create_relation("Zoe", "Alice", "knows")
    with pytest.raises(ValueError):
        work.create_relation("Alice", "Zoe", "knows")
    work.edit_entity("Zoe", new_name="Zora")
    assert work.store.load("relations").where("tgt_id = 'zora' OR src_id = 'zora'").count() == 1
    work.merge_entities(["Zora"], "Alice")
    assert "zora" not in names(work.store.load("entities"))
    work.delete_relation("alice", "robert")
    work.delete_entity("Berlin")
    work.delete_document("d2")
    assert names(work.store.load("chunks")) == ["d1:0"]
    work.create_entity("Yan", "person")
    work.materialize()
    assert "yan" in names(work.store.load("entities"))  # hand-made ones stay
    assert work.rebuild() > before
    work.store.restore(before)
    assert names(work.store.load("chunks")) == ["d1:0", "d2:0"]
    work.store.load_snapshot(f"file://{tmp_path}/snap")
    assert names(work.store.load("documents")) == ["d1", "d2"]


def vectors_of(work, namespace):
    return {r.id: r.searchable_text for r in work.store.load("vectors").where(F.col("namespace") == namespace).collect()}


def test_vectors_follow_edits(spark, tmp_path):
    w = Corvane(spark, f"file://{tmp_path}", embed=models.hashing_embedder(16))
    for n in ("Ann", "Bo", "Cy"):
        w.create_entity(n, "person", aliases=[f"{n}x"])
    w.create_relation("Ann", "Bo", "knows")
    w.create_relation("Cy", "Bo", "sees", weight=0.2)
    with pytest.raises(ValueError, match="taken"):
        w.edit_entity("Ann", new_name="CYX")
    w.edit_entity("Ann", new_name="Dee", description="tall")
    w.update_relation("bo", "Dee", keywords="likes", weight=0.5)
    with pytest.raises(ValueError, match="not related"):
        w.update_relation("Dee", "Cy", weight=1.0)
    entities, relations = vectors_of(w, "entities"), vectors_of(w, "relations")
    assert set(entities) == {"dee", "bo", "cy"} and "tall" in entities["dee"] and set(relations) == {r.id for r in w.store.load("relations").collect()}
    assert any("likes" in t and "dee" in t for t in relations.values()) and not any("ann" in t for t in relations.values())
    assert {r.weight for r in w.store.load("relations").collect()} == {0.5, 0.2}
    w.merge_entities(["Cy"], "Dee")
    assert set(vectors_of(w, "entities")) == {"dee", "bo"} and set(vectors_of(w, "relations")) == {r.id for r in w.store.load("relations").collect()} and w.store.load("relations").count() == 1


def test_failures_and_resuming(spark, tmp_path):
    """A failed ingest leaves the tables, its documents FAILED; resume() takes them up; stored ids are refused."""
    broken = []

    def chat(prompt):
        if "Carol" in prompt and not (tmp_path / "mended").exists():
            raise RuntimeError("no answer")
        return answer(prompt)

    w = Corvane(spark, f"file://{tmp_path}/w", embed=models.hashing_embedder(16), extract_chat=chat, chunking=ChunkOptions("F"))
    docs = spark.createDataFrame(DOCS, SCHEMA)
    w.ingest(docs.where("id = 'd1'"))
    with pytest.raises(ValueError, match="stored"):
        w.ingest(docs)
    with pytest.raises(ValueError, match="twice"):
        w.ingest(docs.unionByName(docs))
    with pytest.raises(Exception, match="no answer"):
        w.ingest(docs.where("id = 'd2'"))
    assert {r.document_id: r.status for r in w.status().collect()} == {"d1": "PROCESSED", "d2": "FAILED"} and names(w.store.load("chunks")) == ["d1:0"]
    before = w.store.current()
    with pytest.raises(Exception, match="no answer"):
        w.rebuild()
    assert w.store.current() == before and names(w.store.load("chunks")) == ["d1:0"]
    (tmp_path / "mended").write_text("")
    assert w.resume() > before and {r.status for r in w.status().collect()} == {"PROCESSED"} and names(w.store.load("chunks")) == ["d1:0", "d2:0"]
    assert w.resume() is None
    longer = [("d1", "One", "Alice works with Robert. " * 200, {})]
    w.ingest(spark.createDataFrame(longer, SCHEMA), replace_stored=True)
    n = w.store.load("chunks").where("document_id = 'd1'").count()
    w.ingest(docs.where("id = 'd1'"), replace_stored=True)
    assert n > 1 and names(w.store.load("chunks")) == ["d1:0", "d2:0"] and not broken
    # the graph of one document is lost, and made again from its snapshots
    w.store.commit({"entities": w.store.load("entities").where("source_chunk_ids <> array('d2:0')")})
    assert {r.document_id: r.mode for r in w.inspect().collect()}["d2"] != "AUTO"
    w.materialize(["d2"], mode="REPAIR")
    assert {r.status for r in w.inspect().collect()} == {"MERGED"}
    journal = {r.chunk_id: (r.snapshot_version, r["mode"]) for r in w.store.load("journals").collect()}
    assert journal["d2:0"][0] > journal["d1:0"][0] and journal["d2:0"][1] == "REPAIR"
    w.materialize(chunk_ids=["d1:0"], mode="REBUILD")
    assert {r.status for r in w.inspect().collect()} == {"MERGED"}
    w.delete_entity("Carol")
    assert "carol" not in {e.name.lower() for r in w.store.load("chunk_snapshots").collect() for e in r.entities} and not any("carol" in r.expected_entities for r in w.store.load("journals").collect())
    task = w.submit_rebuild()
    assert w.runner.wait(task)["status"] == "SUCCEEDED" and w.store.load("task_events").where(F.col("task_id") == task).count() >= 1
    bad = w.submit("bad", lambda: 1 / 0)
    assert w.runner.wait(bad)["status"] == "FAILED" and w.task(bad)["message"]


def test_commits_that_fail_leave_no_trace(spark, tmp_path):
    s = WorkspaceStore(spark, f"file://{tmp_path}", "w")
    row = spark.createDataFrame([("a", "1")], "id string, value string")
    assert s.commit({"llm_cache": row}) == 1
    bad = row.select("id", F.raise_error(F.lit("lost")).cast("string").alias("value"))
    with pytest.raises(Exception, match="lost"):
        s.commit({"documents": spark.createDataFrame(DOCS, SCHEMA), "llm_cache": bad})
    assert s.current() == 1 and s.load("documents").count() == 0
    assert s.commit({"llm_cache": row.unionByName(row)}) == 2 and s.load("llm_cache").count() == 2
    staged = s.staged()
    staged.commit({"llm_cache": row.limit(0)})
    assert staged.load("llm_cache").count() == 0 and s.load("llm_cache").count() == 2 and s.current() == 2
    s.publish(staged.current())
    assert s.load("llm_cache").count() == 0
    s.restore(2)
    assert s.load("llm_cache").count() == 2
    with pytest.raises(ValueError):
        s.restore(99)


def test_readers_during_a_swap(spark, tmp_path):
    """Whatever the moment, a reader sees some whole version."""
    import threading

    s = WorkspaceStore(spark, f"file://{tmp_path}", "w")
    row = spark.createDataFrame([("a", "1")], "id string, value string")
    s.commit({"llm_cache": row})
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append(s.current())

    t = threading.Thread(target=read)
    t.start()
    for _ in range(3):
        s.commit({"llm_cache": row})
    s.restore(1)
    stop.set()
    t.join()
    assert None not in seen and seen[0] == 1


def test_versions_are_whole(spark, tmp_path):
    s = WorkspaceStore(spark, f"file://{tmp_path}", "w")
    assert s.current() is None and s.load("documents").count() == 0
    s.commit({"llm_cache": spark.createDataFrame([("a", "1")], "id string, value string")})
    s.commit({"documents": spark.createDataFrame(DOCS, SCHEMA)})
    assert s.versions() == [1, 2] and s.load("llm_cache").count() == 1 and s.load("documents", 1).count() == 0


def test_cache_asks_once(spark):
    asked = []
    requests = spark.createDataFrame([("x",), ("x",), ("y",)], "prompt string")
    cache = requests.where("prompt = 'y'").select(models.cache_id("extraction", F.col("prompt")).alias("id"), F.lit("known").alias("value"))
    done, fresh = models.generate_cached(requests, cache, lambda p: p.upper())
    assert sorted(r.response for r in done.collect()) == ["X", "X", "known"] and fresh.count() == 1 and not asked
    assert "".join(models.server_sent_pieces(iter(['data: {"choices":[{"delta":{"content":"a"}}]}', "", "data: [DONE]"]))) == "a"


def test_sources(spark, tmp_path):
    (tmp_path / "My Note.md").write_text("intro\n# Head\nbody")
    (tmp_path / "x.blocks.jsonl").write_text('{"type":"meta","title":"T","document_id":"X"}\n{"type":"content","text":"one"}\n\n{"type":"content","text":"two"}\n')
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    raw = files.read_sources(spark, str(tmp_path))
    assert [r.title for r in files.parse_plain(raw).collect()] == ["My Note.md"]
    side = files.parse_sidecars(files.sidecar_lines(raw)).first()
    assert (side.id, side.title, side.content) == ("X", "T", "one\n\ntwo")
    with pytest.raises(Exception, match="no parser"):
        files.parse_complex(raw, None).collect()
    assert files.parse_complex(raw, lambda n, m, b: ("t", b.decode())).first().content == "%PDF"
    doc = files.markdown_documents(spark, str(tmp_path / "My Note.md")).first()
    assert doc.title == "Head" and doc.id.endswith("note")


def test_tasks_and_stream(spark, tmp_path):
    log = TaskLog([lambda e: 1 / 0])
    with log.task("t"):
        pass
    assert {r.event_type for r in event_counts(log.table(spark)).collect()} == {"TASK_STARTED", "TASK_SUCCEEDED", "LISTENER_FAILED"}
    runner = TaskRunner(spark)
    done = runner.submit("count", lambda: spark.range(5).count())
    assert runner.wait(done)["result"] == 5
    assert runner.wait(runner.submit("bad", lambda: 1 / 0))["status"] == "FAILED"
    spark.createDataFrame(DOCS, SCHEMA).write.parquet(str(tmp_path / "in"))
    seen = []
    ingest_stream(document_stream(spark, str(tmp_path / "in")), lambda d: seen.extend(r.id for r in d.collect()), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(seen) == ["d1", "d2"]
