"""Queries that cover whole tables, against brute force on small ones."""

import os
from collections import defaultdict

import pytest

from corvane.queries import QUERIES

LINES = [(1, 1, 10), (1, 1, 11), (1, 1, 11), (2, 1, 11), (2, 2, 12)]  # part, supplier, order


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("star")
    tables = {
        "nation": ([(0, 0)], "n_nationkey long, n_regionkey long"), "customer": ([(5, 0)], "c_custkey long, c_nationkey long"),
        "supplier": ([(1, 0), (2, 0)], "s_suppkey long, s_nationkey long"), "lineitem": (LINES, "l_partkey long, l_suppkey long, l_orderkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{home}/{name}.parquet")
    return str(home)


def all_relations():
    """(src, tgt): keywords, weight and orders."""
    orders, found = defaultdict(list), {("nation-0", "region-0"): ("located_in", 1, set()), ("customer-5", "nation-0"): ("located_in", 1, set())}
    for s in (1, 2):
        found["nation-0", f"supplier-{s}"] = ("located_in", 1, set())
    for p, s, o in LINES:
        orders[f"part-{p}", f"supplier-{s}"].append(o)
    return found | {ends: ("supplied_by", len(o), set(o)) for ends, o in orders.items()}


def test_all_relations(spark, star):
    want = all_relations()
    rows = QUERIES["p10_structured_relations"](spark, star).collect()
    assert sorted((r.src_id, r.tgt_id, r.keywords, r.weight, r.n_chunks) for r in rows) == sorted((*ends, k, w, len(o)) for ends, (k, w, o) in want.items())
    ends = {r.id: (r.src_id, r.tgt_id) for r in rows}
    merged = QUERIES["a6_upserted_relations"](spark, star).collect()
    assert sorted((*ends[r.id], r.keywords, r.weight, r.n_chunks) for r in merged) == sorted((*e, k, w + 1, len(o) + 1) for e, (k, w, o) in want.items())
    texts = QUERIES["g14_embedding_texts"](spark, star).collect()
    assert sorted((*ends[r.id], r.text) for r in texts) == sorted((a, b, f"{a}\n{k}\n{b}\n") for (a, b), (k, _, _) in want.items())


def test_distances_of_all_labels(spark, tmp_path):
    import numpy as np

    g = np.random.default_rng(5)
    data = [(i, g.standard_normal(4).tolist(), i % 3) for i in range(14)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = {}
    for label in range(3):
        own = [(i, np.array(v, np.float32).astype(float)) for i, v, x in data if x == label]
        far = [1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b) for (_, a), (_, b) in zip(own, own[1:])]
        for (i, _), d, slope in zip(own, far, np.gradient(far)):
            want[label, i] = (d, slope)
    rows = QUERIES["w7_distances_and_gradient"](spark, str(tmp_path)).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert np.allclose((r.distance, r.gradient), want[r.label, r.vec_id], atol=2e-6)


def test_ocr_repair_of_all_documents(spark, tmp_path):
    spark.createDataFrame([(1, "an exam-\nple, 7  %"), (2, None), (3, "plain")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n for r in QUERIES["c19_ocr_repair"](spark, str(tmp_path)).collect()}
    assert got == {1: len("an example, 7% an example, 5% more"), 2: None, 3: len("plain an example, 5% more")}


PASSAGES = {0: "red fox", 1: "green tea pot", 2: "blue"}
TEXTS = {0: "red fox runs", 1: "green tea", 2: "red tea pot", 3: "snow", 4: "ice and snow", 5: "fox fox tea"}


def test_sparse_and_dense(spark, tmp_path):
    import math
    from collections import Counter

    import numpy as np

    g = np.random.default_rng(9)
    held = {i: g.standard_normal(4).astype(np.float32) for i in [0, 1, 3, 4, 5, 8]}  # documents 0 to 5 but 2; passages 0 and 1
    tables = {
        "benchmark": (list(PASSAGES.items()), "item_id long, text string"), "documents": (list(TEXTS.items()), "doc_id long, text string"),
        "embeddings": ([(i, v.tolist()) for i, v in held.items()], "vec_id long, embedding array<float>"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    terms = {i: Counter(t.split()) for i, t in TEXTS.items()}
    df = Counter(w for t in terms.values() for w in t)
    weight = lambda n: 1 + math.log(n)
    idf = lambda w: math.log(1 + (len(TEXTS) - df[w] + 0.5) / (df[w] + 0.5))
    sparse, dense = defaultdict(dict), defaultdict(dict)
    for q, text in PASSAGES.items():
        for i, own in terms.items():
            if hits := [weight(n) * weight(own[w]) * idf(w) for w, n in Counter(text.split()).items() if w in own]:
                sparse[q][i] = sum(hits)
            if i in held and q in held:
                a, b = held[q].astype(float), held[i].astype(float)
                dense[q][i] = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    ranks = lambda d: {i: 1 / (60 + n) for n, i in enumerate(sorted(d, key=lambda i: (-d[i], i)), 1)}
    by_rank, by_score = {}, {}
    for q in PASSAGES:
        for i in TEXTS:
            if i in sparse[q] or i in dense[q]:
                by_rank[q, i] = ranks(sparse[q]).get(i, 0) + ranks(dense[q]).get(i, 0)
                by_score[q, i] = (sparse[q].get(i, 0) + dense[q].get(i, 0)) / 2
    for name, want in (("v7_sparse_and_dense_fused", by_rank), ("v7_weighted_scores", by_score)):
        got = {(r.item_id, r.doc_id): r.score for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == pytest.approx(want, abs=2e-6)
    assert any(i not in sparse[q] for q, i in by_rank)  # found by vectors alone


def test_filters_by_id_reach_the_scans(spark):
    """What is known of a few ids comes from filtered scans, of which nothing is kept."""
    from pyspark.sql import functions as F

    from corvane.plans import retrieve
    from corvane.queries import base

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    ws = base.workspace(spark, "/root/testdata/sf0.001")
    assert not ws.entities.is_cached and not ws.relations.is_cached
    ends = ws.entities.where(F.col("id").isin("part-1", "supplier-2")), retrieve._near(ws, {"part-1": 1.0, "part-2": 0.5})[1]
    for rows, scans in zip(ends, (8, 4)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == scans and plan.count("DataFilters: []") == 0
    assert retrieve.local(ws, retrieve.QueryRequest("x", mode="LOCAL", max_entity_tokens=60), base.asked_vector(spark, "/root/testdata/sf0.001")).entities.count() > 0


def test_chunks_go_out_in_bounded_parts():
    """However many documents a batch holds, few rows are Python objects at once."""
    import pyarrow as pa

    from corvane.operators.chunking import frames

    rows = [(str(i), "d", "x" * 5000, None if i % 2 else 5, i, {"k": "v"} if i % 2 else {}) for i in range(5000)]
    parts = list(frames.parts_of(iter(rows)))
    assert max(p.num_rows for p in parts) <= 401 and sum(p.num_rows for p in parts) == len(rows)
    assert [(r.id, r.token_count, dict(r.metadata)) for r in frames.slices(iter(parts))] == [(r[0], r[3], r[5]) for r in rows]
    assert max(len(p) for p in frames.parts_of(("a", "d", "", 0, 0, {}) for _ in range(9000))) == frames.ROWS and isinstance(parts[0], pa.RecordBatch)


def test_children_of_documents_in_one_task(spark):
    """Children count on within a document and begin anew in the next; documents share an Arrow stream."""
    from corvane.operators.chunking import frames

    rows = [(f"{d}:{i}", d, f"{d} {i} " + "word " * 30, 150, i, {}) for i in (1, 0) for d in ("b", "a")]
    found = frames.parents_and_children(spark.createDataFrame(rows, "id string, document_id string, text string, token_count int, chunk_order int, metadata map<string,string>").coalesce(1), 60, 5)
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
    for d in "ab":
        kids = [r for r in found.where(f"document_id = '{d}' AND id LIKE '%#child:%'").collect()]
        assert [r.chunk_order for r in kids] == list(range(len(kids))) and len(kids) > 4 and kids[0].id == f"{d}:0#child:0"


def test_strip_takes_off_white_space_of_unicode(spark):
    """By a set of characters: no regular expression looks at every place of a text."""
    from corvane.functions.text import strip

    odd = "\t\x0b\x1c\u2003\u3000 "
    rows = spark.createDataFrame([(odd + "a\u00a0 b" + odd,), (odd,), ("\u2007x\u00a0",), (None,)], "t string").select(strip("t").alias("s"))
    assert [r.s for r in rows.collect()] == ["a\u00a0 b", "", "\u2007x\u00a0", None]
    assert "regexp" not in rows._jdf.queryExecution().optimizedPlan().toString()
