"""Operators on small tables."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.hashing import fnv1a, string_hash
from corvane.operators import extraction, graph, ranking, search
from corvane.operators.chunking import frames, texts, windows
from corvane.operators.filters import Condition, build_plan, filter_rows, repair_ocr, to_column
from corvane.plans import paths, retrieve
from corvane.plans.engine import Engine, resolve_keywords
from corvane.plans.retrieve import QueryRequest, Workspace
from corvane.schemas import CHUNK, ENTITY, EXTRACTION, RELATION


@pytest.fixture(scope="module")
def people(spark):
    """Three people, two edges."""
    m = lambda r, s: {"region": r, "score": s}
    chunks = spark.createDataFrame([("chunk-1", "doc-1", "Ida maps reefs with Tom", 4, 0, m("north", "71")), ("chunk-2", "doc-1", "Tom pilots for Ida", 4, 1, m("south", "64")), ("chunk-3", "doc-2", "Tom writes to Uma", 4, 0, m("north", "90"))], CHUNK)
    entities = spark.createDataFrame([("ida", "Ida", "person", "Diver", [], ["chunk-1"]), ("tom", "Tom", "person", "Skipper", ["Thomas"], ["chunk-2", "chunk-3"]), ("uma", "Uma", "person", "Editor", [], ["chunk-3"])], ENTITY)
    relations = spark.createDataFrame([("rel-1", "ida", "tom", "maps_with", "", 0.8, ["chunk-1", "chunk-2"], []), ("rel-2", "tom", "uma", "writes_to", "", 0.6, ["chunk-3"], [])], RELATION)
    v = [("chunks", "chunk-1", [1.0, 0.0]), ("chunks", "chunk-2", [0.8, 0.2]), ("chunks", "chunk-3", [0.0, 1.0]), ("entities", "ida", [1.0, 0.0]), ("entities", "tom", [0.5, 0.4]), ("entities", "uma", [0.0, 1.0]), ("relations", "rel-1", [1.0, 0.0]), ("relations", "rel-2", [0.0, 1.0])]
    vectors = spark.createDataFrame([(*x, "", []) for x in v], "namespace string, id string, vector array<double>, searchable_text string, keywords array<string>")
    return Workspace(chunks, entities, relations, vectors)


def ids(rows):
    return [r.id for r in rows.orderBy(F.desc("score"), "id").collect()]


def test_local(people):
    found = retrieve.local(people, QueryRequest("q", "LOCAL", top_k=1, chunk_top_k=2), [1.0, 0.0])
    assert ids(found.entities) == ["ida", "tom"] and ids(found.relations) == ["rel-1"] and ids(found.chunks) == ["chunk-1", "chunk-2"]


def test_naive_filters_what_it_found(people):
    request = QueryRequest("q", "NAIVE", chunk_top_k=2, filters={"region": "north"})
    assert ids(retrieve.naive(people, request, [1.0, 0.0])) == ["chunk-1"]


def test_mix_asks_for_more(spark):
    names = [("chunk-1", "north"), ("chunk-2", "south"), ("chunk-3", "south"), ("chunk-4", "north")]
    chunks = spark.createDataFrame([(c, "d", c, 1, i, {"region": r}) for i, (c, r) in enumerate(names)], CHUNK)
    vectors = spark.createDataFrame([("chunks", c, [s], "", []) for c, s in (("chunk-1", 0.95), ("chunk-2", 0.94), ("chunk-3", 0.93), ("chunk-4", 0.92))], "namespace string, id string, vector array<double>, searchable_text string, keywords array<string>")
    ws = Workspace(chunks, spark.createDataFrame([], ENTITY), spark.createDataFrame([], RELATION), vectors)
    found = retrieve.mix(ws, QueryRequest("q", chunk_top_k=2, filters={"region": "north"}), [1.0])
    assert ids(found.chunks) == ["chunk-1", "chunk-4"]


def test_seed_scores_against_the_loop():
    for trial in range(300):
        r = random.Random(trial)
        n = r.randint(1, 8)
        seeds = sorted(((f"s{i}", round(r.random(), 3)) for i in range(n)), key=lambda x: (-x[1], x[0]))
        pairs = {tuple(sorted(r.sample([s for s, _ in seeds], 2))) for _ in range(r.randint(0, 10))} if n > 1 else set()
        score = dict(seeds)
        for name, _ in seeds:
            for a, b in pairs:
                if name in (a, b):
                    score[a], score[b] = max(score[a], score[name]), max(score[b], score[name])
        eff = retrieve.seed_scores(seeds, pairs)
        got = {s: max([eff[s], *(eff[b if a == s else a] for a, b in pairs if s in (a, b))]) for s, _ in seeds}
        assert got == score


def test_keyword_and_hybrid_scores(spark):
    """A point for each asked word in the text and one for each among the keywords; hybrid adds the inner product."""
    s = "namespace string, id string, vector array<double>, searchable_text string, keywords array<string>"
    rows = [("n", "tide", [0.5, 0.5], "Tables of spring tides and moon phases", ["tide", "moon"]), ("n", "loam", [0.0, 2.0], "Loam holds water", ["soil"]), ("other", "moon", [9.0, 9.0], "moon tide", ["moon", "tide"])]
    v = spark.createDataFrame(rows, s)
    found = lambda specs: [(r.key, r.id, r.score) for r in search.batch_search(v, specs).orderBy("key", "rank").collect()]
    words = search.SearchSpec("w", "n", [], "moon tide", ["moon", "tide"], 2)
    both = search.SearchSpec("h", "n", [0.0, 3.0], "water", ["moon"], 1)
    assert found([words]) == [("w", "tide", 4.0), ("w", "loam", 0.0)]
    assert found([words, both]) == [("h", "loam", 7.0), *found([words])]
    assert found(search.spec_table(spark, [words, both])) == found([words, both]) and found([]) == []
    assert [(r.id, r.score) for r in search.search(v, both).collect()] == [("loam", 7.0)]


def test_searches_in_blocks(spark, monkeypatch):
    s = "namespace string, id string, vector array<double>, searchable_text string, keywords array<string>"
    v = spark.createDataFrame([("n", f"v{i:02}", [float(i), 1.0], "", []) for i in range(40)], s)
    specs = [search.SearchSpec(f"q{i}", "n", [1.0 if i % 2 else -1.0, 0.0], k=i % 4) for i in range(7)]
    want = sorted((r.key, r.id, r.rank) for r in search.batch_search(v, specs).collect())
    assert len(want) == sum(i % 4 for i in range(7))
    monkeypatch.setattr(search, "BLOCK", 2)
    for given in (specs, search.spec_table(spark, specs)):
        assert sorted((r.key, r.id, r.rank) for r in search.batch_search(v, given).collect()) == want


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_vectors_stay_where_they_are(spark, tmp_path):
    """The searches are broadcast, the namespace reaches the scan, each task sends the largest k only."""
    spark.range(10).selectExpr("concat('n', id % 2) AS namespace", "string(id) AS id", "array(double(id)) AS vector", "'' AS searchable_text", "array('') AS keywords").write.parquet(str(tmp_path / "v"))
    v = spark.read.parquet(str(tmp_path / "v"))
    plan = plan_of(search.batch_search(v, [search.SearchSpec("a", "n0", [1.0], k=2), search.SearchSpec("b", "n1", [1.0], k=3)]))
    assert "WindowGroupLimit" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1 and "In(namespace" in plan
    plan = plan_of(search.batch_search(v, search.spec_table(spark, [search.SearchSpec("a", "n0", [1.0], k=2)])))
    assert "WindowGroupLimit" in plan and "Exchange hashpartitioning(namespace" not in plan and "BroadcastExchange" in plan
    plan = plan_of(search.search(v, search.SearchSpec("a", "n0", [1.0], k=2)))
    assert "TakeOrderedAndProject" in plan and "hashpartitioning" not in plan and "EqualTo(namespace,n0)" in plan


def test_budgets_keep_few_rows(spark):
    """No more rows than a budget can hold reach the one task that adds up."""
    rows = spark.range(50).selectExpr("string(id) AS id", "'a b' AS name", "double(id) AS score")
    assert "TakeOrderedAndProject" in plan_of(ranking.limit_entities(rows, 40)) or "GlobalLimit" in plan_of(ranking.limit_entities(rows, 40))
    assert [r.id for r in ranking.limit_entities(rows, 22).orderBy("score").collect()] == ["47", "48", "49"]
    chunks = spark.createDataFrame([("a", "", 0, 9.0), ("b", "x y", 2, 8.0), ("c", "", 0, 7.0), ("d", "p q r", 0, 6.0), ("e", "", 0, 5.0), ("f", "z", 1, 4.0)], "id string, text string, token_count int, score double")
    for tokens, held in ((2, "abc"), (4, "abc"), (5, "abcde"), (6, "abcdef"), (1, "a"), (0, "")):
        assert sorted(r.id for r in ranking.limit_chunks(chunks, tokens).collect()) == list(held), tokens


def test_dimension_mismatch_is_an_error(spark):
    v = spark.createDataFrame([("a", [1.0, 2.0])], "id string, vector array<double>")
    with pytest.raises(Exception, match="dimension"):
        search.semantic_search(v, [1.0], 1).collect()
    assert search.semantic_search(v, [1.0, 0.0], 0).count() == 0


@pytest.mark.parametrize(
    ("equals", "conditions", "metadata", "held"),
    [
        ({"region": ["east", "west"]}, [Condition("status", "EQ", "active"), Condition("category", "IN", ["a", "b"])], {"region": "west", "status": "active", "category": "b"}, True),
        ({}, [Condition("score", "GTE", 80), Condition("rank", "LT", 10)], {"score": "88.5", "rank": "9"}, True),
        ({}, [Condition("p", "AFTER", "2024-01-01"), Condition("u", "BEFORE", "2024-06-01T00:00:00Z")], {"p": "2024-01-02", "u": "2024-05-20T12:00:00"}, True),
        ({}, [Condition("p", "AFTER", "2024-01-01")], {"p": "1704153600001"}, True),
        ({}, [Condition("p", "AFTER", "2024-01-01")], {"p": "2024"}, False),
        ({}, [Condition("score", "GT", 1)], {"score": "many"}, False),
        ({}, [Condition("score", "GT", 1)], {}, False),
        ({"x": "1"}, [], None, False),
        ({}, [], None, True),
    ],
)
def test_filters(spark, equals, conditions, metadata, held):
    rows = spark.createDataFrame([(metadata,)], "metadata map<string,string>")
    assert (filter_rows(rows, build_plan(equals, conditions)).count() == 1) == held


@pytest.mark.parametrize("bad", [Condition("a b", "EQ", "x"), Condition("a", "EQ", ["x"]), Condition("a", "IN", "x"), Condition("a", "IN", []), Condition("a", "GT", "x"), Condition("a", "BEFORE", "soon"), Condition("a", "LIKE", "x")])
def test_bad_filters(bad):
    with pytest.raises(ValueError):
        build_plan(conditions=[bad])


def test_pushed_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", "x", 5, 1.5), ("b", " x", 7, 2.5), ("c", None, 9, 3.5)], "id string, lang string, n int, price double").write.parquet(str(tmp_path / "t"))
    t, none = spark.read.parquet(str(tmp_path / "t")), F.create_map().cast("map<string,string>")
    columns = {"lang": F.col("lang"), "n": F.col("n"), "price": F.col("price")}
    plan = build_plan({"lang": ["x", "y"]}, [Condition("n", "GTE", 5), Condition("price", "LT", "2")])
    rows = t.where(to_column(plan, none, columns, native=True))
    assert [r.id for r in rows.collect()] == ["a"]
    pushed = rows._jdf.queryExecution().executedPlan().toString().split("PushedFilters:")[-1].split("ReadSchema")[0]
    assert "In(lang, [x,y])" in pushed and "GreaterThanOrEqual(n,5" in pushed and "LessThan(price,2.0)" in pushed
    assert sorted(r.id for r in t.where(to_column(build_plan({"lang": "x"}), none, columns)).collect()) == ["a", "b"]  # without native, texts are stripped


def _graph(spark, rows):
    return spark.createDataFrame([("d", f"chunk-{i}", i, [(n, t, d, a) for n, t, d, a in e], [tuple(r) for r in rs]) for i, (e, rs) in enumerate(rows, 1)], EXTRACTION)


def test_assembly_merges_names_and_aliases(spark):
    e = graph.assemble_entities(_graph(spark, [([(" Alice ", "", "Researcher", [])], []), ([("alice", "", "Scientist", [])], [])])).collect()
    assert [(r.id, r.name.strip(), r.description, r.source_chunk_ids) for r in e] == [("alice", "Alice", "Researcher", ["chunk-1", "chunk-2"])]
    e = graph.assemble_entities(_graph(spark, [([("Robert", "", "Lead", ["Bob"])], []), ([("Bob", "", "Other", ["Bobby"])], [])])).collect()
    assert [(r.id, r.aliases, r.description) for r in e] == [("robert", ["Bob", "Bobby"], "Lead")]


def test_assembly_of_relations(spark):
    x = _graph(spark, [([], [("Alice", "Bob", "works_with", "first", 0.7)]), ([], [("Bob", "Alice", "works-with", "second", 0.9)])])
    r = graph.assemble_relations(x).collect()
    assert [(v.src_id, v.tgt_id, v.keywords, v.description, v.weight, v.source_chunk_ids) for v in r] == [("alice", "bob", "works_with", "first", 0.9, ["chunk-1", "chunk-2"])]
    loops = _graph(spark, [([], [(" Alice ", "alice", "k", "", 0.5), ("Alice", "Bob", "k", "", 0.8)])])
    assert [(v.src_id, v.weight) for v in graph.assemble_relations(loops).collect()] == [("alice", 0.8)]


def test_assembly_guard(spark):
    x = _graph(spark, [([("提取申请", "", "", ["提取类型"]), ("提取类型", "", "", [])], [("提取申请", "提取类型", "k", "", 1.0)])])
    e = {r.id: r.aliases for r in graph.assemble_entities(x).collect()}
    assert e == {"提取申请": [], "提取类型": []} and graph.assemble_relations(x).count() == 1


def test_merge_relations_agrees_with_assembly(spark):
    r = random.Random(5)
    rows = [([], [(f"n{r.randint(0, 5)}", f"N{r.randint(0, 5)} ", r.choice(["a b", "A-b,c", "z"]), r.choice(["", "x", "y"]), r.random()) for _ in range(3)]) for _ in range(12)]
    x = _graph(spark, rows)
    want = {(v.src_id, v.tgt_id): (v.keywords, v.description, v.weight, v.source_chunk_ids) for v in graph.assemble_relations(x).collect()}
    m = x.select("chunk_id", "chunk_order", F.posexplode("relations").alias("p", "r")).select(F.struct("chunk_order", "p").alias("pos"), "chunk_id", F.col("r.source").alias("src"), F.col("r.target").alias("tgt"), F.col("r.keywords").alias("keywords"), F.col("r.description").alias("description"), F.col("r.weight").alias("weight"))
    got = {(v.src_id, v.tgt_id): (v.keywords, v.description, v.weight, v.source_chunk_ids) for v in graph.merge_relations(m).collect()}
    assert got == want


def test_paths(spark):
    rel = [("r1", "atlas", "graphstore", "depends_on", "", 1.0, ["chunk-1"], []), ("r2", "graphstore", "team", "owned_by", "", 1.0, ["chunk-2"], [])]
    relations = spark.createDataFrame(rel, RELATION)
    found = paths.expand(relations, spark.createDataFrame([("atlas", 1)], "id string, rank int"), 2)
    assert [(r.entity_ids, r.chunk_ids) for r in found.orderBy("order").collect()] == [(["atlas", "graphstore"], ["chunk-1"]), (["atlas", "graphstore", "team"], ["chunk-1", "chunk-2"])]
    e = spark.createDataFrame([("atlas", "Atlas", 0.95), ("graphstore", "GraphStore", 0.70)], "id string, name string, score double")
    scored = relations.join(spark.createDataFrame([("r1", 0.88), ("r2", 0.84)], "id string, score double"), "id")
    assert paths.score(found, e, scored, "who owns what Atlas uses").where("rank = 1").first().hops == 2


def test_paths_against_a_walk(spark):
    for seed in range(4):
        r = random.Random(seed)
        pairs = sorted({tuple(sorted(r.sample("abcdefgh", 2))) for _ in range(14)})
        names = [f"r{i:02d}" for i in range(len(pairs))]
        r.shuffle(names)
        edges = {n: p for n, p in zip(names, pairs)}
        want: dict = {}

        def walk(path, depth, edges=edges, want=want):
            if depth:
                n = 0
                for name in sorted(edges):
                    if path[-1] in edges[name] and n < 5:
                        other = edges[name][0] if edges[name][1] == path[-1] else edges[name][1]
                        if other not in path:
                            want.setdefault((*path, other), None)
                            n += 1
                            walk((*path, other), depth - 1)

        for s in "ab":
            walk((s,), 3)
        relations = spark.createDataFrame([(n, a, b, "", "", 1.0, [], []) for n, (a, b) in edges.items()], RELATION)
        got = paths.expand(relations, spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int"), 3).orderBy("order").collect()
        assert [tuple(x.entity_ids) for x in got] == list(want)


def test_chunk_texts():
    assert texts.window_texts("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"] == texts.recursive("abcdefghij", 4, 1, ["\n", ""])
    assert texts.window_texts("abcdefghijk", 5, 2) == ["abcde", "defgh", "ghijk"]
    topic = lambda s: [[1, 0] if "Cat" in t or "Kit" in t else [0, 1] for t in s]
    assert texts.semantic("Cats sleep. Kittens play. Revenue rises. Profit grows.", 200, topic, "percentile", 50, 0) == ["Cats sleep. Kittens play.", "Revenue rises. Profit grows."]
    assert texts.semantic("abcdefghijkl", 4, lambda s: [[1, 0]] * len(s)) == ["abcd", "efgh", "ijkl"]
    assert texts.by_rules("A1\nx\nA2\ny", [r"^A\d"]) == (["A1\nx", "A2\ny"], None)
    assert texts.by_rules("intro\n# One heading\nbody", ["^#"]) == (["intro", "# One heading\nbody"], None)  # one match is enough
    assert texts.by_rules("# a " + "x" * 40 + "\n# b", ["^#"], 10, 0) == (["# a " + "x" * 40, "# b"], None)  # parts stay whole
    assert texts.by_rules("none at all", ["^#"], 6, 0) == (["none a", "t all"], texts.NO_BOUNDARIES) and texts.by_rules("x", []) == (["x"], texts.NO_RULES)
    assert texts.by_rules("# only at the start", ["^#"]) == (["# only at the start"], texts.NO_BOUNDARIES) and texts.by_rules("", ["^#"]) == ([], None)


def test_fixed_windows_in_sql_and_python(spark):
    samples = ["", " ", "abc", "x" * 10, "a b" * 30, "é😀" * 25 + " "]
    docs = spark.createDataFrame([(str(i), s) for i, s in enumerate(samples)], "id string, content string")
    got: dict = {}
    for r in windows.fixed_windows(docs, 10, 3).orderBy("document_id", "chunk_order").collect():
        got.setdefault(int(r.document_id), []).append(r.text)
    assert got == {i: w for i, s in enumerate(samples) if (w := texts.window_texts(s, 10, 3))}


def test_structure_lists_tables_and_children():
    text = "# One\nLead:\n- a\n- b\n\n## Two\n| h |\n| - |\n| 1 |\n| 2 |\n\nplain words"
    b = texts.structure("T", text)
    assert [(x.kind, x.section) for x in b] == [("LIST", "One"), ("TABLE", "One > Two"), ("PARAGRAPH", "One > Two")] and b[0].text.startswith("Lead:")
    assert texts.table_parts("| h |\n| - |\n| 1 |\n| 2 |", 17) == ["| h |\n| - |\n| 1 |", "| h |\n| - |\n| 2 |"]
    assert texts.children("figure 1: x", "") == [] and texts.children("One. Two. Three.", "", 10, 0) == ["One. Two.", "Three."]
    assert texts.summary("First. Second.", "A > B") == "A > B | First."
    qa = [texts.Block("1", "PARAGRAPH", "s", "Q: why"), texts.Block("2", "PARAGRAPH", "s", "A: so")]
    assert [x.text for x in texts.pair_questions(qa)] == ["Q: why\nA: so"]
    mixed = texts.split_mixed(texts.Block("1", "PARAGRAPH", "s", "before\nimages/a.png\nfigure 1: a\nafter"))
    assert [x.kind for x in mixed] == ["PARAGRAPH", "IMAGE", "CAPTION", "PARAGRAPH"] and mixed[2].metadata["image"] == "images/a.png"


def test_adaptive_sizes_agree(spark):
    cases = [(k, h, n, a) for k in ("GENERIC", "LAW") for h in (True, False) for n in (1, 4, 8) for a in (20, 55, 80)]
    rows = spark.createDataFrame(cases, "kind string, heading boolean, n int, a int")
    for r in rows.withColumn("s", windows.sizing(800, 1200, 100, F.col("kind"), F.col("heading"), F.col("n"), F.col("a"))).collect():
        s = texts.adapt(texts.Sizing(800, 1200, 100), r.kind, r.heading, r.n, r.a)
        assert (r.s.target, r.s.most, r.s.overlap) == (s.target, s.most, s.overlap)


def test_process_options():
    o = frames.ProcessOptions.parse("it!R")
    assert o.images and o.tables and not o.graph and o.strategy == "RECURSIVE"
    for bad in ("FR", "x"):
        with pytest.raises(ValueError):
            frames.ProcessOptions.parse(bad)


def test_extraction_answers():
    fenced = 'Sure.\n```json\n{"entities": [{"name": " A ", "aliases": ["B", ""]}], "relations": [{"source": "A", "target": "B", "keywords": "k", "confidence": "7"}]}\n```'
    e, r = extraction.parse_extraction(fenced)
    assert e[0]["name"] == "A" and e[0]["aliases"] == ["B"] and r[0]["weight"] == 1.0
    assert extraction.json_object('x {"a": "}{"} y') == {"a": "}{"}
    with pytest.raises(ValueError):
        extraction.json_object("nothing")


def test_parents_sum_and_captions(spark):
    m = ranking
    rows = [("p", "d", "whole", 2, 0, {}), ("p#1", "d", "a", 1, 0, {m.PARENT: "p"}), ("p#2", "d", "b", 1, 1, {m.PARENT: "p"}), ("q", "d", "lost", 1, 2, {m.PARENT: "gone"})]
    c = spark.createDataFrame(rows, CHUNK)
    got = m.expand_parents(c.where("id <> 'p'").withColumn("score", F.lit(0.5)), c, 5)
    assert [(r.id, r.score, r.text) for r in got.orderBy(F.desc("score")).collect()] == [("p", 1.0, "whole"), ("q", 0.5, "lost")]


def test_delete_document_cascades(people):
    left = graph.delete_document(people.chunks, people.entities, people.relations, people.vectors, "doc-2")
    assert sorted(r.id for r in left["entities"].collect()) == ["ida", "tom"] and [r.id for r in left["relations"].collect()] == ["rel-1"]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(tx.strip(F.lit("　 a   "))) == "a " and one(tx.token_count(F.lit("  a  b "))) == 2 and one(tx.token_count(F.lit("  "))) == 0
    assert one(tx.canonical_keywords(F.lit(" B c,a--b ,,B_c"))) == "a_b, b_c" and one(tx.merged_csv(F.lit("a, b"), F.lit("b,c"))) == "a,b,c"
    assert one(tx.relation_id(F.lit("b"), F.lit("a"))) == "rel-" + __import__("hashlib").md5(b"ab").hexdigest()
    assert one(repair_ocr(F.lit("5 \\% and 7  % exam-\nple"))) == "5% and 7% example"
    assert string_hash("hello") == 99162322 and fnv1a("a") == 0xE40C292C & 0x7FFFFFFF


def test_keywords_and_engine(people):
    assert resolve_keywords(QueryRequest("图数据库", "MIX"), None).ll_keywords == ["图数据库"]
    assert resolve_keywords(QueryRequest("what is it", "GLOBAL"), lambda p: "no json").hl_keywords == ["what is it"]
    asked = resolve_keywords(QueryRequest("long question here", "HYBRID"), lambda p: '{"high_level_keywords": ["H"], "low_level_keywords": []}')
    assert list(asked.hl_keywords) == list(asked.ll_keywords) == ["H"]
    engine = Engine(people, lambda t: [[1.0, 0.0]] * len(t), lambda q, s="", h=(): "answer", reranker=lambda q, c: [(i, 1.0) for i, _ in reversed(c)])
    got = engine.query(QueryRequest("who is ida", "LOCAL", top_k=1, chunk_top_k=2, include_references=True))
    assert got.answer == "answer" and [c["source_id"] for c in got.contexts] == ["chunk-3", "chunk-2"]
    assert got.references == [{"reference_id": "1", "source": "doc-2"}, {"reference_id": "2", "source": "doc-1"}]  # twice as many were reranked
    assert engine.query(QueryRequest("x", "NAIVE", only_context=True)).answer.startswith("Entities:\n(none)")
    assert list(engine.query(QueryRequest("x", "BYPASS", stream=True)).stream) == ["answer"]
    with pytest.raises(ValueError):
        engine.query_structured(QueryRequest("x", stream=True))


def test_rerank_drops_and_keeps(spark):
    c = spark.createDataFrame([Row(id=i, position=n) for n, i in enumerate("abcd", 1)])
    r = spark.createDataFrame([("c", 0, 0.9), ("a", 1, 0.2)], "id string, pos int, score double")
    order = lambda d: [x.id for x in d.orderBy("reranked").collect()]
    assert order(ranking.reranked(c, r, 4)) == ["c", "a", "b", "d"] and order(ranking.reranked(c, r, 4, 0.5)) == ["c"]


def test_refinement_fills_a_gap(spark):
    chunks = spark.createDataFrame([("d:0", "d", "网关通过", 4, 0, {}), ("d:1", "d", "缓存 serves", 4, 1, {}), ("e:0", "e", "done.", 5, 0, {})], CHUNK)
    ent = lambda *n: [(x, "", "", []) for x in n]
    found = spark.createDataFrame([("d", "d:0", 0, ent("网关", "缓存"), []), ("d", "d:1", 1, ent("缓存"), []), ("e", "e:0", 0, ent("x", "y"), [])], EXTRACTION)
    joined = found.join(chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id")
    asked = extraction.refinement_windows(joined).collect()
    assert [(r.chunk_id, r.chunk_ids) for r in asked] == [("d:0", ["d:0", "d:1"])]
    items = spark.createDataFrame([("d", ["d:0", "d:1"], [0, 7], "网关", "缓存", "uses", "", 0.4), ("d", ["d:0", "d:1"], [], "缓存", "Serves", "k", "", 1.0)], "document_id string, chunk_ids array<string>, indexes array<int>, source string, target string, keywords string, description string, weight double")
    given = extraction.attribute(items, chunks)
    assert sorted((r.chunk_id, r.source) for r in given.collect()) == [("d:0", "网关"), ("d:1", "缓存")]
    done = {r.chunk_id: r for r in extraction.with_patches(found, given).collect()}
    assert [r.target for r in done["d:0"].relations] == ["缓存"] and [e.name for e in done["d:1"].entities] == ["缓存", "Serves"] and not done["e:0"].relations


def test_own_chunker_and_embedder(spark):
    from corvane.sources.models import embed_column

    docs = spark.createDataFrame([("d", "t", "a b", {})], "id string, title string, content string, metadata map<string,string>")
    assert [r.text for r in frames.chunk_with(docs, lambda i, t, c, m: c.split()).orderBy("chunk_order").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="another number of vectors"):
        embed_column(docs, "content", lambda t: []).collect()


def test_resuming(spark):
    from corvane.operators.materialization import chunk_status, resume_action

    s = spark.createDataFrame([("a", "PROCESSED", "PARTIAL", 2), ("b", "PROCESSED", "MERGED", 2), ("c", "FAILED", "MISSING", 0)], "document_id string, status string, graph_status string, snapshots int")
    assert {r.document_id: r.action for r in resume_action(s).collect()} == {"a": "MATERIALIZE", "b": "NONE", "c": "INGEST"}
    e = spark.createDataFrame([("c1", "SUCCEEDED", ["x", "y"], ["r"], None), ("c2", "SUCCEEDED", ["x"], [], None), ("c3", "FAILED", ["z"], [], None), ("c4", "SUCCEEDED", ["z"], [], None)], "chunk_id string, extract_status string, expected_entities array<string>, expected_relations array<string>, last_status string")
    nodes = spark.createDataFrame([("x", ["c1", "c2"])], "id string, source_chunk_ids array<string>")
    got = {r.chunk_id: (r.status, r.action) for r in chunk_status(e, nodes, nodes.limit(0)).collect()}
    assert got == {"c1": ("PARTIAL", "REPAIR"), "c2": ("MATERIALIZED", "NONE"), "c3": ("FAILED", "RESUME"), "c4": ("MISSING", "RESUME")}


def test_multi_hop_answers(people):
    from corvane.plans.engine import events_of

    vectors = {"what does ida reach through tom": [1.0, 0.0]}
    engine = Engine(people, lambda t: [vectors.get(x, [1.0, 0.0]) for x in t], lambda q, s="", h=(): "draft" if "steps of reasoning" in s else "final")
    request = QueryRequest("what does ida reach through tom", ll_keywords=["ida"], hl_keywords=["maps"], include_references=True)
    got = engine.query(request)
    assert got.answer == "final" and {c["source_id"] for c in got.contexts} >= {"chunk-1", "chunk-3"}
    text = engine.query(retrieve.replace(request, only_context=True)).answer
    assert text.startswith("Reasoning Path 1") and "Hop 1: Ida -> Tom | keywords: maps_with" in text and "Evidence [chunk-1]" in text
    assert [e["event"] for e in events_of(got, "q")][0] == "meta" and [e["event"] for e in events_of(got, "q")][-1] == "complete"


def test_sparse_search_prefers_rare_words(spark):
    docs = spark.createDataFrame([(1, "the graph store"), (2, "the the the"), (3, "图数据库 store")], "id int, text string")
    d, q = search.sparse_vectors(docs, text="text"), search.sparse_vectors(spark.createDataFrame([(9, "graph 数据")], "id int, text string"), text="text")
    ranked = search.sparse_search(d, q, 5)
    assert sorted(r.id for r in ranked.collect()) == [1, 3]
    fused = search.fuse_ranks([ranked.select("key", "id", "rank")] * 2, 1).first()
    assert abs(fused.score - 2 / 61) < 1e-12


def test_tables_in_parts():
    """Parts of any kind of table repeat its header and lose no row."""
    rows = [f"row {i} " + "x" * 9 for i in range(9)]
    markdown = "| a |\n|---|\n" + "\n".join(f"| {r} |" for r in rows)
    html = "<table class='t'>\n<tr><th>a</th></tr>" + "".join(f"<tr><td>{r}</td></tr>" for r in rows) + "</table>"
    lists, objects = json.dumps([["a"], *([r] for r in rows)]), json.dumps([{"a": r} for r in rows])
    for text, size, head in ((markdown, 70, "| a |\n|---|"), (html, 110, "<table class='t'><tr><th>a</th></tr>"), (lists, 60, '[["a"]'), (objects, 60, "[{")):
        parts = texts.table_parts(text, size)
        assert len(parts) > 2 and all(len(p) <= size and p.startswith(head) for p in parts)
        assert [r for p in parts for r in rows if r in p] == rows
    assert json.loads(texts.table_parts(lists, 60)[-1])[0] == ["a"] and texts.table_parts(html, 40) == [html]
    assert texts.table_parts("[no json", 5) == ["[no json"] and texts.table_parts("plain", 2) == ["plain"]
    blocks = [texts.Block("b0", "PARAGRAPH", "s", "Before."), texts.Block("b1", "TABLE", "s", html)]
    roles = [d.metadata.get("table_role") for d in texts.paragraphs(blocks, 110, 0, 0)]
    assert roles[:2] == [None, "first"] and roles[-1] == "last" and set(roles[2:-1]) == {"middle"}


def test_text_hash(spark):
    from corvane.functions.hashing import text_hash

    said = ["", "a", "order 7", "äß", "\U0001f600x", None]
    rows = spark.createDataFrame([(s,) for s in said], "t string").select("t", text_hash("t").alias("h")).collect()
    assert {r.t: r.h for r in rows} == {s: format(string_hash(s or "") & 0xFFFFFFFF, "x") for s in said}


def test_parents_and_captions_are_fetched_by_id(spark, tmp_path):
    """Only chunks that are asked for meet the matched ones: the chunk table is not shuffled for a few rows."""
    rows = [("p", "d", "parent text", 2, 0, {}), ("c1", "d", "one", 1, 1, {ranking.PARENT: "p"}), ("c2", "d", "two", 1, 2, {ranking.PARENT: "p"}), ("c3", "d", "lost", 1, 3, {ranking.PARENT: "gone"})]
    spark.createDataFrame(rows, CHUNK).write.parquet(str(tmp_path / "c"))
    chunks = spark.read.parquet(str(tmp_path / "c"))
    matched = chunks.where("id <> 'p'").withColumn("score", F.col("chunk_order").cast("double"))
    got = [(r.id, r.text, r.score) for r in ranking.expand_parents(matched, chunks, 5).orderBy("id").collect()]
    assert got == [("c3", "lost", 3.0), ("p", "parent text", 3.0)]
    few = matched.orderBy(F.desc("score"), "id").limit(2)
    assert sorted(r.id for r in ranking.expand_parents(few, chunks, 5).collect()) == ["c3", "p"]


def test_terms_of_equal_ids_are_apart(spark):
    """Two words of the same 31-bit id are two terms."""
    from corvane.functions.hashing import fnv1a

    seen, i = {}, 0
    while (other := seen.setdefault(fnv1a(f"w{i}"), f"w{i}")) == f"w{i}":
        i += 1
    v = search.sparse_vectors(spark.createDataFrame([(1, f"w{i} {other}"), (2, other)], "id int, text string"), text="text")
    assert sorted(v.where("id = 1").first().terms) == sorted([f"w{i}", other]) and v.where("id = 1").first().weights == [1.0, 1.0]
    asked = search.sparse_vectors(spark.createDataFrame([(9, f"w{i}")], "id int, text string"), text="text")
    assert [r.id for r in search.sparse_search(v, asked, 5).collect()] == [1]


def test_searches_shuffle_no_documents(spark):
    """Tasks send k rows for each query; equal scores go to smaller ids, and vectors of another length come last."""
    docs = spark.createDataFrame([(i, "red fox" if i % 2 else "red") for i in range(400)], "id int, text string").repartition(4)
    asked = spark.createDataFrame([(q, "fox") for q in range(3)], "id int, text string")
    found = search.sparse_search(search.sparse_vectors(docs, text="text"), search.sparse_vectors(asked, text="text"), 2)
    assert sorted((r.key, r["rank"], r.id) for r in found.collect()) == [(q, n, i) for q in range(3) for n, i in ((1, 1), (2, 3))]
    vectors = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(20)] + [(20, [1.0])], "id int, vector array<double>").repartition(4)
    near = search.dense_search(vectors, vectors.where("id < 3"), 3)
    assert [(r.id, round(r.score, 6)) for r in near.where("key = 1").orderBy("rank").collect()] == [(1, 1.0), (3, 1.0), (5, 1.0)]
    last = search.dense_search(vectors, vectors.where("id = 0"), 30).where("rank = 21").first()
    assert (last.id, last.score) == (20, None)
    for rows in (found, near):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan


def test_few_chunks_are_taken_off_where_rows_are(spark):
    """Rows are filtered, not taken apart and joined; nulls and empty lists stay, and more chunks than fit into a filter give the same."""
    rows = [("a", ["1", "2"]), ("b", ["1"]), ("c", []), ("d", None), ("e", ["3", "1", "4"])]
    e = spark.createDataFrame(rows, "id string, source_chunk_ids array<string>")
    r = spark.createDataFrame([("r", "a", "e", ["1", "9"]), ("s", "a", "b", ["9"])], "id string, src_id string, tgt_id string, source_chunk_ids array<string>")
    lost = spark.createDataFrame([("1",), (None,)], "id string")
    nodes, edges = graph.without_chunks(e, r, lost)
    assert "Join" not in nodes._jdf.queryExecution().optimizedPlan().toString()
    want = {"a": ["2"], "c": [], "d": None, "e": ["3", "4"]}, {"r": ["9"]}
    assert ({x.id: x.source_chunk_ids for x in nodes.collect()}, {x.id: x.source_chunk_ids for x in edges.collect()}) == want
    most, graph.LITERALS = graph.LITERALS, 0
    try:
        nodes, edges = graph.without_chunks(e, r, lost)
        assert ({x.id: x.source_chunk_ids for x in nodes.collect()}, {x.id: x.source_chunk_ids for x in edges.collect()}) == want
    finally:
        graph.LITERALS = most


def test_assembly_runs_through_documents(spark):
    """A task's documents go through one Arrow stream, each with its own chunks in order."""
    rows = [(d, f"{d}-{i}", i, [("A", f"{d}{i}", "", [])], [("A", "B", "k", "", float(i))]) for i in (2, 0, 1) for d in ("x", "y", None)]
    found = graph.assemble_documents(spark.createDataFrame(rows, EXTRACTION).coalesce(1))
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.document_id: (r.entities[0].type, r.entities[0].source_chunk_ids, r.relations[0].weight) for r in found.collect()}
    assert got == {d: (f"{d}0", [f"{d}-{i}" for i in range(3)], 2.0) for d in ("x", "y", None)}
