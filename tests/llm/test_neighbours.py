"""Nearest vectors, near copies, and the pipeline, against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import nearest, ngram_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_nearest(vectors, queries, k):
    out = {}
    for q, v in queries:
        near = sorted(((-float(np.dot(v, w)), i) for i, w in vectors if i != q))[:k]
        out[q] = [i for _, i in near]
    return out


def test_nearest(spark):
    g = np.random.default_rng(1)
    good = [(i, g.standard_normal(16).tolist()) for i in range(1500)]
    good[0] = (0, [4 * x for x in good[0][1]])
    good += [(5000 + i, good[0][1]) for i in range(30)]  # copies tie
    bad = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [None] * 16), (9004, [1.0] * 3), (None, [1.0] * 16), (9005, [float("inf")] + [1.0] * 15)]
    table = spark.createDataFrame([(i, v, 7) for i, v in good + bad], "vec_id long, embedding array<double>, score int")
    queries = [x for x in good if x[0] % 20 == 0]
    got = defaultdict(list)
    for r in nearest.nearest(table, table.where("vec_id % 20 = 0"), 10, shards=2).orderBy("query_id", "rank").collect():
        assert abs(r.score - np.dot(dict(good)[r.query_id], dict(good)[r.vec_id])) < 1e-9 and r.query_id != r.vec_id
        got[r.query_id].append(r.vec_id)
    want = brute_nearest(good, queries, 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (10 * len(want)) >= 0.9
    assert got[0] == [5000 + i for i in range(10)]
    assert nearest.nearest(table.limit(0), table, 5).count() == 0 and nearest.nearest(table, table.limit(0), 5).count() == 0


def recall(spark, rows, shards, exact=False, k=20):
    """Recall over all queries, against brute force."""
    table = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in nearest.nearest(table, table.where("vec_id % 20 = 0"), k, shards=shards, exact=exact).collect():
        got[r.query_id].add(r.vec_id)
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = (m * m[q]).sum(axis=1)
        s[q] = -np.inf
        hits.append(len(got[int(ids[q])] & set(ids[np.lexsort((ids, -s))[:k]].tolist())))
    return sum(hits) / (k * len(hits))


def test_recall_of_all_queries(spark):
    """Random directions, and clusters: sizes at which windows matter, in one shard and in several."""
    g = np.random.default_rng(5)
    flat = g.standard_normal((3000, 48))
    spread = np.repeat(g.standard_normal((60, 48)) * 2, 50, axis=0) + g.standard_normal((3000, 48)) * 0.4
    for rows in (flat, spread):
        assert all(recall(spark, list(enumerate(rows)), shards) >= 0.95 for shards in (1, 3))
    assert recall(spark, list(enumerate(flat[:600])), 2, exact=True) == 1


def test_repeated_vectors(spark):
    """A vec_id takes one rank, whatever its rows; large components do not overflow."""
    rows = [(i, [float(i), 1.0, 0.0]) for i in range(30)] + [(20, [20.0, 1.0, 0.0]), (29, [29.0, 1.0, 0.0]), (29, [30.0, 5.0, 0.0])] * 2
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.nearest(table, table.where("vec_id % 20 = 0"), 5, shards=2).orderBy("query_id", "rank").collect()]
    assert [g[2] for g in got if g[0] == 20] == [29, 28, 27, 26, 25] and [g[:2] for g in got if g[0] == 0] == [(0, n) for n in range(1, 6)]
    assert got[5][3] == 20.0 * 29 + 1  # of two vectors of an id the lesser
    huge = spark.createDataFrame([(i, [(i + 1) * 1e200, -1e200]) for i in range(25)], "vec_id long, embedding array<double>")
    assert nearest.nearest(huge, huge.where("vec_id = 20"), 3).count() == 3


def test_few_candidates(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    rows = nearest.nearest(v, v.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in rows] == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]


def brute_sets(docs):
    out = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    return out


def brute_components(sets, percent=75):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for n, a in enumerate(names):
        for b in names[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def near_copies(seed, n=220):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(50))
    bases = [[r.choice(vocabulary) for _ in range(r.choice([6, 30, 80, 200]))] for _ in range(12)]
    docs = []
    for i in range(n):
        words = list(r.choice(bases)) if r.random() < 0.7 else [r.choice(vocabulary) for _ in range(r.choice([1, 4, 5, 60]))]
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            words[r.randrange(len(words))] = r.choice(vocabulary).upper()
        text = "\t".join(words) if i % 7 == 0 else " ".join(words)
        docs.append((i, text + (" \n" + passage if r.random() < 0.3 else "")))
    return docs + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "ONE  two"), (n + 5, "é É"), (n + 6, "é é")]


@pytest.mark.parametrize("chunk", [1 << 22, 900])
def test_near_duplicates(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "HEAVY", 1000 if chunk > 1000 else 20)
    monkeypatch.setattr(ngram_join, "MEMBERS", 2000 if chunk > 1000 else 15)
    monkeypatch.setattr(ngram_join, "FEW_EDGES", 1 << 20 if chunk > 1000 else 3)
    docs = near_copies(chunk)
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs] + [(None, "one two", "x", 1)], "doc_id long, text string, class string, token int")
    sets = brute_sets(docs)
    want = brute_components(sets)
    rows = ngram_join.near_duplicates(table).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == len(docs) + 1 and got.pop(None) == (1, None)
    assert got == {i: (len(sets[i]), want[i]) for i, _ in docs}
    kept = ngram_join.keep_first(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {*want.values(), None}


def test_no_documents(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_joined_sets_against_all_pairs():
    for seed in range(25):
        r = np.random.default_rng(seed)
        bases = [r.integers(1, 1 << 63, 40, dtype=np.uint64) for _ in range(3)]
        sets = []
        for _ in range(40):
            s = bases[r.integers(3)].copy()
            for _ in range(r.integers(0, 9)):
                s[r.integers(len(s))] = r.integers(1, 1 << 63, dtype=np.uint64) if r.random() < 0.5 else bases[0][r.integers(40)]
            sets.append(np.unique(s[: r.integers(20, 41)]))
        find = {i: i for i in range(len(sets))}

        def root(x, find=find):
            while find[x] != x:
                x = find[x]
            return x

        for i, j in ngram_join.join_sets(sets):
            common = len(np.intersect1d(sets[i], sets[j]))
            assert 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common)
            find[max(root(i), root(j))] = min(root(i), root(j))
        want = brute_components({i: set(s.tolist()) for i, s in enumerate(sets)})
        assert {i: root(i) for i in find} == want


def test_trie_finds_every_link():
    r = random.Random(3)
    trie, sets = ngram_join.Trie(), []
    for name in range(150):
        s = tuple(sorted(r.sample(range(14), r.randint(1, 12))))
        sets.append(s)
        trie.insert(s, len(s), name)
    for s in sets:
        want = [n for n, o in enumerate(sets) if 100 * len({*s} & {*o}) >= 75 * len({*s} | {*o})]
        assert sorted(trie.search(s, len(s))) == want


def test_word_hashes_ignore_the_text_around():
    a, n = ngram_join.word_hashes(pa.array(["x Hello\tworld ", None, "hello", " \n", "world HELLO é"]))
    assert n.tolist() == [3, 0, 1, 0, 3] and a[1] == a[3] == a[5] and a[2] == a[4] and len(set(a.tolist())) == 4


@pytest.mark.parametrize("piece", [1, 3, 7, 64])
def test_words_cut_by_pieces(monkeypatch, piece):
    """Long texts and words in pieces give the same hashes."""
    r = random.Random(piece)
    texts = [None, "", " ", "a", "word " * 9, "x" * 100, " lead", "é" * 20 + "\tß"] + ["".join(r.choice("ab \n") for _ in range(r.randint(0, 90))) for _ in range(60)]
    want = ngram_join.word_hashes(pa.array(texts))
    ngram_join._all_powers.cache_clear()
    monkeypatch.setattr(ngram_join, "PIECE", piece)
    got = ngram_join.word_hashes(pa.array(texts))
    ngram_join._all_powers.cache_clear()
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_other_words_and_similarities(spark):
    docs = near_copies(7, 80)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = set() if not w else {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}
    want = brute_components(sets, 50)
    rows = ngram_join.near_duplicates(table, 3, 50).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(sets[i]), want[i]) for i, _ in docs}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from corvane.llm import language_id
    from corvane.llm.common import tokenizer_path
    from tests.llm.test_text_stages import LINE, brute_lines, said

    texts = [said("en", i % 25) + f"\n{LINE}\n" + said("en", 100 + i % 25, 8) for i in range(60)] + [said("de", i % 9) + f"\n{LINE}" for i in range(20)] + ["123 456", None, "", "q"]
    docs = [(i, t, "en" if i < 60 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    told = [(i, t) for i, t, *_ in docs if i < 80]  # the rest has no letter, or one that both languages share
    lines = {i: x[2] for i, x in brute_lines(told).items()}
    first = brute_components(brute_sets(list(lines.items())))
    kept = {i: t for i, t in lines.items() if first[i] == i}
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.length
    assert got == {i: len(code.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "best_fit_packing"] and language_id.UNDETERMINED == "und"
