"""Near copies: whole groups, all links, repeated ids."""

from corvane.llm import ngram_join
from tests.llm.test_neighbours import brute_sets, near_copies


def test_each_shingle_holds_a_class_once(spark, monkeypatch):
    """However many tasks hold a copy: an even number of them would cancel in a xor of classes."""
    seen = {}
    real = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, what: seen.setdefault(what, real(df, what)) if what == "tokens" else real(df, what))
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join([*words[:20], *"abcdefghij"])] * 8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4, "doc_id")
    ngram_join.near_duplicates(docs).collect()
    rows = [(r.token, r["class"]) for r in seen["tokens"].collect()]
    assert rows and len(rows) == len(set(rows))


def test_groups_of_classes_are_told_apart(spark):
    members = [(t, c, c) for t, own in {1: (10, 11), 2: (10, 11), 3: (12, 13), 4: (10, 11, 12), 5: (14,)}.items() for c in own]
    found = ngram_join._distinct_groups(spark.createDataFrame(members, "token long, class long, root long")).collect()
    assert sorted((r.token, r["size"]) for r in found) == [(1, 2), (3, 2), (4, 3)]


def test_every_link(spark):
    docs = near_copies(5, 90)
    sets = brute_sets(docs)
    first = {}
    for i, s in sorted(sets.items()):
        if s:
            first.setdefault(frozenset(s), i)
    want = set()
    for s, a in first.items():
        for t, b in first.items():
            if a < b and 100 * len(s & t) >= 75 * len(s | t):
                want.add((a, b))
    assert len(want) > len({x for pair in want for x in pair})  # more than join the components
    rows = ngram_join.near_links(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == len(want) and {(r.a, r.b) for r in rows} == want


def test_repeated_ids(spark):
    """Of a repeated doc_id only near copies go, and one row of each group stays."""
    base = [f"w{i}" for i in range(40)]
    near, other = " ".join(base), " ".join(f"v{i}" for i in range(40))
    docs = [(1, near, "a"), (1, near, "b"), (2, " ".join([*base[:-1], "x"]), "c"), (2, other, "d"), (3, "alone", "e"), (3, "apart", "f"), (4, "", "g"), (4, "", "h"), (None, near, "i")]
    rows = ngram_join.keep_first(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    kept = sorted(r.source for r in rows)
    assert kept in (list("adefghi"), list("bdefghi"))
