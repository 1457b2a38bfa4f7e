"""Fingerprints, line dedup, languages, chats and token counts on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import chat_format, fingerprint, language_id, line_dedup, token_counts
from corvane.llm.common import tokenizer_path

LINE = "This line is long enough to count."


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioubcdfgstrnlm") for _ in range(r.randint(2, 9))) for _ in range(n))


# --- fingerprints -------------------------------------------------------------------------------------


def test_fingerprints_tell_edits_from_others(spark):
    texts = [prose(i) for i in range(30)] + [None, "", "short", prose(99, 4000), prose(15)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    rows = sorted(fingerprint.compare_with_edits(docs).collect(), key=lambda r: -r.doc_id)
    order = [t or "" for t in reversed(texts)]
    assert [r.doc_id for r in rows] == list(range(len(texts) - 1, -1, -1))
    for k, r in enumerate(rows):
        own, after = order[k], order[(k + 1) % len(order)]
        assert r.n_chars == len(own) and r.edited_sha256 == sha(fingerprint.edited(own, after)) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if 400 < len(own) and 400 < len(after):
            assert r.near_edited > 0.3 > r.near_next
    prints = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    assert prints[15] == prints[34] and prints == {r.doc_id: r.fingerprint for r in rows} and prints[30] == prints[31]
    assert len(fingerprint.from_string(prints[33])) > 2048 // 8
    assert fingerprint.compare_with_edits(docs.limit(0)).count() == 0 and fingerprint.compare_with_edits(docs.limit(1)).count() == 1


def brute_digest(text):
    """Features one window at a time, straight from the definitions."""
    W, clog = fingerprint.WINDOW, lambda c: round((1 << 16) * c * math.log2(c))
    data = text.ljust(W, b"\0")
    keys = []
    for i in range(len(data) - W + 1):
        held = Counter(data[i : i + W])
        entropy = 1 - sum(clog(c) for c in held.values() if c > 1) / ((1 << 16) * W * math.log2(W))
        keys.append((int(fingerprint.RANKS[min(fingerprint.LEVELS, max(0, int(np.rint(fingerprint.LEVELS * entropy))))]), i))
    best = [min(keys[i : i + W])[1] for i in range(len(keys))]
    places = [i for i, n in sorted(Counter(best).items()) if n >= fingerprint.POPULAR and keys[i][0] <= fingerprint.LEVELS]
    small = fingerprint.SMALL <= len(text) < fingerprint.SHORT
    if not small:
        places = places or [best[0]]
    found = [(data[i : i + W], 0) for i in places]
    if small:
        found += [(text[i : i + fingerprint.SMALL], fingerprint.SMALL) for i in range(len(text) - fingerprint.SMALL + 1)]
    mask, out = (1 << 64) - 1, []
    for n, (piece, h) in enumerate(found):
        step = 8 if len(piece) % 8 == 0 else 4
        for k in range(len(piece) // step):
            h ^= (int.from_bytes(piece[step * k : step * k + step], "little") * 0x9E3779B97F4A7C15 + k) & mask
            for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                h = (h ^ h >> 33) * by & mask
            h ^= h >> 33
        if n % fingerprint.FILTER_FEATURES == 0:
            out.append(bytearray(fingerprint.FILTER_BITS // 8))
        for k in range(fingerprint.FEATURE_BITS):
            bit = h >> 11 * k & fingerprint.FILTER_BITS - 1
            out[-1][bit // 8] |= 128 >> bit % 8
    return b"".join(map(bytes, out))


def test_digests_against_windows_one_by_one(monkeypatch):
    r = random.Random(4)
    texts = [b"", b"a", b"abc", b"abcd", b"x" * 50, b"ab" * 40, prose(1).encode(), prose(2, 900).encode(), "äöü ß €".encode() * 9]
    texts += [bytes(r.choice(b"aab c") for _ in range(n)) for n in (15, 16, 17, 31, 32, 127, 128, 300)] + [bytes(r.randrange(256) for _ in range(700))]
    want = [brute_digest(t) for t in texts]
    assert fingerprint.digest(texts) == want
    monkeypatch.setattr(fingerprint, "SHORT", 30)
    want = [brute_digest(t) for t in texts]
    for piece in (40, 64, 1000):  # long texts in pieces are the same
        monkeypatch.setattr(fingerprint, "PIECE", piece)
        assert fingerprint.digest(texts) == want


def test_short_texts_are_compared():
    a, b = fingerprint.digest([b"Tion was thanonon.", b"Tion was Raas con,"])
    c, d = fingerprint.digest([b"Licensed under it", prose(3, 500).encode()])
    assert fingerprint.likeness(a, b) > 0.3 > max(fingerprint.likeness(a, c), fingerprint.likeness(a, d))


# --- line dedup -----------------------------------------------------------------------------------------


def brute_rows(docs):
    """The kept text of each row."""
    return [brute_lines(docs, only=(i, t))[i][2] for i, t in docs]


def brute_lines(docs, min_chars=20, min_docs=3, only=None):
    blanks = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held: dict = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None:
                held.setdefault(x.strip(blanks).translate(lower), set()).add(i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = {}
    for i, t in docs if only is None else [only]:
        kept = [x for x in (t or "").split("\n") if i is None or gone.get(x.strip(blanks).translate(lower), i) == i]
        out[i] = ((t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(kept), "\n".join(kept))
    return out


def test_line_dedup(spark):
    r = random.Random(2)
    pool = [LINE, LINE.upper() + "\t", "  " + LINE, "É" + LINE, "é" + LINE, "short", "", "x" * 19, "y" * 20, "y" * 20 + "\xa0", "unique one here, long"]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 9)))) for i in range(40)] + [(40, None), (41, ""), (42, "\n\n"), (43, (LINE + "\n") * 500), (None, LINE)]
    table = spark.createDataFrame([(i, t, 1, "a") for i, t in docs], "doc_id long, text string, h1 int, kept string")
    rows = line_dedup.apply_bitmaps(table, line_dedup.keep_bitmaps(table)).collect()
    assert {r.doc_id: (r["__n_lines"], r["__n_dropped"], r["__kept_text"]) for r in rows} == brute_lines(docs)
    stage = line_dedup.dedup_lines(table)
    assert stage.columns == table.columns and stage.count() == len(docs) and stage.where("doc_id = 40 AND text IS NULL").count() == 1
    assert line_dedup.keep_bitmaps(table.limit(0)).count() == 0


def test_line_dedup_runs_no_python(spark):
    docs = spark.createDataFrame([(1, LINE)], "doc_id long, text string")
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup_streams_over_its_ranges(spark):
    """First occurrences come from the sorted ranges: one exchange, one sort, a window."""
    docs = spark.createDataFrame([(1, LINE)], "doc_id long, text string")
    plan = line_dedup._ranged_lines(docs, 20, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and plan.count("Window [") == 1 and "rangepartitioning" in plan


def test_a_line_over_many_ranges(spark):
    """A line that nearly every document holds is split over ranges; repeated rows count once."""
    docs = [(i % 300, f"{LINE}\nown line of number {i % 300}, once more\n{LINE}") for i in range(600)] + [(1000, f"own line of number 7, once more\n{LINE}"), (7, "another text of a repeated id\n" + LINE)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = {}
    for (i, t), kept in zip(docs, brute_rows(docs)):
        want[(i, t)] = kept
    rows = line_dedup.apply_bitmaps(table, line_dedup.keep_bitmaps(table)).collect()
    assert len(rows) == len(docs) and {(r.doc_id, r.text): r["__kept_text"] for r in rows} == want


def test_bitmaps_are_runs(spark):
    docs = [(i, f"{LINE}\na{i}\nb{i}\n{LINE}\nc{i}") for i in range(3)]
    rows = line_dedup.keep_bitmaps(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_dropped, [tuple(k) for k in r.kept]) for r in rows} == {i: (2, [(1, 2), (4, 1)]) for i in (0, 1)}


# --- languages --------------------------------------------------------------------------------------------

SYLLABLES = {"en": "th er ing and tion ed".split(), "de": "sch ung der ein keit ü".split(), "fr": "eau que é ment ou la".split()}


def said(lang, seed, n=40):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_languages_held_out(spark):
    docs = [(i, said(lang, i), lang) for i in range(300) for lang in (list(SYLLABLES)[i % 3],)] + [(900, None, "en"), (901, "12 ! 34", "de"), (902, "", "fr"), (903, said("en", 1), None)]
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string, score string")
    rows = language_id.identify(table, language_id.learn_from(table)).withColumn("held_out", language_id.held_out()).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if r.doc_id < 300:
            assert r.lang_pred == r.lang
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id >= 900} == {900: "und", 901: "und", 902: "und", 903: "en"}
    mixed = spark.createDataFrame([(1, said("en", 5)[:60] + " " + said("de", 6)[:60])], "doc_id long, text string")
    assert language_id.identify(mixed, language_id.learn_from(table)).first().score < 1


def brute_language(learnt, text):
    """Language, score and ambiguity by dictionaries of n-grams, a naive Bayes for each bit, and logistic losses."""
    fold = bytes(32 if 33 <= b < 127 and not chr(b).isalpha() else b + 32 if 65 <= b <= 90 else b for b in range(256))

    def grams(t, n):
        t = t.encode().translate(fold)
        for i in range(len(t) - n + 1):
            code = int.from_bytes(t[i : i + n], "little") * 2654435761 % 2**32
            yield (code ^ code >> 15) * 2246822519 % 2**32 >> 17

    langs = sorted({x for _, x in learnt})
    share = {}
    for n in language_id.ORDERS:
        for lang in langs:
            c = Counter(g for t, x in learnt if x == lang for g in grams(t, n))
            total = sum(c.values()) + 0.5 * language_id.BUCKETS
            share[n, lang] = lambda g, c=c, total=total: (c[g] + 0.5) / total
    codes = language_id.codewords(len(langs))
    margins = []
    for j in range(codes.shape[1]):
        sides = [[x for k, x in enumerate(langs) if codes[k, j] == side] for side in (1, -1)]
        seen = sum(math.log(np.mean([share[n, x](g) for x in sides[0]]) / np.mean([share[n, x](g) for x in sides[1]])) for n in language_id.ORDERS for g in grams(text, n)) if all(sides) else 0
        margins.append(seen / len(language_id.ORDERS) / math.sqrt(max(1, len(text.encode()))))
    losses = [sum(math.log1p(math.exp(-m * c)) for m, c in zip(margins, row)) for row in codes]
    near = [math.exp(min(losses) - x) for x in losses]
    score = max(near) / sum(near)
    return langs[losses.index(min(losses))], score, score < language_id.AMBIGUOUS


def test_languages_against_dictionaries(spark, monkeypatch):
    learnt = [(said(x, i, 12), x) for x in SYLLABLES for i in range(6)]
    model = language_id.learn(spark.createDataFrame(learnt, "text string, lang string"))
    texts = [said("en", 77, 9), said("de", 78, 9), said("fr", 79, 2), "zz", "q", "é", said("en", 5, 3) + " " + said("fr", 6, 3)]
    want = [brute_language(learnt, t) for t in texts]
    assert any(w[2] for w in want) and not all(w[2] for w in want)
    for size in (1 << 20, 16):  # long texts in pieces are the same
        monkeypatch.setattr(language_id, "SLICE_BYTES", size)
        langs, score, unsure = model.predict(pa.array(texts))
        assert langs == [w[0] for w in want] and np.allclose(score, [w[1] for w in want], atol=1e-4) and unsure.tolist() == [w[2] for w in want]


def test_rejected_languages(spark):
    """The prediction decides, and columns of clashing names stay as they are."""
    docs = [(i, said(x, i), x, f"own {i}") for i in range(60) for x in (list(SYLLABLES)[i % 3],)] + [(100, "q", None, "a"), (101, None, None, "b"), (102, "12 34", None, "c"), (None, said("en", 3), None, "d")]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, score string")
    model = language_id.learn_from(table)
    kept = language_id.keep_told(table, model)
    assert kept.columns == table.columns and {r.score for r in kept.collect()} == {f"own {i}" for i in range(60)} | {"d"}
    assert {r.score for r in language_id.keep_told(table, model, ["de"]).collect()} == {f"own {i}" for i in range(1, 60, 3)}
    assert language_id.keep_told(table.limit(0), model).count() == 0


def test_repeated_and_many_languages(spark, monkeypatch):
    rows = [(1, said("en", 1), "en")] * 3 + [(2, said("de", 1), "de")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.identify(table, language_id.learn(table)).collect()] == ["en"] * 3 + ["de"]
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language_id.learn(table)


def test_unlabelled_documents(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert language_id.identify(docs, language_id.learn_from(docs)).first().lang_pred == "und"
    assert language_id.identify(docs.limit(0), language_id.learn_from(docs)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 4, 5, 30])
def test_codewords_are_far_apart(n):
    c = language_id.codewords(n)
    assert len(c) == n and all((a != b).sum() == (c.shape[1] + 1) // 2 for i, a in enumerate(c) for b in c[:i])


# --- chats --------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    r = random.Random(6)
    odd = ["<turn:user>", "</turn>", "&lt;", "&amp;lt;", "\\### Assistant: </turn> ok", "", "plain", "é\n"]
    turns = [(c, t, r.choice(["user", "assistant", "system", "a<b"]), r.choice(odd + [None]), 1) for c in range(30) for t in range(r.randint(1, 7))]
    turns += [(50, 0, "user", "only", 1), (51, None, None, None, 1), (None, 0, "user", "x", 1), (None, 1, "assistant", "y", 1), (52, 1, "assistant", "same", 1), (52, 1, "assistant", "same", 1)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, prompt int")
    examples = chat_format.format_conversations(table)
    got = {x.conv_id: x for x in chat_format.digest(examples).collect()}
    held: dict = {}
    for c, t, role, text, _ in turns:
        held.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(held)
    for c, own in held.items():
        own.sort()
        loss = "".join(x for _, role, x in own if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), sha("".join(f"{role}\n{x}\n" for _, role, x in own)), len(loss), sha(loss))
    parts = examples.where("conv_id = 52").orderBy("example").collect()
    assert [p.n_context for p in parts] == [0, 1] and parts[1].prompt == "<turn:assistant>same</turn><turn:assistant>" and parts[1].target == "same"
    assert chat_format.digest(chat_format.format_conversations(table.limit(0))).count() == 0
    plan = chat_format.digest(examples)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- token counts -------------------------------------------------------------------------------------------


def brute_count(word, scores, least):
    best = [(0.0, 0)] + [(-float("inf"), 0)] * len(word)
    for j in range(1, len(word) + 1):
        options = [(best[i][0] + scores[word[i:j]], best[i][1] - 1) for i in range(j) if word[i:j] in scores]
        if word[j - 1] not in scores:
            n = len(word[j - 1].encode())
            options.append((best[j - 1][0] + n * least, best[j - 1][1] - n))
        best[j] = max(options)
    return -best[-1][1]


def test_counts_against_all_segmentations():
    r = random.Random(8)
    pieces = ["▁"] + list("abc") + ["ab", "bc", "abc", "▁a", "ca", "aa"]
    for trial in range(20):
        scores = {p: -float(r.randint(1, 6)) for p in pieces}  # many ties
        trie = token_counts.UnigramTrie(scores)
        words = ["".join(r.choice("abcé日") for _ in range(r.randint(1, 9))) for _ in range(60)]
        want = [brute_count("▁" + w, scores, trie.least) for w in words]
        assert trie.counts(words) == want and trie.counts(words[::-1]) == want[::-1]
        small = token_counts.UnigramTrie(scores, most=30)  # full again and again
        assert small.counts(words) == want and small.counts(["a" * 40 + w for w in words]) == [brute_count("▁" + "a" * 40 + w, scores, trie.least) for w in words]


def test_shared_prefixes_are_scored_once():
    trie = token_counts.UnigramTrie({p: -1.0 for p in "▁abc"})
    assert trie.counts(["abc", "ab", "abcc", "ac", "abc"]) == [4, 3, 5, 3, 4]
    assert len(trie.score) == 2 + len({"a", "ab", "abc", "abcc", "ac"})  # the root and the mark, then a node for each prefix


def test_counts_against_the_library(spark):
    from tokenizers import Tokenizer, models

    path = tokenizer_path("piece_bpe_32k.model")
    scores = token_counts.piece_model_scores(path)
    whole = Tokenizer(models.Unigram(list(scores.items()), None, False))
    texts = [prose(i, 30) for i in range(20)] + [None, "", " \n\t", "one  two\nthree", "x" * 3000, "one  two\nthree"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}
    assert got == {i: sum(len(whole.encode("▁" + w).ids) for w in (t or "").split()) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_zipf_scores_sum_to_one():
    s = token_counts.zipf_scores(["a", "b", "c"])
    assert np.isclose(sum(np.exp(v) for v in s.values()), 1) and s["a"] > s["b"] > s["c"]
