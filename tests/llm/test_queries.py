"""Every registered query over the smallest whole tables: contract columns, and rows by brute force or SQL."""

import hashlib
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest

from corvane.llm import queries
from tests.llm.test_neighbours import brute_sets
from tests.llm.test_packing_and_files import encoder
from tests.test_oracles import SF, _rows, duck  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

COLUMNS = {
    "op1_token_files": "doc_id start n_tokens ids_crc32",
    "op2_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op4_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op5_language_id": "doc_id held_out lang_pred score",
    "op6_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op7_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8_token_counts": "doc_id n_tokens",
    "op9_nearest": "query_id rank vec_id score",
    "op10_ngram_join": "doc_id n_shingles component_id",
    "pipeline": "doc_id piece start length ids_crc32 sequence_id offset",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    found = queries.queries()[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(found.columns)
    return found.collect()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_all_are_registered():
    assert set(queries.queries()) == set(COLUMNS)


def test_op1(spark, texts):
    encode, at, want = encoder("word_bpe_49k.json"), 0, {}
    for i in sorted(texts):
        ids = [*encode(texts[i]), 1]
        want[i] = (at, len(ids), crc(ids))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op1_token_files")} == want


def test_op2(spark, texts):
    ids = sorted(texts, reverse=True)
    following = dict(zip(ids, [*ids[1:], ids[0]]))
    rows = {r.doc_id: r for r in run(spark, "op2_fingerprints")}
    assert rows.keys() == texts.keys()
    prints = defaultdict(set)
    for i, r in rows.items():
        t, half = texts[i], len(texts[i]) // 2
        edited = t[: len(t) - half] + texts[following[i]][:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(edited))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints[t].add(r.fingerprint)
        prints[edited].add(r.edited_fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_op3(spark, texts):
    encode, pieces, bins = encoder("byte_bpe_50k.json"), defaultdict(list), defaultdict(list)
    for r in run(spark, "op3_best_fit_packing"):
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert pieces.keys() == texts.keys()
    total = 0
    for i, own in pieces.items():
        ids, at = [*encode(texts[i]), 2], 0
        total += len(ids)
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 1024)
        for r in own:
            assert (r.start, r.ids_crc32) == (at, crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids) and all(r.length == 1024 for r in own[1:])
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(bins) <= 1.02 * -(-total // 1024) + 1


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):  # noqa: F811
    expected = duck.sql(queries.oracle_sql()[name])
    columns = sorted(expected.columns)
    want = [dict(zip(expected.columns, r)) for r in expected.fetchall()]
    assert _rows([r.asDict() for r in run(spark, name)], columns) == _rows(want, columns)


def test_op5(spark, texts):
    rows = {r.doc_id: r for r in run(spark, "op5_language_id")}
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[i]))
    tested = [i for i, r in rows.items() if r.held_out and known[i] is not None and r.lang_pred != "und"]
    assert tested and sum(rows[i].lang_pred == known[i] for i in tested) >= 0.95 * len(tested)


def test_op7(spark, texts):
    from tokenizers import Tokenizer

    from corvane.llm.common import tokenizer_path

    encode, decode = encoder("byte_bpe_50k.json"), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).decode
    want = {}
    for i, t in texts.items():
        ids = encode(t)
        want[i] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op7_bpe")} == want


def test_op8(spark, texts):
    rows = {r.doc_id: r.n_tokens for r in run(spark, "op8_token_counts")}
    assert rows.keys() == texts.keys() and all((n > 0) == bool(texts[i].strip()) for i, n in rows.items())


def test_op9(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, m = table["vec_id"].to_numpy(), np.array([list(v) for v in table["embedding"]], np.float64)
    found, hit, all_ = defaultdict(list), 0, 0
    for r in run(spark, "op9_nearest"):
        found[r.query_id].append(r)
    assert found.keys() == {i for i in ids.tolist() if i % 20 == 0}
    for q, own in found.items():
        own.sort(key=lambda r: r.rank)
        exact = m @ m[ids == q][0]
        of = dict(zip(ids.tolist(), exact.tolist()))
        del of[q]
        near = sorted(of, key=lambda i: (-of[i], i))[:20]
        assert [r.rank for r in own] == list(range(1, len(near) + 1))
        assert all(abs(r.score - of[r.vec_id]) < 1e-9 for r in own)
        assert own == sorted(own, key=lambda r: (-r.score, r.vec_id))
        hit, all_ = hit + len({r.vec_id for r in own} & set(near)), all_ + len(near)
    assert hit >= 0.95 * all_


def test_op10(spark, texts):
    sets, root = brute_sets(list(texts.items())), {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    want = {i: (len(sets[i]), top(i)) for i in ids}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op10_ngram_join")} == want


def test_pipeline_packs_what_stays(spark, texts):
    """Some near copies go, and what stays is packed whole."""
    kept, filled = defaultdict(list), defaultdict(int)
    for r in run(spark, "pipeline"):
        kept[r.doc_id].append((r.piece, r.start, r.length))
        filled[r.sequence_id] += r.length
    assert kept.keys() < texts.keys() and max(filled.values()) <= 1024
    for own in kept.values():
        at = 0
        for n, (piece, start, length) in enumerate(sorted(own)):
            assert (piece, start) == (n, at)
            at += length
