"""Token files, packing, word-wise encoding and decoding, against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, packing, token_files
from corvane.llm.common import tokenizer_path
from corvane.llm.words import ByteCoder, coder, text_coder

HARD = [None, "", " ", "\n", "a  b", " a b ", "x\n y", "a <|endoftext|> b<|endoftext|>c", "don't  's\t\tq", "İstanbul ΑΣ é x", "a\x1cb \x1c c", "日本 語　x y", "​ x​ y", "é" * 5 + " 1234 12a", "word " * 3000, "same", "same"]
SCHEMA = "extra int, text string, doc_id long, ids string"


def documents(spark, texts=HARD):
    return spark.createDataFrame([(0, t, i, "clash") for i, t in enumerate(texts)], SCHEMA)


def encoder(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_give_the_texts_ids(name):
    r = random.Random(1)
    parts = ["a", "B", " ", " ", "\n", "'s", "1", "é", "<|endoftext|>", "\t", "\x1c", "　", "́", "!", "ß", "İ", "᠎", "\x85", "\xa0", "\r", ". ", "The", "œ"]
    texts = [t or "" for t in HARD] + ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(3000)]
    encode, code = encoder(name), text_coder(tokenizer_path(name))
    ids, lens = code.encode(pa.array(texts))
    ends = np.cumsum(lens)
    for t, a, b in zip(texts, ends - lens, ends):
        assert ids[a:b].tolist() == encode(t), t
    if name.startswith("byte"):
        one = coder(tokenizer_path(name), ByteCoder).one
        assert all(np.frombuffer(one(t), "<u4").tolist() == encode(t) for t in texts)


@pytest.mark.parametrize("width", [1, 3, 7, 8, 13, 16, 17, 25, 31, 32])
def test_bits_round_trip(width):
    for n in (0, 1, 7, 8, 9, 1000):
        ids = np.random.default_rng(n).integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
        data = token_files.pack(ids, width)
        assert len(data) == -(-n // 8) * width and np.array_equal(token_files.unpack(data, width, n), ids)
    with pytest.raises(ValueError):
        token_files.pack(np.array([1 << (width - 1) << 1], np.uint64), width) if width < 32 else token_files.pack(np.zeros(1), 33)


def test_token_files(spark):
    encode = encoder("word_bpe_49k.json")
    files = token_files.write_token_files(documents(spark), tokenizer_path("word_bpe_49k.json"), 1, n_files=3)
    rows, start = token_files.read_token_files(files).orderBy("doc_id").collect(), 0
    assert len(rows) == len(HARD)
    for i, (t, r) in enumerate(zip(HARD, rows)):
        ids = np.array([*encode(t), 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    system, name = token_files._filesystem(files.files[0].path)
    with system.open_input_file(name) as source:
        file = token_files.TokenFileReader(source)
        k = len(file.ends) - 1
        assert file.document(k).tolist() == [*encode(HARD[int(file.doc_ids[k])]), 1] and file.ids(1, 3).tolist() == file.ids(0, 5).tolist()[1:3]


def test_no_documents(spark):
    none, path = documents(spark).limit(0), tokenizer_path("byte_bpe_50k.json")
    assert token_files.read_token_files(token_files.write_token_files(none, path, 1)).count() == 0
    assert packing.pack_documents(none, path, 2).count() == 0 and bpe.encode_documents(none, path).count() == 0


def brute_best_fit(sizes, capacity, most):
    """(bin, place) of each piece: a list of open bins, the fullest that has room, of equals the last filled so far."""
    open_bins, made, out, closed = [], 0, [], []
    for n in sizes:
        fits = [b for b in open_bins if capacity - b[1] >= n]
        if fits:
            best = max(fits, key=lambda b: (b[1], b[2]))
        else:
            best = [made, 0, 0]
            made += 1
            open_bins.append(best)
        out.append((best[0], best[1]))
        best[1], best[2] = best[1] + n, len(out)
        if best[1] == capacity:
            gone = best
        elif len(open_bins) > most:
            gone = max(open_bins, key=lambda b: (b[1], b[2]))
        else:
            gone = None
        if gone:
            open_bins.remove(gone)
        closed.append(gone and gone[0])
    return out, closed


def test_best_fit_against_a_list_of_bins():
    r = random.Random(3)
    for most in (1, 2, 4, 64):
        for capacity in (10, 100):
            sizes = [r.randint(1, capacity) for _ in range(1500)]
            fit = packing.BestFit(capacity, most)
            got = [fit.put(n) for n in sizes]
            want, closed = brute_best_fit(sizes, capacity, most)
            assert [g[:2] for g in got] == want and [g[2] for g in got] == closed
    fit = packing.BestFit(10, 2)
    assert [fit.put(n) for n in (7, 5, 4, 3)] == [(0, 0, None), (1, 0, None), (1, 5, None), (0, 7, 0)]
    fit = packing.BestFit(10, 2)  # the fullest of all three closes, the new one
    assert [fit.put(n)[2] for n in (5, 6, 9)] == [None, None, 2]
    assert packing.cut(2500, 1024) == [452, 1024, 1024] and packing.cut(1024, 1024) == [1024] and packing.cut(1, 1024) == [1]


@pytest.mark.parametrize("parts", [1, 40])
def test_partitions_leave_no_gaps(spark, parts):
    """However many tasks there are, their last bins are packed together."""
    r = random.Random(9)
    texts = ["a " * r.randint(1, 60) for _ in range(800)]
    docs = spark.createDataFrame([(None if i % 50 == 0 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(parts)
    rows = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 2, 128).collect()
    assert len(rows) == 800 and sum(r.doc_id is None for r in rows) == 16
    total = sum(r.length for r in rows)
    assert total / (128 * len({r.sequence_id for r in rows})) > 0.98


def test_packing(spark):
    encode = encoder("byte_bpe_50k.json")
    rows = packing.pack_documents(documents(spark), tokenizer_path("byte_bpe_50k.json"), 2, 128, keep_ids=True).collect()
    by, bins = {}, {}
    for r in sorted(rows, key=lambda r: r.piece):
        assert r.length == len(r.ids) <= 128 and r.start == len(by.get(r.doc_id, [])) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by.setdefault(r.doc_id, []).extend(r.ids)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by == {i: [*encode(t), 2] for i, t in enumerate(HARD)}
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128


def test_encode_and_decode(spark):
    path, encode = tokenizer_path("byte_bpe_50k.json"), encoder("byte_bpe_50k.json")
    done = bpe.encode_documents(documents(spark), path)
    rows = {r.doc_id: r for r in bpe.decode_documents(done, path).collect()}
    assert len(rows) == len(HARD)
    for i, t in enumerate(HARD):
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == encode(t) and rows[i].n_tokens == len(encode(t)) and rows[i].decoded == (t or "")
    both = bpe.encode_documents(documents(spark), path, decoded=True).select("doc_id", F.sha2("decoded", 256).alias("s")).collect()
    assert {r.doc_id: r.s for r in both} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(HARD)}


def test_null_and_repeated_ids(spark):
    """Every row is a document of its own, whatever its id."""
    texts = ["one two", "three", None, "", "one two", "one two", "four"]
    ids = [None, None, 5, 5, 7, 7, 7]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    for name, end in (("byte_bpe_50k.json", []), ("word_bpe_49k.json", [1])):
        encode, path = encoder(name), tokenizer_path(name)
        want = sorted((-1 if i is None else i, len([*encode(t), *end])) for i, t in zip(ids, texts))
        if end:
            rows = token_files.read_token_files(token_files.write_token_files(docs, path, 1)).collect()
            assert sum(r.n_tokens for r in rows if r.start == 0) and max(r.start + r.n_tokens for r in rows) == sum(n for _, n in want)
        else:
            rows = bpe.encode_documents(docs, path).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in rows) == want


def test_equal_blocks(spark, monkeypatch):
    """Blocks of the same rows, and full tables, change nothing."""
    monkeypatch.setattr(bpe, "TABLE_WORDS", 3)
    docs = spark.createDataFrame([(1, "the same five words again")] * 4 + [(2, "b " * 50)], "doc_id long, text string").repartition(4)
    path, encode = tokenizer_path("byte_bpe_50k.json"), encoder("byte_bpe_50k.json")
    rows = bpe.encode_documents(docs, path).collect()
    assert len(rows) == 5 and all(np.frombuffer(r.ids, "<u4").tolist() == encode("the same five words again" if r.doc_id == 1 else "b " * 50) for r in rows)


def test_decoding_of_broken_bytes(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    ids = Tokenizer.from_file(path).encode("é", add_special_tokens=False).ids + [97, 222, 50256, 60000]
    row = spark.createDataFrame([(np.array(ids, "<u4").tobytes(), "old"), (None, "old")], "ids binary, decoded string")
    got = [r.decoded for r in bpe.decode_documents(row, path).collect()]
    assert got == [Tokenizer.from_file(path).decode(ids[:-1], skip_special_tokens=False), ""]
