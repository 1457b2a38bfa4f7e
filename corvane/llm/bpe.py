"""BPE encoding and decoding by a table of distinct words.

Documents are handled in blocks of bounded size.  Every block's distinct words go, dealt by the
word's hash, to the task that has all of that word's share, which encodes it once while its table of TABLE_WORDS has
room (a full table starts anew, so memory is bounded, and more shuffle partitions hold more words); the ids come back to the
block, where each position looks up its word's ids.  Words are cut where byte-level pre-tokenizers
always cut (see words.py), so joined ids are those of the whole text.  Only distinct words and packed
blocks are shuffled, never a row for each position.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_tasks
from .words import ByteCoder, coder, gather_flat, piece_bytes, slices, split_words

#: Text of a block, in bytes; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: Words whose ids a task keeps, of those that hash to it.
TABLE_WORDS = 250_000
_ZSTD = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))


def to_blob(**columns: pa.Array) -> bytes:
    """Arrays, packed; they may differ in length."""
    batch = pa.RecordBatch.from_pydict({k: pa.LargeListArray.from_arrays(pa.array([0, len(v)], pa.int64()), v) for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_ZSTD) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes) -> list[pa.Array]:
    batch = next(iter(pa.ipc.open_stream(blob)))
    return [c.flatten() for c in batch.columns]


def narrow(x: np.ndarray) -> pa.Array:
    """Non-negative integers in the least unsigned type that holds them."""
    return pa.array(x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)))


def distinct_words(texts: pa.Array) -> pa.Array:
    """The distinct words of the texts, in order of first use; slice by slice, to hold few words at once."""
    found = [split_words(texts.slice(a, n))[0].unique() for a, n in slices(texts)]
    return pc.unique(pa.concat_arrays(found)) if found else pa.array([], pa.large_string())


def words_crc(words: pa.Array) -> int:
    """A checksum of words in their order."""
    words = pa.concat_arrays([words.cast(pa.large_binary())])
    sizes, text = words.buffers()[1:]
    return zlib.crc32(text.to_pybytes() if text else b"") << 31 ^ zlib.crc32(sizes.to_pybytes()[: 8 * (len(words) + 1)] if sizes else b"")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """(id, document ids, texts) of each block; the id comes from what the block holds."""
    for batch in batches:
        for a, n in slices(batch.column(1), BLOCK_BYTES):
            ids, texts = batch.column(0).slice(a, n), batch.column(1).slice(a, n).cast(pa.large_string())
            texts = pc.fill_null(texts, pa.scalar("", pa.large_string()))
            texts = pa.concat_arrays([texts])  # from its own first byte
            at = texts.buffers()[1].to_pybytes()
            raw = texts.buffers()[2]
            low = zlib.crc32(raw.to_pybytes() if raw else b"", zlib.crc32(at))
            yield zlib.crc32(repr(ids.to_pylist()).encode()) << 31 ^ low, ids, texts


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers).

    With `decoded`, also the text that decode_documents makes of the ids, by the same join, in the same task.

    docs is read twice and must give the same rows in the same order both times, as tables do;
    a block is known by checksums of what it holds, and its distinct words are compared by theirs, so rows that differ are
    an error.  A text is a block at least and is encoded in one piece: a worker needs a few times its size.  Null and empty texts have no ids; null ids
    and repeated rows are rows like any others; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tasks = n_tasks(docs.sparkSession)

    names = [*OUT.names, *["decoded"] * decoded]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in blocks(batches):
            found = distinct_words(texts)
            whole = pa.array([words_crc(found)], pa.int64())
            to = np.fromiter((zlib.crc32(w) for w in found.cast(pa.large_binary()).to_pylist()), np.uint32, len(found)) % tasks
            order = np.argsort(to, kind="stable")
            bounds = np.searchsorted(to[order], np.arange(tasks + 1))
            for k, a, b in zip(range(tasks), bounds, bounds[1:]):
                if a < b:
                    own = found.take(pa.array(order[a:b]))
                    sizes = pc.binary_length(own).cast(pa.uint32())
                    text = pa.array(np.frombuffer(own.buffers()[2] or b"", np.uint8))
                    blob = to_blob(step=narrow(np.diff(order[a:b], prepend=0)), size=narrow(sizes.to_numpy()), text=text, whole=whole)
                    yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "block": pa.array([block], pa.int64()), "words": pa.array([blob], pa.binary())})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, table = coder(tokenizer, ByteCoder), {}
        for batch in batches:
            for block, blob in zip(batch.column(1).to_pylist(), batch.column(2)):
                step, size, text, whole = from_blob(blob.as_py())
                raw, ends = text.to_numpy().tobytes(), np.cumsum(size.to_numpy(), dtype=np.int64).tolist()
                ids = []
                for a, b in zip([0, *ends], ends):
                    word = raw[a:b]
                    known = table.get(word)
                    if known is None:
                        if len(table) >= TABLE_WORDS:
                            table.clear()
                        known = table[word] = code.one(word.decode())
                    ids.append(known)
                lens = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
                done = to_blob(step=step, n=narrow(lens), ids=narrow(np.frombuffer(b"".join(ids), "<u4")), whole=whole)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "ids": pa.array([done], pa.binary())})

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in blocks(batches):
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "docs": pa.array([to_blob(doc_id=ids, text=texts)], pa.binary())})

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [from_blob(blob.as_py()) for blob in right.column("ids")]
        at = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(p[0].to_numpy(), dtype=np.int64) for p in parts)])
        lens = np.concatenate([np.zeros(0, np.int64), *(p[1].to_numpy() for p in parts)]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint8), *(p[2].to_numpy() for p in parts)])
        sent = {p[3][0].as_py() for p in parts}
        del parts
        at, first = np.unique(at, return_index=True)
        begin, lens = (np.cumsum(lens) - lens)[first], lens[first]
        out = []
        for blob in left.column("docs"):
            docs = pa.RecordBatch.from_arrays(from_blob(blob.as_py()), names=["doc_id", "text"])
            for a, n in slices(docs.column(1)):
                words, n_words = split_words(docs.column(1).slice(a, n))
                if a == 0:
                    # the same distinct words in the same order as those that were sent
                    known = distinct_words(docs.column(1))
                    if len(known) != len(at) or sent - {words_crc(known)}:
                        raise RuntimeError("the documents differ between two reads; write them to a table first")
                where = pc.index_in(words, known).to_numpy()
                ids, counts = gather_flat(flat, begin, lens, where, n_words)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * 4
                lists = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                columns = [docs.column(0).slice(a, n), pa.array(counts, pa.int64()), lists]
                if decoded:
                    columns.append(pa.array(joined_pieces(piece_table(tokenizer), ids, ends // 4), pa.string()))
                out.append(pa.RecordBatch.from_arrays(columns, names=names))
        return pa.Table.from_batches(out, OUT.append(pa.field("decoded", pa.string())) if decoded else OUT)

    encoded = rows.mapInArrow(words, "part int, block long, words binary").repartitionById(tasks, F.col("part")).mapInArrow(encode, "block long, ids binary")
    whole = rows.mapInArrow(packed, "block long, docs binary")
    return whole.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(join, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded)


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


@lru_cache(maxsize=2)
def piece_table(path: str) -> pa.Array:
    """The bytes of each id's piece, by id; its size is that of the vocabulary."""
    tokenizer = coder(path).tokenizer
    special = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    pieces = {i: p for p, i in tokenizer.get_vocab().items()}
    return pa.array([special[i] if i in special else piece_bytes(pieces[i]) if i in pieces else b"" for i in range(max(pieces) + 1)], pa.binary())


def joined_pieces(pieces: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """The texts of ids[ends[0]:ends[1]], ids[ends[1]:ends[2]], ...: each id joined to its piece, pieces end to end."""
    joined = pieces.take(pa.array(np.where(ids < len(pieces), ids, 0), mask=ids >= len(pieces)))
    places = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1][ends]
    data = memoryview(joined.buffers()[2] or b"")
    return [str(data[i:j], "utf-8", "replace") for i, j in zip(places, places[1:])]


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """encoded with a last column `decoded`: each id joined to its piece, the pieces joined to a text.

    Bytes that are no UTF-8 become U+FFFD.  Null ids are an empty text, unknown ids an empty piece;
    a column `decoded` that was there is replaced.
    """
    kept = [c for c in encoded.columns if c != "decoded"]
    at = kept.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(tokenizer)
        for batch in batches:
            for a, n in slices(batch.column(at), 8 << 20):
                part = batch.slice(a, n)
                raw = [x or b"" for x in part.column(at).to_pylist()]
                ids = np.frombuffer(b"".join(raw), "<u4")
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])])
                texts = joined_pieces(pieces, ids, ends)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*kept, "decoded"])

    rows = encoded.select(*kept)
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded string")
