"""Token-ID / binary output: fixed-width bit packing with block offsets.

A file holds the ids of consecutive documents, end to end, each id in `width` bits, the least
that the vocabulary needs.  Ids are packed least significant bit first, in blocks of BLOCK ids
(a multiple of 8, so every block starts at a byte); then come the index and a fixed trailer:

    blocks | block offsets u64[n_blocks + 1] | document ids i64[n] | null flags u8[n] |
    document ends u64[n], in ids | trailer: magic, width, n_blocks, n_docs, n_ids, index offset

Blocks make any id or document readable by one seek, and 8 ids at a time fill `width` whole
bytes, so packing and unpacking are a few numpy operations for each byte column.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_tasks, shared_dir
from .words import slices, text_coder

MAGIC = b"CRVTOK01"
TRAILER = struct.Struct("<8sQQQQQ")
BLOCK = 8192
MANIFEST = "path string, first_doc_id long, n_docs long, n_tokens long"
#: Documents read back at a time hold about so many ids.
READ_IDS = 1 << 20


def bits_for(n_vocab: int) -> int:
    """The least width that holds the ids 0 to n_vocab - 1."""
    return max(1, int(n_vocab - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids of `width` (1 to 32) bits each, least significant bit first, padded to whole groups of 8 ids."""
    if not 1 <= width <= 32:
        raise ValueError(f"width {width} is not in 1 to 32")
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {int(ids.max())} does not fit {width} bits")
    groups = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(groups), width + 8), np.uint8)
    for j in range(8):
        first, shift = divmod(j * width, 8)
        lane = groups[:, j] << np.uint64(shift)
        for k in range((shift + width + 7) // 8):
            out[:, first + k] |= ((lane >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
    return out[:, :width].tobytes()


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    """The first `count` ids of what pack() made."""
    groups = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.empty((len(groups), 8), np.uint32)
    for j in range(8):
        first, shift = divmod(j * width, 8)
        lane = np.zeros(len(groups), np.uint64)
        for k in range((shift + width + 7) // 8):
            lane |= groups[:, first + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = (lane >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    return out.reshape(-1)[:count]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class TokenFileWriter:
    """Writes documents' ids to one file; close() adds index and trailer.

    Ids go out block by block; what stays until the end is the index, 17 bytes for each document.
    """

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.offsets, self.doc_ids, self.nulls, self.ends = array("Q", [0]), array("q"), array("B"), array("Q")
        self.rest, self.n_ids = np.zeros(0, np.uint32), 0

    def add(self, doc_ids: list, ids: np.ndarray, lens: np.ndarray) -> None:
        """Documents' ids, end to end, and how many each has."""
        self.doc_ids.extend(x or 0 for x in doc_ids)
        self.nulls.extend(x is None for x in doc_ids)
        self.ends.frombytes((self.n_ids + np.cumsum(lens)).astype(np.uint64).tobytes())
        self.n_ids += len(ids)
        ids = np.concatenate([self.rest, ids])
        full = len(ids) // BLOCK * BLOCK
        if full:
            self._write(pack(ids[:full], self.width), full // BLOCK)
        self.rest = ids[full:]

    def _write(self, data: bytes, blocks: int) -> None:
        self.sink.write(data)
        step = len(data) // blocks
        at = self.offsets[-1]
        self.offsets.extend(range(at + step, at + len(data) + 1, step))

    def close(self) -> None:
        if len(self.rest):
            self._write(pack(self.rest, self.width), 1)
        at = self.offsets[-1]
        for x, kind in ((self.offsets, "<u8"), (self.doc_ids, "<i8"), (self.nulls, "u1"), (self.ends, "<u8")):
            self.sink.write(np.asarray(x, kind).tobytes())
        self.sink.write(TRAILER.pack(MAGIC, self.width, len(self.offsets) - 1, len(self.doc_ids), self.n_ids, at))
        self.sink.close()


class TokenFileReader:
    """Random access to a file of TokenFileWriter."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - TRAILER.size)
        magic, self.width, n_blocks, n_docs, self.n_ids, at = TRAILER.unpack(source.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(at)
        read = lambda kind, n: np.frombuffer(source.read(np.dtype(kind).itemsize * n), kind)
        self.offsets, self.doc_ids = read("<u8", n_blocks + 1), read("<i8", n_docs)
        self.nulls, self.ends = read("u1", n_docs).astype(bool), read("<u8", n_docs).astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first to last - 1 of the file; reads only the blocks that hold them."""
        if last <= first:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, -(-last // BLOCK)
        self.source.seek(int(self.offsets[a]))
        data = self.source.read(int(self.offsets[b] - self.offsets[a]))
        return unpack(data, self.width, last - a * BLOCK)[first - a * BLOCK :]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


@dataclass
class TokenFiles:
    """Files in order of their documents' ids, as (path, first doc_id, documents, ids)."""

    spark: SparkSession
    folder: str
    files: list


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, n_files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encodes whole texts and writes their ids, each document closed by end_id, in ascending doc_id order.

    Documents are range-partitioned by id, sorted in each partition, and every partition streams
    into a file of its own: a task holds an Arrow batch, a text's ids, and the file's index, 17 bytes for each document.  A task's file has a name of
    its own for each attempt, and only files of tasks that succeeded are listed, so a lost executor
    leaves nothing but an unlisted file.  The list (one row for each file) is all the driver gets.

    Null texts are empty documents (the end id alone), null ids come first, equal ids stand
    together in the order of their texts, an empty table gives no files; other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = text_coder(tokenizer)
        width = bits_for(max(code.tokenizer.get_vocab_size(), end_id + 1))
        writer = path = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                files, base = _filesystem(folder)
                files.create_dir(base, recursive=True)
                name = f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
                path, first = f"{folder}/{name}", batch.column(0)[0].as_py()
                writer = TokenFileWriter(files.open_output_stream(f"{base}/{name}"), width)
            for a, n in slices(batch.column(1)):
                ids, lens = code.encode(batch.column(1).slice(a, n))
                ids = np.insert(ids, np.cumsum(lens), end_id)
                writer.add(batch.column(0).slice(a, n).to_pylist(), ids, lens + 1)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "first_doc_id": first, "n_docs": len(writer.doc_ids), "n_tokens": writer.n_ids}], SCHEMA)

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = keyed.repartitionByRange(n_files or n_tasks(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    files = dealt.mapInArrow(write, MANIFEST).collect()
    return TokenFiles(spark, folder, sorted(files, key=lambda r: (r.first_doc_id is not None, r.first_doc_id or 0)))


SCHEMA = pa.schema([("path", pa.string()), ("first_doc_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_token_files(files: TokenFiles) -> DataFrame:
    """One row for each document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it, over all files; ids_crc32 is of the ids as
    little-endian unsigned 32-bit integers.
    """
    at, rows = 0, []
    for f in files.files:
        rows.append((len(rows), f.path, at))
        at += f.n_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, path, base in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = _filesystem(path)
                with system.open_input_file(name) as source:
                    file, k = TokenFileReader(source), 0
                    begins = np.concatenate([[0], file.ends])
                    while k < len(file.ends):
                        last = max(k + 1, int(np.searchsorted(file.ends, begins[k] + READ_IDS, "right")))
                        ids = file.ids(int(begins[k]), int(begins[last])).astype("<u4")
                        cuts = begins[k : last + 1] - begins[k]
                        crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:])]
                        yield pa.record_batch([pa.array(file.doc_ids[k:last], mask=file.nulls[k:last]), pa.array(base + begins[k:last]), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())], schema=READ)
                        k = last

    spark = files.spark
    listed = spark.createDataFrame(rows, "file int, path string, base long")
    # a file a task
    return listed.repartitionById(max(1, len(rows)), F.col("file")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
