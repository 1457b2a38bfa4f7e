"""Best-fit packing: bounded-space online best fit over a bitset of open bins.

Tasks pack their documents as they stream by.  What is in the bins that are still open when a
task ends is packed again, all tasks' remains together, so the number of partitions leaves no mark.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .words import ByteCoder, coder, slices

#: Bins that are open at once in a task.
OPEN_BINS = 4096
#: Documents whose lengths are looked at together, in texts' bytes.
LOOK_AHEAD_BYTES = 16 << 20
#: Remains that a task of the second round packs, in bins' worth of tokens.
REMAINS = 4 * OPEN_BINS


class BestFit:
    """Online best fit with at most `most` open bins; the fullest closes first.

    Bit f of the bitset is set while some open bin has exactly f tokens free, so the best bin
    for a piece of n tokens is the lowest set bit at or above n: one shift and one isolation of
    the lowest bit, whatever the number of bins.  Of bins equally full the last that became so is taken.
    """

    def __init__(self, capacity: int, most: int = OPEN_BINS):
        if capacity < 1 or most < 1:
            raise ValueError("capacity and number of open bins must be positive")
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.bins = 0, 0, [[] for _ in range(capacity + 1)]
        self.made = 0

    def put(self, n: int) -> tuple[int, int, int | None]:
        """Place a piece of n tokens: the bin's number, the place in it, and the number of the bin that closes, if one does."""
        if not 0 < n <= self.capacity:
            raise ValueError(f"a piece of {n} tokens for bins of {self.capacity}")
        fits = self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        left, closed = free - n, number
        if left:
            self.bins[left].append(number)
            self.bits |= 1 << left
            self.open += 1
            # the bin just used is a candidate like any other
            closed = self._take((self.bits & -self.bits).bit_length() - 1) if self.open > self.most else None
        return number, self.capacity - free, closed

    def _take(self, free: int) -> int:
        bins = self.bins[free]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole unless longer than a bin; then the first may be shorter."""
    first = n % capacity
    return [first] * (first > 0) + [capacity] * (n // capacity)


OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: A placed piece as its bin holds it: whether there is a doc_id, then SCHEMA's columns but for the bin.
_PIECE = np.dtype([("known", "?"), ("doc_id", "<i8"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i8"), ("ids_crc32", "<i8"), ("offset", "<i8")])
_ROW = struct.Struct("<?qiqqqq")
#: Pieces of closed bins are given out so many at a time.
ROWS_OUT = 1 << 14


def _batch(bins: list[tuple[int, bytes, list]], loose: bool, keep_ids: bool) -> pa.RecordBatch:
    """Rows of whole bins (sequence_id, pieces, ids)."""
    rows = np.frombuffer(b"".join(b[1] for b in bins), _PIECE)
    sequence = np.repeat([b[0] for b in bins], [len(b[1]) // _PIECE.itemsize for b in bins])
    columns = {n: pa.array(np.ascontiguousarray(rows[n])) for n in _PIECE.names[1:]} | {"sequence_id": pa.array(sequence, pa.int64())}
    columns["doc_id"] = pa.array(np.ascontiguousarray(rows["doc_id"]), mask=~rows["known"])
    arrays, names = [columns[f.name] for f in SCHEMA], list(SCHEMA.names)
    if keep_ids:
        arrays, names = [*arrays, pa.array([np.frombuffer(x, "<u4").tolist() for b in bins for x in b[2]], pa.list_(pa.int32()))], [*names, "ids"]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(rows), loose))], names=[*names, "loose"])


class Packer:
    """Best fit that holds what open bins hold, and gives out rows of bins that closed."""

    def __init__(self, capacity: int, most: int, base: int, keep_ids: bool):
        self.fit, self.base, self.keep_ids = BestFit(capacity, most), base, keep_ids
        self.held: dict[int, tuple[bytearray, list]] = {}
        self.closed: list[tuple[int, bytes, list]] = []
        self.rows = 0

    def put(self, pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Place pieces (doc_id, piece, start, length, crc, ids), the longest first."""
        for doc, k, start, length, crc, ids in sorted(pieces, key=lambda p: -p[3]):
            number, offset, closed = self.fit.put(length)
            rows, own = self.held.setdefault(number, (bytearray(), []))
            rows += _ROW.pack(doc is not None, doc or 0, k, start, length, crc, offset)
            if self.keep_ids:
                own.append(ids)
            if closed is not None:
                rows, own = self.held.pop(closed)
                self.closed.append((self.base + closed, bytes(rows), own))
                self.rows += len(rows) // _PIECE.itemsize
                if self.rows >= ROWS_OUT:
                    yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.closed:
            yield _batch(self.closed, False, self.keep_ids)
        self.closed, self.rows = [], 0

    def end(self, loose: bool) -> Iterator[pa.RecordBatch]:
        """The rest: closed bins, then those that are open, marked as loose or not."""
        yield from self.flush()
        left = [(self.base + n, bytes(rows), own) for n, (rows, own) in self.held.items()]
        for a in range(0, len(left), 1024):
            yield _batch(left[a : a + 1024], loose, self.keep_ids)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, most: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; ids too with keep_ids.

    Each task encodes its documents as they stream by and packs their pieces at once.  Pieces of a
    look-ahead of a few thousand documents are placed longest first, which leaves the short
    ones to fill gaps.  A task keeps at most `most` open bins, whatever it reads; the pieces that are
    in them at its end are loose.  All pieces are written to the shared folder, and the loose ones,
    rows of a few numbers without text, are packed again by tasks that take about REMAINS
    bins' worth each, longest first.  sequence_id holds the round and the task's partition in its upper bits, so it
    is unique, and the same when a lost task runs again.

    A null or empty text is the end id alone; null ids and repeated rows are packed like any
    others; an empty table gives no rows; other columns are not read.  A text is encoded as a whole, which
    takes a worker a few times its size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = coder(tokenizer, ByteCoder), np.array([end_id], "<u4").tobytes()
        packer = Packer(capacity, most, TaskContext.get().partitionId() << 36, keep_ids)
        for batch in batches:
            for a, n in slices(batch.column(1), LOOK_AHEAD_BYTES):
                pieces = []
                for doc, text in zip(batch.column(0).slice(a, n).to_pylist(), batch.column(1).slice(a, n)):
                    text = text.as_py()
                    own, at = (code.one(text) if text else b"") + end, 0
                    for k, length in enumerate(cut(len(own) // 4, capacity)):
                        part = own[4 * at : 4 * (at + length)]
                        pieces.append((doc, k, at, length, zlib.crc32(part), part if keep_ids else None))
                        at += length
                yield from packer.put(pieces)
        yield from packer.end(True)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, most, 1 << 62 | TaskContext.get().partitionId() << 36, keep_ids)
        for batch in batches:
            ids = (np.array(x, "<u4").tobytes() for x in batch.column("ids").to_pylist()) if keep_ids else iter([None] * batch.num_rows)
            yield from packer.put(list(zip(*(batch.column(n).to_pylist() for n in SCHEMA.names[:5]), ids)))
        yield from packer.end(False)

    out = OUT + ", ids array<int>" * keep_ids
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(keyed.mapInArrow(run, out + ", loose boolean"), "pieces")
    loose = pieces.where("loose")
    tokens = loose.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-tokens // (capacity * REMAINS)))
    dealt = loose.repartition(tasks).sortWithinPartitions(F.desc("length"), "doc_id", "piece", "start", "ids_crc32")
    return pieces.where("NOT loose").unionByName(dealt.mapInArrow(again, out + ", loose boolean")).drop("loose")
