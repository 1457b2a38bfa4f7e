"""Document fingerprints: a digest of improbable features in chained Bloom filters.

Every window of WINDOW bytes has an entropy; the rarer its entropy is among windows of prose, the
better the window's rank.  A window that is the best of many of its neighbourhoods is a feature.
Texts of fewer than SHORT bytes have too few of these to compare by, so each of their windows of SMALL bytes is one as well.
Features, hashed, go in order into Bloom filters of fixed size, a new one when one is full;
the filters are the fingerprint.  Two fingerprints are as alike as their filters' bits
overlap, beyond what chance would give.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_tasks
from .words import slices

#: Bytes of a window, and windows of a neighbourhood; a power of two.
WINDOW = 16
#: Neighbourhoods whose best a window must be to be a feature.
POPULAR = 8
#: Texts of fewer bytes are short: their windows of SMALL bytes are features too.
SHORT, SMALL = 128, 4
#: A longer text is taken in pieces of so many windows, to hold few numbers for it at once.
PIECE = 1 << 20
#: Bits of a filter, features that it takes, and bits set for each.
FILTER_BITS, FILTER_FEATURES, FEATURE_BITS = 2048, 160, 5
#: Entropy of windows of prose, in bits: mean, standard deviation, and the least that counts.
MEAN, DEVIATION, LEAST = 3.3, 0.25, 1.0
LEVELS = 1000
_SCALE = 1 << 16
_CLOG = np.array([0, *(round(_SCALE * c * np.log2(c)) for c in range(1, WINDOW + 2))], np.int64)


def _ranks() -> np.ndarray:
    """The rank of a window by its entropy in 1/LEVELS of the most: 0 is the rarest."""
    bits = np.arange(LEVELS + 1) / LEVELS * np.log2(WINDOW)
    rare = np.abs(bits - MEAN) / DEVIATION
    order = np.lexsort((np.arange(LEVELS + 1), -rare))
    rank = np.empty(LEVELS + 1, np.uint32)
    rank[order] = np.arange(LEVELS + 1)
    rank[bits < LEAST] = LEVELS + 1
    return rank


RANKS = _ranks()


def digest(texts: list[bytes]) -> list[bytes]:
    """The filters of each text, end to end.  Equal texts have equal filters; a text shorter than a window is padded to one."""
    if not texts:
        return []
    found = [f for run in _runs(texts) for f in _features(texts, run)]
    owner, h = (np.concatenate(x) for x in zip(*found))
    bare = np.setdiff1d(np.arange(len(texts)), owner)
    if len(bare):  # no window is popular: the best of the first neighbourhood stands for all
        at, data = _popular([texts[i][: 2 * WINDOW - 1] for i in bare], True)
        owner, h = np.append(owner, bare), np.append(h, _hashed(data, at, WINDOW))
    order = np.argsort(owner, kind="stable")  # the small windows' after the others
    owner, h = owner[order], h[order]
    per_text = np.bincount(owner, minlength=len(texts))
    n_filters = -(-per_text // FILTER_FEATURES)
    begin = np.cumsum(n_filters) - n_filters
    ordinal = np.arange(len(h)) - (np.cumsum(per_text) - per_text)[owner]
    chosen = begin[owner] + ordinal // FILTER_FEATURES
    bits = np.zeros((int(n_filters.sum()), FILTER_BITS), bool)
    for k in range(FEATURE_BITS):
        bits[chosen, ((h >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    raw = np.packbits(bits, axis=1).tobytes()
    size, ends = FILTER_BITS // 8, np.cumsum(n_filters)
    return [raw[size * int(e - n) : size * int(e)] for e, n in zip(ends, n_filters)]


def _runs(texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text, first window, last window): many whole texts, or a part of a long one."""
    k, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield k, i, 0, 0
            k, size = i, 0
        size += len(t)
        if size > PIECE:
            for a in range(0, len(t) - WINDOW + 1, PIECE):
                yield i, i + 1, a, min(a + PIECE, len(t) - WINDOW + 1)
            k, size = i + 1, 0
    if k < len(texts):
        yield k, len(texts), 0, 0


def _features(texts: list[bytes], run: tuple[int, int, int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hash) of a run's features, in order of text and place."""
    k, last, a, b = run
    if b:  # a part: with the windows that decide on those at its edges
        low = max(0, a - WINDOW + 1)
        at, data = _popular([texts[k][low : b + 2 * WINDOW - 2]])
        at = at[(at >= a - low) & (at < b - low)]
        yield np.full(len(at), k), _hashed(data, at, WINDOW)
        return
    own = texts[k:last]
    room = np.maximum(np.fromiter(map(len, own), np.int64, len(own)), WINDOW)
    starts = np.cumsum(room) - room
    at, data = _popular(own)
    yield k + np.searchsorted(starts, at, "right") - 1, _hashed(data, at, WINDOW)
    short = np.array([i for i, t in enumerate(own) if SMALL <= len(t) < SHORT], np.int64)
    if len(short):
        n = np.array([len(own[i]) - SMALL + 1 for i in short])
        at = np.repeat(starts[short] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield k + np.repeat(short, n), _hashed(data, at, SMALL)


def _popular(texts: list[bytes], first_best: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows that are features, and the texts' bytes, each padded to a window, end to end.

    With first_best, the place of the best of each text's first neighbourhood instead.
    """
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    room = np.maximum(lens, WINDOW)
    starts = np.cumsum(room) - room
    data = np.frombuffer(b"".join(t.ljust(WINDOW, b"\0") for t in texts), np.uint8)
    total = len(data)
    ahead, behind = np.zeros(total, np.uint8), np.zeros(total, np.uint8)
    for a in range(0, total, 1 << 16):  # in the cache's size
        b = min(total, a + (1 << 16))
        for d in range(1, WINDOW):
            if (n := min(b, total - d) - a) > 0:
                same = data[a : a + n] == data[a + d : a + d + n]
                ahead[a : a + n] += same
                behind[a + d : a + d + n] += same
    # sum of c*log(c) over a window's bytes: how it changes from window to window, and each text's first
    gain = _CLOG[1:] - _CLOG[:-1]
    step = np.zeros(total, np.int64)
    step[1 : total - WINDOW + 1] = gain[behind[WINDOW:]] - gain[ahead[: total - WINDOW]]
    heads = data[starts[:, None] + np.arange(WINDOW)]
    first = np.concatenate([_first_sums(h) for h in np.array_split(heads, max(1, len(heads) // 1000))])
    summed = np.cumsum(step)
    summed += np.repeat(first - summed[starts], room)
    level = np.clip(np.rint(LEVELS * (1 - summed / (_SCALE * WINDOW * np.log2(WINDOW)))), 0, LEVELS).astype(np.int64)
    key = RANKS[level].astype(np.int64) << 40 | np.arange(total)
    valid = np.arange(total) - np.repeat(starts, room) <= np.repeat(room - WINDOW, room)
    key[~valid] = np.iinfo(np.int64).max
    best, width = key, 1
    while width < WINDOW:
        best = np.concatenate([np.minimum(best[:-width], best[width:]), best[-width:]])
        width *= 2
    best &= (1 << 40) - 1
    if first_best:
        return best[starts], data
    popular = np.bincount(best[valid], minlength=total) >= POPULAR
    popular &= RANKS[level] <= LEVELS
    return np.flatnonzero(popular), data


def _first_sums(heads: np.ndarray) -> np.ndarray:
    """The sum of c*log(c) over the distinct bytes of each window."""
    same = heads[:, :, None] == heads[:, None, :]
    first = ~np.tril(same, -1).any(axis=2)
    return (_CLOG[same.sum(axis=2)] * first).sum(axis=1)


def _hashed(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes, 4 or a multiple of 8, at each place."""
    words = data[at[:, None] + np.arange(size)].view("<u8" if size % 8 == 0 else "<u4").astype(np.uint64)
    h = np.full(len(at), 0 if size == WINDOW else size, np.uint64)
    for k in range(words.shape[1]):
        h = _mix(h ^ (words[:, k] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)))
    return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: how far bits overlap beyond chance, averaged over the filters of the shorter fingerprint, each with its best match."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(v, np.uint64).reshape(-1, FILTER_BITS // 64) for v in ((a, b) if len(a) <= len(b) else (b, a)))
    nx, ny = np.bitwise_count(x).sum(axis=1)[:, None].astype(float), np.bitwise_count(y).sum(axis=1)[None].astype(float)
    both = np.stack([np.bitwise_count(f & y).sum(axis=1) for f in x]).astype(float)
    chance, most = nx * ny / FILTER_BITS, np.minimum(nx, ny)
    score = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(axis=1)
    return float((score * nx[:, 0]).sum() / nx.sum())


def to_string(digest: bytes) -> str:
    return base64.b64encode(digest).decode()


def from_string(fingerprint: str) -> bytes:
    return base64.b64decode(fingerprint)


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with a last column of fingerprints; a null text is an empty one.  All rows stay; a column of that name is replaced."""
    kept = [c for c in docs.columns if c != out]
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n in slices(batch.column(at), 2 << 20):
                part = batch.slice(a, n)
                done = digest([(t or "").encode() for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(map(to_string, done), pa.string())], names=[*kept, out])

    rows = docs.select(*kept)
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` string")


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDGE = pa.schema([("part", pa.int64()), ("first_id", pa.int64()), ("first", pa.string()), ("last_id", pa.int64()), ("last", pa.string())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited(text: str, following: str) -> str:
    """text with its last half, rounded down, replaced by as many characters of the next text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(ids: list, texts: list[str]) -> pa.RecordBatch:
    """A row for each text but the last, each compared with the one after it."""
    changed = [edited(t, u) for t, u in zip(texts, texts[1:])]
    own, other = digest([t.encode() for t in texts]), digest([t.encode() for t in changed])
    rows = zip(ids, texts, changed, own, own[1:], other)
    return pa.RecordBatch.from_pylist(
        [{"doc_id": i, "n_chars": len(t), "edited_sha256": hashlib.sha256(c.encode()).hexdigest(), "fingerprint": to_string(x), "edited_fingerprint": to_string(z), "near_edited": likeness(x, z), "near_next": likeness(x, y)} for i, t, c, x, y, z in rows], _OUT
    )


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document, by descending doc_id.

    Documents are range-partitioned by id; a task compares each with the one that follows it in the
    partition.  For the partitions' edges, a task gets each partition's first and last document alone:
    two rows for each partition, however many documents there are.  Null texts are empty, null ids
    come last, equal ids stand in the order of their texts, a lone document is followed by itself.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(n_tasks(docs.sparkSession), F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id"), "text")

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = [], []  # the document that waits for its next
        for batch in batches:
            for a, n in slices(batch.column(1), 2 << 20):
                ids += batch.column(0).slice(a, n).to_pylist()
                texts += batch.column(1).slice(a, n).to_pylist()
                if len(ids) > 1:
                    yield _compare(ids, texts)
                ids, texts = ids[-1:], texts[-1:]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = last = None
        for batch in batches:
            if batch.num_rows:
                ends = [tuple(c[i].as_py() for c in batch.columns) for i in (0, batch.num_rows - 1)]
                first, last = first or ends[0], ends[1]
        if first:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "first_id": first[0], "first": first[1], "last_id": last[0], "last": last[1]}], EDGE)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["part"])
        for here, there in zip(found, found[1:] + found[:1]):
            yield _compare([here["last_id"], None], [here["last"], there["first"]])

    outer = dealt.mapInArrow(edges, "part long, first_id long, first string, last_id long, last string").repartition(1)
    return dealt.mapInArrow(inner, COMPARED).unionByName(outer.mapInArrow(across, COMPARED))
