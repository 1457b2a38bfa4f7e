"""N-gram Jaccard self-join by prefix trees over globally ordered shingle sets.

A document's set holds the hashes of its distinct word shingles, in one order for all documents:
shingles that many documents share come last, the rest by hash.  Two sets as alike as asked
share one of their first few shingles (their prefix), so only documents with a common prefix shingle can
be linked.  Documents with equal sets are one class from the start.

    1. which shingles are frequent: counts above a batch's threshold, summed over all batches
    2. each document's class, prefix and sketch; written once to the shared folder
    3. of prefix shingles that several classes hold, those that tie a class to another by most of
       its prefix are tried first: the sets of such groups go, once each, to their group, where a trie
       of the sets is searched with every set, and what is linked becomes one component
    4. in what prefix shingles still join different components, sketches bound the overlap of every
       pair from above; pairs that may link go to such tries as well
    5. links make components

A group too large for a task is cut into chunks, and each pair of chunks is a task.  A sketch counts
a set's shingles by buckets of their hashes, in about a byte for each two shingles; the sum of
the lesser counts is an upper bound of an overlap, so no link is lost.

Only the frequent shingles are broadcast (a table of at most FREQUENT, which affects the order
alone, never the result).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import batched
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_tasks, shared_dir, written
from .words import slices

#: Words of a shingle, and the least similarity, in percent.
WORDS, PERCENT = 5, 75
#: A shingle counts as frequent in a batch of documents from so many on; over all, so many are ordered last.
LOCAL, FREQUENT = 3, 1 << 18
#: Shingles of the sets in a chunk of a candidate group.
CHUNK = 4 << 20
#: Edges that one task may join, 16 bytes each.
FEW_EDGES = 1 << 20
#: Members of a prefix shingle's group whose sketches are compared in a task.
MEMBERS = 2000
#: Bytes of texts whose words are hashed at a time.
PIECE = 1 << 20
#: A class is heavy if it holds at least one in so many of all rows, so at most so many are; these are broadcast.
HEAVY = 1000
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LUT = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SALT = np.random.default_rng(8).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z lower-cased, and the number of words of each text.

    Bytes are taken in pieces, which may cut a word: a polynomial of a word's bytes, by their places in
    it, is the sum of its parts' polynomials, each moved by the bytes before it.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    if raw is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    sums, sizes, begins = [], [], []
    for a in range(0, len(data), PIECE):
        part = data[a : a + PIECE]
        cuts = bounds[np.searchsorted(bounds, a + 1) : np.searchsorted(bounds, a + len(part))] - a
        total, size, begin = _fragments(part, cuts)
        if len(begin) and begin[0] == 0 and a and not _SPACE[data[a - 1]] and bounds[np.searchsorted(bounds, a)] != a:
            k = next(k for k in range(len(sizes) - 1, -1, -1) if len(sizes[k]))
            moved = pow(int(_BASE), int(sizes[k][-1]), 1 << 64)
            sums[k][-1] = np.uint64(int(sums[k][-1]) + int(total[0]) * moved & (1 << 64) - 1)
            sizes[k][-1] += size[0]
            total, size, begin = total[1:], size[1:], begin[1:]
        sums.append(total)
        sizes.append(size)
        begins.append(begin + a)
    begins = np.concatenate(begins)
    hashes = _mix(np.concatenate(sums) + np.concatenate(sizes).astype(np.uint64) * _SALT[40])
    return hashes, np.searchsorted(begins, bounds[1:]) - np.searchsorted(begins, bounds[:-1])


def _fragments(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polynomial, size and first byte of each run of word bytes; runs end at the cuts."""
    word = ~_SPACE[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    begins[cuts] |= word[cuts]
    ends[cuts - 1] |= word[cuts - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), begins
    power = _powers(int((ends - begins).max()))
    place = np.arange(len(data)) - np.repeat(np.append(0, begins), np.diff(np.concatenate([[0], begins, [len(data)]])))
    terms = _LUT[_FOLD[data]]
    terms[~word] = 0
    terms[word] *= power[place[word]]
    return np.add.reduceat(terms, begins), ends - begins, begins


@lru_cache(maxsize=1)
def _all_powers() -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(PIECE, _BASE, np.uint64))])


def _powers(n: int) -> np.ndarray:
    return _all_powers()[: n + 1]


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes of all texts, ascending in each, and the size of each set.

    A text of fewer words is one shingle; one without words has an empty set.  Shingles are known by
    64 bits of hash, so a set is wrong by one in about one of 10^19 / its size cases.
    """
    hashes, counts = word_hashes(texts)
    starts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    place = np.arange(len(hashes)) - starts[owner]
    total = np.zeros(len(hashes), np.uint64)
    for k in range(words):
        inside = place + k < counts[owner]
        total += np.where(inside, _mix(padded[k : k + len(hashes)] * _SALT[k]), np.uint64(0))
    total = _mix(total + np.minimum(counts[owner], words).astype(np.uint64))
    full = place <= np.maximum(counts[owner] - words, 0)
    owner, total = owner[full], total[full]
    order = np.lexsort((total, owner))
    owner, total = owner[order], total[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    return total[new], np.bincount(owner[new], minlength=len(counts))


def signatures(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each set's class, 64 bits of its shingles and size; 0 for an empty set."""
    full = np.flatnonzero(sizes)
    out = np.zeros(len(sizes), np.uint64)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        a = np.add.reduceat(_mix(shingles ^ _SALT[50]), starts)
        b = np.bitwise_xor.reduceat(_mix(shingles ^ _SALT[51]), starts)
        out[full] = np.maximum(_mix(_mix(a) + b * _SALT[52] + sizes[full].astype(np.uint64)), np.uint64(1))
    return out.view(np.int64)


def least_common(size_a: int, size_b: int, percent: int = PERCENT) -> int:
    """The least intersection of linked sets: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (size_a + size_b) // (100 + percent))


def prefix_length(size, percent: int = PERCENT):
    """Linked sets share one of so many first shingles: all but the least intersection less one."""
    return size - -(-percent * size // 100) + 1


def union_find(n: int):
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    return parent, find


class Trie:
    """Sets in one order of their items, as a prefix tree: sets with the same first items share a path,
    so an overlap with the path is counted once for all of them.

    Chains without a branch are one edge.  A node knows the least and the largest size of the sets under
    it and the most items that are still to come, which bound what an overlap must and can become.
    """

    __slots__ = ("edge", "children", "least", "most", "rest", "ends")

    def __init__(self, edge: tuple = (), least: int = 1 << 60, most: int = 0, rest: int = 0):
        self.edge, self.children, self.least, self.most, self.rest, self.ends = edge, {}, least, most, rest, []

    def insert(self, items: tuple, size: int, name: int) -> None:
        """A set of `size`, of which `items` may be shared with others."""
        node, at = self, 0
        while True:
            node.least, node.most, node.rest = min(node.least, size), max(node.most, size), max(node.rest, len(items) - at + len(node.edge))
            if at == len(items):
                node.ends.append((name, size))
                return
            child = node.children.get(items[at])
            if child is None:
                node.children[items[at]] = child = Trie(items[at:], size, size, len(items) - at)
                child.ends.append((name, size))
                return
            edge, k = child.edge, 0
            while k < len(edge) and at + k < len(items) and edge[k] == items[at + k]:
                k += 1
            if k < len(edge):  # the edge is cut where the two part
                upper = Trie(edge[:k], child.least, child.most, child.rest)
                upper.children[edge[k]] = child
                child.edge, child.rest = edge[k:], child.rest - k
                node.children[items[at]] = child = upper
            node, at = child, at + k

    def search(self, items: tuple, size: int, percent: int = PERCENT) -> Iterator[int]:
        """Names of all sets that link with one of `size` and these items."""
        where, n = {x: i for i, x in enumerate(items)}, len(items)
        floor = -(-percent * size // 100)
        stack = [(self, 0, 0)]
        while stack:
            node, common, used = stack.pop()
            if node.most < floor or percent * node.least > 100 * size:
                continue
            # a set under the node overlaps by so much at least, if it links
            need, rest = least_common(size, max(node.least, floor), percent), node.rest
            for x in node.edge:
                if common + min(n - used, rest) < need:
                    break
                rest -= 1
                i = where.get(x)
                if i is not None:
                    common, used = common + 1, i + 1
            else:
                if common + min(n - used, rest) >= need:
                    for name, other in node.ends:
                        if common >= least_common(size, other, percent):
                            yield name
                    stack += [(c, common, used) for c in node.children.values()]


def join_sets(sets: list[np.ndarray], roots: list | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (i, j) that join all sets that are linked, directly or by way of others.

    Sets hold distinct shingles in the order of all documents; sets of one root are joined
    already.  They come in by size; each meets the components that hold a shingle of its prefix, and a
    component's tries are searched for a link unless bounds leave no room for one with any of its sets: first the
    components whose first member may link, then the others.  No link between components is missed; links within one are not needed.
    """
    sizes = np.array([len(s) for s in sets])
    if len(sets) < 2:
        return []
    flat = np.concatenate(sets)
    _, code, df = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    prefixes, shared = [], []
    for a, b in zip(bounds, bounds[1:]):
        own = code[a:b]
        first = own[: prefix_length(b - a, percent)]
        prefixes.append(first[df[first] > 1].tolist())
        shared.append(np.sort(rank[own[df[own] > 1]]))
    # the lesser counts by buckets of hashes bound an overlap from above
    bits = max(0, int(np.median(sizes)).bit_length() - 1)
    owner = np.repeat(np.arange(len(sets)), sizes)
    bucket = (flat >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(flat), np.int64)
    counts = np.bincount(owner << bits | bucket, minlength=len(sets) << bits).reshape(len(sets), -1)
    counts = counts.astype(np.min_scalar_type(int(counts.max())))
    parent, find = union_find(len(sets))
    first: dict = {}
    for i, root in enumerate(roots or ()):
        parent[i] = first.setdefault(root, i)
    held: dict[int, set[int]] = {}
    hub: dict[int, int] = {}
    tries: dict[int, list[Trie]] = {}
    label = np.full(len(sets), len(sets))  # of sets that came in: their component
    links: list[tuple[int, int]] = []

    def link(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            links.append((i, j))
            parent[a] = b
            hub[b] = j
            tries.setdefault(b, []).extend(tries.pop(a, ()))
            label[label == a] = b

    def may(i: int, others: np.ndarray) -> np.ndarray:
        """Which of the others may link with i."""
        fit = others[100 * sizes[others] >= percent * sizes[i]]
        most = np.concatenate([np.minimum(counts[p], counts[i]).sum(axis=1, dtype=np.int64) for p in np.array_split(fit, max(1, len(fit) >> 11))])
        return fit[(100 + percent) * most >= percent * (sizes[fit] + sizes[i])]

    for i in np.argsort(sizes, kind="stable").tolist():
        size, met = int(sizes[i]), set()
        for x in prefixes[i]:
            if own := held.get(x):
                now = {find(r) for r in own}
                if len(now) < len(own):
                    held[x] = now
                met |= now
        met.discard(find(i))
        items = tuple(shared[i].tolist())
        if met:
            searched: set[int] = set()

            def meet(r: int, i=i, items=items, size=size, searched=searched) -> None:
                if r != find(i) and r not in searched:
                    searched.add(r)
                    j = next((j for t in tries.get(r, ()) for j in t.search(items, size, percent)), None)
                    if j is not None:
                        link(i, j)

            for j in may(i, np.array([hub[r] for r in met])).tolist():
                meet(find(j))
            asked = np.zeros(len(sets) + 1, bool)
            asked[[r for r in {find(r) for r in met} if r != find(i) and r not in searched]] = True
            if asked.any():
                for r in np.unique(label[may(i, np.flatnonzero(asked[label]))]).tolist():
                    meet(find(r))
        own = find(i)
        label[i] = own
        hub.setdefault(own, i)
        mine = tries.setdefault(own, [])
        if not mine:
            mine.append(Trie())
        mine[0].insert(items, size, i)
        for x in prefixes[i]:
            held.setdefault(x, set()).add(own)
    return links


def every_link(sets: list[np.ndarray], roots: list | None = None, percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """All links (i, j) of sets that hold distinct shingles: each is searched for in a trie of those that are not larger.

    Roots are ignored, as links within a component count as well.
    """
    if len(sets) < 2:
        return
    sizes = np.array([len(s) for s in sets])
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    bounds, trie = np.concatenate([[0], np.cumsum(sizes)]), Trie()
    for i in np.argsort(sizes, kind="stable").tolist():
        own = code[bounds[i] : bounds[i + 1]]
        items = tuple(np.sort(rank[own[df[own] > 1]]).tolist())
        for j in trie.search(items, int(sizes[i]), percent):
            yield j, i
        trie.insert(items, int(sizes[i]), i)


class GlobalOrder:
    """Orders shingles: frequent ones last, by how frequent they are, the rest by hash."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        order = np.argsort(frequent)
        self.frequent, self.rank = frequent[order], np.lexsort((frequent, counts)).argsort()[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(frequent >> np.uint64(42)).astype(np.int64)] = True

    def arrange(self, shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sets that ascend by hash, each put in this order."""
        at = np.flatnonzero(self.maybe[(shingles >> np.uint64(42)).astype(np.int64)])
        if not len(at) or not len(self.frequent):
            return shingles
        k = np.minimum(np.searchsorted(self.frequent, shingles[at]), len(self.frequent) - 1)
        hit = self.frequent[k] == shingles[at]
        place = np.zeros(len(shingles), np.int64)
        place[at[hit]] = 1 + self.rank[k[hit]]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        moved = np.zeros(len(sizes), bool)
        moved[owner[at[hit]]] = True
        some = np.flatnonzero(moved[owner])
        out = shingles.copy()
        out[some] = shingles[some[np.lexsort((place[some], owner[some]))]]
        return out


class Alike(NamedTuple):
    """Words of a shingle, and the least similarity in percent."""

    words: int = WORDS
    percent: int = PERCENT


def _keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


def frequent_shingles(rows: DataFrame, words: int = WORDS) -> GlobalOrder:
    """The order of all documents' shingles; the driver gets FREQUENT pairs of numbers at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_sets(batch.column(1).slice(a, n), words)[0] for a, n in slices(batch.column(1))]
            if found:
                h, c = np.unique(np.concatenate(found), return_counts=True)
                often = c >= LOCAL
                yield pa.RecordBatch.from_pydict({"h": pa.array(h[often].view(np.int64)), "c": pa.array(c[often], pa.int64())})

    summed = rows.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    top = summed.orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()
    return GlobalOrder(top.column("h").to_numpy().astype(np.int64).view(np.uint64), top.column("c").to_numpy())


def components(edges: DataFrame) -> DataFrame:
    """The connected components of edges (a, b): node and root, the component's least node.

    Alternates large and small stars until nothing changes, or until FEW_EDGES are left, which one task
    joins.  Each round is written to the shared folder, so a lost executor repeats no earlier one.
    """
    spark = edges.sparkSession

    def stars(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(low, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).collect()[0])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [np.stack([c.to_numpy() for c in b.columns], axis=1) for b in batches if b.num_rows]
        if pairs:
            nodes, code = np.unique(np.concatenate(pairs), return_inverse=True)
            parent, find = union_find(len(nodes))
            for a, b in code.reshape(-1, 2).tolist():
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[[find(i) for i in range(len(nodes))]])], names=["node", "root"])

    now = written(edges.where("a <> b").distinct(), "edges")
    seen = state(now)
    while seen[0] > FEW_EDGES:
        now = written(stars(stars(now, True), False), "edges")
        seen, before = state(now), seen
        if seen == before:
            break
    else:
        return written(now.repartition(1).mapInArrow(joined, "node long, root long"), "components")
    found = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return found.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def sketch(shingles: np.ndarray) -> bytes:
    """Counts of a set's shingles by the upper bits of their hashes, in a power of two of buckets: half the set's size or less."""
    bits = max(0, int(len(shingles)).bit_length() - 2)
    bucket = (shingles >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(shingles), np.int64)
    return np.minimum(np.bincount(bucket, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def may_link(names: list, sizes: np.ndarray, roots: np.ndarray, sketches: list[bytes], percent: int = PERCENT) -> Iterator[tuple]:
    """Pairs of different roots whose sketches allow a link, enough to join all that such pairs join: fewer pairs than names.

    A full counter, 255, stands for any number.
    """
    order = np.argsort(sizes, kind="stable")
    rows = [np.frombuffer(sketches[i], np.uint8).astype(np.int64) for i in order]
    rows = [np.where(r == 255, 1 << 20, r) for r in rows]
    sizes, roots = sizes[order], roots[order]
    held: dict[int, list] = {}
    tree = np.arange(len(names))
    for k, (row, size) in enumerate(zip(rows, sizes.tolist())):
        width = len(row)
        for w in (width, width // 2):
            if w in held:
                at = np.array(held[w])
                at = at[(100 * sizes[at] >= percent * size) & (roots[at] != roots[k])]
                if len(at):
                    mine = row if w == width else row.reshape(w, -1).sum(axis=1)
                    most = np.minimum(np.stack([rows[j] for j in at]), mine).sum(axis=1)
                    near = at[(100 + percent) * most >= percent * (sizes[at] + size)]
                    for t in np.unique(tree[near]).tolist():
                        if t != tree[k]:
                            yield names[order[near[tree[near] == t][0]]], names[order[k]]
                    tree[np.isin(tree, tree[near])] = tree[k]
        held.setdefault(width, []).append(k)


def _links(rows: DataFrame, table: DataFrame, groups: DataFrame, shared, alike: Alike, known: DataFrame | None = None, search=join_sets) -> DataFrame:
    """Links (a, b) between classes of one group, enough to join all that are linked, or what another search yields.

    known: (class, part) of those joined already.
    """
    spark = rows.sparkSession
    reps = table.where("class <> 0").join(groups, F.col("class") == F.col("node")).groupBy("class", "root").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"))
    reps = written(reps, "candidates")
    chunks = reps.groupBy("root").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"))
    wanted = reps.join(chunks, "root")
    wanted = wanted.join(known, "class", "left") if known is not None else wanted.withColumn("part", F.lit(None).cast("long"))
    wanted = wanted.select("id", "class", "root", "chunks", F.coalesce("part", "class").alias("part"))
    fetched = rows.join(wanted.hint("shuffle_hash"), rows["doc_id"] == wanted["id"]).select("class", "root", "chunks", "text", "part")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            for a, n in slices(batch.column(3)):
                part = batch.slice(a, n)
                shingles, sizes = shingle_sets(part.column(3), alike.words)
                # a doc_id may have other rows, of another class
                same = signatures(shingles, sizes) == part.column(0).to_numpy()
                raw, ends = order.arrange(shingles, sizes).tobytes(), np.cumsum(sizes) * 8
                held = pa.array([raw[e - 8 * k : e] for e, k in zip(ends.tolist(), sizes.tolist())], pa.binary())
                out = pa.RecordBatch.from_arrays([*part.columns[:3], part.column(4), held], names=["class", "root", "chunks", "part", "shingles"])
                yield out.filter(pa.array(same))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, own, parts = None, [], [], []

        def links():
            for found in batched(search(own, parts, alike.percent), 1 << 16):
                a, b = (pa.array([names[p[k]] for p in found], pa.int64()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        for batch in batches:
            for root, i, j, name, part, held in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, i, j) != key:
                    if len(own) > 1:
                        yield from links()
                    key, names, own, parts = (root, i, j), [], [], []
                if not names or names[-1] != name:  # sorted by name: copies stand together
                    names.append(name)
                    parts.append(part)
                    own.append(np.frombuffer(held, np.uint64))
        if len(own) > 1:
            yield from links()

    pairs = _chunk_pairs(F.pmod(F.hash("class"), F.col("chunks")), F.col("chunks"))
    dealt = fetched.mapInArrow(sets, "class long, root long, chunks int, part long, shingles binary").select("root", "class", "part", "shingles", F.explode(pairs).alias("p"))
    keyed = dealt.select("root", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "class", "part", "shingles").repartition(n_tasks(spark), "root", "i", "j").sortWithinPartitions("root", "i", "j", "class")
    return keyed.mapInArrow(joined, "a long, b long").distinct()


def _distinct_groups(members: DataFrame) -> DataFrame:
    """token and size: one shingle for each set of classes that join different components; members are distinct (token, class, root).

    Sets of classes are told apart by their size and two hashes of 64 bits.
    """
    mixed = members.groupBy("token").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"),
        F.bit_xor(F.xxhash64("class")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("h2"),
    ).where("low < high")
    return mixed.groupBy("h1", "h2", "size").agg(F.min("token").alias("token")).select("token", "size")


def _chunk_pairs(mine, chunks):
    """The pairs of chunks that a member of chunk `mine` belongs to; (0, 0) where there is one chunk."""
    others = F.filter(F.sequence(F.lit(0), chunks - 1), lambda x: (x != mine) | (chunks == 1))
    return F.transform(others, lambda x: F.struct(F.least(x, mine).alias("i"), F.greatest(x, mine).alias("j")))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, the least doc_id that links reach.

    Texts null or without a word have an empty set, link with nothing and are their own component; so
    are rows without a doc_id, whose component_id is null.  Repeated rows are in one class; an empty table
    gives no rows.  Classes are told apart by 64 bits of hash.  Other columns are not read.  A worker needs
    about ten times the size of its longest text.
    """
    if words < 1 or not 0 < percent <= 100:
        raise ValueError("shingles of a word at least, and a similarity of 1 to 100 percent")
    found = _joined(_keyed(docs, id_col, text_col), Alike(words, percent))
    return _with_firsts(found).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"))


class Joined(NamedTuple):
    """Keyed texts, their table of classes, links that join all linked classes, and the broadcast order."""

    rows: DataFrame
    table: DataFrame
    links: DataFrame
    shared: object
    alike: Alike


def _joined(rows: DataFrame, alike: Alike = Alike()) -> Joined:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(frequent_shingles(rows, alike.words))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, set()
        for batch in batches:
            for a, n in slices(batch.column(1)):
                shingles, sizes = shingle_sets(batch.column(1).slice(a, n), alike.words)
                classes, arranged = signatures(shingles, sizes), order.arrange(shingles, sizes)
                classes[batch.column(0).slice(a, n).is_null().to_numpy(zero_copy_only=False)] = 0
                starts, heads, sketches = np.cumsum(sizes) - sizes, [], []
                for s, size, c in zip(starts.tolist(), sizes.tolist(), classes.tolist()):
                    # copies in one task need no prefix of their own
                    new = c and c not in seen
                    heads.append(arranged[s : s + prefix_length(size, alike.percent)].view(np.int64) if new else None)
                    sketches.append(sketch(shingles[s : s + size]) if new else None)
                    if len(seen) < 1_000_000:
                        seen.add(c)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, n), "h": batch.column(2).slice(a, n), "n": pa.array(sizes, pa.int32()), "class": pa.array(classes), "prefix": pa.array(heads, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.binary())})

    table = written(rows.mapInArrow(prefixes, "doc_id long, h long, n int, class long, prefix array<bigint>, sketch binary"), "prefixes")
    tokens = table.where("prefix IS NOT NULL").select("class", F.explode("prefix").alias("token")).repartition(n_tasks(spark), "token")
    low = tokens.groupBy("token").agg(F.min("class").alias("b"), F.max("class").alias("top")).where("b < top")
    # a class comes once from each task with a copy; each shingle holds it once, or its copies cancel in a xor
    shared_tokens = written(tokens.join(low, "token").select("token", "class", "b").distinct(), "tokens")
    known = table.where("prefix IS NOT NULL").groupBy("class").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    votes = shared_tokens.where("class <> b").groupBy("class", "b").agg(F.count(F.lit(1)).alias("votes"))
    least = F.col("n") - F.ceil(F.col("n") * alike.percent / 100) + 1
    strong = votes.join(known.select("class", "n"), "class").where(2 * F.col("votes") >= least).select(F.col("class").alias("a"), "b")
    first = written(_links(rows, table, components(strong), shared, alike), "links")
    joined = components(first).select(F.col("node").alias("class"), "root")
    members = shared_tokens.join(joined, "class", "left").select("token", "class", F.coalesce("root", "class").alias("root"))
    # shingles held by the same classes ask the same, so one of them is enough
    asked = _distinct_groups(members).select("token", F.ceil(F.col("size") / MEMBERS).cast("int").alias("chunks"))
    mine = F.pmod(F.hash("class"), F.col("chunks"))
    own = members.join(asked, "token").join(known, "class").select("token", "class", "root", "n", "sketch", F.explode(_chunk_pairs(mine, F.col("chunks"))).alias("p"))
    dealt = own.select("token", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "class", "root", "n", "sketch").repartition(n_tasks(spark), "token", "i", "j").sortWithinPartitions("token", "i", "j")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], set()

        def flush() -> None:
            names, roots, sizes, sketches = zip(*held)
            out.update((min(a, b), max(a, b)) for a, b in may_link(names, np.array(sizes), np.array(roots), sketches, alike.percent))

        for batch in batches:
            for token, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (token, i, j) != key:
                    if len(held) > 1:
                        flush()
                    key, held = (token, i, j), []
                held.append(row)
            a, b = (pa.array([p[k] for p in out], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])
            out = set()
        if len(held) > 1:
            flush()
            a, b = (pa.array([p[k] for p in out], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    more = _links(rows, table, components(dealt.mapInArrow(bounded, "a long, b long")), shared, alike, joined.withColumnRenamed("root", "part"))
    return Joined(rows, table, first.unionByName(more), shared, alike)


def _firsts(found: Joined) -> DataFrame:
    """class, copies and first: doc_id and hash of the text of the least row of its component."""
    classes = found.table.where("class <> 0").groupBy("class").agg(F.min(F.struct("doc_id", "h")).alias("least"), F.count(F.lit(1)).alias("copies"))
    rooted = classes.join(components(found.links), F.col("class") == F.col("node"), "left").select("class", "copies", "least", F.coalesce("root", "class").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("first")), "root").select("class", "copies", "first")


def _with_firsts(found: Joined) -> DataFrame:
    """The table with `first` (null for empty sets), without sending a class that holds many rows to one task."""
    firsts = written(_firsts(found), "firsts")
    few = found.table.count() / HEAVY
    heavy = firsts.where(F.col("copies") >= few).select("class", "first", F.lit(True).alias("heavy"))
    marked = found.table.join(F.broadcast(heavy), "class", "left")  # at most HEAVY rows
    done = marked.where("heavy OR class = 0").drop("heavy")
    rest = marked.where("heavy IS NULL AND class <> 0").drop("heavy", "first").join(firsts.where(F.col("copies") < few).select("class", "first"), "class")
    return done.unionByName(rest)


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All links (a, b), a < b or of one repeated doc_id, between the least doc_ids of classes of equal sets.

    A link never leaves its component, so the tries of each component are searched once more, for every link.
    """
    found = _joined(_keyed(docs, id_col, text_col))
    every = _links(found.rows, found.table, components(found.links), found.shared, found.alike, search=every_link)
    ids = found.table.where("class <> 0").groupBy("class").agg(F.min("doc_id").alias("id"))
    named = every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for end in "ab":
        named = named.join(ids.select(F.col("class").alias(end), F.col("id").alias(f"id_{end}")), end)
    return named.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each component one row stays, with all columns: one of its least doc_id.

    Rows are known by doc_id and text, so of a repeated doc_id only the texts that are near copies go.  Of
    several texts of the least doc_id in a component that of the least hash stays, and of rows that repeat
    both any one.  Rows without a doc_id, and documents without a word, stay.
    """
    found = _joined(_keyed(docs))
    rows = _with_firsts(found).where("class <> 0").groupBy("doc_id", "h").agg(F.first("first").alias("first"), F.count(F.lit(1)).alias("n"))
    last = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    marks = written(rows.where(~last | (F.col("n") > 1)).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), last.alias("__kept")), "repeats")
    keyed = docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__text": F.xxhash64(F.col("text").cast("string"))})
    same = (F.col("__doc") == F.col("__id")) & (F.col("__text") == F.col("__h"))
    # texts are shuffled once: the window goes by the join's keys
    marked = keyed.join(marks.hint("shuffle_hash"), same, "left")
    turn = F.row_number().over(Window.partitionBy("__doc", "__text").orderBy("__doc"))
    return marked.withColumn("__turn", turn).where(F.col("__kept").isNull() | (F.col("__kept") & (F.col("__turn") == 1))).select(*docs.columns)
