"""Chunkers over tables: the plain-Python ones run in Arrow batches, a document at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...schemas import CHUNK, LEVEL, PARENT, SEARCHABLE, SUMMARY
from . import texts, windows
from .texts import Block, Draft, Sizing

#: Names and letters of strategies.
ALIASES = {
    "": "AUTO", "AUTO": "AUTO", "F": "FIXED", "FIX": "FIXED", "FIXED": "FIXED", "P": "PARAGRAPH", "PARAGRAPH": "PARAGRAPH", "PARAGRAPH_SEMANTIC": "PARAGRAPH",
    "R": "RECURSIVE", "RECURSIVE": "RECURSIVE", "V": "SEMANTIC_VECTOR", "VECTOR": "SEMANTIC_VECTOR", "SEMANTIC_VECTOR": "SEMANTIC_VECTOR", "SMART": "SMART", "REGEX": "REGEX",
}
#: Metadata keys of chunks.
SECTION, KIND, BLOCKS, PREVIOUS, NEXT, IMAGE = (f"smart_chunker.{k}" for k in ("section_path", "content_type", "source_block_ids", "prev_chunk_id", "next_chunk_id", "primary_image_path"))


def strategy_of(name: str | None) -> str:
    try:
        return ALIASES[(name or "").strip().upper()]
    except KeyError:
        raise ValueError(f"unsupported chunking strategy: {name}") from None


def strategy_column(name: Column) -> Column:
    """strategy_of of rows; null for names that are none."""
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.try_element_at(known, F.upper(F.trim(F.coalesce(name, F.lit("")))))


@dataclass(frozen=True)
class ProcessOptions:
    """Flags of a document's processing: i, t, e for images, tables and equations, ! for no graph, and one chunker's letter."""

    images: bool = False
    tables: bool = False
    equations: bool = False
    graph: bool = True
    strategy: str = "AUTO"

    @classmethod
    def parse(cls, flags: str | None) -> ProcessOptions:
        flags = (flags or "").strip()
        letters = {c for c in flags if c in "FRVP"}
        if len(letters) > 1:
            raise ValueError("at most one chunker may be chosen")
        if odd := set(flags) - set("ite!FRVP"):
            raise ValueError(f"no such flag: {sorted(odd)[0]}")
        return cls("i" in flags, "t" in flags, "e" in flags, "!" not in flags, strategy_of("".join(letters)))


@dataclass(frozen=True)
class ChunkOptions:
    strategy: str = "AUTO"
    granularity: str = "MEDIUM"
    kind: str = "GENERIC"
    rules: Sequence[str] = ()
    embed: Callable | None = None
    threshold: str = "percentile"
    amount: float | None = None
    merge: float | None = 0.80
    size: int | None = None
    overlap: int | None = None
    base: Sizing | None = None
    metadata: dict = field(default_factory=dict)

    def resolved(self) -> ChunkOptions:
        """Sizes by granularity where none are given, and AUTO as REGEX with rules, else SMART."""
        (target, most, over), (size, overlap) = windows.GRANULARITY[self.granularity]
        strategy = strategy_of(self.strategy)
        if strategy == "AUTO":
            strategy = "REGEX" if self.rules else "SMART"
        return replace(self, strategy=strategy, size=self.size or size, overlap=overlap if self.overlap is None else self.overlap, base=self.base or Sizing(target, most, over))


def _draft_rows(doc_id: str, metadata: dict, drafts: list[Draft], strategy: str) -> list[tuple]:
    rows = []
    for i, d in enumerate(drafts):
        own = {SECTION: d.section, KIND: d.kind, BLOCKS: ",".join(d.blocks), PREVIOUS: f"{doc_id}:{i - 1}" if i else "", NEXT: f"{doc_id}:{i + 1}" if i + 1 < len(drafts) else ""}
        image = {IMAGE: d.metadata["image"]} if "image" in d.metadata else {}
        rows.append((f"{doc_id}:{i}", doc_id, d.text, len(d.text), i, metadata | {k: v for k, v in d.metadata.items() if k != "image"} | own | image | {"chunking.mode": strategy}))
    return rows


def chunk_text(doc_id: str, title: str, content: str, metadata: dict, options: ChunkOptions, blocks: list[Block] | None = None) -> list[tuple]:
    """A document's chunks, as rows of CHUNK; options are resolved."""
    o = options
    if o.strategy in ("SMART", "PARAGRAPH"):
        if o.strategy == "PARAGRAPH" and blocks:
            drafts = texts.paragraphs(blocks, o.size, o.overlap)
        elif o.strategy == "SMART":
            drafts = texts.smart(title, content, o.base, o.kind, o.merge, blocks=blocks)
        else:
            drafts = [Draft(t, title, "text", []) for t in texts.recursive(content, o.size, o.overlap)]
        return _draft_rows(doc_id, metadata, drafts, o.strategy)
    extra = {"chunking.mode": o.strategy}
    if o.strategy == "FIXED":
        parts = texts.window_texts(content, o.size, o.overlap) if content.strip() else []
    elif o.strategy == "RECURSIVE":
        parts = texts.recursive(content, o.size, o.overlap)
    elif o.strategy == "SEMANTIC_VECTOR":
        parts = texts.semantic(content, o.size, o.embed, o.threshold, o.amount)
    else:
        parts, reason = texts.by_rules(content, o.rules, o.size, o.overlap)
        extra |= {"chunking.downgraded": "true", "chunking.mode": "FIXED", "chunking.reason": reason} if reason else {"chunking.downgraded": "false"}
    return [(f"{doc_id}:{i}", doc_id, p, len(p), i, metadata | extra) for i, p in enumerate(parts)]


COLUMNS = ["id", "document_id", "text", "token_count", "chunk_order", "metadata"]
TYPES = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()))
#: Rows that become Python objects at a time, and characters and rows of chunks that go out at a time: batches grow with tables, these do not.
SLICE, CHARS, ROWS = 64, 2_000_000, 2_000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The batches' rows as named tuples, of which few are Python objects at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            yield from batch.slice(a, SLICE).to_pandas(integer_object_nulls=True).itertuples(index=False)


def parts_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of CHUNK in bounded batches."""
    out, n = [], 0
    pack = lambda: pa.RecordBatch.from_arrays([pa.array([list(v.items()) for v in c] if name == "metadata" else c, t) for c, name, t in zip(zip(*out), COLUMNS, TYPES)], COLUMNS)
    for row in rows:
        out.append(row)
        n += len(row[2] or "")
        if n > CHARS or len(out) >= ROWS:
            yield pack()
            out, n = [], 0
    if out:
        yield pack()


def chunk_documents(docs: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Chunks of documents (id, title, content, metadata, and blocks if they are parsed)."""
    o = options.resolved()
    if o.strategy == "FIXED":
        return windows.fixed_windows(docs, o.size, o.overlap)
    names = ["id", "title", "content", "metadata", *(["blocks"] if "blocks" in docs.columns else [])]
    none = {"title": F.lit(""), "metadata": F.create_map().cast("map<string,string>")}
    rows = docs.select(*[F.col(c).cast("string").alias(c) if c == "id" else F.col(c) if c in docs.columns else none[c].alias(c) for c in names])

    def chunked(row) -> list[tuple]:
        blocks = [Block(b["block_id"], b["block_type"], b["section_path"] or row.title or "", b["text"] or "") for b in row.blocks] if "blocks" in names and row.blocks is not None and len(row.blocks) else None
        return chunk_text(row.id, row.title or "", row.content or "", dict(row.metadata or {}), o, blocks)

    return rows.mapInArrow(lambda batches: parts_of(c for row in slices(batches) for c in chunked(row)), CHUNK)


def chunk_with(docs: DataFrame, chunker: Callable[[str, str, str, dict], list[str]]) -> DataFrame:
    """Chunks by the caller's own function of (id, title, content, metadata), which returns texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                for i, t in enumerate(chunker(row.id, row.title, row.content, dict(row.metadata or {}))):
                    out.append((f"{row.id}:{i}", row.id, t, len(t), i, dict(row.metadata or {})))
            yield pd.DataFrame(out, columns=COLUMNS)

    return docs.select("id", "title", "content", "metadata").mapInPandas(run, CHUNK)


def parents_and_children(chunks: DataFrame, window: int = 400, overlap: int = 40, enabled: bool = True) -> DataFrame:
    """Chunks as parents, and their searchable children; captions are searchable parents, images neither.

    Children count their orders on after each other in the document.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        n = 0
        for r in rows:
            n = 0 if r.place == 1 else n
            m = dict(r.metadata or {})
            about = texts.summary(r.text, m.get(SECTION, ""))
            m |= {LEVEL: "parent"} | ({SUMMARY: about} if about else {})
            what = texts.kind_of(r.text, m.get(KIND, ""))
            yield (r.id, r.document_id, r.text, r.token_count, r.chunk_order, m | ({SEARCHABLE: str(what == "caption").lower()} if enabled else {}))
            for i, t in enumerate(texts.children(r.text, m.get(KIND, ""), window, overlap) if enabled else []):
                yield (f"{r.id}#child:{i}", r.document_id, t, len(t), n, m | {LEVEL: "child", PARENT: r.id, SEARCHABLE: "true"})
                n += 1

    # the window leaves each document's rows together and in order, so tasks run through all of theirs in one go
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(F.asc_nulls_last("chunk_order"), F.asc_nulls_last("id")))
    return chunks.select(*COLUMNS, place.alias("place")).mapInArrow(lambda batches: parts_of(run(slices(batches))), CHUNK)


def structured_blocks(docs: DataFrame) -> DataFrame:
    """document_id, block_id, block_type, section_path, pos, text of markdown documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(r.id, b.id, b.kind, b.section, i, b.text) for r in batch.itertuples(index=False) for i, b in enumerate(texts.structure(r.title or "", r.content or ""))]
            yield pd.DataFrame(out, columns=["document_id", "block_id", "block_type", "section_path", "pos", "text"])

    rows = docs.select(F.col("id").cast("string").alias("id"), F.col("title") if "title" in docs.columns else F.lit("").alias("title"), "content")
    return rows.mapInPandas(run, "document_id string, block_id string, block_type string, section_path string, pos int, text string")
