"""Documents from files: plain text, block sidecars, pages, pre-chunked rows and evaluation sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank, first_non_blank

#: File endings and media types by kind of source.
SIDECAR = (".blocks.jsonl",)
PLAIN, PLAIN_TYPES = (".txt", ".md", ".markdown"), ("text/plain", "text/markdown", "text/x-markdown")
IMAGES, OFFICE, PDF, HTML = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".tif", ".tiff"), (".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx"), (".pdf",), (".html", ".htm")
BLOCK_LINE = "type string, block_id string, block_type string, text string, section_path string, page_no int, document_id string, title string, doc_id string, id string"


def source_kind(file_name: Column, media_type: Column) -> Column:
    """sidecar, plain, image, office, pdf, html or unsupported."""
    name, media = F.lower(file_name), F.lower(F.coalesce(media_type, F.lit("")))
    ends = lambda suffixes: F.greatest(*[F.endswith(name, F.lit(s)) for s in suffixes], F.lit(False))
    return (
        F.when(ends(SIDECAR), "sidecar").when(ends(PLAIN) | media.isin(*PLAIN_TYPES), "plain").when(ends(IMAGES) | F.startswith(media, F.lit("image/")), "image")
        .when(ends(OFFICE) | media.contains("officedocument") | media.isin("application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint"), "office")
        .when(ends(PDF) | (media == "application/pdf"), "pdf").when(ends(HTML) | (media == "text/html"), "html").otherwise("unsupported")
    )


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Files as raw sources: source_id, file_name, media_type, bytes, metadata."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.sha2("path", 256).alias("source_id"), name.alias("file_name"), F.lit("").alias("media_type"), F.col("content").alias("bytes"), F.create_map(F.lit("file_path"), F.col("path")).alias("metadata"))


def parse_plain(sources: DataFrame) -> DataFrame:
    """Documents of plain-text sources, with the mode and backend of parsing."""
    marks = F.create_map(F.lit("parse_mode"), F.lit("plain"), F.lit("parse_backend"), F.lit("text"))
    return sources.where(source_kind(F.col("file_name"), F.col("media_type")) == "plain").select(
        F.col("source_id").alias("id"), F.col("file_name").alias("title"), F.decode("bytes", "UTF-8").alias("content"), F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), marks).alias("metadata")
    )


def parse_sidecars(lines: DataFrame) -> DataFrame:
    """Parsed documents of block sidecars, from their lines (source_id, file_name, pos, line).

    The meta line names document and title; content lines are blocks in order; the plain text
    is the blocks' texts apart by blank lines.
    """
    read = lines.where(~blank("line")).select("source_id", "file_name", "pos", F.from_json("line", BLOCK_LINE).alias("b"))
    block = F.struct(
        "pos", F.coalesce("b.block_id", F.concat(F.col("source_id"), F.lit(":"), F.col("pos").cast("string"))).alias("block_id"), F.coalesce("b.block_type", F.lit("paragraph")).alias("block_type"),
        F.coalesce("b.text", F.lit("")).alias("text"), F.col("b.section_path").alias("section_path"), F.col("b.page_no").alias("page_no"),
    )
    grouped = read.groupBy("source_id", "file_name").agg(
        F.max(F.when(F.col("b.type") == "meta", F.struct(first_non_blank("b.document_id", "b.doc_id", "b.id").alias("document_id"), F.col("b.title").alias("title")))).alias("meta"),
        F.array_sort(F.collect_list(F.when(F.col("b.type") == "content", block))).alias("blocks"),
    )
    texts = F.filter(F.transform("blocks", lambda b: b["text"]), lambda t: F.trim(t) != "")
    return grouped.select(
        F.coalesce("meta.document_id", "source_id").alias("id"), F.coalesce("meta.title", "file_name").alias("title"), F.array_join(texts, "\n\n").alias("content"), "blocks",
        F.create_map(F.lit("parse_mode"), F.lit("sidecar"), F.lit("parse_backend"), F.lit("blocks_jsonl")).alias("metadata"),
    )


def sidecar_lines(sources: DataFrame) -> DataFrame:
    own = sources.where(source_kind(F.col("file_name"), F.col("media_type")) == "sidecar")
    return own.select("source_id", "file_name", F.posexplode(F.split(F.decode("bytes", "UTF-8"), r"\r?\n")).alias("pos", "line"))


def parse_complex(sources: DataFrame, parser: Callable[[str, str, bytes], tuple[str, str]] | None) -> DataFrame:
    """Images, office files, PDF and HTML through the caller's parser of (file_name, media_type, bytes) to (title, text).

    Without a parser they are an error; one source's failure is its row's `error`.
    """
    kinds = ("image", "office", "pdf", "html")
    own = sources.where(source_kind(F.col("file_name"), F.col("media_type")).isin(*kinds))
    if parser is None:
        wrong = F.raise_error(F.concat(F.lit("no parser for "), "file_name")).cast("string")
        return own.select(F.col("source_id").alias("id"), wrong.alias("title"), F.lit("").alias("content"), F.lit("").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                try:
                    out.append((r.source_id, *parser(r.file_name, r.media_type, r.bytes), None))
                except Exception as e:  # one bad file must not stop the rest; it is reported in its row
                    out.append((r.source_id, r.file_name, "", str(e)))
            yield pd.DataFrame(out, columns=["id", "title", "content", "error"])

    return own.select("source_id", "file_name", "media_type", "bytes").mapInPandas(run, "id string, title string, content string, error string")


def routed(sources: DataFrame) -> DataFrame:
    """Each source's kind and, for those nothing can read, the error for its status."""
    kind = source_kind(F.col("file_name"), F.col("media_type"))
    return sources.withColumn("kind", kind).withColumn("error", F.when(kind == "unsupported", F.concat(F.lit("unsupported source: "), "file_name")))


def html_text(html: Column) -> Column:
    """The text of a page's paragraphs and headings, without scripts, styles, comments and tags."""
    s = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|head)\b.*?</\1>|<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?i)</?(p|div|h[1-6]|li|br|tr|article|section)\b[^>]*>", "\n")
    s = F.regexp_replace(s, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def grouped_chunks(chunks: DataFrame) -> DataFrame:
    """Pre-chunked rows (document_id, id, text, chunk_order) by document: id, content, chunks in order."""
    packed = F.array_sort(F.collect_list(F.struct("chunk_order", "id", "text")))
    g = chunks.groupBy("document_id").agg(packed.alias("chunks"))
    return g.select(F.col("document_id").alias("id"), F.array_join(F.transform("chunks", lambda c: c["text"]), "\n").alias("content"), F.size("chunks").alias("n_chunks"), "chunks")


def markdown_documents(spark: SparkSession, path: str) -> DataFrame:
    """A folder's markdown files: id is the file's name as a slug, title its first heading."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.input_file_name().alias("path"))
    return files.select(slug(F.regexp_extract("path", r"([^/]+?)(\.[A-Za-z]+)?$", 1)).alias("id"), first_heading(F.col("content")).alias("title"), "content")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def first_heading(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"(?m)^#{1,6}\s+(.+)$", 1))


def text_segments(chunks: DataFrame) -> DataFrame:
    """Chunks as (text, metadata), with their ids among the metadata."""
    own = F.create_map(F.lit("chunk_id"), F.col("id"), F.lit("document_id"), F.col("document_id"), F.lit("order"), F.col("chunk_order").cast("string"))
    return chunks.select("text", F.map_concat(own, F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("chunk_id", "document_id", "order"))).alias("metadata"))


def retrieval_cases(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cases, documents) of a benchmark in three tables: corpus (_id, title, text), queries (_id, text), qrels (query_id, corpus_id, score)."""
    good = qrels.where("score > 0").groupBy("query_id").agg(F.array_sort(F.collect_set("corpus_id")).alias("relevant_doc_ids"))
    cases = queries.join(good, queries["_id"] == good["query_id"]).select(F.col("_id").alias("case_id"), F.col("text").alias("question"), "relevant_doc_ids")
    if most is not None:
        cases = cases.orderBy("case_id").limit(most)
    used = cases.select(F.explode("relevant_doc_ids").alias("_id")).distinct()
    return cases, corpus.join(used, "_id", "left_semi").select(F.col("_id").alias("id"), "title", F.col("text").alias("content"))


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, tasks: int = 8, **options: str) -> DataFrame:
    """A database table; with a numeric key and its bounds, read by several tasks."""
    r = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key and bounds:
        r = r.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=tasks)
    return r.load()


def write_jdbc(rows: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()


