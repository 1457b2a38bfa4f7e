"""Chunkers, text noise and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters
from ..operators.chunking import frames, windows
from ..operators.chunking.texts import Sizing
from ..schemas import LEVEL, SEARCHABLE
from ..sources import files
from .base import register, table

QUERIES: dict = {}
SQL: dict = {}


def _documents(spark, sf_dir):
    m = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"), m.alias("metadata"))


def _digest(chunks):
    """Chunks as oracles compare them: texts by their hash."""
    return chunks.select("id", "document_id", "chunk_order", "token_count", F.sha2("text", 256).alias("text_sha256"))


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WINDOWS = "unnest(range(0, CASE WHEN length({0}) <= {1} THEN 1 ELSE ceil((length({0}) - {1}) / {2}.0)::INT + 1 END))"
NUMBERED = "SELECT document_id || ':' || (row_number() OVER w - 1) AS id, document_id, (row_number() OVER w - 1)::INT AS chunk_order, length(t)::INT AS token_count, sha256(t) AS text_sha256 FROM ({}) WHERE t <> '' WINDOW w AS (PARTITION BY document_id ORDER BY {})"
C1 = NUMBERED.format(f"SELECT document_id, i, trim(substr(text, (i * 900 + 1)::INT, 1000), {BLANKS}) AS t FROM (SELECT doc_id::VARCHAR AS document_id, text, {WINDOWS.format('text', 1000, 900)} AS i FROM documents)", "i")


@register(QUERIES, SQL, C1)
def c1_fixed_windows(spark, sf_dir):
    return _digest(windows.fixed_windows(_documents(spark, sf_dir), 1000, 100))


C2 = NUMBERED.format(
    f"SELECT document_id, p, i, trim(substr(line, (i * 250 + 1)::INT, 300), {BLANKS}) AS t FROM (SELECT document_id, p, line, {WINDOWS.format('line', 300, 250)} AS i FROM (SELECT doc_id::VARCHAR AS document_id, generate_subscripts(string_split(text, chr(10)), 1) AS p, unnest(string_split(text, chr(10))) AS line FROM documents))", "p, i"
)


@register(QUERIES, SQL, C2)
def c2_split_by_line(spark, sf_dir):
    return _digest(windows.split_by(_documents(spark, sf_dir), "\n", 300, 50))


def _by(strategy: str, **more):
    def run(spark, sf_dir):
        c = frames.chunk_documents(_documents(spark, sf_dir), frames.ChunkOptions(strategy, **more))
        return _digest(c)

    return run


def _embed(texts):
    """Shares of a few letters: enough to tell sentences apart."""
    return [[1.0 + t.lower().count(c) for c in "etaoinsr"] for t in texts]


for name, query in (
    ("c3_recursive", _by("R")), ("c4_regex", _by("REGEX", rules=(r"^[A-ZÀ-Ý][^\n]{0,40}\.$",))), ("c5_semantic_vector", _by("V", embed=_embed)),
    ("c7_smart", _by("SMART", granularity="FINE", merge=None)), ("c11_merged_neighbours", _by("SMART", base=Sizing(150, 300, 20), merge=0.3)), ("c17_orchestrated", _by("AUTO", granularity="COARSE")),
):
    QUERIES[name] = query


@register(QUERIES, SQL)
def c8_structure(spark, sf_dir):
    b = frames.structured_blocks(_documents(spark, sf_dir))
    return b.select("document_id", "block_id", "block_type", "pos", F.char_length("text").alias("n_chars"))


C10 = """WITH s AS (SELECT doc_id, len(list_filter(string_split_regex(text, '[.?!][ \\n\\t]+'), lambda x: x <> '')) AS n, n_chars, source FROM documents), r AS (
SELECT doc_id, source = 'src1' AS heading, source = 'src2' AS law, n, n_chars // greatest(n, 1) AS a FROM s), q AS (
SELECT *, CASE WHEN law THEN 1.08 ELSE 1.35 END AS top, CASE WHEN heading THEN 0.75 ELSE 1.0 END AS r0 FROM r), q1 AS (
SELECT *, CASE WHEN n <= 2 OR a <= 48 THEN least(r0, 0.90) ELSE r0 END AS r1 FROM q), q2 AS (
SELECT *, least(greatest(CASE WHEN n >= 6 AND a >= 60 THEN greatest(r1, CASE WHEN law THEN 1.05 ELSE 1.35 END) ELSE r1 END, 0.75), top) AS ratio FROM q1), q3 AS (
SELECT *, greatest(600, least(floor(800 * top + 0.5)::INT, floor(800 * ratio + 0.5)::INT)) AS target, CASE WHEN ratio >= 1 THEN least(top, 1 + (ratio - 1) * 0.90) WHEN heading THEN greatest(0.75, ratio + 0.02) ELSE greatest(0.75, ratio + 0.10) END AS wide FROM q2)
SELECT doc_id, target::INT AS target, greatest(target, least(floor(1200 * top + 0.5)::INT, floor(1200 * wide + 0.5)::INT))::INT AS most FROM q3"""


@register(QUERIES, SQL, C10)
def c10_adaptive_sizes(spark, sf_dir):
    """Sizes for each document as a paragraph; one source counts as headed, one as law."""
    d = table(spark, sf_dir, "documents")
    n = F.size(F.filter(F.split("text", r"[.?!][ \n\t]+"), lambda x: x != ""))
    rows = d.select("doc_id", "source", n.alias("n"), F.floor(F.col("n_chars") / F.greatest(n, F.lit(1))).cast("int").alias("a"))
    s = windows.sizing(800, 1200, 100, F.when(F.col("source") == "src2", "LAW").otherwise("GENERIC"), F.col("source") == "src1", F.col("n"), F.col("a"))
    return rows.withColumn("s", s).select("doc_id", "s.target", "s.most")


C12 = """WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '[^a-zà-öø-ÿœß0-9]+'), lambda x: x <> '')) AS w FROM conversations), p AS (SELECT conv_id, turn, w, lead(w) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM t)
SELECT conv_id, turn, round(CASE WHEN least(len(w), len(n)) = 0 THEN 0 ELSE len(list_intersect(w, n))::DOUBLE / least(len(w), len(n)) END, 6) AS similarity FROM p WHERE n IS NOT NULL"""


@register(QUERIES, SQL, C12)
def c12_word_overlap(spark, sf_dir):
    """How alike a turn is to the next."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("next", after).where("next IS NOT NULL").select("conv_id", "turn", F.round(windows.token_overlap(F.col("text"), F.col("next")), 6).alias("similarity"))


@register(QUERIES, SQL)
def c13_parents_and_children(spark, sf_dir):
    c = frames.parents_and_children(windows.fixed_windows(_documents(spark, sf_dir), 1000, 100))
    return c.select("id", "document_id", "chunk_order", F.col("metadata")[LEVEL].alias("level"), F.sha2("text", 256).alias("text_sha256"))


C14 = "SELECT conv_id, turn FROM (SELECT *, max((role = 'system')::INT) OVER (PARTITION BY conv_id) AS flagged, max((role = 'assistant')::INT) OVER (PARTITION BY conv_id) AS kids FROM conversations) WHERE CASE WHEN flagged = 1 THEN role = 'system' WHEN kids = 1 THEN role = 'assistant' ELSE role <> 'assistant' END"


@register(QUERIES, SQL, C14)
def c14_searchable(spark, sf_dir):
    """System turns are marked searchable, assistant turns are children."""
    c = table(spark, sf_dir, "conversations")
    m = F.when(F.col("role") == "system", F.create_map(F.lit(SEARCHABLE), F.lit("true"))).when(F.col("role") == "assistant", F.create_map(F.lit(LEVEL), F.lit("child"))).otherwise(F.create_map(F.lit(LEVEL), F.lit("parent")))
    rows = c.select(F.col("conv_id").alias("document_id"), "turn", m.alias("metadata"))
    return windows.searchable(rows).select(F.col("document_id").alias("conv_id"), "turn")


C4 = f"""WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text <> '')
), g AS (SELECT *, sum(regexp_full_match(line, '[A-ZÀ-Ý].{{0,40}}\\.')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM l
), p AS (SELECT doc_id, part, trim(string_agg(line, chr(10) ORDER BY pos), {BLANKS}) AS t FROM g GROUP BY ALL), many AS (SELECT doc_id FROM p WHERE t <> '' GROUP BY doc_id HAVING count(*) > 1)
""" + NUMBERED.format(f"SELECT doc_id::VARCHAR AS document_id, part AS i, t FROM p WHERE doc_id IN (FROM many) UNION ALL SELECT document_id, i, trim(substr(text, (i * 900 + 1)::INT, 1000), {BLANKS}) AS t FROM (SELECT doc_id::VARCHAR AS document_id, text, {WINDOWS.format('text', 1000, 900)} AS i FROM documents WHERE doc_id NOT IN (FROM many))", "i")
SQL["c4_regex"] = C4


@register(QUERIES, SQL)
def c6_paragraphs(spark, sf_dir):
    """Conversations as parsed documents: turns as paragraphs, and as tables in Markdown, HTML and JSON with a row for each sentence."""
    c = table(spark, sf_dir, "conversations")
    cells = F.filter(F.split(F.regexp_replace("text", r"[|<>\s]+", " "), r"(?<=[.?!]) "), lambda s: F.trim(s) != "")
    markdown = F.concat(F.lit("| n | said |\n|---|---|\n"), F.array_join(F.transform(cells, lambda s, i: F.concat(F.lit("| "), i.cast("string"), F.lit(" | "), s, F.lit(" |"))), "\n"))
    html = F.concat(F.lit("<table><tr><th>n</th><th>said</th></tr>"), F.array_join(F.transform(cells, lambda s, i: F.concat(F.lit("<tr><td>"), i.cast("string"), F.lit("</td><td>"), s, F.lit("</td></tr>"))), ""), F.lit("</table>"))
    rows = F.to_json(F.concat(F.array(F.array(F.lit("n"), F.lit("said"))), F.transform(cells, lambda s, i: F.array(i.cast("string"), s))))
    kind = F.col("turn") % 4
    text = F.when(kind == 1, markdown).when(kind == 2, html).when(kind == 3, rows).otherwise(F.col("text"))
    block = F.struct(F.col("turn"), F.col("turn").cast("string").alias("block_id"), F.when(kind == 0, "PARAGRAPH").otherwise("TABLE").alias("block_type"), text.alias("text"), F.concat(F.lit("Talk"), F.when(F.col("turn") >= 4, " > Later").otherwise("")).alias("section_path"))
    d = c.groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    d = d.select("id", F.lit("Talk").alias("title"), F.lit("").alias("content"), F.create_map().cast("map<string,string>").alias("metadata"), F.transform("blocks", lambda b: b.dropFields("turn")).alias("blocks"))
    return _digest(frames.chunk_documents(d, frames.ChunkOptions("P")))


C18 = "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'FIXED' WHEN 1 THEN 'RECURSIVE' WHEN 2 THEN 'SEMANTIC_VECTOR' WHEN 3 THEN 'AUTO' WHEN 4 THEN 'PARAGRAPH' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'SMART' END END AS strategy FROM part"


@register(QUERIES, SQL, C18)
def c18_strategy_names(spark, sf_dir):
    """Names by parts' sizes, in many spellings; unknown ones have no strategy."""
    names = F.array(*[F.lit(n) for n in ("F", "r", " vector ", "", "paragraph_semantic")])
    name = F.coalesce(F.get(names, F.col("p_size") % 6), F.when(F.col("p_partkey") % 2 == 0, "Smart").otherwise("clever"))
    return table(spark, sf_dir, "part").select("p_partkey", frames.strategy_column(name).alias("strategy"))


C19 = r"""SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(replace(text || ' an exam-' || chr(10) || 'ple, 5 \% more', '\%', '%'), '([0-9])\s+%', '\1%', 'g'), '([A-Za-z]{2})-\n([A-Za-z]{2})', '\1\2', 'g'), '([A-Za-z]{2})-\n([A-Za-z]{2})', '\1\2', 'g')) AS n FROM documents"""


@register(QUERIES, SQL, C19)
def c19_ocr_repair(spark, sf_dir):
    """All documents, each with a word broken at a line's end and an escaped percent sign; in SQL twice, as breaks that share a word overlap."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.char_length(filters.repair_ocr(F.concat("text", F.lit(" an exam-\nple, 5 \\% more")))).cast("long").alias("n"))


@register(QUERIES, SQL, "SELECT conv_id::VARCHAR AS document_id, 'orders with gaps' AS problem FROM (SELECT conv_id, count(*) AS n, min(turn) AS a, max(turn) AS b FROM conversations WHERE role <> 'system' GROUP BY conv_id) WHERE a <> 0 OR b <> n - 1")
def c21_contract(spark, sf_dir):
    """Conversations without their system turns: orders no longer count from 0."""
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    rows = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("chunk_order"))
    return windows.contract_errors(rows, c.select(F.col("conv_id").alias("id")).distinct())


P11 = "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' AND NOT regexp_full_match(line, '[-_\\s]*\\d+(\\s*/\\s*\\d+)?[-_\\s]*') AND NOT regexp_full_match(line, '[A-Za-z0-9()\\-,:;\\s]+[.]{2,}\\s*\\d+') AND NOT regexp_full_match(line, '[._\\-\\s]{3,}') GROUP BY doc_id"


@register(QUERIES, SQL, P11)
def p11_noise_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return filters.content_lines(d).groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))


P12 = "SELECT source AS document_id, line AS text, count(DISTINCT doc_id) AS pages FROM (SELECT source, doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' AND length(line) <= 32 AND NOT regexp_matches(line, '[。！？.!?:：,，;；]') GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3"


def _blocks(spark, sf_dir):
    """Each source as a document, its texts as pages, their lines as blocks."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("document_id"), F.col("doc_id").cast("int").alias("page_no"), F.explode(F.split("text", "\n")).alias("text"))


@register(QUERIES, SQL, P12)
def p12_page_chrome(spark, sf_dir):
    return filters.page_chrome(_blocks(spark, sf_dir))


@register(QUERIES, SQL, f"WITH c AS ({P12}), b AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT source AS document_id, count(*) AS n FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.document_id = b.source AND c.text = trim(b.line)) GROUP BY source")
def a8_without_page_chrome(spark, sf_dir):
    return filters.without_page_chrome(_blocks(spark, sf_dir)).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


@register(QUERIES, SQL, "SELECT doc_id::VARCHAR AS id, length(text) AS n, 'plain' AS parse_mode FROM documents")
def s3_plain_text(spark, sf_dir):
    """Texts as the bytes of markdown files, read back."""
    d = table(spark, sf_dir, "documents")
    raw = d.select(F.col("doc_id").cast("string").alias("source_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".MD")).alias("file_name"), F.lit("").alias("media_type"), F.encode("text", "UTF-8").alias("bytes"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    return files.parse_plain(raw).select("id", F.char_length("content").cast("long").alias("n"), F.col("metadata")["parse_mode"].alias("parse_mode"))


S4 = "SELECT conv_id::VARCHAR AS id, 'Conversation ' || conv_id AS title, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS content_sha256, count(*) AS n_blocks FROM conversations WHERE trim(text) <> '' GROUP BY conv_id"


@register(QUERIES, SQL, S4)
def s4_sidecars(spark, sf_dir):
    """Conversations as block sidecars: a meta line and a content line for each turn."""
    c = table(spark, sf_dir, "conversations")
    body = c.select(F.col("conv_id").cast("string").alias("source_id"), (F.col("turn") + 1).cast("int").alias("pos"), F.to_json(F.struct(F.lit("content").alias("type"), "text")).alias("line"))
    head = c.select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("source_id"), F.lit(0).alias("pos"), F.to_json(F.struct(F.lit("meta").alias("type"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"))).alias("line"))
    d = files.parse_sidecars(head.unionByName(body).withColumn("file_name", F.lit("x.blocks.jsonl")))
    return d.select("id", "title", F.sha2("content", 256).alias("content_sha256"), F.size("blocks").cast("long").alias("n_blocks"))


S5 = "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'sidecar' WHEN 1 THEN 'plain' WHEN 2 THEN 'image' WHEN 3 THEN 'office' WHEN 4 THEN 'pdf' WHEN 5 THEN 'html' ELSE 'unsupported' END AS kind, event_id % 7 = 6 AS failed FROM events"


@register(QUERIES, SQL, S5)
def s5_routed(spark, sf_dir):
    ends = F.array(*[F.lit(e) for e in (".blocks.jsonl", ".markdown", ".PNG", ".docx", ".pdf", ".htm", ".bin")])
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("f"), F.get(ends, (F.col("event_id") % 7).cast("int"))).alias("file_name"), F.lit(None).cast("string").alias("media_type"))
    return files.routed(e).select("event_id", "kind", F.col("error").isNotNull().alias("failed"))


@register(QUERIES, SQL)
def s7_html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.char_length(files.html_text(F.col("html"))).alias("n_chars"))


@register(QUERIES, SQL, "SELECT item_id, 'passage-' || item_id AS id, 'Title ' || item_id AS title FROM benchmark")
def s17_markdown_titles(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    text = F.concat(F.lit("intro\n## Title "), F.col("item_id").cast("string"), F.lit(" \n"), "text")
    return b.select("item_id", files.slug(F.concat(F.lit("_Passage "), F.col("item_id").cast("string"), F.lit("!"))).alias("id"), files.first_heading(text).alias("title"))




@register(QUERIES, SQL, "SELECT source AS case_id, count(*) AS n_relevant FROM documents WHERE lang = 'en' GROUP BY source")
def s16_retrieval_cases(spark, sf_dir):
    """Each source as a question whose relevant documents are its English ones."""
    d = table(spark, sf_dir, "documents")
    corpus = d.select(F.col("doc_id").cast("string").alias("_id"), F.lit("").alias("title"), "text")
    queries = d.select(F.col("source").alias("_id"), F.col("source").alias("text")).distinct()
    qrels = d.select(F.col("source").alias("query_id"), F.col("doc_id").cast("string").alias("corpus_id"), F.when(F.col("lang") == "en", 1).otherwise(0).alias("score"))
    return files.retrieval_cases(corpus, queries, qrels)[0].select("case_id", F.size("relevant_doc_ids").cast("long").alias("n_relevant"))


@register(QUERIES, SQL, "SELECT conv_id, turn, text, conv_id || '-' || turn AS chunk_id FROM conversations")
def s18_text_segments(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("document_id"), "text", F.col("turn").alias("chunk_order"), F.create_map(F.lit("role"), F.col("role")).alias("metadata"))
    s = files.text_segments(rows)
    m = F.col("metadata")
    return s.select(m["document_id"].cast("long").alias("conv_id"), m["order"].cast("long").alias("turn"), "text", m["chunk_id"].alias("chunk_id"))
