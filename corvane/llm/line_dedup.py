"""Line dedup on range-partitioned line hashes; the result is a keep bitmap for each document.

DataFrame and SQL functions only.  A line is known by 128 bits of hash, so text is never shuffled
but where a caller applies the bitmaps.  Documents are split and hashed into ranges of (hash,
document), sorted by hash, document and position, which splits even a line that every document holds over many
tasks.  A window streams over each sorted range and marks a document's first occurrence of a
line; the marked positions are written once to the shared folder.

A line that spans ranges is the first or last of one, so there are at most two such lines for each
range, whatever the data: they are counted apart and broadcast, and the line's rows stay where
they are.  The rows of any other line are part of one range; they meet their count by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_tasks, written

#: Fixed value: the white space [\x20\x09-\x0D] that keys lose at both ends.
BLANKS = "\x20\t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def ascii_lower(s: Column) -> Column:
    """A-Z lower-cased; lower() does no more than that where all is ASCII."""
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def _ranged_lines(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """h1, h2, doc_id, text_hash, n, pos, range, first: the keyed lines, by ranges of (h1, h2, doc_id), sorted; first marks a document's first of a line."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    split = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), lines_of(F.col("text")).alias("lines"))
    lines = split.select("doc_id", "text_hash", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    keys = lines.select("doc_id", "text_hash", "n", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.char_length("key") >= min_chars)
    key = ascii_lower(F.col("key"))
    hashed = keys.select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"), "doc_id", "text_hash", "n", "pos")
    ranged = hashed.repartitionByRange(n_tasks(docs.sparkSession), "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos", "text_hash")
    # ranges hold each (h1, h2, doc_id) together and in this order: no exchange, no sort
    order = Window.partitionBy("h1", "h2", "doc_id").orderBy("pos", "text_hash")
    return ranged.withColumn("first", F.row_number().over(order) == 1).withColumn("range", F.spark_partition_id())


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document that loses lines: doc_id, __text_hash, n_dropped, kept.  Writes the lines' hashes at once.

    kept is the keep bitmap, run-length compressed: an array of (first, length) of the kept lines.
    Keys of at least min_chars code points in at least min_docs documents lose all lines but those
    in the largest doc_id that holds them.

    Rows of one doc_id are one document; the hash of the text tells them apart where texts differ.
    Rows without a doc_id are in no document: they lose nothing and count for nothing.  Null and
    empty texts are one empty line.  Other columns are not read.
    """
    lines = written(_ranged_lines(docs, min_chars, id_col, text_col), "lines")
    key = ["h1", "h2"]
    ends = lines.groupBy("range").agg(F.min(F.struct(*key)).alias("low"), F.max(F.struct(*key)).alias("high"))
    spanning = ends.select(F.explode(F.array("low", "high")).alias("k")).select("k.*").distinct().withColumn("spans", F.lit(True))
    split = lines.join(F.broadcast(spanning), key, "left")  # at most two for each range
    apart, rest = split.where("spans").drop("spans"), split.where("spans IS NULL").drop("spans")

    def often(part: DataFrame) -> DataFrame:
        return part.where("first").groupBy(*key).agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("holder")).where(F.col("docs") >= min_docs)

    gone = apart.join(F.broadcast(often(apart)), key).unionByName(rest.join(often(rest), key)).where("doc_id <> holder")
    flat = gone.groupBy("doc_id", "text_hash").agg(F.max("n").alias("n"), F.array_sort(F.collect_set("pos")).alias("lost"))
    starts = F.filter("lost", lambda x, i: (i == 0) | (F.try_element_at("lost", i) != x - 1))
    ends = F.filter("lost", lambda x, i: (i == F.size("lost") - 1) | (F.try_element_at("lost", i + 2) != x + 1))
    runs = flat.select("doc_id", "n", F.col("text_hash").alias("__text_hash"), F.size("lost").alias("n_dropped"), starts.alias("starts"), ends.alias("ends"))
    between = F.zip_with(
        F.concat(F.array(F.lit(-1)), "ends"), F.concat("starts", F.array("n")),
        lambda end, start: F.struct((end + 1).alias("first"), (start - end - 1).alias("length")),
    )
    return runs.select("doc_id", "__text_hash", "n_dropped", F.filter(between, lambda r: r["length"] > 0).alias("kept"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with __lines, __n_dropped and __kept_text; all rows and columns stay as they are."""
    b = bitmaps.select(F.col("doc_id").alias("__doc_id"), "__text_hash", F.col("n_dropped").alias("__n_dropped"), F.col("kept").alias("__kept"))
    text = docs[text_col].cast("string")
    joined = docs.join(b.hint("shuffle_hash"), (docs[id_col] == b["__doc_id"]) & (F.xxhash64(text) == b["__text_hash"]), "left")
    lines = lines_of(text)
    kept = F.array_join(F.flatten(F.transform("__kept", lambda r: F.slice(lines, r["first"] + 1, r["length"]))), "\n")
    return joined.select(
        *[docs[c] for c in docs.columns], F.size(lines).alias("__n_lines"), F.coalesce("__n_dropped", F.lit(0)).alias("__n_dropped"),
        F.when(F.col("__kept").isNull(), F.coalesce(text, F.lit(""))).otherwise(kept).alias("__kept_text"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs without the lines that other documents keep; all rows and columns stay, n_chars follows the text.

    A null text stays null; a document that loses all its lines stays with an empty text.
    """
    done = apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
    text = F.when(F.col("__n_dropped") > 0, F.col("__kept_text")).otherwise(F.col("text"))
    count = lambda c: F.when(F.col("__n_dropped") > 0, F.char_length("__kept_text").cast("long")).otherwise(F.col(c))
    return done.select(*[text.alias(c) if c == "text" else count(c).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


SQL = r"""
WITH line AS (
    SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), often AS (
    SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE holder IS NOT NULL AND doc_id <> holder) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE holder IS NULL OR doc_id = holder), '')) AS kept_sha256
FROM keyed LEFT JOIN often USING (key) GROUP BY doc_id
"""
