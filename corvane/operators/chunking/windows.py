"""Fixed windows, in built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.text import strip
from ...schemas import LEVEL, SEARCHABLE

#: Sizes and overlaps by granularity: smart (target, most, overlap), and fixed or recursive (size, overlap).
GRANULARITY = {"FINE": ((300, 500, 60), (500, 60)), "MEDIUM": ((800, 1200, 100), (1000, 100)), "COARSE": ((1200, 1800, 160), (1600, 160))}


def windows(text: Column, size: int, overlap: int) -> Column:
    """The windows of a text; the last ends where the text does."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    n, step = F.char_length(text), size - overlap
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def _as_chunks(parts: DataFrame) -> DataFrame:
    """document_id, pos, text (and metadata) as chunks, blanks dropped and orders without gaps."""
    kept = parts.withColumn("text", strip("text")).where("text <> ''")
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("pos")) - 1
    kept = kept.withColumn("chunk_order", order)
    return kept.select(
        F.concat("document_id", F.lit(":"), F.col("chunk_order").cast("string")).alias("id"), "document_id", "text",
        F.char_length("text").alias("token_count"), "chunk_order", "metadata",
    )


def _documents(docs: DataFrame) -> DataFrame:
    metadata = F.col("metadata") if "metadata" in docs.columns else F.create_map().cast("map<string,string>")
    return docs.select(F.col("id").cast("string").alias("document_id"), F.coalesce("content", F.lit("")).alias("content"), metadata.alias("metadata"))


def fixed_windows(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Chunks of `size` code points, each beginning `overlap` before the last one's end."""
    d = _documents(docs)
    return _as_chunks(d.select("document_id", "metadata", F.posexplode(windows(F.col("content"), size, overlap)).alias("pos", "text")))


def split_by(docs: DataFrame, separator: str, size: int = 1000, overlap: int = 100, only: bool = False) -> DataFrame:
    """Chunks at a separator; longer parts are cut into windows, or are an error with `only`."""
    d = _documents(docs)
    parts = d.select("document_id", "metadata", F.posexplode(F.split("content", "\\Q" + separator + "\\E", -1)).alias("part", "piece"))
    if only:
        text = F.when(F.char_length(strip("piece")) > size, F.raise_error(F.lit("a part is longer than a chunk"))).otherwise(F.col("piece"))
        return _as_chunks(parts.select("document_id", "metadata", F.struct("part", F.lit(0).alias("i")).alias("pos"), text.cast("string").alias("text")))
    cut = parts.select("document_id", "metadata", "part", F.posexplode(windows(F.col("piece"), size, overlap)).alias("i", "text"))
    return _as_chunks(cut.select("document_id", "metadata", F.struct("part", "i").alias("pos"), "text"))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over the lesser number of them."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    least = F.least(F.size(words(a)), F.size(words(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(words(a), words(b))) / least)


def searchable(chunks: DataFrame) -> DataFrame:
    """Of each document the chunks marked searchable if any chunk is marked, else its children, else its parents."""
    flag, level = F.try_element_at("metadata", F.lit(SEARCHABLE)), F.try_element_at("metadata", F.lit(LEVEL))
    w = Window.partitionBy("document_id")
    marked = chunks.withColumn("__any", F.max(flag.isNotNull().cast("int")).over(w)).withColumn("__kids", F.max((level == "child").cast("int")).over(w))
    child = F.coalesce(level == "child", F.lit(False))
    keep = F.when(F.col("__any") == 1, F.coalesce(flag == "true", F.lit(False))).when(F.col("__kids") == 1, child).otherwise(~child)
    return marked.where(keep).drop("__any", "__kids")


def sizing(target: int, most: int, overlap: int, kind: Column, heading: Column, sentences: Column, average: Column, low: float = 0.75, high: float = 1.35, share: float = 0.12) -> Column:
    """Adaptive sizes of a paragraph's chunks as (target, most, overlap).

    Smaller after a heading or for few or short sentences, larger for many long ones; laws and
    questions stay near the base.
    """
    strict = kind.isin("LAW", "QA")
    ratio = F.when(heading, 0.75).otherwise(1.0)
    ratio = F.when((sentences <= 2) | (average <= 48), F.least(ratio, F.lit(0.90))).otherwise(ratio)
    ratio = F.when((sentences >= 6) & (average >= 60), F.greatest(ratio, F.when(strict, 1.05).otherwise(1.35))).otherwise(ratio)
    top = F.least(F.lit(high), F.when(strict, 1.08).otherwise(1.35))
    ratio = F.least(F.greatest(ratio, F.lit(low)), top)
    whole = lambda x: F.floor(x + 0.5).cast("int")
    within = lambda x, a, b: F.greatest(a, F.least(b, x))
    new_target = within(whole(F.lit(target) * ratio), whole(F.lit(target * low)), whole(target * top))
    wide = F.when(ratio >= 1, F.least(top, 1 + (ratio - 1) * 0.90)).when(heading, F.greatest(F.lit(low), ratio + 0.02)).otherwise(F.greatest(F.lit(low), ratio + 0.10))
    new_most = within(whole(F.lit(most) * wide), new_target, whole(most * top))
    own = whole(new_target * share)
    new_overlap = within(F.when(ratio >= 1, F.greatest(F.lit(overlap), own)).otherwise(F.least(F.lit(overlap), own)), F.lit(0), F.greatest(F.lit(0), new_most - 1))
    return F.struct(new_target.alias("target"), new_most.alias("most"), new_overlap.alias("overlap"))


def contract_errors(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """document_id and problem of chunks that break the contract: unknown document, repeated id, orders with gaps."""
    known = docs.select(F.col("id").cast("string").alias("document_id"), F.lit(True).alias("known"))
    by = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.min("chunk_order").alias("a"), F.max("chunk_order").alias("b"), F.countDistinct("chunk_order").alias("orders"))
    problem = F.when(F.col("known").isNull(), "unknown document").when(F.col("ids") < F.col("n"), "repeated id").when((F.col("a") != 0) | (F.col("b") != F.col("n") - 1) | (F.col("orders") < F.col("n")), "orders with gaps")
    return by.join(known, "document_id", "left").select("document_id", problem.alias("problem")).where("problem IS NOT NULL")
