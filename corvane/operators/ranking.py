"""Merging scores, token budgets, references and neighbourhoods of ranked rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, first_non_blank, fixed3, token_count
from ..schemas import PARENT

BUFFER_TOKENS = 16
#: Ids that go into a filter, and rows that are broadcast, once counted; more are joined.
LITERALS, FEW = 10_000, 1_000_000
#: Metadata of chunks that belong to others.
PREVIOUS, NEXT = "smart_chunker.prev_chunk_id", "smart_chunker.next_chunk_id"
CONTENT, SECTION, IMAGE = "smart_chunker.content_type", "smart_chunker.section_path", "smart_chunker.primary_image_path"


def meta(key: str, metadata: Column | str = "metadata") -> Column:
    return F.try_element_at(F.col(metadata) if isinstance(metadata, str) else metadata, F.lit(key))


def best_scores(scores: DataFrame, id_col: str = "id") -> DataFrame:
    return scores.groupBy(id_col).agg(F.max("score").alias("score"))


def load_by_ids(ids: DataFrame, table: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of the table with these ids, each with what ids says of it; ids that are not there are dropped."""
    return ids.join(table, id_col)


def few(rows: DataFrame) -> DataFrame:
    """Rows that are broadcast if they are few, so that what they are joined with stays where it is."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def with_ids(table: DataFrame, scores: dict, id_col: str = "id") -> DataFrame:
    """Rows of the table with these ids, scored: as load_by_ids, for ids that are bounded.  The filter reaches the table's scan."""
    found = table.sparkSession.createDataFrame(list(scores.items()), f"{id_col} string, score double")
    own = table.where(F.col(id_col).isin(list(scores))) if len(scores) <= LITERALS else table
    return F.broadcast(found).join(own, id_col)


def best_ids(scores: DataFrame, tokens: int, least: int) -> dict:
    """id and score of the best rows, no more than a budget can hold where each costs `least`: these come to the driver."""
    return {r.id: r.score for r in scores.select("id", "score").orderBy(F.desc("score"), "id").limit(max(0, tokens) // least).collect()}


def pick_best(branches: Sequence[DataFrame], id_col: str = "id") -> DataFrame:
    """Rows of all branches, of each id the one with the best score; the earlier branch on ties."""
    tagged = [b.withColumn("__branch", F.lit(i)) for i, b in enumerate(branches)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t, allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "__branch"))
    return both.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__branch")


def chunk_scores(sources: Sequence[DataFrame]) -> DataFrame:
    """id and score of the chunks that scored rows (source_chunk_ids, score) come from, each with its best score."""
    parts = [s.select(F.explode("source_chunk_ids").alias("id"), "score") for s in sources]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return best_scores(both)


def retain_chunks(chunks: DataFrame, sources: Sequence[DataFrame]) -> DataFrame:
    """Chunks that any of the rows comes from."""
    parts = [s.select(F.explode("source_chunk_ids").alias("id")) for s in sources]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return chunks.join(few(both.distinct()), "id", "left_semi")


# --- formats and budgets ----------------------------------------------------------------------------


def entity_line() -> Column:
    return F.concat(F.lit("- "), "id", F.lit(" | "), "name", F.lit(" | "), fixed3("score"))


def relation_line() -> Column:
    return F.concat(F.lit("- "), "src_id", F.lit(" -> "), "tgt_id", F.lit(" | "), "keywords", F.lit(" | "), fixed3("score"))


def chunk_line() -> Column:
    return F.concat(F.lit("- "), "id", F.lit(" | "), fixed3("score"), F.lit(" | "), "text")


def _running(rows: DataFrame, cost: Column, by: Sequence[str] = ()) -> DataFrame:
    return rows.withColumn("__spent", F.sum(cost).over(Window.partitionBy(*by).orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)))


def within_budget(rows: DataFrame, cost: Column, tokens: int, by: Sequence[str] = (), least: int = 0) -> DataFrame:
    """The best rows whose running cost stays within the budget: costs are not negative, so that is up to the first that exceeds it.

    Where every row costs `least` at least, a global limit first leaves no more rows than the budget can hold.
    """
    if tokens <= 0:
        return rows.limit(0)
    if least > 0 and not by:
        rows = rows.orderBy(F.desc("score"), "id").limit(tokens // least)
    return _running(rows, cost, by).where(F.col("__spent") <= tokens).drop("__spent")


#: What a line costs at least: of an entity two marks, an id and a score, of a relation four marks and two ids.
ENTITY_LEAST, RELATION_LEAST = 4, 6


def limit_entities(rows: DataFrame, tokens: int) -> DataFrame:
    return within_budget(rows, token_count(entity_line()), tokens, least=ENTITY_LEAST)


def limit_relations(rows: DataFrame, tokens: int) -> DataFrame:
    return within_budget(rows, token_count(relation_line()), tokens, least=RELATION_LEAST)


def chunk_cost() -> Column:
    return F.when(F.col("token_count") > 0, F.col("token_count")).otherwise(token_count("text"))


def limit_chunks(rows: DataFrame, tokens: int) -> DataFrame:
    """Chunks within the budget.  Those that cost nothing stay if they come before the first that exceeds it."""
    if tokens <= 0:
        return rows.limit(0)
    cost = chunk_cost()
    paid = _running(rows.where(cost > 0).orderBy(F.desc("score"), "id").limit(tokens + 1), cost)
    over = paid.where(F.col("__spent") > tokens).orderBy(F.desc("score"), "id").limit(1).select(F.col("score").alias("__score"), F.col("id").alias("__id"))
    before = F.col("__id").isNull() | (F.col("score") > F.col("__score")) | ((F.col("score") == F.col("__score")) & (F.col("id") < F.col("__id")))
    free = rows.where(cost <= 0).join(F.broadcast(over), F.lit(True), "left").where(before).select(*rows.columns)  # one row
    return paid.where(F.col("__spent") <= tokens).drop("__spent").unionByName(free)


def remaining_budget(total: int, prompt_tokens: int, query_tokens: int) -> int:
    return max(0, total - prompt_tokens - query_tokens - BUFFER_TOKENS)


def remaining_tokens(total: Column, prompt_tokens: Column, query_tokens: Column) -> Column:
    """remaining_budget of rows."""
    return F.greatest(F.lit(0), total - prompt_tokens - query_tokens - BUFFER_TOKENS)


# --- references -------------------------------------------------------------------------------------


def source_of_chunk() -> Column:
    return F.coalesce(first_non_blank(meta("file_path"), meta("source")), F.col("document_id"))


def references(chunks: DataFrame) -> DataFrame:
    """reference_id ("1", "2", ...) and source of ranked chunks (position): most chunks first, then first seen."""
    counted = chunks.select("position", source_of_chunk().alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "first"))
    return counted.select(rank.cast("string").alias("reference_id"), "source", "n")


def contexts(chunks: DataFrame) -> DataFrame:
    """position, id, text, reference_id and source of ranked chunks."""
    own = chunks.withColumn("source", source_of_chunk())
    return own.join(references(chunks).select("reference_id", "source"), "source").select("position", "id", "text", "reference_id", "source")


# --- parents and captions ---------------------------------------------------------------------------


def expand_parents(matched: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Matched chunks (all of a chunk's columns and score), children replaced by their parents.

    A parent's score is the sum of its children's; a child whose parent is not stored stays;
    captions take in the text around them.  The best k stay; these k rows are persisted, as each
    join of expand_captions would otherwise run the whole search again.
    """
    above = F.when(~blank(meta(PARENT)), meta(PARENT))
    # only parents that are asked for are joined; where those are few, the chunks stay where they are
    asked = matched.select(above.alias("p_id")).where("p_id IS NOT NULL").distinct()
    if asked.isEmpty():
        up = matched.select("*", *[F.lit(None).cast(f.dataType).alias(f"p_{f.name}") for f in chunks.schema])
    else:
        parents = chunks.select(*[F.col(c).alias(f"p_{c}") for c in chunks.columns]).join(few(asked), "p_id", "left_semi")
        up = matched.join(parents, above == F.col("p_id"), "left")
    own = [F.coalesce(f"p_{c}", c).alias(c) if c != "metadata" else F.when(F.col("p_id").isNotNull(), F.col("p_metadata")).otherwise(F.col("metadata")).alias(c) for c in chunks.columns]
    resolved = up.select(*own, "score")
    rest = [c for c in chunks.columns if c not in ("id", "metadata")]
    packed = resolved.withColumn("__row", F.struct(*rest)).withColumn("__meta", F.map_entries("metadata"))
    summed = packed.groupBy("id").agg(F.sum("score").alias("score"), F.max_by(F.struct("__row", "__meta"), "score").alias("__r"))
    back = summed.select("id", *[F.col(f"__r.__row.{c}").alias(c) for c in rest], F.map_from_entries("__r.__meta").alias("metadata"), "score")
    best = back.orderBy(F.desc("score"), "id").limit(k).persist()
    return expand_captions(best, chunks)


def expand_captions(matched: DataFrame, chunks: DataFrame) -> DataFrame:
    """Captions with the text before and after them in their section, over an image's placeholder if it is theirs."""
    near = chunks.select(
        F.col("id").alias("n_id"), F.col("text").alias("n_text"), F.col("token_count").alias("n_tokens"), meta(CONTENT).alias("n_type"),
        meta(SECTION).alias("n_section"), meta(IMAGE).alias("n_image"), meta(PREVIOUS).alias("n_prev"),
    )
    captions = matched.where(meta(CONTENT) == "caption")
    asked = captions.select(F.explode(F.array(meta(PREVIOUS), meta(NEXT))).alias("n_id")).where("n_id IS NOT NULL").distinct()
    if asked.isEmpty():
        return matched
    around = near.join(few(asked), "n_id", "left_semi")
    beyond = near.join(few(around.select(F.col("n_prev").alias("n_id")).where("n_id IS NOT NULL").distinct()), "n_id", "left_semi")
    part = lambda p: F.struct(F.col(f"{p}.n_text").alias("text"), F.col(f"{p}.n_tokens").alias("tokens"))
    at = lambda p, key: (F.col(f"{p}.n_id") == key) & F.col(f"{p}.n_section").eqNullSafe(meta(SECTION, F.col("m.metadata")))
    m = matched.alias("m")
    mm = lambda k: meta(k, F.col("m.metadata"))
    j = m.join(around.alias("a"), at("a", mm(PREVIOUS)), "left").join(beyond.alias("b"), at("b", F.col("a.n_prev")) & (F.col("b.n_type") == "text"), "left")
    j = j.join(around.alias("c"), at("c", mm(NEXT)) & (F.col("c.n_type") == "text"), "left")
    image = (F.col("a.n_type") == "image_placeholder") & (F.col("a.n_image") == mm(IMAGE)) & ~blank(mm(IMAGE))
    own = F.struct(F.col("m.text").alias("text"), F.col("m.token_count").alias("tokens"))
    none = F.lit(None).cast("struct<text:string,tokens:int>")
    parts = F.filter(
        F.array(
            F.when(image & F.col("b.n_id").isNotNull(), part("b")).otherwise(none), F.when(image | (F.col("a.n_type") == "text"), part("a")).otherwise(none),
            own, F.when(F.col("c.n_id").isNotNull(), part("c")).otherwise(none),
        ), lambda x: x.isNotNull(),
    )
    joined = j.withColumn("__parts", F.when(mm(CONTENT) == "caption", parts))
    more = F.size("__parts") > 1
    texts = F.array_distinct(F.filter(F.transform("__parts", lambda x: x["text"]), lambda t: F.trim(F.coalesce(t, F.lit(""))) != ""))
    tokens = F.aggregate(F.transform("__parts", lambda x: x["tokens"]), F.lit(0), lambda s, t: s + t)
    out = {"text": F.when(F.coalesce(more, F.lit(False)), F.array_join(texts, "\n")).otherwise(F.col("m.text")), "token_count": F.when(F.coalesce(more, F.lit(False)), tokens).otherwise(F.col("m.token_count"))}
    return joined.select(*[out.get(c, F.col(f"m.{c}")).alias(c) for c in matched.columns])


def reranked(chunks: DataFrame, results: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """Chunks (position) in the order of a reranker's results (id, pos, score), those below `least` dropped.

    Chunks that it left out come after the others if nothing is dropped for its score.  The first k stay.
    """
    first = Window.partitionBy("id").orderBy("pos")
    kept = results.where(F.col("score") >= least).withColumn("__n", F.row_number().over(first)).where("__n = 1").select("id", F.col("pos").alias("__pos"))
    joined = chunks.join(kept, "id", "left" if least == 0.0 else "inner")
    order = Window.orderBy(F.asc_nulls_last("__pos"), "position")
    return joined.withColumn("reranked", F.row_number().over(order)).where(F.col("reranked") <= k).drop("__pos")


# --- lists and windows ------------------------------------------------------------------------------


def neighbours(chunks: DataFrame) -> DataFrame:
    """Chunks with the ids of those before and after them in the document."""
    w = Window.partitionBy("document_id").orderBy("chunk_order", "id")
    return chunks.withColumn("prev_id", F.lag("id").over(w)).withColumn("next_id", F.lead("id").over(w))


def renumbered(chunks: DataFrame) -> DataFrame:
    """Chunks whose orders count from 0 without gaps, by order and id."""
    return chunks.withColumn("chunk_order", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_order", "id")) - 1)


def latest(rows: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    """Of each key the row of the latest time; the first by `tie` where times are equal."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time), tie))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """A page, counted from 1, of ordered rows."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def intersects(a: Column | str, b: Column | str) -> Column:
    """Whether two lists share a value; null lists share none."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def differences(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    """rows with `missing`, expected but not there, and `orphan`, there but not expected, both sorted."""
    return rows.withColumn("missing", F.array_sort(F.array_except(expected, actual))).withColumn("orphan", F.array_sort(F.array_except(actual, expected)))
