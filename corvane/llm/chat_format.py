"""Chat formatting by prefix-target expansion.

DataFrame and SQL functions only.  Every assistant turn becomes an example of its own: all turns
before it are the prompt, its text alone is trainable.  The template is

    <turn:ROLE>TEXT</turn>

where `&` and `<` inside roles and texts are written `&amp;` and `&lt;`, so no text can hold a
control string, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSE = "</turn>"


def escape(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_conversations(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """One row for each example: conv_id, example, n_context, prompt, target, suffix, last.

    The formatted example is prompt + target + suffix; the loss mask covers the target, which
    is the escaped text of one assistant turn.  Turns after the last assistant turn, and conversations
    without one, make a last example with an empty target and suffix, so nothing is lost.  last
    marks each conversation's example with all its turns.

    Turns are ordered by turn, then role and text, so ties and repeated rows have a fixed
    order; null turns come first; null texts and roles are empty; rows without a conv_id are one
    conversation.  One conversation must fit into a task, as every prompt is a row.
    Other columns are not read.
    """
    order = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = turns.select(F.col("conv_id").cast("long").alias("conv_id"), order.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    written = whole.select(
        "conv_id",
        F.transform("t", lambda t: escape(t["text"])).alias("texts"),
        F.transform("t", lambda t: F.concat(F.lit("<turn:"), escape(t["role"]), F.lit(">"))).alias("heads"),
        F.filter(F.transform("t", lambda t, i: F.when(t["role"] == assistant, i)), lambda i: i.isNotNull()).alias("at"),
    )
    n = F.size("texts")
    ends = F.when(F.coalesce(F.try_element_at("at", F.lit(-1)), F.lit(-1)) == n - 1, F.col("at")).otherwise(F.concat("at", F.array(n)))
    parts = F.zip_with("heads", "texts", lambda h, x: F.concat(h, x, F.lit(CLOSE)))
    exploded = written.select("conv_id", "heads", "texts", parts.alias("parts"), F.size(ends).alias("n"), F.posexplode(ends).alias("example", "n_context"))
    real = F.col("n_context") < F.size("texts")
    before = F.array_join(F.slice("parts", F.lit(1), F.col("n_context")), "")
    return exploded.select(
        "conv_id", "example", "n_context",
        F.when(real, F.concat(before, F.get("heads", F.col("n_context")))).otherwise(before).alias("prompt"),
        F.when(real, F.get("texts", F.col("n_context"))).otherwise(F.lit("")).alias("target"),
        F.when(real, F.lit(CLOSE)).otherwise(F.lit("")).alias("suffix"),
        (F.col("example") == F.col("n") - 1).alias("last"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    marked = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    head = lambda x: F.instr(x, ">")
    return F.transform(marked, lambda x: F.struct(unescape(F.substr(x, F.lit(7), head(x) - 7)).alias("role"), unescape(F.substr(x, head(x) + 1)).alias("text")))


def digest(examples: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its examples: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    formatted_chars counts the code points of all its formatted examples.
    """
    full = F.concat("prompt", "target", "suffix")
    read = examples.select(
        "conv_id", "example", unescape(F.col("target")).alias("loss"), F.char_length(full).cast("long").alias("chars"), F.when(F.col("last"), read_turns(full)).alias("turns")
    )
    grouped = read.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"), F.first("turns", ignorenulls=True).alias("turns"),
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return grouped.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
    SELECT *, length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + length(replace(replace(role, '&', '&amp;'), '<', '&lt;')) + 14 AS own,
           row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), summed AS (
    SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (coalesce(sum(upto) FILTER (WHERE role = 'assistant' OR k = n), 0))::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""
