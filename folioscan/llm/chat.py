"""Chat formatting: logged snapshots of a conversation collapse into the longest one before rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A rendered turn: %1$s is the role, %2$s the text.
TEMPLATE = "<|%1$s|>\n%2$s\n<|end|>\n"


def _turns(table: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """The turns with a hash of what is said, null taken as empty."""
    r, t = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return table.select(F.col(f"`{key}`").alias("k"), F.col(f"`{turn}`").alias("n"), r.alias("r"), t.alias("t"), F.xxhash64(r, t).alias("h"), F.xxhash64(t, F.lit(7), r).alias("g"))


def maximal(table: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The conversations that are no proper prefix of another: ``k`` (their key), ``n_turns`` and ``n_copies``.

    Each turn has a rolling hash of all turns up to it, twice 64 bits over (position, role, text). A conversation goes if its
    last hash is that of an earlier turn of a longer one (an anti-join on length and hash); of conversations with the same turns
    the one with the smallest key stays and ``n_copies`` counts them. Only hashes are shuffled here.
    """
    spoken = _turns(table, key, turn, role, text).groupBy("k", "n", "h", "g").agg(F.lit(1).alias("one")).drop("one")
    order = Window.partitionBy("k").orderBy("n", "h", "g")
    placed = spoken.withColumn("i", F.row_number().over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("k")
    rolled = placed.select(
        "k", "i",
        F.bit_xor(F.xxhash64("i", "h", "g")).over(upto).alias("p"),
        F.bit_xor(F.xxhash64("g", "i", "h")).over(upto).alias("q"),
        F.count("*").over(whole).alias("n_turns"),
    )
    full = rolled.where("i = n_turns").groupBy("n_turns", "p", "q").agg(F.min("k").alias("k"), F.count("*").alias("n_copies"))
    earlier = rolled.where("i < n_turns").groupBy(F.col("i").cast("long").alias("n_turns"), "p", "q").agg(F.lit(1).alias("one"))
    return full.join(earlier, ["n_turns", "p", "q"], "left_anti").select("k", "n_turns", "n_copies")


def format_chats(table: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: str = TEMPLATE) -> DataFrame:
    """One row per maximal conversation: ``key, n_turns, n_copies, rendered``.

    Turns are taken in order of ``turn`` (gaps do not matter; of two rows with one turn the order follows their hashes, so it is the
    same in every copy). Repeated rows count once. A null role or text is empty; a null turn comes first; all rows with a null
    key are one conversation. An empty table gives no rows; other columns are ignored. A conversation is one row of the result
    and has to fit a task, like a document.
    """
    best = maximal(table, key=key, turn=turn, role=role, text=text).withColumnRenamed("k", "best")
    turns = _turns(table, key, turn, role, text)
    kept = turns.join(best, F.col("k").eqNullSafe(F.col("best")))
    lines = F.sort_array(F.collect_set(F.struct("n", "h", "g", "r", "t")))
    said = kept.groupBy("k").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), lines.alias("lines"))
    rendered = F.array_join(F.transform("lines", lambda x: F.format_string(template, x["r"], x["t"])), "")
    return said.select(F.col("k").alias(key), "n_turns", "n_copies", rendered.alias("rendered"))
