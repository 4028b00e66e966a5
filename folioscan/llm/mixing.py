"""Mixing sources to target weights: weighted fair queueing over shuffled documents. Column expressions, joins and windows only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.rows import written

# Rows that a bucket of a window holds on average, and the limits of the number of buckets.
BUCKET_ROWS = 400
LEAST_BUCKETS, MOST_BUCKETS = 64, 1 << 20


def _slim(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(k, s, sk, size, h): key, source, source without null, words of the text, and the hash that shuffles."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    name = F.col(f"`{source}`").cast("string")
    k = F.col(f"`{key}`")
    h = F.md5(F.concat(F.coalesce(k.cast("string"), F.lit("")), F.lit(":"), F.md5(t.cast("binary"))).cast("binary"))
    return docs.select(
        k.alias("k"), name.alias("s"), F.when(name.isNull(), "n").otherwise(F.concat(F.lit("s"), name)).alias("sk"),
        F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]++")).cast("long").alias("size"), h.alias("h"),
    )


def targets(sizes: DataFrame, weights: Sequence[int] | Mapping[str | None, int], repeats: int) -> DataFrame:
    """Add ``rank`` (sources by code point, null last), ``weight``, ``budget`` (all words) and ``target`` to a table
    (s, source_size, ...) of one row per source.

    The budget is shared by weight; a target stops at ``repeats`` times the words of its source, and what is left over goes
    to the others by weight until no target is above its stop. Sources are taken in the order in which they reach their
    stops as the share for a unit of weight rises. The table has a row per source and is ordered in one task.
    """
    everything = Window.orderBy(F.col("s").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(everything))
    if isinstance(weights, Mapping):
        weight = F.lit(1)
        for name, w in weights.items():
            weight = F.when(F.col("s").eqNullSafe(F.lit(name)), w).otherwise(weight)
    else:
        weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    stop = F.col("source_size") * repeats
    full = Window.orderBy(stop.cast("double") / F.col("weight"), "rank")
    upto, whole = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = ranked.withColumn("weight", weight.cast("long")).select(
        "*", stop.alias("stop"), F.sum("source_size").over(whole).alias("budget"),
        F.coalesce(F.sum(stop).over(upto), F.lit(0)).alias("before"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0))).alias("rest"),
    )
    stopped = F.col("stop").cast("double") / F.col("weight") <= (F.col("budget") - F.col("before")).cast("double") / F.col("rest")
    marked = shared.withColumn("stopped", stopped)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("stop"))).over(whole), F.lit(0))
    free = F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(whole)
    target = F.when(F.col("stopped"), F.col("stop").cast("double")).otherwise((F.col("weight") * left).cast("double") / free)
    return marked.withColumn("target", target).drop("stop", "before", "rest", "stopped")


def _buckets(rows: int) -> int:
    """A power of two that follows the number of rows."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, rows // BUCKET_ROWS).bit_length()))


def _placed(docs: DataFrame, weights, repeats: int, key: str, text: str, source: str) -> tuple[DataFrame, int]:
    """Every row with its source's numbers and ``c``, the words of its source before it in shuffled order; and the number of buckets.

    A source is cut into buckets of the hash, so that a hot one is many windows.
    """
    slim = written(_slim(docs, key, text, source), "mix-sizes")
    sizes = slim.groupBy("sk").agg(F.first("s").alias("s"), F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    per_source = written(targets(sizes, weights, repeats), "mix-targets")
    k = _buckets(per_source.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    bits = k.bit_length() - 1
    b = F.shiftright(F.conv(F.substring("h", 1, 6), 16, 10).cast("long"), 24 - bits)
    slim = slim.drop("s").withColumn("b", b)
    before = F.sum("n").over(Window.partitionBy("sk").orderBy("b")) - F.col("n")
    offsets = slim.groupBy("sk", "b").agg(F.sum("size").alias("n")).withColumn("before", before).drop("n").join(per_source.drop("rows", "weight"), "sk")
    here = F.sum("size").over(Window.partitionBy("sk", "b").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return written(slim.join(offsets, ["sk", "b"]).withColumn("c", F.col("before") + here).drop("sk", "b", "before", "h"), "mix-placed"), k


def _served() -> Column:
    """Rows that the mix can take at least a word of."""
    return (F.col("size") > 0) & (F.col("c") < F.floor("target"))


def _ordered(placed: DataFrame, k: int, cut: bool) -> DataFrame:
    """Entries (a row and a round of its source) in order of virtual finish time, with ``words`` taken and ``position`` in the mix."""
    last = F.floor((F.floor("target") - 1 - F.col("c")) / F.col("source_size"))
    rounds = placed.where(_served()).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("epoch") * F.col("source_size") + F.col("c")
    entries = rounds.withColumn("start", start).withColumn("offered", F.least("size", F.floor("target") - F.col("start")) if cut else F.col("size"))
    finish = (F.col("start") + F.col("offered")).cast("double") / F.col("target")
    timed = entries.withColumn("finish", finish).withColumn("slot", F.least(F.lit(k - 1), F.floor(F.col("finish") * k)).cast("int"))
    sums = timed.groupBy("slot").agg(F.sum("offered").alias("n"))
    sums = sums.select("slot", (F.sum("n").over(Window.orderBy("slot")) - F.col("n")).alias("before"))
    within = Window.partitionBy("slot").orderBy("finish", "rank", "start").rowsBetween(Window.unboundedPreceding, 0)
    position = F.col("before") + F.sum("offered").over(within) - F.col("offered")
    placed_in = timed.join(sums, "slot").withColumn("position", position)
    room = F.greatest(F.lit(0), F.col("budget") - F.col("position"))
    words = F.least("offered", room) if cut else F.when(F.col("offered") <= room, F.col("offered")).otherwise(0)
    return placed_in.withColumn("words", words.cast("long"))


def mix(
    docs: DataFrame, *, weights: Sequence[int] | Mapping[str | None, int] = (1, 2, 3), repeats: int = 3, cut: bool = True,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The mix as a table of entries: ``key, source_rank, epoch, size, words, finish, position``.

    Words are what stands between ASCII white space. The documents of a source are shuffled by a hash of key and text and
    queued, and the queue begins anew up to ``repeats`` times. An entry's virtual finish time is the words of its source up to its end,
    divided by the target of the source (``targets``). Entries are range-sorted by finish time over all sources, and the mix
    ends at the budget, as many words as the documents have. ``position`` counts the words of the mix before an
    entry; the entries in order of ``position`` are the mix.

    With ``cut``, a document that is being taken when its source reaches its target gives the ``words`` up to there, so a source meets its target to a word; without
    it only whole documents are taken, and a source may miss its target by one document.

    ``weights`` go to the sources in order, repeating, or by name (1 where a name is missing). Null and empty texts have no words and no
    entry, a null source is a source, null keys and repeated rows are documents each; ties in finish time go to the earlier source. Very long texts
    are counted whole. An empty table gives an empty mix. Other columns are ignored, whatever their names. Rows that are alike in key and text share a hash,
    and the copies of one such row meet in one task; all else is cut into buckets that follow the number of rows.
    """
    placed, k = _placed(docs, weights, repeats, key, text, source)
    out = _ordered(placed, k, cut).where("words > 0")
    return out.select(F.col("k").alias(key), F.col("rank").alias("source_rank"), "epoch", "size", "words", "finish", "position")


def mix_totals(
    docs: DataFrame, *, weights: Sequence[int] | Mapping[str | None, int] = (1, 2, 3), repeats: int = 3, cut: bool = True,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """What the ``mix`` takes of each row: ``key, size, source_size, target, taken, first_position``.

    ``taken`` counts repeats and is at most ``repeats * size``; ``first_position`` is the place of its first entry, null where
    nothing is taken. One row per row of ``docs``.
    """
    placed, k = _placed(docs, weights, repeats, key, text, source)
    taken = _ordered(placed, k, cut).groupBy("rank", "c", "k", "size", "source_size", "target").agg(F.sum("words").alias("taken"), F.min(F.when(F.col("words") > 0, F.col("position"))).alias("first_position"))
    names = ["k", "size", "source_size", "target", "taken", "first_position"]
    rest = placed.where(~_served()).withColumn("taken", F.lit(0).cast("long")).withColumn("first_position", F.lit(None).cast("long"))
    return taken.select(*names).union(rest.select(*names)).withColumnRenamed("k", key)
