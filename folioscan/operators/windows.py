"""Operators along an order: gaps, runs, running values, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.functions import html as H
from folioscan.functions.text import normalize_text, round_half_up
from folioscan.operators.ordered import islands, numbered, ordered_scan, restarting_sum

# Limits of a gap in em, and of a rise in sizes.
NOT_A_SPACE, MIN_FLOW, MAX_FLOW, MAX_WORD = 0.03, 0.102, 0.6, 3.0
NEGATIVE, VERTICAL = -0.2, 0.25


def classify_gaps(
    df: DataFrame,
    part: list[str],
    order: list[str],
    x: str = "x",
    y: str = "y",
    width: str = "width",
    size: str = "size",
    ch: str = "ch",
    blank: str = "blank",
    unknown: str = "unknown",
) -> DataFrame:
    """Class of the gap before each item: adds ``gap_class`` and ``em``.

    Classes: ``unknown``, ``blank``, ``first``, ``line``, ``back``, ``tight``, ``thin``, ``flow``,
    ``wide``, ``jump``. ``part`` names one stream of one document, which is what bounds a window.

    The previous visible item is the anchor; an unknown item cuts the chain. An item that starts a
    line does not become the anchor, so of consecutive items that rise, every other one starts a
    line. A tight gap is thin when, since the last reset, the last character is a blank and the one
    before it is not. Resets: unknown, line, back, and gaps of at most 0.03 em.
    """
    visible = ~F.col(blank) & ~F.col(unknown)
    w = W.partitionBy(*part).orderBy(*order)
    past = w.rowsBetween(W.unboundedPreceding, -1)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    anchor = F.when(visible | F.col(unknown), F.struct(x, y, width, size, F.col(unknown).alias("cut")))
    step = df.withColumn("__visible", visible).withColumn("__pv", F.last(anchor, ignorenulls=True).over(past))
    has = F.col("__visible") & F.col("__pv").isNotNull() & ~F.col("__pv.cut")
    rise = F.abs(F.col(y) - F.col(f"__pv.{y}")) > F.col(f"__pv.{size}") * VERTICAL
    step = (
        step.withColumn("__has", F.coalesce(has, F.lit(False)))
        .withColumn("__cand", F.coalesce(F.col("__has") & rise, F.lit(False)))
        .withColumn("__vi", F.sum(F.col("__visible").cast("int")).over(upto))
    )
    start = F.when(F.col(unknown) | (F.col("__visible") & ~F.col("__cand")), F.col("__vi"))
    step = step.withColumn("__base", F.coalesce(F.last(start, ignorenulls=True).over(upto), F.lit(0)))
    step = step.withColumn("__line", F.col("__cand") & ((F.col("__vi") - F.col("__base")) % 2 == 1))
    after = F.last(F.when(F.col("__visible") | F.col(unknown), F.col("__line")), ignorenulls=True).over(past)
    step = step.withColumn("__after", F.coalesce(after, F.lit(False)))
    measured = F.col("__has") & ~F.col("__line") & ~F.col("__after")
    gap = F.col(x) - (F.col(f"__pv.{x}") + F.col(f"__pv.{width}"))
    step = step.withColumn("__gap", F.when(measured, gap)).withColumn("em", F.col("__gap") / F.col(f"__pv.{size}"))
    is_back = F.coalesce(F.col("__gap") < F.col(f"__pv.{size}") * NEGATIVE, F.lit(False))
    step = step.withColumn("__back", is_back)
    reset = F.col(unknown) | F.col("__line") | F.col("__back") | F.coalesce(F.col("em") <= NOT_A_SPACE, F.lit(False))
    saved = F.when(F.col(blank) & ~F.col(unknown), " ").when(
        F.col("__visible") & ~F.col("__line"), F.coalesce(F.nullif(F.col(ch), F.lit("")), F.lit(" "))
    )
    step = step.withColumn("__saved", saved).withColumn("__group", F.sum(reset.cast("int")).over(upto))
    one = F.when(F.col("__saved").isNotNull(), F.struct(F.col("__saved").alias("c"), F.col("__group").alias("g")))
    step = step.withColumn("__one", one).withColumn("__s1", F.last("__one", ignorenulls=True).over(past))
    two = F.when(F.col("__saved").isNotNull(), F.struct(F.col("__s1.c").alias("c"), F.col("__s1.g").alias("g")))
    step = step.withColumn("__s2", F.last(two, ignorenulls=True).over(past))
    last_blank = (F.col("__s1.g") == F.col("__group")) & (F.col("__s1.c") == " ")
    before_not = (F.col("__s2.g") == F.col("__group")) & (F.col("__s2.c") != " ")
    due = F.coalesce(last_blank & before_not, F.lit(False)) & (F.col("em") > NOT_A_SPACE)
    kind = (
        F.when(F.col(unknown), "unknown")
        .when(F.col(blank), "blank")
        .when(F.col("__line"), "line")
        .when(~measured, "first")
        .when(F.col("__back"), "back")
        .when(F.col("em") <= MIN_FLOW, F.when(due, "thin").otherwise("tight"))
        .when(F.col("em") <= MAX_FLOW, "flow")
        .when(F.col("em") <= MAX_WORD, "wide")
        .otherwise("jump")
    )
    em = F.when(F.col("__back"), F.lit(None)).otherwise(F.col("em"))
    return step.select(*df.columns, kind.alias("gap_class"), em.alias("em"))


BREAKS = ("thin", "wide", "jump", "back", "line", "unknown")


def segments(df: DataFrame, keys: list[str], order: list[str], is_break: Column, text: str | None = None) -> DataFrame:
    """Items cut at breaks: ``keys, segment, n, first, last`` and, with ``text``, the joined text.

    The row that breaks starts the new segment.
    """
    at = F.struct(*[F.col(c) for c in order])
    work = ordered_scan(df, keys, order, sums={"segment": is_break.cast("bigint")})
    aggs = [F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last")]
    if text is not None:
        pairs = F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col(text).alias("text"))))
        aggs.append(F.array_join(F.transform(pairs, lambda p: p["text"]), " ").alias("text"))
    return work.groupBy(*keys, "segment").agg(*aggs)


def wide_gaps(runs: DataFrame, key: str = "page_id", limit_em: float = 0.6, top: int | None = None) -> DataFrame:
    """Gaps over the limit between neighbours of a row: ``key, selector, text, em, top, cause``.

    ``runs``: ``key, left, right, top, height, element, text, display, column_gap, justify, font_size,
    margin`` where display to justify describe the container of the run before, and ``margin`` is the run's
    own side margin. Runs belong to one page each, which bounds the windows.
    """
    by_top = W.partitionBy(key).orderBy("top", "left", "element")
    new_row = (F.col("top") - F.lag("top").over(by_top) > 2).cast("int")
    rows = runs.withColumn("__row", F.coalesce(new_row, F.lit(0)))
    rows = rows.withColumn("__row", F.sum("__row").over(by_top.rowsBetween(W.unboundedPreceding, W.currentRow)))
    along = W.partitionBy(key).orderBy("__row", "left", "element", "right")
    names = ("right", "top", "height", "element", "display", "column_gap", "justify", "margin")
    step = rows.withColumn("__p", F.lag(F.struct(*names)).over(along)).withColumn("__at", F.row_number().over(along))
    gap = F.col("left") - F.col("__p.right")
    em = gap / F.coalesce(F.nullif(F.col("font_size"), F.lit(0)), F.lit(16))
    near = F.abs(F.col("top") - F.col("__p.top")) <= F.greatest(F.lit(2), F.col("__p.height") / 2)
    shown = F.coalesce(F.col("__p.display"), F.lit(""))
    spaced = F.coalesce(F.col("__p.justify"), F.lit("")).rlike("space-(?:between|around|evenly)")
    has_gap = F.coalesce(F.col("__p.column_gap"), F.lit(0)) > 0
    cause = (
        F.when(shown == "table-cell", "table-cell")
        .when(spaced, "space-between")
        .when(F.coalesce(F.col("__p.margin"), F.lit(0)) + F.coalesce("margin", F.lit(0)) > 0.5, "margin")
        .when(F.contains(shown, F.lit("grid")), F.when(has_gap, "grid-gap").otherwise("unknown"))
        .when(F.contains(shown, F.lit("flex")), F.when(has_gap, "flex-gap").otherwise("unknown"))
        .otherwise("unknown")
    )
    found = (
        step.filter(near & (F.col("element") != F.col("__p.element")) & (gap > 0) & (em > limit_em))
        .select(
            key,
            F.concat(F.col("__p.element"), F.lit(" -> "), F.col("element")).alias("selector"),
            "text",
            (round_half_up(em * 100) / 100).alias("em"),
            round_half_up(F.col("top")).alias("top"),
            cause.alias("cause"),
            F.col("element").alias("__el"),
            round_half_up(F.col("top") / 8).alias("__band"),
            "__at",
        )
    )
    kept = found.groupBy(key, "cause", "__el", "__band").agg(
        F.min_by(F.struct("selector", "text", "em", "top"), "__at").alias("g"), F.min("__at").alias("__at")
    )
    out = kept.select(key, "g.*", "cause", "__at")
    if top is not None:
        rank = F.row_number().over(W.partitionBy(key).orderBy(F.col("em").desc(), "__at"))
        out = out.withColumn("__rank", rank).filter(F.col("__rank") <= top).drop("__rank")
    return out.drop("__at")


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values with their length and both ends."""
    return islands(df, keys, order, value)


def marker_segments(pages: DataFrame, marker: str, test: str, key: str = "page_id", text: str = "html") -> DataFrame:
    """Text from one marker to the next: ``key, pos, shows_text``; what precedes the first marker is dropped.

    ``marker`` is a pattern, ``test`` the pattern that a segment with text matches. A segment stays in the row of its
    document until it is one number.
    """
    parts = F.split(H.mask_raw(F.col(text)), marker)
    flags = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: p.rlike(test))
    return pages.select(key, F.posexplode(flags).alias("pos", "shows_text"))


def assemble_text(tokens: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """Text of each mark in stream order; nested text belongs to the innermost open mark.

    ``tokens``: ``key, idx, token, kind, tag`` of one document per key. Result: ``key, idx, tag, text`` with the
    white space removed.
    """
    marks = tokens.filter(F.col("tag").isin(*names) | (F.col("kind") == "text"))
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    order = W.partitionBy(key).orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    depth = marks.withColumn("depth", F.sum(step).over(order))
    per_level = W.partitionBy(key, "depth").orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    opened = F.when(F.col("kind") == "open", F.struct("idx", "tag"))
    owner = (
        depth.filter(F.col("kind") != "close")
        .withColumn("owner", F.last(opened, ignorenulls=True).over(per_level))
        .filter((F.col("depth") > 0) & F.col("owner").isNotNull())
    )
    pieces = owner.groupBy(key, "owner").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("idx", "token")))).alias("pieces"))
    joined = pieces.select(key, "owner.*", F.array_join(F.transform("pieces", lambda p: p["token"]), "").alias("raw"))
    return joined.select(key, "idx", "tag", normalize_text(H.decode_entities(F.col("raw"))).alias("text"))


def running_position(df: DataFrame, keys: list[str], order: list[str], advance: Column, restart: Column, origin: Column | None = None, name: str = "x") -> DataFrame:
    """Position of each item: origin plus the advances before it since the last restart."""
    out = restarting_sum(df, keys, order, advance, restart, name)
    return out if origin is None else out.withColumn(name, F.col(name) + origin)


def diffused_round(df: DataFrame, keys: list[str], order: list[str], value: Column, places: int, name: str = "rounded") -> DataFrame:
    """Each value rounded with the residue carried to the next one.

    Equal to the difference of the rounded running totals before and after the row; exact in decimals.
    """
    exact = value.cast("decimal(28,10)")
    cum = ordered_scan(df.withColumn("__v", exact), keys, order, sums={"__cum": F.col("__v")})
    unit = F.lit(10**places).cast("decimal(10,0)")

    def rounded(c: Column) -> Column:
        return F.floor(c * unit + F.lit("0.5").cast("decimal(2,1)"))

    step = rounded(F.col("__cum")) - rounded(F.col("__cum") - F.col("__v"))
    return cum.withColumn(name, (step / unit).cast(f"decimal(28,{places})")).drop("__v", "__cum")


def forward_fill(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The value of the row, else the last one before it."""
    out = ordered_scan(df.withColumn("__own", value), keys, order, lasts={"__before": F.col("__own")})
    return out.withColumn(name, F.coalesce("__own", "__before")).drop("__own", "__before")


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first rows per key. Spark keeps ``n`` rows per key and task before it shuffles."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def first_failure(df: DataFrame, keys: list[str], order: list[str], failed: Column) -> DataFrame:
    """The first failing row per key; combines on the map side."""
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in others])
    at = F.struct(*[F.col(c) for c in order])
    return df.filter(failed).groupBy(*keys).agg(F.min_by(row, at).alias("row")).select(*keys, "row.*")


def concurrency(df: DataFrame, start: str, end: str, limit: int, id_: str) -> DataFrame:
    """Jobs open at each start: ``id, start, open, above``. Jobs that end at the moment of a start are closed.

    The order is global; it is scanned in chunks of time, so no single task holds all events.
    """
    opens = df.select(F.col(start).alias("at"), F.lit(1).alias("step"), F.col(id_).alias("job"))
    closes = df.select(F.col(end).alias("at"), F.lit(-1).alias("step"), F.col(id_).alias("job"))
    events = opens.unionByName(closes)
    running = ordered_scan(events, [], ["at", "step", "job"], sums={"open": F.col("step").cast("bigint")})
    return running.filter(F.col("step") == 1).select(
        F.col("job").alias(id_), F.col("at").alias(start), "open", (F.col("open") > limit).alias("above")
    )


def retention(df: DataFrame, keys: list[str], ts: str, max_age: str, order: list[str]) -> DataFrame:
    """Rows no older than the limit before the newest row, and the newest row of each key."""
    newest = df.agg(F.max(ts).alias("m")).scalar()
    at = F.struct(*[F.col(c) for c in order])
    since = newest - F.expr(f"INTERVAL {max_age}")
    row = F.struct(*[F.col(c) for c in df.columns])
    last = df.groupBy(*keys).agg(F.max_by(row, at).alias("row")).select("row.*")
    young = df.filter(F.col(ts) >= since).withColumn("kept_as", F.lit("young"))
    return young.unionByName(last.filter(F.col(ts) < since).withColumn("kept_as", F.lit("newest")))


def top_k(df: DataFrame, keys: list[str], order: list[str], by: str, k: int) -> DataFrame:
    """The first row per composite key, then the ``k`` largest of them."""
    others = [c for c in df.columns if c not in keys]
    at = F.struct(*[F.col(c) for c in order])
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*others), at).alias("row")).select(*keys, "row.*")
    return first.orderBy(F.col(by).desc(), *order).limit(k)


def order_numeric(df: DataFrame, id_: str) -> DataFrame:
    """Rows in the numeric order of a text id; ids that are no number come last."""
    return df.orderBy(F.col(id_).try_cast("bigint").asc_nulls_last(), id_)


__all__ = [
    "assemble_text", "classify_gaps", "concurrency", "diffused_round", "first_failure", "first_n", "forward_fill",
    "marker_segments", "numbered", "order_numeric", "retention", "run_lengths", "running_position", "segments",
    "top_k", "wide_gaps",
]
