"""Rewrites of texts that are kept only when they verify, and checks on rewrites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators.joins import STEP, block_levels, clean_ranges, last_of_block, range_blocks
from folioscan.operators.ordered import ordered_scan

Rewrite = Callable[[Column], Column]
Verify = Callable[[Column, Column], Column]


def strip_redundant(df: DataFrame, text: str, wrapper: str, declared: Column, resolved: Column) -> DataFrame:
    """Remove the wrapper where its declared text equals the resolved one: adds ``stripped`` and ``rewritten``.

    A wrapper whose text differs or cannot be resolved is kept.
    """
    same = F.coalesce(declared == resolved, F.lit(False)) & F.col(text).rlike(wrapper)
    out = df.withColumn("stripped", same)
    return out.withColumn("rewritten", F.when(F.col("stripped"), F.regexp_replace(text, wrapper, "")).otherwise(F.col(text)))


def gated_column(c: Column, candidate: Column, problem: Column) -> Column:
    """``{value, state, problem}``: the candidate if it changes something and verifies, else the original."""
    state = (
        F.when(candidate.eqNullSafe(c), "unchanged").when(problem.isNotNull(), "rejected").otherwise("applied")
    )
    return F.struct(
        F.when(state == "applied", candidate).otherwise(c).alias("value"),
        state.alias("state"),
        F.when(state == "rejected", problem).alias("problem"),
    )


def gated(df: DataFrame, key: str, text: str, rewrite: Rewrite, verify: Verify) -> tuple[DataFrame, DataFrame]:
    """Apply a rewrite row by row where it verifies.

    ``verify(original, candidate)`` gives the problem or null. Returns the table with the rewritten text and its
    ``state``, and the rejected rows as findings.
    """
    candidate = df.withColumn("__new", rewrite(F.col(text)))
    checked = candidate.withColumn("__gate", gated_column(F.col(text), F.col("__new"), verify(F.col(text), F.col("__new"))))
    out = checked.select(*[c for c in df.columns if c != text], F.col("__gate.value").alias(text), F.col("__gate.state").alias("state"))
    rejected = checked.filter(F.col("__gate.state") == "rejected").select(
        key, F.lit("repair-rejected").alias("code"), F.col("__gate.problem").alias("message")
    )
    return out, rejected


def rewrite_chain(df: DataFrame, text: str, steps: list[tuple[str, Rewrite, Verify]]) -> DataFrame:
    """Gated rewrites one after another in one pass: the final text, and the names ``applied`` and ``rejected``."""
    none = F.array().cast("array<string>")
    out = df.withColumn("applied", none).withColumn("rejected", none)
    for name, rewrite, verify in steps:
        out = out.withColumn("__new", rewrite(F.col(text)))
        out = out.withColumn("__gate", gated_column(F.col(text), F.col("__new"), verify(F.col(text), F.col("__new"))))
        for state in ("applied", "rejected"):
            added = F.when(F.col("__gate.state") == state, F.array_append(state, F.lit(name))).otherwise(F.col(state))
            out = out.withColumn(state, added)
        out = out.withColumn(text, F.col("__gate.value")).drop("__new", "__gate")
    return out


def idempotent(df: DataFrame, key: str, text: str, rewrite: Rewrite) -> DataFrame:
    """Rows that a second application of the rewrite changes; none for a sound rewrite."""
    once = df.select(key, rewrite(F.col(text)).alias("__once"))
    twice = once.withColumn("__twice", rewrite(F.col("__once")))
    return twice.filter(~F.col("__once").eqNullSafe(F.col("__twice"))).select(key)


def _in_blocks(df: DataFrame, keys: list[str], order: list[str], value: str, simple: str, block: str) -> DataFrame:
    """Items with ``__at`` (their number in the block), ``__ok`` (the block is simple) and ``__run`` (the number of their run)."""
    part = [*keys, block]
    ordered = W.partitionBy(*part).orderBy(*order)
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = df.withColumn("__at", F.row_number().over(ordered) - 1).withColumn("__ok", F.bool_and(simple).over(W.partitionBy(*part)))
    starts = F.col("__ok") & ((F.col("__at") == 0) | ~F.lag(value).over(ordered).eqNullSafe(F.col(value)))
    return marked.withColumn("__starts", starts).withColumn("__run", F.sum(F.col("__starts").cast("int")).over(upto)).drop("__starts")


def merge_runs(
    df: DataFrame, keys: list[str], order: list[str], value: str, simple: str, block: str, *,
    text: str | None = None, x: str = "x", width: str = "width", places: int = 3,
) -> DataFrame:
    """Merge consecutive equal items of a block: ``keys, block, value, first, last, n, state``.

    A block with an item that is not simple is refused: its items stay as they are and count as one
    ``refused`` row, and the other blocks still merge. Runs of one item are ``single``.

    With ``text`` a run also gets ``run`` (its number in the block), ``text`` (that of its items in order), ``start`` (the ``x`` of the first) and ``gaps``: for each item the distance
    from the end of the one before it (``x`` plus ``width``), rounded to ``places`` so that what one rounding leaves over goes into the next and errors do
    not add up. ``replay`` rebuilds the places of all items from that. A refused block has no text.

    A block comes from one document. All steps are windows and one aggregate in one partitioning by key and block: the items are shuffled once.
    """
    part = [*keys, block]
    items = _in_blocks(df, keys, order, value, simple, block)
    at = F.struct(*[F.col(c) for c in order])
    state = F.when(~F.col("__ok"), "refused").when(F.col("n") > 1, "merged").otherwise("single")
    base = [F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"), F.first("__ok").alias("__ok")]
    kept = F.min_by(value, "__at").alias("__value")
    more = []
    if text is not None:
        in_run = W.partitionBy(*part, "__run").orderBy("__at")
        before = in_run.rowsBetween(W.unboundedPreceding, -1)
        spread = F.col(x) - F.first(x).over(in_run) - F.coalesce(F.sum(width).over(before), F.lit(0))
        items = items.withColumn("__due", F.round(spread, places))
        items = items.withColumn("__gap", F.col("__due") - F.lag("__due", 1, 0.0).over(in_run))
        piece = F.struct(F.col("__at").alias("at"), F.col(text).alias("text"), F.round("__gap", places).alias("gap"))
        ordered = F.array_sort(F.collect_list(F.when(F.col("__ok"), piece)))
        base += [ordered.alias("__pieces"), F.min_by(F.when(F.col("__ok"), F.col(x)), "__at").alias("start")]
        whole = F.when(F.col("__ok"), F.array_join(F.transform("__pieces", lambda p: F.coalesce(p["text"], F.lit(""))), ""))
        more = [F.col("__run").alias("run"), whole.alias("text"), "start", F.transform("__pieces", lambda p: p["gap"]).alias("gaps")]
    runs = items.groupBy(*part, "__run").agg(kept, *base)
    return runs.select(*part, F.when(F.col("__ok"), F.col("__value")).alias(value), "first", "last", "n", state.alias("state"), *more)


def _pieces(c: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), change), "")


def pin_dates(c: Column, epoch: Column) -> Column:
    """Dates rewritten to one moment, cut or padded with blanks so that the text keeps its length."""
    pinned = T.pinned_date(epoch)
    iso = F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss")
    date = r"D:\d{14}(?:[+\-]\d{2}'?\d{2}'?|Z)"
    tag = r"<(xmp:(?:CreateDate|ModifyDate))>([^<]{0,40})</\1>"
    out = F.when(
        c.rlike(date),
        _pieces(c, rf"(?s){date}|[^D]++|.", lambda p: F.when(p.rlike(rf"^{date}$"), F.rpad(pinned, F.length(p), F.lit(" "))).otherwise(p)),
    ).otherwise(c)

    def packet(p: Column) -> Column:
        name = F.regexp_extract(p, tag, 1)
        value = F.rpad(iso, F.length(F.regexp_extract(p, tag, 2)), F.lit(" "))
        return F.when(p.rlike(rf"^{tag}$"), F.concat(F.lit("<"), name, F.lit(">"), value, F.lit("</"), name, F.lit(">"))).otherwise(p)

    return F.when(out.rlike(tag), _pieces(out, rf"(?s){tag}|[^<]++|.", packet)).otherwise(out)


def first_difference(a: Column, b: Column) -> Column:
    """``{same, at, left, right, left_length, right_length}``: 0-based first differing position (-1 where one text is a prefix of the other).

    Found by halving: the longest common prefix is searched in 31 steps of substring comparisons, so a
    long text is not taken apart into characters.
    """
    n = F.least(F.length(a), F.length(b))
    bounds = F.aggregate(
        F.sequence(F.lit(1), F.lit(31)),
        F.struct(F.lit(0).alias("lo"), n.cast("int").alias("hi")),
        lambda acc, _: F.when(acc["lo"] >= acc["hi"], acc).otherwise(_halve(acc, a, b)),
    )
    at = F.when(bounds["lo"] < n, bounds["lo"]).otherwise(-1)
    start = F.greatest(bounds["lo"] - 30, F.lit(0)) + 1
    same = a.eqNullSafe(b)
    size = bounds["lo"] + 20 - (start - 1)
    return F.struct(
        same.alias("same"),
        F.when(~same, at).alias("at"),
        F.when(~same & (at >= 0), F.substr(a, start, size)).alias("left"),
        F.when(~same & (at >= 0), F.substr(b, start, size)).alias("right"),
        F.length(a).alias("left_length"),
        F.length(b).alias("right_length"),
    )


def _halve(acc: Column, a: Column, b: Column) -> Column:
    # Invariant: the first ``lo`` characters agree, and the common prefix has at most ``hi``.
    mid = F.ceil((acc["lo"] + acc["hi"]) / 2).cast("int")
    agree = F.substr(a, F.lit(1), mid) == F.substr(b, F.lit(1), mid)
    return F.when(agree, F.struct(mid.alias("lo"), acc["hi"].alias("hi"))).otherwise(
        F.struct(acc["lo"].alias("lo"), (mid - 1).cast("int").alias("hi"))
    )


def apply_by_index(df: DataFrame, changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Replace values at recorded indexes; all other rows stay. ``changes`` holds one row per index."""
    new = changes.select(*keys, F.col(value).alias("__new"), F.lit(True).alias("__hit"))
    out = df.join(new, keys, "left")
    return out.select(
        *[F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(c)).alias(c) if c == value else F.col(c) for c in df.columns],
        F.coalesce("__hit", F.lit(False)).alias("replaced"),
    )


def expand_ranges(ranges: DataFrame, keys: list[str], max_span: int | None = None, max_code: int | None = None) -> DataFrame:
    """Ranges ``lo, hi, base, ord`` written out as ``keys, code, value``; the last entry for a code wins.

    ``base`` is a number or the hexadecimal text of 16-bit units, every one of which grows with the code. Ranges are cut into aligned
    blocks; from the largest blocks down, each hands its last range to its parts, so a code is written out once, not once per range over it.
    """
    clean = clean_ranges(ranges, max_span=max_span, max_code=max_code).filter(F.col("hi") >= 0)
    kind = clean.select(F.explode(F.sequence(F.greatest(F.col("lo"), F.lit(0)), F.col("hi"))).alias("code")).schema["code"].dataType
    clean = clean.withColumn("__from", F.greatest(F.col("lo"), F.lit(0)))
    last = None
    for level in reversed(range(block_levels(clean))):
        here = range_blocks(clean, F.lit(level), "__from").select(*keys, "block", "ord", "lo", "base")
        if last is not None:
            first = F.col("block") * (1 << STEP)
            parts = last.withColumn("block", F.explode(F.sequence(first, first + (1 << STEP) - 1)))
            here = here.unionByName(parts.select(*keys, "block", "last.ord", "last.lo", "last.base"))
        last = last_of_block(here, [*keys, "block"])
    codes = last.select(*keys, F.col("block").cast(kind).alias("code"), "last.lo", "last.base")
    step = F.col("code") - F.col("lo")
    if ranges.schema["base"].dataType.simpleString() == "string":
        units = F.regexp_extract_all(F.col("base"), F.lit("[0-9A-Fa-f]{4}"), F.lit(0))
        value = F.array_join(
            F.transform(
                units,
                lambda u: F.lpad(F.hex((F.conv(u, 16, 10).cast("bigint") + step).bitwiseAND(F.lit(0xFFFF))), 4, "0"),
            ),
            "",
        )
    else:
        value = F.col("base") + step
    return codes.select(*keys, "code", value.alias("value"))


def xmp_packet(title: Column, subject: Column, author: Column, keywords: Column, created: Column) -> Column:
    """Metadata packet with only the fields that are present, values escaped."""

    def wrapped(tag: str, kind: str, c: Column, attributes: str = "") -> Column:
        return F.concat(
            F.lit(f"<dc:{tag}><rdf:{kind}><rdf:li{attributes}>"), T.xml_escape(c), F.lit(f"</rdf:li></rdf:{kind}></dc:{tag}>")
        )

    language = ' xml:lang="x-default"'
    return F.concat_ws(
        "\n",
        F.lit('<rdf:Description rdf:about="">'),
        wrapped("title", "Alt", title, language),
        wrapped("description", "Alt", subject, language),
        wrapped("creator", "Bag", author),
        wrapped("subject", "Bag", keywords),
        F.concat(F.lit("<xmp:CreateDate>"), T.iso_from_pdf_date(created), F.lit("</xmp:CreateDate>")),
        F.lit("</rdf:Description>"),
    )


def replay(df: DataFrame, merged: DataFrame, keys: list[str], order: list[str], value: str, simple: str, block: str, *, x: str = "x", width: str = "width", eps: float = 0.005) -> DataFrame:
    """Play merged runs back and compare them with the items: ``keys, block, item, order, value, x, replayed, same``.

    The runs of a block follow each other, and a run names its items by its ``gaps``. An item is placed at the start of its run plus the gaps up to it plus
    the widths of the items of the run before it. ``same`` says that item and run agree in value and that the place is within ``eps``; an item that
    no run gives back, or one that the block never had, is not the same. Blocks that were refused are not replayed.
    """
    part = [*keys, block]
    items = _in_blocks(df, keys, order, value, simple, block).where("__ok").select(*part, F.col("__at").alias("item"), *order, F.col(value).alias("__value"), F.col(x).alias("x"), F.col(width).alias("__width"))
    earlier = W.partitionBy(*part).orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = merged.where("state <> 'refused'").withColumn("__offset", F.coalesce(F.sum(F.size("gaps")).over(earlier), F.lit(0)))
    given = runs.select(*[F.col(c).alias(f"__{c}") for c in part], "run", F.col(value).alias("__given"), "start", "__offset", F.posexplode("gaps").alias("__pos", "__gap"))
    same_block = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in part]
    both = items.join(given, [*same_block, F.col("item") == F.col("__offset") + F.col("__pos")], "full_outer")
    named = both.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in part], F.coalesce("item", F.col("__offset") + F.col("__pos")).alias("item"), *order, F.coalesce("__value", "__given").alias(value), "x", "__value", "__given", "__width", "__gap", "start", "run")
    upto = W.partitionBy(*part, "run").orderBy("item").rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = W.partitionBy(*part, "run").orderBy("item").rowsBetween(W.unboundedPreceding, -1)
    replayed = F.col("start") + F.sum("__gap").over(upto) + F.coalesce(F.sum("__width").over(ahead), F.lit(0))
    placed = named.withColumn("replayed", F.when(F.col("run").isNotNull(), replayed))
    same = F.col("__value").eqNullSafe(F.col("__given")) & (F.abs(F.col("x") - F.col("replayed")) <= eps)
    return placed.select(*part, "item", *order, value, "x", "replayed", F.coalesce(same, F.lit(False)).alias("same"))


__all__ = [
    "apply_by_index", "expand_ranges", "first_difference", "gated", "gated_column", "idempotent", "merge_runs",
    "ordered_scan", "pin_dates", "replay", "rewrite_chain", "strip_redundant", "xmp_packet",
]
