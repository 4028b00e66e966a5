"""Element tables of pages and what follows from their nesting.

Every window here is per page: its rows come from one row of the page table, so a group is never
larger than one document. The tables carry tags and offsets, never the page text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.functions import html as H
from folioscan.functions.text import normalize_text, trimmed

# The tags of the landmark census.
LANDMARKS = ("nav", "main", "section", "header", "footer", "dl", "dt", "dd")


def tokens(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Tags and text runs of each page in order: ``key, idx, token, kind, tag``."""
    pieces = F.regexp_extract_all(H.mask_raw(F.col(html)), F.lit(H.TAG_OR_TEXT), F.lit(0))
    token = F.col("token")
    kind = (
        F.when(token.rlike(rf"^</{H.TAG[3:]}"), "close")
        .when(token.rlike(rf"^{H.TAG}"), "open")
        .otherwise("text")
    )
    return (
        pages.select(key, F.posexplode(pieces).alias("idx", "token"))
        .withColumn("kind", kind)
        .withColumn("tag", F.when(F.col("kind") != "text", H.tag_name(token)))
    )


def elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per tag in document order: ``key, idx, tag, kind, token`` (the token holds the attributes)."""
    token = F.col("token")
    kind = F.when(token.startswith("</"), "close").when(H.tag_name(token).isin(*H.VOID), "void").otherwise("open")
    return pages.select(key, F.posexplode(H.tags(F.col(html))).alias("idx", "token")).select(
        key, "idx", H.tag_name(token).alias("tag"), kind.alias("kind"), "token"
    )


def element_spans(
    tags: DataFrame,
    key: str = "page_id",
    names: tuple[str, ...] | None = None,
    ends: tuple[str, ...] = (),
    parents: tuple[str, ...] = (),
) -> DataFrame:
    """Opening tags with their end and their parent: adds ``close_idx``, ``depth`` and ``parent_idx``.

    ``tags`` holds ``key, idx, tag, kind`` and more columns. ``ends`` names columns to take from the closing tag
    (as ``end_<name>``), ``parents`` columns to take from the parent (as ``parent_<name>``).

    An opening tag ends at the closing tag of its name at the same level. One without such a tag ends
    with the innermost closed element around it, else with the page (null). All steps are windows
    over the page in one partitioning, so the tags are shuffled once.
    """
    work = tags.filter(F.col("kind").isin("open", "close"))
    if names:
        work = work.filter(F.col("tag").isin(*names))
    work = work.repartition(key)
    is_open = F.col("kind") == "open"

    # Level per name: opens minus closes, less the lowest count so far, so that stray closing tags shift nothing.
    by_tag = W.partitionBy(key, "tag").orderBy("idx")
    upto = by_tag.rowsBetween(W.unboundedPreceding, W.currentRow)
    work = work.withColumn("__cum", F.sum(F.when(is_open, 1).otherwise(-1)).over(upto))
    work = work.withColumn("__low", F.least(F.lit(0), F.min("__cum").over(upto)))
    work = work.withColumn("__was", F.coalesce(F.lag("__low").over(by_tag), F.lit(0)))
    work = work.filter(is_open | (F.col("__low") == F.col("__was")))
    work = work.withColumn("__lvl", F.col("__cum") - F.col("__low") + F.when(is_open, 0).otherwise(1))
    by_level = W.partitionBy(key, "tag", "__lvl").orderBy("idx")
    end = F.struct(F.col("idx").alias("close_idx"), *[F.col(c).alias(f"end_{c}") for c in ends])
    partner = F.when(F.lead("kind").over(by_level) == "close", F.lead(end).over(by_level))
    work = work.withColumn("__end", F.when(is_open, partner))

    # Depth among the closed elements gives each tag without an end the innermost element around it.
    work = work.withColumn("__loose", is_open & F.col("__end").isNull())
    loose = F.col("__loose")
    in_page = W.partitionBy(key).orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    step = F.when(loose, 0).when(is_open, 1).otherwise(-1)
    work = work.withColumn("__label", F.sum(step).over(in_page))
    around = W.partitionBy(key, "__label").orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    work = work.withColumn("__around", F.last(F.when(is_open, F.col("__end")), ignorenulls=True).over(around))
    work = work.withColumn("__end", F.when(loose & (F.col("__label") > 0), F.col("__around")).otherwise(F.col("__end")))

    # Events: an element opens, and closes at its own closing tag or, if it has none, with the element around it.
    virtual = F.struct(F.coalesce("__end.close_idx", F.lit(2**31 - 1)).alias("at"), F.lit(-2).alias("delta"))
    opening = F.struct(F.col("idx").alias("at"), F.lit(1).alias("delta"))
    closing = F.struct(F.col("idx").alias("at"), F.lit(-1).alias("delta"))
    events = F.when(loose, F.array(opening, virtual)).when(is_open, F.array(opening)).otherwise(F.array(closing))
    work = work.withColumn("__loose_events", events).withColumn("__e", F.explode("__loose_events")).drop("__loose_events")
    in_order = W.partitionBy(key).orderBy("__e.at", "__e.delta")
    running = in_order.rowsBetween(W.unboundedPreceding, W.currentRow)
    work = work.withColumn("depth", F.sum(F.signum("__e.delta").cast("int")).over(running))
    above = F.struct(F.col("idx").alias("idx"), *[F.col(c) for c in parents])
    work = work.withColumn("__prev", F.lag(F.when(F.col("__e.delta") == 1, above)).over(in_order))
    opens = work.filter(F.col("__e.delta") == 1)

    # The first child of an element follows its opening tag; later children take over what the first one found.
    by_depth = W.partitionBy(key, "depth").orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    opens = opens.withColumn("__parent", F.last("__prev", ignorenulls=True).over(by_depth))
    return opens.select(
        *tags.columns,
        "__end.close_idx",
        *[f"__end.end_{c}" for c in ends],
        "depth",
        F.col("__parent.idx").alias("parent_idx"),
        *[F.col(f"__parent.{c}").alias(f"parent_{c}") for c in parents],
    )


def landmark_census(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Landmarks of each page: ``key, idx, tag, text, owner``.

    ``idx`` numbers the landmarks of the page, ``owner`` is the number of the nearest landmark
    around it or -1. The text is cut out of the page text by offsets; pages without landmarks leave at the scan.
    """
    pattern = rf"(?i)<(?:{'|'.join(LANDMARKS)})\b"
    marked = pages.filter(F.col(html).rlike(pattern))
    size = F.when(F.col("kind") == "text", F.length(normalize_text(H.decode_entities(F.col("token"))))).otherwise(0)
    # The text runs become their length before anything is shuffled.
    parts = tokens(marked, key, html).select(key, "idx", "kind", "tag", size.alias("size")).repartition(key)
    order = W.partitionBy(key).orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = F.col("tag").isin(*LANDMARKS) & (F.col("kind") == "open")
    placed = (
        parts.withColumn("offset", F.sum("size").over(order))
        .withColumn("no", F.sum(F.coalesce(counted, F.lit(False)).cast("int")).over(order) - 1)
        .drop("size")
    )
    spans = element_spans(placed, key, LANDMARKS, ends=("offset",), parents=("no",))
    whole = marked.select(key, H.landmark_text(F.col(html)).alias("whole"))
    length = F.coalesce("end_offset", F.length("whole")) - F.col("offset")
    return spans.join(whole, key).select(
        key,
        F.col("no").alias("idx"),
        "tag",
        F.substr(F.col("whole"), F.col("offset") + 1, length).alias("text"),
        F.coalesce("parent_no", F.lit(-1)).alias("owner"),
    )


def figure_audit(tags: DataFrame, key: str = "page_id") -> DataFrame:
    """Figures with neither a caption nor a described image inside: ``key, idx``."""
    described = (F.col("tag") == "img") & (trimmed(F.coalesce(H.attr(F.col("token"), "alt"), F.lit(""))) != "")
    named = (F.col("kind") != "close") & ((F.col("tag") == "figcaption") | described)
    order = W.partitionBy(key).orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.partitionBy(key)
    wanted = tags.filter(F.col("tag").isin("figure", "figcaption", "img")).repartition(key)
    marked = wanted.withColumn("named", F.sum(named.cast("int")).over(order))
    marked = marked.withColumn("all_named", F.max("named").over(everything))
    spans = element_spans(marked, key, ("figure",), ends=("named",))
    return spans.filter(F.coalesce("end_named", "all_named") == F.col("named")).select(key, "idx")


def element_tree(tags: DataFrame, key: str = "page_id", names: tuple[str, ...] | None = None) -> DataFrame:
    """Parent of every opening tag: ``key, idx, tag, depth, parent_idx`` (null parent at the top)."""
    return element_spans(tags.select(key, "idx", "tag", "kind"), key, names).select(key, "idx", "tag", "depth", "parent_idx")


def attribute(name: str, token: Column | None = None) -> Column:
    """Attribute of the ``token`` column."""
    return H.attr(F.col("token") if token is None else token, name)
