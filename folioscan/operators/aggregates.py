"""Aggregations: census, statistics, profiles and reports.

All of them combine on the map side. Distinct values are found by grouping, never by gathering a
group, and medians by counting equal values first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.functions import html as H
from folioscan.functions import text as T
from folioscan.functions.css import clean_styles
from folioscan.operators.ordered import ordered_scan

# Family names that stand for a kind of font.
GENERIC_FAMILY = (
    r"(?i)^(serif|sans-serif|monospace|cursive|fantasy|system-ui|ui-|math|emoji|fangsong|inherit|initial)$"
)

ICON_URL = r"/favicon\.ico(\?|$)"


def inspect(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Inspection record per page: size, header, distinct titles and counts of marks."""
    c = F.col(html)
    tags = H.tags(c)
    return pages.select(
        key,
        F.octet_length(c).alias("bytes"),
        F.substring(c, 1, 8).alias("header"),
        F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?i)<h[1-6][^>]*>"), F.lit(0)))).alias("heading_forms"),
        H.count_tags(tags, "p").alias("paragraphs"),
        H.count_tags(tags, "a").alias("links"),
        H.count_tags(tags, "li").alias("items"),
        H.count_tags(tags, "img").alias("images"),
        c.rlike(r"(?i)<(?:nav|main|article|header|footer)\b").alias("tagged"),
    )


def resolve_count(nodes: DataFrame, key: str, is_root: Column, declared: str, is_leaf: Column) -> DataFrame:
    """Count per key: the root's own, else the largest declared, else the number of leaves."""
    return nodes.groupBy(key).agg(
        F.coalesce(
            F.max(F.when(is_root, F.col(declared))), F.max(declared), F.count_if(is_leaf)
        ).alias("n")
    )


def css_families(pages: DataFrame, html: str = "html") -> DataFrame:
    """First family of every ``font-family`` declaration in the style sheets of the pages."""
    decl = F.regexp_extract_all(clean_styles(F.col(html)), F.lit(r"(?i)font-family\s*:\s*([^;{},]+)"), F.lit(1))
    name = F.regexp_replace(T.trimmed(F.col("family")), r"^[\"']|[\"']$", "")
    return pages.select(F.explode(decl).alias("family")).select(name.alias("family"))


def family_census(df: DataFrame, family: str, loaded: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows per family that is neither generic nor loaded, the most frequent first."""
    counts = (
        df.filter(~F.col(family).rlike(GENERIC_FAMILY) & (F.col(family) != ""))
        .groupBy(F.col(family).alias("family"))
        .agg(F.count("*").alias("n"))
        .join(loaded.select("family").distinct(), "family", "left_anti")
    )
    return counts if limit is None else counts.orderBy(F.col("n").desc(), "family").limit(limit)


def match_stats(df: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    """Number of rows seen and of rows that meet each condition, per key."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("seen"), *[F.count_if(c).alias(name) for name, c in conditions.items()]
    )


def plan_summary(df: DataFrame, tag: str = "tag") -> DataFrame:
    """Planned changes per tag."""
    return df.groupBy(F.col(tag).alias("tag")).agg(F.count("*").alias("n"))


def _ranked(found: DataFrame, keys: list[str], limit: int | None) -> DataFrame:
    """Rows with their rank by ``at``; only the first ones if there is a limit."""
    if limit is None:
        return found.withColumn("rank", F.col("at"))
    return found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("at"))).filter(F.col("rank") <= limit)


def failure_summary(df: DataFrame, keys: list[str], url: str, kind: str, order: list[str], limit: int | None = None) -> DataFrame:
    """Failed assets per key: number of distinct addresses, kinds, images and the addresses in order, or the first of them.

    Icon requests are dropped. Failures without address count one by one. The rows shrink to one
    per address before they are summed up.
    """
    work = df.filter(~F.coalesce(F.col(url).rlike(ICON_URL), F.lit(False)))
    at = F.struct(*[F.col(c) for c in order])
    known = (
        work.filter(F.col(url).isNotNull())
        .groupBy(*keys, url)
        .agg(F.min_by(kind, at).alias("kind"), F.min(at).alias("at"), F.lit(1).cast("bigint").alias("n"))
    )
    unknown = (
        work.filter(F.col(url).isNull())
        .groupBy(*keys, kind)
        .agg(F.count("*").alias("n"))
        .select(*keys, F.lit(None).cast("string").alias(url), F.col(kind).alias("kind"), "n")
    )
    rows = known.unionByName(unknown, allowMissingColumns=True)
    first = (
        _ranked(known, keys, limit)
        .groupBy(*keys)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", url))), lambda x: x[url]), "\n").alias("listed"))
    )
    totals = rows.groupBy(*keys).agg(
        F.sum("n").alias("failed"),
        F.count_distinct("kind").alias("kinds"),
        F.coalesce(F.sum(F.when(F.col("kind") == "Image", F.col("n"))), F.lit(0)).alias("images"),
    )
    return totals.join(first, keys, "left")


def distinct_errors(df: DataFrame, keys: list[str], message: str, order: list[str], limit: int | None = None) -> DataFrame:
    """Distinct messages per key in order; with ``limit`` the first ones and how many more there are."""
    at = F.struct(*[F.col(c) for c in order])
    found = df.groupBy(*keys, message).agg(F.min(at).alias("at"))
    first = _ranked(found, keys, limit)
    total = found.groupBy(*keys).agg(F.count("*").alias("n"))
    return (
        first.groupBy(*keys)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", message))), lambda x: x[message]), "; ").alias("listed"))
        .join(total, keys)
        .withColumn("more", F.lit(0).cast("bigint") if limit is None else F.greatest(F.col("n") - limit, F.lit(0)))
    )


def upper_median(df: DataFrame, keys: list[str], value: str, name: str = "p50") -> DataFrame:
    """``sorted[floor(n / 2)]`` per key, exact.

    Equal values are counted on the map side; the running count goes over the distinct values in
    chunks, so a key with a third of the rows is not sorted in one task.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    running = ordered_scan(counted, keys, [value], sums={"__upto": F.col("__n")})
    total = counted.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    want = F.floor(F.col("__total") / 2) + 1
    hit = (F.col("__upto") >= want) & (F.col("__upto") - F.col("__n") < want)
    return running.join(total, keys).filter(hit).select(*keys, F.col(value).alias(name))


def latency_profile(df: DataFrame, keys: list[str], ms: str, ok: Column | None = None, refused: Column | None = None, ts: str | None = None) -> DataFrame:
    """Runs, upper median, least and most per key; ok and refused counts and throughput where asked.

    Throughput is runs per second between the first and the last time stamp.
    """
    parts = [F.count("*").alias("n"), F.min(ms).alias("lo"), F.max(ms).alias("hi")]
    if ok is not None:
        parts.append(F.count_if(ok).alias("ok"))
    if refused is not None:
        parts.append(F.count_if(refused).alias("refused"))
    if ts is not None:
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
        wall = (F.max(micros) - F.min(micros)) / 1e6
        parts.append(F.when(wall > 0, F.count("*") / wall).alias("per_second"))
    return df.groupBy(*keys).agg(*parts).join(upper_median(df, keys, ms), keys, "left")


def cost_ratio(part: Column, whole: Column) -> Column:
    """Part as a percentage of the whole, one decimal."""
    return F.when(whole != 0, T.round_half_up(part * 1000 / whole) / 10)


def quality_profile(df: DataFrame, keys: list[str], size: str, pages: str, text: str, **flags: Column) -> DataFrame:
    """Size per page, flags that hold and words, per key."""
    words = F.size(F.filter(F.split(F.col(text), rf"{T.SPACE}+"), lambda w: w != ""))
    return (
        df.groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.sum(size).alias("bytes"),
            F.sum(pages).alias("pages"),
            F.sum(words).alias("words"),
            *[F.count_if(c).alias(name) for name, c in flags.items()],
        )
        .withColumn("kb_per_page", T.round_half_up(F.col("bytes") / 1024 / F.greatest(F.col("pages"), F.lit(1))))
    )


def corpus_report(
    pages: DataFrame, extracted: DataFrame, counts: DataFrame | None = None, key: str = "page_id", html: str = "html", text: str = "text", floor: float = 0.5,
) -> DataFrame:
    """Per document: ``source_words, got, retention, notes, clean``.

    ``extracted`` holds the text that came out (``key, text``); ``counts`` may hold ``rejected`` (rewrites that did not verify), ``metrics``
    (font metrics without a source) and ``failed`` (assets that did not load) per document. Notes, in this order: tags
    that do not balance, rejected rewrites, no text extracted, text under the floor, metrics, ligatures that were not expanded, failed assets.

    Either side becomes numbers and short lists before the join, so no text is shuffled; a document without an extracted text stays.
    """
    words = T.source_words_of(F.col(text))
    ligatures = F.size(F.filter(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(T.LIGATURE_BLOCK), F.lit(0))), lambda ch: T.ligature_of(ch).isNotNull()))
    got = extracted.select(key, words.cast("bigint").alias("words"), ligatures.alias("ligatures")).groupBy(key).agg(F.sum("words").alias("got"), F.max("ligatures").alias("ligatures"))
    c = F.col(html)
    judged = pages.select(key, H.source_words(c).cast("bigint").alias("source_words"), H.unbalanced(H.mask_raw(c)).alias("unbalanced")).join(got, key, "left")
    if counts is not None:
        judged = judged.join(counts, key, "left")

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("bigint"), F.lit(0)) if counts is not None and name in counts.columns else F.lit(0)

    def counted(n: Column, what: str) -> Column:
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {what}")))

    found = F.coalesce("got", F.lit(0))
    ratio = F.when(F.col("source_words") > 0, found / F.col("source_words")).otherwise(1.0)
    out = judged.withColumn("retention", ratio)
    lost = F.when(
        F.col("retention") < floor,
        F.concat(
            F.lit("lost text: "), T.round_half_up(F.col("retention") * 100).cast("string"), F.lit(" of 100 words left, source has "),
            F.col("source_words").cast("string"),
        ),
    )
    notes = F.array_compact(
        F.array(
            F.when(F.size("unbalanced") > 0, F.concat(F.lit("not verified: "), F.array_join("unbalanced", ", "))),
            counted(number("rejected"), "rewrites rejected"),
            F.when(F.col("got").isNull(), "no text extracted"),
            lost,
            counted(number("metrics"), "metrics without source"),
            counted(F.coalesce("ligatures", F.lit(0)), "ligatures left"),
            counted(number("failed"), "assets failed"),
        )
    )
    return out.select(key, "source_words", found.alias("got"), "retention", notes.alias("notes")).withColumn("clean", F.size("notes") == 0)


def corpus_totals(report: DataFrame) -> DataFrame:
    """One row for a corpus report: ``clean`` documents of ``documents``, and ``observations``, the notes of all."""
    return report.agg(F.count_if("clean").alias("clean"), F.count("*").alias("documents"), F.coalesce(F.sum(F.size("notes")), F.lit(0)).alias("observations"))


def coverage_floor(df: DataFrame, name: str, lines: str, hits: str, floor: float = 85.0, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Hits over lines without the excluded names, and whether that reaches the floor."""
    counted = ~F.col(name).isin(*exclude) if exclude else F.lit(True)
    sums = df.agg(
        F.sum(F.when(counted, F.col(lines))).alias("lines"),
        F.sum(F.when(counted, F.col(hits))).alias("hits"),
        F.coalesce(F.sum(F.when(~counted, F.col(lines))), F.lit(0)).alias("skipped_lines"),
        F.coalesce(F.sum(F.when(~counted, F.col(hits))), F.lit(0)).alias("skipped_hits"),
    )
    return sums.withColumn("pct", F.lit(100) * F.col("hits") / F.col("lines")).withColumn("passes", F.col("pct") >= floor)


def run_profile(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Per page: characters of text, tag runs and block openers."""
    c = H.mask_raw(F.col(html))
    return pages.select(
        key,
        F.length(T.normalize_text(F.regexp_replace(c, rf"(?s){H.TAG}", ""))).alias("glyphs"),
        F.regexp_count(c, F.lit(r"(?:</?[a-zA-Z][\w-]*[^>]*>)+")).alias("runs"),
        F.regexp_count(c, F.lit(r"(?i)<(?:p|li|h1|div|nav|footer|article)\b")).alias("blocks"),
    )


def unresolved_expansions(df: DataFrame, text: str) -> DataFrame:
    """Distinct characters that still stand for several letters, with the rows that hold them."""
    chars = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(T.LIGATURE_BLOCK), F.lit(0)))
    return (
        df.select(F.explode(chars).alias("ch"))
        .groupBy("ch")
        .agg(F.count("*").alias("n_rows"))
        .withColumn("expands_to", T.ligature_of(F.col("ch")))
        .filter(F.col("expands_to").isNotNull())
    )


# The counters that make a text flow fragmented, in the order in which they are reported.
FLOW_REASONS = ("too_wide", "jumps", "too_thin", "backwards", "unreadable", "spans")


def text_flow(classified: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of the text flow per key over classified gaps (``gap_class``, ``em``, ``unknown``)."""
    k = F.col("gap_class")
    gap = k.isin("thin", "tight", "flow", "wide", "jump")
    spans = F.sum("span").cast("bigint") if "span" in classified.columns else F.lit(0).cast("bigint")
    return classified.groupBy(*keys).agg(
        F.count("*").alias("glyphs"),
        F.count_if(gap).alias("gaps"),
        F.count_if(k.isin("thin", "wide", "jump", "back")).alias("breaks"),
        F.count_if(k == "wide").alias("too_wide"),
        F.count_if(k == "jump").alias("jumps"),
        F.count_if(k == "thin").alias("too_thin"),
        F.count_if(k == "back").alias("backwards"),
        (F.count_if(k == "line") + 1).alias("lines"),
        F.coalesce(F.max(F.when(gap & (F.col("em") <= 3), F.col("em"))), F.lit(0.0)).alias("widest"),
        F.coalesce(F.max(F.when(gap, F.col("em"))), F.lit(0.0)).alias("widest_all"),
        F.coalesce(F.min(F.when(gap, F.col("em"))), F.lit(0.0)).alias("narrowest"),
        F.count_if(F.col("unknown")).alias("unreadable"),
        F.coalesce(spans, F.lit(0)).alias("spans"),
    )


def flow_totals(streams: DataFrame, keys: list[str]) -> DataFrame:
    """Flow of a document from the flows of its streams (``is_read`` marks the readable ones)."""
    added = ("glyphs", "gaps", "breaks", "too_wide", "jumps", "too_thin", "backwards", "lines", "unreadable", "spans")
    measured = F.col("is_read") & (F.col("gaps") > 0)
    return streams.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(F.col("is_read"), F.col(c))), F.lit(0)).alias(c) for c in added],
        F.coalesce(F.max(F.when(measured, F.col("widest"))), F.lit(0.0)).alias("widest"),
        F.coalesce(F.max(F.when(measured, F.col("widest_all"))), F.lit(0.0)).alias("widest_all"),
        F.coalesce(F.min(F.when(measured, F.col("narrowest"))), F.lit(0.0)).alias("narrowest"),
        F.count("*").alias("streams"),
        F.count_if("is_read").alias("read"),
    )


def flow_reasons(flow: DataFrame) -> DataFrame:
    """Is the flow fragmented, and why: reasons in fixed order."""
    gaps = (F.col("too_wide") > 0) | (F.col("jumps") > 0) | (F.col("too_thin") > 0) | (F.col("backwards") > 0)
    bad = ((F.col("breaks") > 0) & gaps) | (F.col("spans") > 0) | (F.col("unreadable") > 0)
    reasons = F.array_compact(
        F.array(
            *[
                F.when(F.col(c) > 0, F.concat(F.lit(f"{c}="), F.col(c).cast("string")))
                for c in FLOW_REASONS
            ]
        )
    )
    return flow.withColumn("fragmented", bad).withColumn(
        "reasons", F.when(bad, F.array_join(reasons, "; ")).otherwise("")
    )
