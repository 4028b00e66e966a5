"""Operators that compare two tables.

Sides that only name ids are made distinct before they are joined, which combines on the map side
first, so a key that holds a third of the rows meets one row. Groups of equal keys are compared by
their counts and their only member, never pair by pair.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.text import SPACE, normalize_text
from folioscan.operators.ordered import numbered


def reference_census(present: DataFrame, named: DataFrame, keys: list[str], textless: str | None = None) -> DataFrame:
    """Orphans (present, not named, holding text) and ghosts (named, not present).

    ``named`` carries ``role`` and ``ord``; a ghost takes its first role.
    """
    named_ids = named.select(*keys).distinct()
    holding = present if textless is None else present.filter(~F.col(textless))
    orphans = holding.select(*keys).distinct().join(named_ids, keys, "left_anti")
    roles = named.groupBy(*keys).agg(F.min_by("role", "ord").alias("role"))
    ghosts = roles.join(present.select(*keys).distinct(), keys, "left_anti")
    return orphans.select(*keys, F.lit("orphan").alias("kind"), F.lit(None).cast("string").alias("role")).unionByName(
        ghosts.select(*keys, F.lit("ghost").alias("kind"), "role")
    )


def untagged(documents: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """Documents that no structure names at all."""
    return documents.select(key).distinct().join(named.select(key).distinct(), key, "left_anti")


def dangling_refs(
    edges: DataFrame, nodes: DataFrame, ref: str, node: str, doc: str | None = None, skip: DataFrame | None = None, holds: Column | None = None
) -> DataFrame:
    """Referenced ids that no node defines, with the number of references.

    The references are counted per id before the join. Documents in ``skip`` are left out. With ``holds``, a condition on
    columns of the node and of the reference, ``nodes`` is one catalogue for all documents, and a node defines its id only where it holds.
    """
    keys = [ref] if doc is None else [doc, ref]
    work = edges if skip is None or doc is None else edges.join(skip.select(doc).distinct(), doc, "left_anti")
    counted = work.groupBy(*keys).agg(F.count("*").alias("refs"))
    if holds is not None:
        return counted.join(nodes, (F.col(ref) == F.col(node)) & holds, "left_anti")
    ids = nodes.select(*([] if doc is None else [doc]), F.col(node).alias(ref)).distinct()
    return counted.join(ids, keys, "left_anti")


def pair_by_position(a: DataFrame, b: DataFrame, key: str, order: list[str], value: str = "text") -> tuple[DataFrame, DataFrame]:
    """The i-th row of ``a`` with the i-th of ``b`` per key, where both have equally many.

    Returns ``(pairs, refusals)``: a key with unequal counts is refused whole with both counts; a key
    with nothing on the right has nothing to do and appears in neither.
    """
    counts = (
        a.groupBy(key).agg(F.count("*").alias("n_left"), F.lit(0).cast("bigint").alias("n_right"))
        .unionByName(b.groupBy(key).agg(F.lit(0).cast("bigint").alias("n_left"), F.count("*").alias("n_right")))
        .groupBy(key)
        .agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))
    )
    refused = counts.filter((F.col("n_right") > 0) & (F.col("n_left") != F.col("n_right")))
    left = numbered(a, [key], order).select(key, "rn", F.col(value).alias("left_value"))
    right = numbered(b, [key], order).select(key, "rn", F.col(value).alias("right_value"))
    bad = refused.select(key)
    pairs = left.join(right, [key, "rn"]).join(bad, key, "left_anti")
    return pairs, refused


def fill_parts(targets: DataFrame, parts: DataFrame, values: DataFrame, keys: list[str], part: str, value: str) -> DataFrame:
    """Fill the parts of each target; a target without parts takes the value itself (``part`` is null there).

    ``targets``: ``keys, value``; ``parts``: ``keys, part, value``; ``values``: ``keys, value``, one row per key.
    """
    bare = targets.join(parts.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(None).cast(parts.schema[part].dataType).alias(part), value)
    return fill_missing(parts.select(*keys, part, value).unionByName(bare), values, keys, value)


def fill_missing(target: DataFrame, values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Write a value where the target has none: adds ``filled`` and ``changed``.

    ``values`` holds one row per key.
    """
    new = values.select(*keys, F.col(value).alias("__new"))
    out = target.join(new, keys, "left")
    return out.select(
        *target.columns,
        F.coalesce(F.col(value), F.col("__new")).alias("filled"),
        (F.col(value).isNull() & F.col("__new").isNotNull()).alias("changed"),
    )


def _digest(c: Column) -> Column:
    """Digest that cannot be null: else the join would add a null check, which computes it again at the scan."""
    return F.coalesce(F.sha2(c, 256), F.lit(""))


def _singles(df: DataFrame, keys: list[Column], id_: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), F.min(id_).alias(f"first_{name}"))


def match_by_text(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    left_text: str,
    right_text: str,
    ancestors: DataFrame | None = None,
) -> DataFrame:
    """Match rows by their text without white space, mirrored text as a fallback.

    Texts are compared by their SHA-256, so no text is shuffled. One row per distinct left text:
    ``match_key, n_left, first_left, n_right, first_right, how, outcome``. ``how`` is ``exact`` or ``mirror`` or null. ``outcome`` is ``matched`` when the left
    text is unique and one right row carries it (with ``ancestors(ancestor, descendant)`` also
    when one of the right rows lies around all others), ``ambiguous`` when it cannot be told which
    row is meant, and ``none``. A sequential reader would give equal texts out in order; here equal
    texts on the left are ambiguous, which is the only answer that does not depend on an order.
    """
    key_l, key_r = normalize_text(F.col(left_text)), normalize_text(F.col(right_text))
    # Blank rows leave by a test that stops at the first character that shows.
    shows = rf"[^{SPACE[1:]}"
    texts = left.filter(F.col(left_text).rlike(shows)).select(F.col(left_id).alias("__id"), key_l.alias("__t"))
    keys = [_digest(F.col("__t")).alias("match_key"), _digest(F.reverse("__t")).alias("mirror_key")]
    wanted = _singles(texts, keys, "__id", "left")
    texts = right.filter(F.col(right_text).rlike(shows)).select(F.col(right_id).alias("__id"), key_r.alias("__t"))
    offered = _singles(texts, [_digest(F.col("__t")).alias("match_key")], "__id", "right")
    if ancestors is not None:
        # A right row that lies inside another right row of the same text is not outermost.
        named = right.select(F.col(right_id).alias("id"), _digest(key_r).alias("match_key"))
        inner = (
            ancestors.join(named.select(F.col("id").alias("descendant"), F.col("match_key")), "descendant")
            .join(named.select(F.col("id").alias("ancestor"), F.col("match_key").alias("outer_key")), "ancestor")
            .filter(F.col("match_key") == F.col("outer_key"))
            .groupBy("match_key", "ancestor")
            .agg(F.count_distinct("descendant").alias("inside"))
        )
        widest = inner.groupBy("match_key").agg(
            F.max("inside").alias("inside"), F.max_by("ancestor", "inside").alias("outermost")
        )
        offered = (
            offered.join(widest, "match_key", "left")
            .withColumn("around_all", F.coalesce(F.col("inside") == F.col("n_right") - 1, F.lit(False)))
            .withColumn("first_right", F.when(F.col("around_all"), F.col("outermost")).otherwise(F.col("first_right")))
            .withColumn("n_right", F.when(F.col("around_all"), F.lit(1)).otherwise(F.col("n_right")))
            .select("match_key", "n_right", "first_right")
        )
    exact = wanted.join(offered, "match_key", "left")
    # Rows that already have a partner look for their own digest with a prefix, which never matches; a null
    # key would send all of them to one task.
    done = F.col("n_right").isNotNull()
    seek = F.when(done, F.concat(F.lit("="), F.col("match_key"))).otherwise(F.col("mirror_key"))
    mirrored = offered.select(
        F.col("match_key").alias("seek"), F.col("n_right").alias("n_mirror"), F.col("first_right").alias("first_mirror")
    )
    both = exact.withColumn("seek", seek).join(mirrored, "seek", "left")
    how = F.when(done, "exact").when(F.col("n_mirror").isNotNull(), "mirror")
    both = both.select(
        "match_key", "n_left", "first_left",
        F.coalesce("n_right", "n_mirror").alias("n_right"),
        F.coalesce("first_right", "first_mirror").alias("first_right"),
        how.alias("how"),
    )
    outcome = (
        F.when(F.col("n_right").isNull(), "none")
        .when((F.col("n_left") == 1) & (F.col("n_right") == 1), "matched")
        .otherwise("ambiguous")
    )
    return both.withColumn("outcome", outcome)


def complete_groups(parents: DataFrame, kids: DataFrame, parent: str, kid_parent: str, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Parents all of whose children pass, and the children of those.

    Returns ``(kept_parents, kept_kids)``; a parent without children is not kept.
    """
    state = kids.groupBy(F.col(kid_parent).alias(parent)).agg(
        F.bool_and(F.coalesce(ok, F.lit(False))).alias("complete"), F.count("*").alias("n_kids")
    )
    kept = parents.join(state.filter("complete").drop("complete"), parent)
    inside = kept.select(F.col(parent).alias(kid_parent))
    return kept, kids.join(inside, kid_parent, "left_semi")


def redundant_parents(nodes: DataFrame, closure: DataFrame, node: str = "node", described: str = "described") -> DataFrame:
    """Undescribed nodes that have a described descendant; ``closure(ancestor, descendant)``."""
    told = nodes.filter(F.col(described)).select(F.col(node).alias("descendant"))
    above = closure.join(told, "descendant", "left_semi").select(F.col("ancestor").alias(node)).distinct()
    return nodes.filter(~F.col(described)).join(above, node, "left_semi")


def map_roles(df: DataFrame, role: str, existing: DataFrame, defaults: DataFrame) -> DataFrame:
    """Map values by an existing mapping, else by the defaults: adds ``mapped`` and ``source``.

    Both mappings ``role, standard`` list roles, of which there are few; the join method is left to
    the optimizer, which knows their size.
    """
    own = existing.select(F.col("role").alias(role), F.col("standard").alias("__own"))
    base = defaults.select(F.col("role").alias(role), F.col("standard").alias("__base"))
    out = df.join(own, role, "left").join(base, role, "left")
    return out.select(
        *df.columns,
        F.coalesce("__own", "__base", F.col(role)).alias("mapped"),
        F.when(F.col("__own").isNotNull(), "existing").when(F.col("__base").isNotNull(), "default").otherwise("none").alias("source"),
    )


def clean_ranges(ranges: DataFrame, lo: str = "lo", hi: str = "hi", max_span: int | None = None, max_code: int | None = None) -> DataFrame:
    """Drop ranges that end before they start. With ``max_span`` also those that span more, with ``max_code`` cut them to the codes."""
    out = ranges.filter(F.col(hi) >= F.col(lo))
    if max_span is not None:
        out = out.filter(F.col(hi) - F.col(lo) <= max_span)
    if max_code is not None:
        out = out.filter(F.col(lo) <= max_code).withColumn(hi, F.least(F.col(hi), F.lit(max_code)))
    return out


# Blocks of a level hold eight of the level below.
STEP = 3


def block_levels(clean: DataFrame) -> int:
    """Levels of blocks that the longest range fills."""
    span = clean.agg(F.max(F.col("hi").cast("double") - F.col("lo"))).first()[0]
    return 1 if span is None else min(int(math.log2(span + 1) / STEP + 1e-9), 62 // STEP) + 1


def range_blocks(clean: DataFrame, level: Column, lo: str = "lo") -> DataFrame:
    """Ranges cut into aligned blocks of a level: adds ``block``. Over all levels the blocks of a range cover each of its codes once.

    Block ``b`` of level ``n`` holds the codes from ``b * 8 ** n``. A level takes what the next one cannot, at most seven blocks at either end.
    """
    bits = level * STEP
    size, rest = F.lit(1 << STEP).cast("bigint"), F.lit((1 << STEP) - 1).cast("bigint")

    def ends(bits: Column) -> tuple[Column, Column]:
        """First and last block that lie in the range whole."""
        low, high = F.col(lo).cast("bigint"), F.col("hi").cast("bigint")
        mask = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), bits))
        first = F.call_function("shiftright", low, bits) + F.when(low.bitwiseAND(mask) == 0, 0).otherwise(1)
        last = F.call_function("shiftright", high, bits) - F.when(high.bitwiseAND(mask) == mask, 0).otherwise(1)
        return first, last

    first, last = ends(bits)
    first_up, last_up = ends(bits + STEP)
    up, none = (bits + STEP < 63) & (first_up <= last_up), F.array().cast("array<bigint>")
    whole = F.when(~up & (first <= last), F.sequence(first, last)).otherwise(none)
    left = F.when(up & (first < first_up * size), F.sequence(first, first_up * size - 1)).otherwise(none)
    right = F.when(up & (last_up * size + rest < last), F.sequence(last_up * size + rest + 1, last)).otherwise(none)
    return clean.withColumn("block", F.explode(F.concat(whole, left, right)))


def last_of_block(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The last range of each block by ``ord``: ``keys, last`` with ``ord, lo, base``."""
    return blocks.groupBy(*keys).agg(F.max_by(F.struct("ord", "lo", "base"), "ord").alias("last"))


def range_lookup(codes: DataFrame, ranges: DataFrame, code: str, max_span: int | None = None, max_code: int | None = None) -> DataFrame:
    """Value of a code in ``ranges(lo, hi, base, ord)``: ``base + (code - lo)``, the last range wins.

    Ranges are cut into aligned blocks, of which each keeps its last range only. A distinct code meets the one block around it per
    level, an equi join, so ranges that lie over each other are never paired with all codes in them. The answers go back to the rows
    by code. No code or span is too large; a caller may set bounds.
    """
    clean = clean_ranges(ranges, max_span=max_span, max_code=max_code).select(F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"), "base", "ord")
    levels = F.explode(F.sequence(F.lit(0), F.lit(block_levels(clean) - 1)))
    blocks = last_of_block(range_blocks(clean.withColumn("level", levels), F.col("level")), ["level", "block"])
    distinct = codes.select(F.col(code).cast("bigint").alias("code")).distinct()
    around = distinct.withColumn("level", levels).withColumn("block", F.call_function("shiftright", F.col("code"), F.col("level") * STEP))
    found = (
        around.join(blocks, ["level", "block"])
        .groupBy("code")
        .agg(F.max_by(F.col("last.base") + (F.col("code") - F.col("last.lo")), "last.ord").alias("value"))
    )
    return codes.join(found.withColumnRenamed("code", "__code"), F.col(code) == F.col("__code"), "left").drop("__code")


def fallback_resolve(df: DataFrame, primary: str, secondary: str, default: Column | None = None) -> DataFrame:
    """Primary value unless null or 0, else the secondary one, else the default: adds ``resolved``."""
    choices = [F.nullif(F.col(primary), F.lit(0)), F.nullif(F.col(secondary), F.lit(0))]
    return df.withColumn("resolved", F.coalesce(*choices, *([] if default is None else [default])))


def match_requests(requests: DataFrame, failures: DataFrame, id_: str = "request_id") -> DataFrame:
    """Failures with the address of their request, null where none is known. An id belongs to one request; of several the latest counts."""
    sent = requests.groupBy(id_).agg(F.max_by("url", "ts").alias("request_url"))
    return failures.join(sent, id_, "left")


def paired_sequences(a: DataFrame, b: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Full outer pairing of two ordered sequences per key by position: columns ``a_*`` and ``b_*``."""

    def side(df: DataFrame, name: str) -> DataFrame:
        n = numbered(df, [key], order)
        return n.select(key, "rn", *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key])

    return side(a, "a").join(side(b, "b"), [key, "rn"], "full_outer")


def same_sequence(a: DataFrame, b: DataFrame, key: str, order: list[str], codes: list[str], numbers: list[str], eps: float = 1e-4) -> DataFrame:
    """Per key: do both sequences have the same length, codes and, within ``eps``, numbers?"""
    names = list(dict.fromkeys([*order, *codes, *numbers]))
    sides = a.select(key, *names, F.lit(False).alias("__b")).unionByName(b.select(key, *names, F.lit(True).alias("__b")))
    # Both sides are numbered by one scan and meet by grouping; a position holds one row of a side at most.
    left, right = ({c: F.max(F.when(F.col("__b") == side, F.col(c))) for c in names} for side in (False, True))
    same = F.count("*") == 2
    for c in codes:
        same = same & left[c].eqNullSafe(right[c])
    for c in numbers:
        same = same & F.coalesce(F.abs(left[c] - right[c]) <= eps, F.lit(False))
    pairs = numbered(sides, [key, "__b"], order).groupBy(key, "rn").agg(same.alias("same"))
    return pairs.groupBy(key).agg(F.bool_and("same").alias("same"), F.count("*").alias("n"))


def preserved(before: DataFrame, after: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Rows whose payload is not the same before and after: ``keys, problem``.

    ``problem`` is ``added``, ``removed`` or ``changed``. ``keys`` identify a payload. Payloads travel as
    two hashes, not as text.
    """
    digest = F.struct(F.xxhash64(payload).alias("h"), F.length(payload).alias("n"), F.crc32(F.col(payload)).alias("c"))
    a = before.select(*keys, F.lit(True).alias("__a"), digest.alias("__pa"))
    b = after.select(*keys, F.lit(True).alias("__b"), digest.alias("__pb"))
    problem = (
        F.when(F.col("__a").isNull(), "added")
        .when(F.col("__b").isNull(), "removed")
        .when(~F.col("__pa").eqNullSafe(F.col("__pb")), "changed")
    )
    return a.join(b, keys, "full_outer").select(*keys, problem.alias("problem")).filter(F.col("problem").isNotNull())


def select_ranges(df: DataFrame, spec: str, order: str, first: int = 1) -> DataFrame:
    """Rows whose number lies in a range text such as ``1,4-6``; the numbering is that of the full set.

    ``order`` holds dense positions; ``first`` is the position that counts as 1. The text becomes a filter that
    reaches the scan.
    """
    if not re.fullmatch(r"\s*[1-9]\d*(-[1-9]\d*)?\s*(,\s*[1-9]\d*(-[1-9]\d*)?\s*)*", spec):
        raise ValueError(f"not a list of numbers and ranges: {spec!r}")
    ends = [[int(x) for x in part.split("-")] for part in spec.split(",")]
    inside = [F.col(order).between(e[0] + first - 1, e[-1] + first - 1) for e in ends]
    return df.filter(reduce(lambda x, y: x | y, inside))
