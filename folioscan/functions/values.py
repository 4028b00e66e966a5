"""Functions on small values: paths, hosts, ranges, limits, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions.text import round_half_up, trimmed

LOOPBACK = r"(?i)^(?:127\.0\.0\.1|\[::1\]|localhost)(?::\d+)?$"
VOLATILE_TITLE = r"(?i)^(?:127\.0\.0\.1|localhost|\[::1\]):\d+/\S*|^about:blank$"
RANGE = r"^[1-9]\d*(-[1-9]\d*)?$"


def clamped_path(c: Column) -> Column:
    """Path with ``.`` dropped and ``..`` popped, never above the root."""
    parts = F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.array_append(acc, p)),
    )
    return F.array_join(kept, "/")


def resolved_path(root: Column, ref: Column) -> Column:
    """Absolute path of a reference below a root; absolute references stay as they are."""
    whole = F.when(ref.startswith("/"), ref).otherwise(F.concat(root, F.lit("/"), ref))
    return F.concat(F.lit("/"), clamped_path(whole))


def loopback_host(c: Column) -> Column:
    """True for a loopback host with a port of at most 65535, and for no host at all."""
    port = F.regexp_extract(c, r":(\d+)$", 1)
    bracketed = c.rlike(r"(?i)^\[[0-9a-f:]+\]$")
    ok = (port == "") | bracketed | ((F.length(port) <= 5) & (port.try_cast("int") <= 65535))
    return F.when(c.isNull(), True).otherwise(c.rlike(LOOPBACK) & ok)


def volatile_title(c: Column) -> Column:
    """True for titles that are a local address or a blank page."""
    return F.coalesce(c.rlike(VOLATILE_TITLE), F.lit(False))


def steady_title(title: Column, url: Column) -> Column:
    """The title, or where it is volatile the host of the page, else the last part of its path, else ``document``."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)
    last = F.try_element_at(F.filter(F.split(path, "/"), lambda p: p != ""), F.lit(-1))
    host = F.nullif(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    return F.when(volatile_title(title), F.coalesce(host, last, F.lit("document"))).otherwise(title)


def default_name(c: Column) -> Column:
    """Output name of a URL or path: its last segment without ``.html``."""
    url_path = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)
    is_url = c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    path = F.when(is_url, url_path).otherwise(c)
    segment = F.try_element_at(F.filter(F.split(path, "/"), lambda p: p != ""), F.lit(-1))
    fallback = F.when(is_url, "index").otherwise("out")
    name = F.regexp_replace(F.coalesce(segment, fallback), r"(?i)\.html?$", "")
    return F.when(c == "-", "out.pdf").otherwise(
        F.concat(F.when(name == "", fallback).otherwise(name), F.lit(".pdf"))
    )


def clamp_col(c: Column, lo: float, hi: float, default: float | None = None) -> Column:
    """Number between two bounds; text that is no number, and no value, give the default."""
    n = c.try_cast("double")
    finite = n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    return F.when(finite, F.floor(F.least(F.greatest(n, F.lit(float(lo))), F.lit(float(hi))))).otherwise(
        F.lit(default).cast("bigint")
    )


def page_ranges_problem(c: Column) -> Column:
    """Code and parts of what is wrong with a page-range text; null when nothing is.

    ``malformed: ...`` lists the parts that are neither a number nor a range, ``reversed: ...`` the ranges that end before they start.
    """
    parts = F.transform(F.split(c, ","), trimmed)

    def ends(p: Column) -> Column:
        return F.transform(F.split(p, "-"), lambda x: x.try_cast("long"))

    malformed = F.filter(parts, lambda p: ~p.rlike(RANGE))
    backwards = F.filter(parts, lambda p: F.coalesce(F.get(ends(p), F.lit(0)) > F.get(ends(p), F.lit(1)), F.lit(False)))

    def listed(code: str, found: Column) -> Column:
        return F.when(F.size(found) > 0, F.concat(F.lit(f"{code}: "), F.array_join(found, ", ")))

    return F.coalesce(listed("malformed", malformed), listed("reversed", backwards))


def flag_bits(current: Column, symbolic: Column, italic: Column, fixed: Column) -> Column:
    """Set or clear bits 4, 32, 64 and 1 from attributes; a null attribute leaves its bit."""

    attributes = ((symbolic, 4, 32), (italic, 64, 0), (fixed, 1, 0))  # bits for true and for false
    either = F.lit(0)
    wanted = F.lit(0)
    for given, yes, no in attributes:
        either = either + F.when(given.isNotNull(), yes | no).otherwise(0)
        wanted = wanted + F.when(given, yes).when(given.isNotNull(), no).otherwise(0)
    kept = F.coalesce(current.cast("int"), F.lit(0)).bitwiseAND(F.bitwise_not(either))
    return kept.bitwiseOR(wanted)


def scaled_metric(source: Column, units: Column, target: Column) -> Column:
    """Source per thousand units where the source is positive and the target is not; else null."""
    needed = (source > 0) & (target.isNull() | (target <= 0))
    return F.when(needed, round_half_up(source / units * 1000))


def mirrored_metric(value: Column, other: Column) -> Column:
    """A negative value turned positive, only if that exceeds the other metric; else null."""
    return F.when((value < 0) & other.isNotNull() & (-value > other), -value)


def short_selector(path: Column, identity: Column) -> Column:
    """``#id``, or up to three levels of ``tag.class.class`` outermost first.

    ``path`` is an array of ``{tag, class}`` from the element outwards. Class names made by tools
    (``ng-``, ``css-``, ``sc-``) are dropped and two are kept per level.
    """

    def level(e: Column) -> Column:
        names = F.filter(F.split(trimmed(F.coalesce(e["class"], F.lit(""))), r"\s+"), lambda x: (x != "") & ~x.rlike(r"^(?:ng|css|sc)-"))
        return F.array_join(F.concat(F.array(F.lower(e["tag"])), F.slice(names, 1, 2)), ".")

    levels = F.transform(F.slice(path, 1, 3), level)
    below_body = F.exists(F.slice(path, 2, 3), lambda e: F.lower(e["tag"]) == "body")
    cut = F.when(
        below_body,
        F.slice(levels, F.lit(1), F.array_position(F.transform(F.slice(path, 1, 4), lambda e: F.lower(e["tag"])), F.lit("body")) - 1),
    ).otherwise(levels)
    with_body = F.when(below_body, F.concat(cut, F.array(F.lit("body")))).otherwise(cut)
    return F.when(F.coalesce(identity, F.lit("")) != "", F.concat(F.lit("#"), identity)).otherwise(
        F.array_join(F.reverse(with_body), " > ")
    )
