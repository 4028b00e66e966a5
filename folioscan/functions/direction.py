"""Direction of the text blocks of a page, and the digit runs that right-to-left layout reorders. All in the row of the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions import html as H
from folioscan.functions import text as T

# Elements that the next element of their name ends.
SELF_ENDING = ("p", "li", "td", "th", "tr", "dt", "dd", "option")
# References to characters from the right-to-left blocks, and style declarations of the direction.
RTL_REFERENCE = r"&#(?:0*(?:1[4-9]|2[0-3])\d\d|0*6[45]\d{3}|[xX]0*(?:[5-8][0-9a-fA-F]{2}|[fF][b-eB-E][0-9a-fA-F]{2}));"
STYLE_RTL = r"(?i)\bdirection\s*:\s*rtl\b"
ROOT_RTL = r"(?i)(?:^|[\s,}])(?:html|body|:root)\s*(?:,[^{}]*)?\{[^{}]*\bdirection\s*:\s*rtl\b"

TEXT = "struct<text:string,no:int,dir:string>"
OPEN = "struct<name:string,no:int,dir:string,last:string>"
END = "struct<no:int,last:string>"


def may_hold_rtl(html: Column) -> Column:
    """Could the page hold a digit run at risk? Few pages without right-to-left text pass."""
    return html.rlike(T.RISKY_DIGITS) & (html.rlike(f"[{T.RTL_LETTERS}]|(?i)\\brtl\\b") | html.rlike(RTL_REFERENCE))


def _token(t: Column) -> Column:
    """What the machine needs of a tag or text: kind, name, declared direction, text, its last direction, whether it has digits at risk."""
    tag = t.rlike(rf"^{H.TAG}")
    name = H.tag_name(t)
    text = H.decode_entities(t)
    asked = F.lower(T.trimmed(F.coalesce(H.attr(t, "dir"), F.lit(""))))
    styled = F.coalesce(H.attr(t, "style"), F.lit("")).rlike(STYLE_RTL)
    own = F.when(asked.isin("rtl", "ltr", "auto"), asked).when(styled, "rtl").when(name == "bdi", "auto")
    kind = F.when(~tag, "text").when(t.startswith("</"), "close").when(name.isin(*H.VOID), "void").otherwise("open")
    return F.struct(
        kind.alias("kind"), F.when(tag, name).alias("name"), F.when(kind == "open", own).alias("dir"), F.when(~tag, text).alias("text"),
        F.when(~tag, T.last_strong(text)).alias("last"), F.when(~tag, text.rlike(T.RISKY_DIGITS)).otherwise(F.lit(False)).alias("risky"),
    )


def _pop(acc: Column, count: Column) -> Column:
    """The machine after the innermost elements have ended; those that hold a waiting text leave their last direction."""
    size = F.size(acc["stack"])
    gone = F.slice(acc["stack"], size - count + 1, count)
    held = F.filter(gone, lambda e: F.exists(acc["waits"], lambda w: w["no"] == e["no"]))
    ended = F.transform(held, lambda e: F.struct(e["no"].alias("no"), e["last"].alias("last")))
    return F.struct(F.slice(acc["stack"], F.lit(1), size - count).alias("stack"), acc["n"].alias("n"), acc["waits"].alias("waits"), F.concat(acc["ends"], ended).alias("ends"))


def _step(acc: Column, t: Column) -> Column:
    top = F.element_at(acc["stack"], -1)
    # an opening tag
    ended = F.when(t["name"].isin(*SELF_ENDING) & (top["name"] == t["name"]), _pop(acc, F.lit(1))).otherwise(acc)
    above = F.element_at(ended["stack"], -1)
    inherited = F.when(above["dir"] == "rtl", "rtl")
    own = F.when(t["dir"] == "auto", F.lit(None).cast("string")).otherwise(F.coalesce(t["dir"], inherited))
    entry = F.struct(t["name"].alias("name"), (acc["n"] + 1).alias("no"), own.alias("dir"), F.lit(None).cast("string").alias("last"))
    opened = F.struct(F.array_append(ended["stack"], entry).alias("stack"), (acc["n"] + 1).alias("n"), ended["waits"].alias("waits"), ended["ends"].alias("ends"))
    # a closing tag ends what is open down to its name; the page itself stays
    names = F.reverse(F.transform(F.slice(acc["stack"], F.lit(2), F.greatest(F.size(acc["stack"]) - 1, F.lit(0))), lambda e: e["name"]))
    depth = F.array_position(names, t["name"]).cast("int")
    # a text: all elements around it learn its last direction
    heard = F.when(t["last"].isNull(), acc["stack"]).otherwise(
        F.transform(acc["stack"], lambda e: F.struct(e["name"].alias("name"), e["no"].alias("no"), e["dir"].alias("dir"), t["last"].alias("last")))
    )
    wait = F.struct(t["text"].alias("text"), top["no"].alias("no"), top["dir"].alias("dir"))
    read = F.struct(heard.alias("stack"), acc["n"].alias("n"), F.when(t["risky"], F.array_append(acc["waits"], wait)).otherwise(acc["waits"]).alias("waits"), acc["ends"].alias("ends"))
    return F.when(t["kind"] == "text", read).when(t["kind"] == "open", opened).when((t["kind"] == "close") & (depth > 0), _pop(acc, depth)).otherwise(acc)


def rtl_texts(html: Column, masked: Column, styles: Column) -> Column:
    """The texts with digits at risk that stand in right-to-left blocks, in order.

    A stack machine runs over the tokens of the page. Each open element carries its direction: its own ``dir`` or style, else
    right-to-left if the element around it has it; ``auto``, ``bdi`` and an outer ``ltr`` leave it open, and an element that leaves it
    open has the direction of the last letter in it, which is known when it ends. Style sheets count for the root only.
    """
    pieces = F.regexp_extract_all(F.regexp_replace(masked, H.PLAIN_BODY, "$1$2"), F.lit(H.TAG_OR_TEXT), F.lit(0))
    root = F.struct(F.lit("").alias("name"), F.lit(0).alias("no"), F.when(styles.rlike(ROOT_RTL), "rtl").alias("dir"), F.lit(None).cast("string").alias("last"))
    start = F.struct(
        F.array(root).cast(f"array<{OPEN}>").alias("stack"), F.lit(0).alias("n"), F.array().cast(f"array<{TEXT}>").alias("waits"), F.array().cast(f"array<{END}>").alias("ends"),
    )

    def resolved(acc: Column) -> Column:
        ends = F.concat(acc["ends"], F.transform(acc["stack"], lambda e: F.struct(e["no"].alias("no"), e["last"].alias("last"))))

        def rtl(w: Column) -> Column:
            mine = F.get(F.filter(ends, lambda e: e["no"] == w["no"]), F.lit(0))
            return F.coalesce(w["dir"], mine["last"]) == "rtl"

        return F.transform(F.filter(acc["waits"], rtl), lambda w: w["text"])

    texts = F.aggregate(F.transform(pieces, _token), start, _step, resolved)
    return F.when(may_hold_rtl(html), texts).otherwise(F.array().cast("array<string>"))


def risky_hits(c: Column) -> Column:
    """Digit runs of a right-to-left text that print in another order, with some text around: array of ``{token, sample}``.

    A run is safe when the last letter before it reads left to right.
    """
    runs, gaps = F.regexp_extract_all(c, F.lit(T.RISKY_DIGITS), F.lit(0)), F.split(c, T.RISKY_DIGITS)
    zero = F.struct(
        F.lit(1).alias("at"), F.lit(None).cast("string").alias("dir"), F.array().cast("array<struct<token:string,at:int,dir:string>>").alias("out")
    )

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.length(p["gap"])
        before = F.coalesce(T.last_strong(p["gap"]), acc["dir"])
        return F.struct(
            (at + F.length(p["run"])).alias("at"),
            F.coalesce(T.last_strong(p["run"]), before).alias("dir"),
            F.array_append(acc["out"], F.struct(p["run"].alias("token"), at.alias("at"), before.alias("dir"))).alias("out"),
        )

    # The text after the last run has no run of its own.
    pieces = F.transform(runs, lambda r, i: F.struct(r.alias("run"), F.get(gaps, i).alias("gap")))
    placed = F.aggregate(pieces, zero, step)["out"]

    def shown(h: Column) -> Column:
        start = F.greatest(h["at"] - 12, F.lit(1))
        return F.struct(h["token"].alias("token"), T.trimmed(F.substr(c, start, h["at"] - start + F.length(h["token"]) + 8)).alias("sample"))

    return F.transform(F.filter(placed, lambda h: F.coalesce(h["dir"], F.lit("rtl")) != "ltr"), shown)


def reordered(token: Column) -> Column:
    """The form in which a digit run prints; null where it looks the same."""
    return F.nullif(T.reverse_groups(token), token)
