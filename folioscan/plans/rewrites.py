"""Queries that rewrite texts, and scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions import css
from folioscan.functions import html as H
from folioscan.functions import text as T
from folioscan.functions import values as V
from folioscan.operators import rewrites as R
from folioscan.plans.registry import query, table


@query(
    "strip_redundant",
    r"""WITH p AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN replace(html, '<title>', '<title>x') ELSE html END AS h FROM pages),
    q AS (SELECT page_id, h, regexp_extract(h, '(?s)<title>(.*?)</title>', 1) = regexp_extract(h, '(?s)<h1>(.*?)</h1>', 1) AS same FROM p)
    SELECT page_id, same AS stripped, md5(CASE WHEN same THEN regexp_replace(h, '(?s)<title>.*?</title>', '') ELSE h END) AS digest FROM q""",
)
def strip_redundant(spark, sf):
    h = F.expr("CASE WHEN page_id % 4 = 0 THEN replace(html, '<title>', '<title>x') ELSE html END")
    p = table(spark, sf, "pages").select("page_id", h.alias("html"))
    c = F.col("html")
    out = R.strip_redundant(p, "html", r"(?is)<title[^>]*>.*?</title\s*>", H.title_of(c), H.heading_of(c))
    return out.select("page_id", "stripped", F.md5("rewritten").alias("digest"))


def collapse(c):
    return F.regexp_replace(c, "[ \n]+|[,.] ", " ")


def not_much_shorter(old, new):
    return F.when(F.length(new) < F.length(old) * 0.98, "too much removed")


GATE_SQL = r"""WITH d AS (SELECT doc_id, text, regexp_replace(text, '[ \n]+|[,.] ', ' ', 'g') AS n FROM documents),
    g AS (SELECT *, CASE WHEN n = text THEN 'unchanged' WHEN length(n) < length(text) * 0.98 THEN 'rejected' ELSE 'applied' END AS state FROM d)"""


@query("gated_rewrite", f"{GATE_SQL} SELECT doc_id, state, md5(CASE WHEN state = 'applied' THEN n ELSE text END) AS digest FROM g")
def gated_rewrite(spark, sf):
    out, _ = R.gated(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", collapse, not_much_shorter)
    return out.select("doc_id", "state", F.md5("text").alias("digest"))


@query("gated_rejections", f"{GATE_SQL} SELECT doc_id, 'repair-rejected' AS code, 'too much removed' AS message FROM g WHERE state = 'rejected'")
def gated_rejections(spark, sf):
    return R.gated(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", collapse, not_much_shorter)[1]


@query(
    "rewrite_chain",
    r"""WITH a AS (SELECT doc_id, text AS t0, replace(text, '|', '/') AS c1 FROM documents), b AS (SELECT doc_id, t0, c1, regexp_replace(c1, '[ \n]+|[,.] ', ' ', 'g') AS c2 FROM a),
    c AS (SELECT *, CASE WHEN length(c2) < length(c1) * 0.98 THEN c1 ELSE c2 END AS t2 FROM b), d AS (SELECT *, concat(t2, '.') AS c3 FROM c)
    SELECT doc_id, md5(CASE WHEN length(t2) % 2 = 0 THEN c3 ELSE t2 END) AS digest,
    concat_ws(',', CASE WHEN c1 <> t0 THEN 'bars' END, CASE WHEN c2 <> c1 AND t2 = c2 THEN 'space' END, CASE WHEN length(t2) % 2 = 0 THEN 'stop' END) AS applied,
    concat_ws(',', CASE WHEN c2 <> c1 AND t2 <> c2 THEN 'space' END, CASE WHEN length(t2) % 2 = 1 THEN 'stop' END) AS rejected FROM d""",
)
def rewrite_chain(spark, sf):
    steps = [
        ("bars", lambda c: F.replace(c, F.lit("|"), F.lit("/")), lambda old, new: F.lit(None).cast("string")),
        ("space", collapse, not_much_shorter),
        ("stop", lambda c: F.concat(c, F.lit(".")), lambda old, new: F.when(F.length(old) % 2 == 1, "odd")),
    ]
    out = R.rewrite_chain(table(spark, sf, "documents").select("doc_id", "text"), "text", steps)
    return out.select("doc_id", F.md5("text").alias("digest"), F.array_join("applied", ",").alias("applied"), F.array_join("rejected", ",").alias("rejected"))


@query("idempotent_rewrite", "SELECT doc_id FROM documents WHERE regexp_replace(text, '[ ]+', ' ', 'g') <> regexp_replace(regexp_replace(text, '[ ]+', ' ', 'g'), '[ ]+', ' ', 'g')")
def idempotent_rewrite(spark, sf):
    return R.idempotent(table(spark, sf, "documents"), "doc_id", "text", lambda c: F.regexp_replace(c, "[ ]+", " "))


@query("not_idempotent_rewrite", "SELECT doc_id FROM documents WHERE replace(text, 'en', 'e') <> replace(replace(text, 'en', 'e'), 'en', 'e')")
def not_idempotent_rewrite(spark, sf):
    return R.idempotent(table(spark, sf, "documents"), "doc_id", "text", lambda c: F.replace(c, F.lit("en"), F.lit("e")))


@query(
    "merge_runs",
    """WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events), b AS (SELECT user_id, day, bool_and(value < 150) AS ok FROM e GROUP BY ALL),
    g AS (SELECT e.*, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, day, event_type ORDER BY ts, event_id) AS k FROM e JOIN b USING (user_id, day) WHERE ok)
    SELECT user_id, day, event_type, count(*) AS n, CASE WHEN count(*) > 1 THEN 'merged' ELSE 'single' END AS state, arg_min(event_id, ts) AS first_event, arg_max(event_id, ts) AS last_event FROM g GROUP BY user_id, day, event_type, k
    UNION ALL SELECT user_id, day, NULL, count(*), 'refused', arg_min(event_id, ts), arg_max(event_id, ts) FROM e JOIN b USING (user_id, day) WHERE NOT ok GROUP BY user_id, day""",
)
def merge_runs(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("value") < 150).alias("simple"))
    out = R.merge_runs(e, ["user_id"], ["ts", "event_id"], "event_type", "simple", "day")
    return out.select("user_id", "day", "event_type", "n", "state", F.col("first.event_id").alias("first_event"), F.col("last.event_id").alias("last_event"))


# Items of a day: places and widths are multiples of 1/64, so that sums are exact in any order.
LAID = "epoch_us(date_trunc('second', ts)) % 86400000000 // 1000000 + (event_id % 64) / 64.0 AS x, floor(value) / 64.0 AS width"
RUN_SQL = f"""WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, {LAID} FROM events), b AS (SELECT *, bool_and(value < 150) OVER (PARTITION BY user_id, day) AS ok,
      row_number() OVER w - 1 AS item, coalesce(lag(event_type) OVER w <> event_type, true) AS brk FROM e WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id)),
    r AS (SELECT *, sum(brk::INT) OVER (PARTITION BY user_id, day ORDER BY item) AS run FROM b WHERE ok),
    g AS (SELECT *, first_value(x) OVER v AS start, coalesce(sum(width) OVER (PARTITION BY user_id, day, run ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0 FROM r WINDOW v AS (PARTITION BY user_id, day, run ORDER BY item)),
    d AS (SELECT *, round(x - start - w0, 1) AS due FROM g)"""


def laid_out(spark, sf):
    second = F.expr("unix_micros(date_trunc('second', cast(ts AS TIMESTAMP))) % 86400000000 div 1000000")
    e = table(spark, sf, "events").withColumn("x", second + F.col("event_id") % 64 / F.lit(64.0)).withColumn("width", F.floor("value") / F.lit(64.0))
    piece = F.concat("event_type", F.lit(" "))
    return e.select("user_id", "ts", "event_id", "event_type", "x", "width", piece.alias("piece"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("value") < 150).alias("simple"))


BLOCKS = (["user_id"], ["ts", "event_id"], "event_type", "simple", "day")


@query(
    "merge_texts",
    RUN_SQL + """, z AS (SELECT *, round(due - coalesce(lag(due) OVER (PARTITION BY user_id, day, run ORDER BY item), 0), 1) AS gap FROM d)
    SELECT user_id, day, run::BIGINT AS run, event_type, count(*) AS n, string_agg(concat(event_type, ' '), '' ORDER BY item) AS text, min(start) AS start,
      string_agg(CAST(CAST(gap * 10 AS BIGINT) AS VARCHAR), ' ' ORDER BY item) AS gaps FROM z GROUP BY user_id, day, run, event_type""",
)
def merge_texts(spark, sf):
    out = R.merge_runs(laid_out(spark, sf), *BLOCKS, text="piece", places=1).where("state <> 'refused'")
    gaps = F.array_join(F.transform("gaps", lambda g: F.round(g * 10).cast("bigint").cast("string")), " ")
    return out.select("user_id", "day", F.col("run").cast("bigint").alias("run"), "event_type", "n", "text", "start", gaps.alias("gaps"))


@query("merge_replays", RUN_SQL + " SELECT user_id, day, item, event_id, event_type, x, round(start + w0 + due, 6) AS replayed, true AS same FROM d")
def merge_replays(spark, sf):
    """All items of the merged runs, rebuilt from the runs, beside the places they had."""
    items = laid_out(spark, sf)
    merged = R.merge_runs(items, *BLOCKS, text="piece", places=1)
    out = R.replay(items, merged, *BLOCKS, eps=0.0501)
    return out.select("user_id", "day", "item", "event_id", "event_type", "x", F.round("replayed", 6).alias("replayed"), "same")


@query(
    "pin_dates",
    """SELECT event_id, concat('made D:20231114221320Z and D:20231114221320Z', CASE event_id % 3 WHEN 0 THEN '      ' WHEN 1 THEN '    ' ELSE '' END, ' Did <xmp:CreateDate>', CASE WHEN event_id % 2 = 0 THEN '2023-11-14' ELSE '2023-11-14T22:13:20      ' END,
    '</xmp:CreateDate> D:2024') AS pinned FROM events""",
)
def pin_dates(spark, sf):
    stamp = F.date_format("ts", "yyyyMMddHHmmss")
    zone = F.expr("CASE event_id % 3 WHEN 0 THEN \"+01'00'\" WHEN 1 THEN '-0330' ELSE 'Z' END")
    iso = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:00")))
    text = F.concat(F.lit("made D:"), stamp, F.lit("Z and D:"), stamp, zone, F.lit(" Did <xmp:CreateDate>"), iso, F.lit("</xmp:CreateDate> D:2024"))
    return table(spark, sf, "events").select("event_id", text.alias("t")).select("event_id", R.pin_dates(F.col("t"), F.lit(1700000000)).alias("pinned"))


VARIANT = (
    "CASE WHEN doc_id % 4 = 0 THEN text WHEN doc_id % 4 = 1 THEN concat(text, '!') ELSE concat(substr(text, 1, cast(doc_id % length(text) AS INT)), '~', substr(text, cast(doc_id % length(text) AS INT) + 2)) END"
)


@query(
    "first_difference",
    """SELECT doc_id, doc_id % 4 = 0 AS same, CASE WHEN doc_id % 4 = 1 THEN -1 WHEN doc_id % 4 > 1 THEN doc_id % length(text) END AS at_pos,
    CASE WHEN doc_id % 4 > 1 THEN md5(substr(text, greatest(doc_id % length(text) - 30, 0)::INT + 1, (doc_id % length(text) + 20 - greatest(doc_id % length(text) - 30, 0))::INT)) END AS context, length(text) AS n_left FROM documents""",
)
def first_difference(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.expr(VARIANT).alias("variant"))
    diff = d.select("doc_id", R.first_difference(F.col("text"), F.col("variant")).alias("d"))
    return diff.select("doc_id", "d.same", F.col("d.at").cast("bigint").alias("at_pos"), F.md5("d.left").alias("context"), F.col("d.left_length").cast("bigint").alias("n_left"))


@query("apply_by_index", "SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN concat('[', turn, ']') ELSE md5(text) END AS digest, turn % 3 = 1 AS replaced FROM conversations")
def apply_by_index(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.md5("text").alias("digest"))
    changes = c.filter("turn % 3 = 1").select("conv_id", "turn", F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("]")).alias("digest"))
    return R.apply_by_index(c, changes, ["conv_id", "turn"], "digest")


@query(
    "xmp_packet",
    """WITH p AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS t FROM pages), e AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS t FROM p)
    SELECT page_id, concat_ws(chr(10), '<rdf:Description rdf:about="">', concat('<dc:title><rdf:Alt><rdf:li xml:lang="x-default">', t, '</rdf:li></rdf:Alt></dc:title>'),
      CASE WHEN page_id % 2 = 0 THEN concat('<dc:creator><rdf:Bag><rdf:li>a&amp;', page_id, '</rdf:li></rdf:Bag></dc:creator>') END,
      CASE WHEN page_id % 3 = 0 THEN '<xmp:CreateDate>2024-05-01T00:00:00</xmp:CreateDate>' END, '</rdf:Description>') AS packet FROM e""",
)
def xmp_packet(spark, sf):
    none = F.lit(None).cast("string")
    author = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("a&"), F.col("page_id").cast("string")))
    created = F.when(F.col("page_id") % 3 == 0, "D:202405")
    p = table(spark, sf, "pages").select("page_id", R.xmp_packet(H.title_of(F.col("html")), none, author, none, created).alias("packet"))
    return p


# -- scalar functions -----------------------------------------------------------------------------


@query(
    "xml_escape",
    r"""SELECT doc_id, md5(replace(replace(replace(replace(replace(regexp_replace(concat(text, ' <a href="x">&''', chr(7), chr(9)), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS digest,
    true AS round_trip FROM documents""",
)
def xml_escape(spark, sf):
    text = F.expr("concat(text, ' <a href=\"x\">&''', chr(7), chr(9))")
    clean = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    d = table(spark, sf, "documents").select("doc_id", clean.alias("clean"), T.xml_escape(text).alias("e"))
    return d.select("doc_id", F.md5("e").alias("digest"), (T.xml_unescape(F.col("e")) == F.col("clean")).alias("round_trip"))


@query(
    "pdf_dates",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-01-01T00:00:00') WHEN 1 THEN strftime(ts, '%Y-%m-%dT00:00:00') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS iso,
    strftime(ts, 'D:%Y%m%d%H%M%SZ') AS pinned FROM events""",
)
def pdf_dates(spark, sf):
    f = F.col("event_id") % 4
    stamp = (
        F.when(f == 0, F.date_format("ts", "'D:'yyyy")).when(f == 1, F.date_format("ts", "'D:'yyyyMMdd"))
        .when(f == 2, F.date_format("ts", "'D:'yyyyMMddHHmmss'+01'")).otherwise(F.date_format("ts", "yyyyMMdd"))
    )
    epoch = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    return table(spark, sf, "events").select("event_id", T.iso_from_pdf_date(stamp).alias("iso"), T.pinned_date(epoch).alias("pinned"))


@query(
    "normalize_text",
    r"""SELECT doc_id, md5(regexp_replace(t, S, '', 'g')) AS bare, md5(regexp_replace(regexp_replace(t, S, ' ', 'g'), '^ | $', '', 'g')) AS collapsed FROM (SELECT doc_id, concat(chr(160), text, chr(8195), chr(65279)) AS t FROM documents)""".replace(
        "S,", r"'[\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+',"
    ),
)
def normalize_text(spark, sf):
    t = F.concat(F.lit(" "), F.col("text"), F.lit(" ﻿"))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalize_text(t)).alias("bare"), F.md5(T.collapsed(t)).alias("collapsed"))


@query("last_strong", r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'rtl' WHEN regexp_matches(text, '[A-Za-z\x{00C0}-\x{02AF}]') THEN 'ltr' END AS direction FROM documents""")
def last_strong(spark, sf):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" سلام 12"))).otherwise(F.concat("text", F.lit(" 12 -")))
    return table(spark, sf, "documents").select("doc_id", T.last_strong(t).alias("direction"))


@query(
    "reverse_groups",
    """SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y') AS shown FROM orders""",
)
def reverse_groups(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.reverse_groups(F.date_format("o_orderdate", "yyyy - MM_dd")).alias("shown"))


@query(
    "format_bytes",
    """WITH b AS (SELECT doc_id, n_chars * (CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 37 ELSE 4099 END) AS n FROM documents)
    SELECT doc_id, CASE WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024 * 10 + 0.5) / 10) ELSE printf('%.2f MB', floor(n / 1048576 * 100 + 0.5) / 100) END AS size,
    CASE WHEN n = 4099 THEN '0' WHEN n > 4099 THEN concat('-', n - 4099) ELSE concat('+', 4099 - n) END AS change FROM b""",
)
def format_bytes(spark, sf):
    n = F.expr("n_chars * (CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 37 ELSE 4099 END)")
    return table(spark, sf, "documents").select("doc_id", T.format_bytes(n).alias("size"), T.size_change(n, F.lit(4099)).alias("change"))


@query("code_point_labels", r"""SELECT DISTINCT ch, printf('U+%04X', unicode(ch)) AS label FROM (SELECT unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS ch FROM documents)""")
def code_point_labels(spark, sf):
    chars = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^\x00-\x7F]"), F.lit(0)))
    return table(spark, sf, "documents").select(F.explode(chars).alias("ch")).distinct().select("ch", T.code_point_label(F.col("ch")).alias("label"))


@query(
    "short_selector",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN concat('#', p_type) WHEN 1 THEN concat('body > div.a.b > span.', p_type) WHEN 2 THEN 'ul > li > b' ELSE 'body > p' END AS selector FROM part""",
)
def short_selector(spark, sf):
    path = F.expr(
        "CASE p_size % 4 WHEN 3 THEN array(named_struct('tag', 'P', 'class', 'css-1 ng-x'), named_struct('tag', 'BODY', 'class', 'z'), named_struct('tag', 'HTML', 'class', '')) "
        "WHEN 2 THEN array(named_struct('tag', 'B', 'class', ''), named_struct('tag', 'LI', 'class', ' '), named_struct('tag', 'UL', 'class', cast(null as string)), named_struct('tag', 'DIV', 'class', 'q')) "
        "ELSE array(named_struct('tag', 'SPAN', 'class', concat('sc-1 ', p_type)), named_struct('tag', 'DIV', 'class', 'a b c'), named_struct('tag', 'BODY', 'class', '')) END"
    )
    p = table(spark, sf, "part").select("p_partkey", path.alias("path"), F.expr("CASE WHEN p_size % 4 = 0 THEN p_type ELSE '' END").alias("id"))
    return p.select("p_partkey", V.short_selector(F.col("path"), F.col("id")).alias("selector"))


@query("alpha_of", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN (p_size % 10) / 10.0::DOUBLE WHEN 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS alpha FROM part")
def alpha_of(spark, sf):
    c = F.expr("CASE p_size % 3 WHEN 0 THEN concat('rgba(1, 2, 3, 0.', p_size % 10, ' )') WHEN 1 THEN concat('rgb(', p_size, ', 0, 0)') ELSE 'transparent' END")
    return table(spark, sf, "part").select("p_partkey", css.alpha_of(c).alias("alpha"))


@query(
    "clamped_path",
    """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN concat(p_type, '/x') WHEN 1 THEN concat(p_brand, '/', p_size) ELSE '' END AS path FROM part""",
)
def clamped_path(spark, sf):
    c = F.expr("CASE p_size % 3 WHEN 0 THEN concat('../../', p_type, '/./a/../x') WHEN 1 THEN concat('/', p_brand, '//', p_size, '/') ELSE concat(p_type, '/../..') END")
    return table(spark, sf, "part").select("p_partkey", V.clamped_path(c).alias("path"))


@query(
    "loopback_host",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN user_id * 900 <= 65535 WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true ELSE false END AS allowed FROM events""",
)
def loopback_host(spark, sf):
    host = F.expr("CASE event_id % 6 WHEN 0 THEN '127.0.0.1' WHEN 1 THEN concat('localhost:', user_id * 900) WHEN 2 THEN concat('[::1]:', user_id) WHEN 3 THEN concat('10.0.0.', user_id % 250) WHEN 5 THEN 'localhost.example:80' END")
    return table(spark, sf, "events").select("event_id", V.loopback_host(host).alias("allowed"))


@query(
    "flag_bits",
    """SELECT p_partkey, (((p_size & ~4 & ~32) | CASE WHEN p_size % 2 = 0 THEN 4 ELSE 32 END) & ~64 | CASE WHEN p_size % 3 = 0 THEN 64 ELSE 0 END) & CASE WHEN p_size % 5 = 1 THEN ~1 ELSE -1 END | CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS flags FROM part""",
)
def flag_bits(spark, sf):
    s = F.col("p_size")
    fixed = F.when(s % 5 == 0, True).when(s % 5 == 1, False)
    return table(spark, sf, "part").select("p_partkey", V.flag_bits(s, s % 2 == 0, s % 3 == 0, fixed).alias("flags"))


@query(
    "scaled_metrics",
    """SELECT c_custkey, CASE WHEN c_nationkey % 5 > 0 AND c_acctbal <= 0 THEN floor(c_nationkey % 5 / 2048 * 1000 + 0.5)::BIGINT END AS scaled, CASE WHEN c_acctbal < 0 AND -c_acctbal > 400 THEN -c_acctbal END AS mirrored FROM customer""",
)
def scaled_metrics(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey", V.scaled_metric(F.col("c_nationkey") % 5, F.lit(2048), F.col("c_acctbal")).alias("scaled"), V.mirrored_metric(F.col("c_acctbal"), F.lit(400)).alias("mirrored")
    )
