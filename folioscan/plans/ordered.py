"""Queries along an order, and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions import html as H
from folioscan.functions import text as T
from folioscan.operators import aggregates as A
from folioscan.operators import windows as W
from folioscan.plans.registry import query, table

# Words of a document laid out as glyphs: the line is the stream, the gap before a word depends on its length.
GLYPH_SQL = r"""lines AS (SELECT doc_id, i AS stream_id, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)),
    words AS (SELECT doc_id, stream_id, i AS pos, w[i] AS word FROM (SELECT *, string_split(line, ' ') AS w FROM lines), unnest(range(1, len(w) + 1)) AS u(i)),
    g AS (SELECT doc_id, stream_id, pos, (pos * 8)::DOUBLE AS x, CASE WHEN (pos + length(word)) % 17 = 0 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS y,
      (length(word) % 9)::DOUBLE AS width, (CASE WHEN length(word) % 4 = 1 THEN 1 WHEN length(word) % 4 = 2 THEN 5 ELSE 20 END)::DOUBLE AS size,
      CASE WHEN length(word) = 2 THEN ' ' ELSE substr(word, 1, 1) END AS ch, length(word) = 2 AS blank, length(word) = 13 AS unknown FROM words)"""

# The walk over glyphs as a state machine over the list of one stream.
WALK_SQL = f"""WITH RECURSIVE {GLYPH_SQL},
    v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, stream_id ORDER BY pos) AS rn FROM g),
    k AS (SELECT doc_id, stream_id, rn, 'start' AS cls, NULL::DOUBLE AS em, false AS has, 0.0::DOUBLE AS px, 0.0::DOUBLE AS py, 0.0::DOUBLE AS pw, 0.0::DOUBLE AS ps, ' ' AS c2, ' ' AS c1
        FROM (SELECT DISTINCT doc_id, stream_id, 0::BIGINT AS rn FROM v)
      UNION ALL
      SELECT z.doc_id, z.stream_id, z.rn, z.cls, z.em, CASE WHEN z.cls IN ('unknown', 'line') THEN false WHEN z.cls = 'blank' THEN z.has ELSE true END,
        CASE WHEN z.cls IN ('unknown', 'line', 'blank') THEN z.px ELSE z.x END, CASE WHEN z.cls IN ('unknown', 'line', 'blank') THEN z.py ELSE z.y END,
        CASE WHEN z.cls IN ('unknown', 'line', 'blank') THEN z.pw ELSE z.width END, CASE WHEN z.cls IN ('unknown', 'line', 'blank') THEN z.ps ELSE z.size END,
        CASE WHEN z.cls IN ('unknown', 'line') THEN ' ' WHEN z.cls IN ('back', 'thin') OR z.em <= 0.03 THEN ' ' ELSE z.c1 END,
        CASE WHEN z.cls IN ('unknown', 'line') THEN ' ' ELSE z.ch2 END
      FROM (SELECT v.doc_id, v.stream_id, v.rn, v.x, v.y, v.width, v.size, k.has, k.px, k.py, k.pw, k.ps, k.c1, CASE WHEN v.blank OR v.ch = '' THEN ' ' ELSE v.ch END AS ch2,
          CASE WHEN v.unknown OR v.blank OR NOT k.has OR abs(v.y - k.py) > 0.25 * k.ps OR (v.x - (k.px + k.pw)) < -0.2 * k.ps THEN NULL ELSE (v.x - (k.px + k.pw)) / k.ps END AS em,
          CASE WHEN v.unknown THEN 'unknown' WHEN v.blank THEN 'blank' WHEN NOT k.has THEN 'first' WHEN abs(v.y - k.py) > 0.25 * k.ps THEN 'line'
            WHEN (v.x - (k.px + k.pw)) < -0.2 * k.ps THEN 'back'
            WHEN (v.x - (k.px + k.pw)) / k.ps <= 0.102 THEN CASE WHEN (v.x - (k.px + k.pw)) / k.ps > 0.03 AND k.c2 <> ' ' AND k.c1 = ' ' THEN 'thin' ELSE 'tight' END
            WHEN (v.x - (k.px + k.pw)) / k.ps <= 0.6 THEN 'flow' WHEN (v.x - (k.px + k.pw)) / k.ps <= 3 THEN 'wide' ELSE 'jump' END AS cls
        FROM k JOIN v ON v.doc_id = k.doc_id AND v.stream_id = k.stream_id AND v.rn = k.rn + 1) z)"""


# Bytes of text in a part of the documents; each becomes some 20 times as many bytes of rows.
PART_BYTES = 8 << 20


def dealt(spark, sf):
    """The documents dealt out by key before their words become rows: windows and groups of a document then find their rows in place.

    The number of parts follows the bytes, so what a task sorts does not grow with the table.
    """
    docs = table(spark, sf, "documents").select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1), "doc_id")


def glyphs(spark, sf):
    """Words as glyphs. A stream is one line of one document, so a stream's rows come from one row."""
    lines = dealt(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("stream_id", "line"))
    words = lines.select("doc_id", (F.col("stream_id") + 1).alias("stream_id"), F.posexplode(F.split("line", " ")).alias("pos", "word"))
    n, pos = F.length("word"), F.col("pos") + 1
    return words.select(
        "doc_id", F.col("stream_id").cast("bigint").alias("stream_id"), pos.cast("bigint").alias("pos"), (pos * 8).cast("double").alias("x"),
        F.when((pos + n) % 17 == 0, 10.0).otherwise(0.0).alias("y"),
        (n % 9).cast("double").alias("width"),
        F.when(n % 4 == 1, 1.0).when(n % 4 == 2, 5.0).otherwise(20.0).alias("size"),
        F.when(n == 2, " ").otherwise(F.substring("word", 1, 1)).alias("ch"),
        (n == 2).alias("blank"),
        (n == 13).alias("unknown"),
    )


def classified(spark, sf):
    return W.classify_gaps(glyphs(spark, sf), ["doc_id", "stream_id"], ["pos"])


@query(
    "classify_gaps",
    f"""{WALK_SQL} SELECT doc_id, cls AS gap_class, count(*) AS n, round(sum(em), 6) AS em FROM k WHERE rn > 0 GROUP BY ALL""",
)
def classify_gaps(spark, sf):
    return classified(spark, sf).groupBy("doc_id", "gap_class").agg(F.count("*").alias("n"), F.round(F.sum("em"), 6).alias("em"))


FLOW_SQL = f"""{WALK_SQL}, t AS (SELECT * FROM k WHERE rn > 0),
    f AS (SELECT doc_id, count(*) AS glyphs, count(*) FILTER (cls IN ('thin', 'tight', 'flow', 'wide', 'jump')) AS gaps, count(*) FILTER (cls IN ('thin', 'wide', 'jump', 'back')) AS breaks,
      count(*) FILTER (cls = 'wide') AS too_wide, count(*) FILTER (cls = 'jump') AS jumps, count(*) FILTER (cls = 'thin') AS too_thin, count(*) FILTER (cls = 'back') AS backwards,
      count(*) FILTER (cls = 'line') + count(DISTINCT stream_id) AS lines, coalesce(max(em) FILTER (em <= 3), 0) AS widest, coalesce(max(em), 0) AS widest_all,
      coalesce(min(em), 0) AS narrowest, count(*) FILTER (cls = 'unknown') AS unreadable, count(DISTINCT stream_id) AS streams FROM t GROUP BY doc_id)"""


def flows(spark, sf):
    streams = A.text_flow(classified(spark, sf), ["doc_id", "stream_id"]).withColumn("is_read", F.lit(True))
    return A.flow_totals(streams, ["doc_id"])


@query(
    "text_flow",
    f"{FLOW_SQL} SELECT doc_id, glyphs, gaps, breaks, too_wide, jumps, too_thin, backwards, lines, round(widest, 6) AS widest, round(widest_all, 6) AS widest_all, "
    "round(narrowest, 6) AS narrowest, unreadable, 0 AS spans, streams, streams AS read FROM f",
)
def text_flow(spark, sf):
    f = flows(spark, sf)
    return f.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in f.dtypes])


@query(
    "flow_reasons",
    f"""{FLOW_SQL} SELECT doc_id, (breaks > 0 AND (too_wide > 0 OR jumps > 0 OR too_thin > 0 OR backwards > 0)) OR unreadable > 0 AS fragmented,
    CASE WHEN breaks > 0 OR unreadable > 0 THEN concat_ws('; ', CASE WHEN too_wide > 0 THEN concat('too_wide=', too_wide) END, CASE WHEN jumps > 0 THEN concat('jumps=', jumps) END,
      CASE WHEN too_thin > 0 THEN concat('too_thin=', too_thin) END, CASE WHEN backwards > 0 THEN concat('backwards=', backwards) END,
      CASE WHEN unreadable > 0 THEN concat('unreadable=', unreadable) END) ELSE '' END AS reasons FROM f""",
)
def flow_reasons(spark, sf):
    return A.flow_reasons(flows(spark, sf)).select("doc_id", "fragmented", "reasons")


def user_events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")




@query(
    "segments",
    """WITH b AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM events)
    SELECT user_id, segment::BIGINT AS segment, count(*) AS n, arg_min(event_id, ts) AS first_event, arg_max(event_id, ts) AS last_event, string_agg(event_type, ' ' ORDER BY ts, event_id) AS text
    FROM b GROUP BY ALL""",
)
def segments(spark, sf):
    s = W.segments(user_events(spark, sf), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", "event_type")
    return s.select("user_id", "segment", "n", F.col("first.event_id").alias("first_event"), F.col("last.event_id").alias("last_event"), "text")


# Words as text runs: a document is a page, a line a row; margins and containers follow from the word.
RUNS_SQL = r"""lines AS (SELECT doc_id, i AS ln, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)),
    words AS (SELECT doc_id, ln, i AS pos, w[i] AS word, length(w[i]) AS n FROM (SELECT *, string_split(line, ' ') AS w FROM lines), unnest(range(1, len(w) + 1)) AS u(i)),
    runs AS (SELECT doc_id AS page_id, pos * 50.0 + (n % 7) * 3 AS "left", pos * 50.0 + (n % 7) * 3 + n * 5 AS "right", ln * 20.0 + pos % 2 AS top, 12.0 AS height, concat('span', n % 5) AS element, word AS text,
      CASE pos % 6 WHEN 0 THEN 'table-cell' WHEN 1 THEN 'flex' WHEN 2 THEN 'inline-grid' ELSE 'block' END AS display, CASE WHEN n % 4 = 0 THEN 8.0 ELSE 0.0 END AS column_gap,
      CASE WHEN pos % 11 = 0 THEN 'space-between' ELSE 'normal' END AS justify, 16.0 AS font_size, CASE WHEN pos % 7 = 0 THEN 4.0 ELSE 0.0 END AS margin FROM words)"""


GAPS_SQL = f"""WITH {RUNS_SQL}, a AS (SELECT *, coalesce((top - lag(top) OVER (PARTITION BY page_id ORDER BY top, "left", element) > 2)::INT, 0) AS nr FROM runs KEPT),
    b AS (SELECT *, sum(nr) OVER (PARTITION BY page_id ORDER BY top, "left", element ROWS UNBOUNDED PRECEDING) AS rw FROM a),
    c AS (SELECT *, lag("right") OVER w AS p_right, lag(top) OVER w AS p_top, lag(height) OVER w AS p_height, lag(element) OVER w AS p_element, lag(display) OVER w AS p_display,
      lag(column_gap) OVER w AS p_gap, lag(justify) OVER w AS p_justify, lag(margin) OVER w AS p_margin, row_number() OVER w AS at_ FROM b WINDOW w AS (PARTITION BY page_id ORDER BY rw, "left", element, "right")),
    d AS (SELECT *, ("left" - p_right) / font_size AS e, CASE WHEN p_display = 'table-cell' THEN 'table-cell' WHEN p_justify LIKE 'space-between%' THEN 'space-between' WHEN p_margin + margin > 0.5 THEN 'margin'
      WHEN p_display LIKE '%grid%' THEN CASE WHEN p_gap > 0 THEN 'grid-gap' ELSE 'unknown' END WHEN p_display LIKE '%flex%' THEN CASE WHEN p_gap > 0 THEN 'flex-gap' ELSE 'unknown' END ELSE 'unknown' END AS cause
      FROM c WHERE abs(top - p_top) <= greatest(2, p_height / 2) AND element <> p_element AND "left" > p_right AND ("left" - p_right) / font_size > 0.6),
    f AS (SELECT page_id, cause, element, floor(top / 8 + 0.5) AS band, arg_min(concat(p_element, ' -> ', element), at_) AS selector, arg_min(text, at_) AS text, arg_min(floor(e * 100 + 0.5) / 100, at_) AS em,
      arg_min(floor(top + 0.5), at_) AS top, min(at_) AS at_ FROM d GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY em DESC, at_) AS rank FROM f)
    SELECT page_id, selector, text, em, top::BIGINT AS top, cause FROM r"""


@query("wide_gaps", GAPS_SQL.replace("KEPT", ""))
def wide_gaps(spark, sf):
    return W.wide_gaps(text_runs(spark, sf))


def text_runs(spark, sf):
    lines = dealt(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    words = lines.select("doc_id", "ln", F.posexplode(F.split("line", " ")).alias("p", "word")).selectExpr(
        "doc_id", "ln + 1 AS ln", "p + 1 AS pos", "word", "length(word) AS n"
    )
    return words.selectExpr(
        "doc_id AS page_id", "cast(pos * 50 + (n % 7) * 3 AS DOUBLE) AS left", "cast(pos * 50 + (n % 7) * 3 + n * 5 AS DOUBLE) AS right",
        "cast(ln * 20 + pos % 2 AS DOUBLE) AS top", "12.0D AS height", "concat('span', n % 5) AS element", "word AS text",
        "CASE pos % 6 WHEN 0 THEN 'table-cell' WHEN 1 THEN 'flex' WHEN 2 THEN 'inline-grid' ELSE 'block' END AS display",
        "CASE WHEN n % 4 = 0 THEN 8.0D ELSE 0.0D END AS column_gap", "CASE WHEN pos % 11 = 0 THEN 'space-between' ELSE 'normal' END AS justify",
        "16.0D AS font_size", "CASE WHEN pos % 7 = 0 THEN 4.0D ELSE 0.0D END AS margin",
    )


@query("gaps_probe", GAPS_SQL.replace("KEPT", "WHERE text <> ''"))
def gaps_probe(spark, sf):
    """The named probe, prepared by a hook that keeps the runs of wide lines."""
    from folioscan.operators.probes import run_probe

    return run_probe("gaps", text_runs(spark, sf), lambda df: df.filter(F.col("text") != ""))


@query(
    "run_lengths",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)
    SELECT user_id, event_type, count(*) AS n, arg_min(event_id, ts) AS first_event, arg_max(event_id, ts) AS last_event FROM a GROUP BY user_id, event_type, k""",
)
def run_lengths(spark, sf):
    r = W.run_lengths(user_events(spark, sf), ["user_id"], ["ts", "event_id"], "event_type")
    return r.select("user_id", "event_type", "n", F.col("first.event_id").alias("first_event"), F.col("last.event_id").alias("last_event"))


LINE_ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"]
LINE_SQL = ", ".join(LINE_ORDER)


@query(
    "running_position",
    f"""WITH a AS (SELECT *, sum((l_returnflag = 'R')::INT) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, {LINE_SQL}) AS grp FROM lineitem),
    b AS (SELECT *, coalesce(sum(l_quantity) OVER (PARTITION BY l_suppkey, grp ORDER BY l_orderkey, {LINE_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 100 AS x FROM a)
    SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_quantity, x FROM b""",
)
def running_position(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", *LINE_ORDER)
    out = W.running_position(lines, ["l_suppkey"], ["l_orderkey", *LINE_ORDER], F.col("l_quantity"), F.col("l_returnflag") == "R", F.lit(100.0))
    return out.select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "x")


@query(
    "diffused_round",
    f"""WITH a AS (SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, (l_extendedprice * l_tax)::DECIMAL(28,10) AS v, sum((l_extendedprice * l_tax)::DECIMAL(28,10)) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, {LINE_SQL} ROWS UNBOUNDED PRECEDING) AS cum FROM lineitem)
    SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, (floor(cum + 0.5) - floor(cum - v + 0.5))::BIGINT AS rounded FROM a""",
)
def diffused_round(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", *LINE_ORDER)
    out = W.diffused_round(lines, ["l_suppkey"], ["l_orderkey", *LINE_ORDER], F.col("l_extendedprice") * F.col("l_tax"), 0)
    return out.select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", F.col("rounded").cast("bigint").alias("rounded"))


@query(
    "forward_fill",
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user FROM conversations""",
)
def forward_fill(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return W.forward_fill(c, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "last_user").drop("role")


@query(
    "first_n_orders",
    """SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders) WHERE rank <= 8""",
)
def first_n_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return W.first_n(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], 8).drop("o_orderdate")


@query(
    "first_failure",
    """SELECT source, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents WHERE n_chars <> octet_length(encode(text)) GROUP BY source""",
)
def first_failure(spark, sf):
    d = table(spark, sf, "documents")
    failed = F.col("n_chars") != F.col("octets")
    rows = d.select("source", "doc_id", "n_chars", F.octet_length("text").alias("octets"))
    return W.first_failure(rows, ["source"], ["doc_id"], failed).drop("octets")


@query(
    "concurrency",
    """WITH e AS (SELECT event_id, epoch_us(ts) AS s, epoch_us(ts) + (value * 60000000)::BIGINT AS t FROM events),
    x AS (SELECT event_id, s AS at_, 1 AS step FROM e UNION ALL SELECT event_id, t, -1 FROM e),
    r AS (SELECT *, sum(step) OVER (ORDER BY at_, step, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS open FROM x)
    SELECT event_id, at_ AS start, open, open > 8 AS above FROM r WHERE step = 1""",
)
def concurrency(spark, sf):
    e = table(spark, sf, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    jobs = e.select("event_id", start.alias("start"), (start + F.round(F.col("value") * 60000000).cast("bigint")).alias("end"))
    return W.concurrency(jobs, "start", "end", 8, "event_id")


@query(
    "retention",
    """WITH m AS (SELECT max(ts) AS m FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
    SELECT event_id, CASE WHEN ts >= m - INTERVAL 1 HOUR THEN 'young' ELSE 'newest' END AS kept_as FROM l, m WHERE ts >= m - INTERVAL 1 HOUR OR r = 1""",
)
def retention(spark, sf):
    e = user_events(spark, sf).select("event_id", "user_id", "ts")
    return W.retention(e, ["user_id"], "ts", "1 HOUR", ["ts", "event_id"]).select("event_id", "kept_as")


@query(
    "top_parts",
    """WITH f AS (SELECT p_brand, p_type, min(p_partkey) AS p_partkey, arg_min(p_retailprice, p_partkey) AS p_retailprice FROM part GROUP BY ALL)
    SELECT * FROM f ORDER BY p_retailprice DESC, p_partkey LIMIT 20""",
)
def top_parts(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_type", "p_partkey", "p_retailprice")
    return W.top_k(p, ["p_brand", "p_type"], ["p_partkey"], "p_retailprice", 20)


@query("order_numeric", "SELECT cast(doc_id AS VARCHAR) AS id, n_chars FROM documents ORDER BY doc_id")
def order_numeric(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "n_chars")
    return W.order_numeric(d, "id")


# -- aggregates -----------------------------------------------------------------------------------


@query(
    "inspect_pages",
    """SELECT page_id, octet_length(encode(html)) AS bytes, substr(html, 1, 8) AS header, len(list_distinct(regexp_extract_all(html, '<h[1-6][^>]*>'))) AS heading_forms,
    len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '<li>')) AS items, 0 AS images, true AS tagged FROM pages""",
)
def inspect_pages(spark, sf):
    return A.inspect(table(spark, sf, "pages"))


@query(
    "resolve_count",
    """SELECT conv_id, coalesce(max(turn) FILTER (role = 'system') + 5, max(CASE WHEN turn % 4 = 3 THEN turn END), count(*) FILTER (role = 'user')) AS n FROM conversations GROUP BY conv_id""",
)
def resolve_count(spark, sf):
    c = table(spark, sf, "conversations")
    root = F.col("role") == "system"
    nodes = c.withColumn("declared", F.when(root, F.col("turn") + 5).when(F.col("turn") % 4 == 3, F.col("turn")))
    return A.resolve_count(nodes, "conv_id", root, "declared", F.col("role") == "user")


@query(
    "family_census",
    """SELECT p_brand AS family, count(*) AS n FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50) GROUP BY 1""",
)
def family_census(spark, sf):
    p = table(spark, sf, "part")
    loaded = p.filter("p_size = 50").select(F.col("p_brand").alias("family"))
    return A.family_census(p, "p_brand", loaded)


@query(
    "css_family_census",
    """SELECT p_brand AS family, count(*) AS n FROM part GROUP BY 1""",
)
def css_family_census(spark, sf):
    text = F.expr("concat('<style>p{font-family: \"', p_brand, '\", serif} q{font-family:monospace} /* font-family: x; */</style>')")
    pages = table(spark, sf, "part").select(text.alias("html"))
    return A.family_census(A.css_families(pages), "family", spark.createDataFrame([], "family string"))


@query(
    "match_stats",
    r"""WITH t AS (SELECT page_id % 10 AS bucket, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) = regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS same FROM pages)
    SELECT bucket, count(*) AS seen, count(*) FILTER (same) AS stripped, count(*) FILTER (NOT same) AS kept FROM t GROUP BY bucket""",
)
def match_stats(spark, sf):
    c = F.col("html")
    t = table(spark, sf, "pages").select((F.col("page_id") % 10).alias("bucket"), (H.title_of(c) == H.heading_of(c)).alias("same"))
    return A.match_stats(t, ["bucket"], stripped=F.col("same"), kept=~F.col("same"))


@query(
    "plan_summary",
    r"""SELECT 'nav' AS tag, sum(len(regexp_extract_all(html, '<nav')))::BIGINT AS n FROM pages UNION ALL SELECT 'footer', sum(len(regexp_extract_all(html, '<footer')))::BIGINT FROM pages""",
)
def plan_summary(spark, sf):
    from folioscan.operators.elements import LANDMARKS, elements

    tags = elements(table(spark, sf, "pages")).filter((F.col("kind") == "open") & F.col("tag").isin(*LANDMARKS))
    return A.plan_summary(tags)




@query(
    "failure_summary",
    """WITH e AS (SELECT event_type, ts, event_id, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '/favicon.ico?v=1' ELSE concat('/a/', floor(value)::INT) END AS url,
      CASE WHEN value < 10 THEN 'Image' WHEN value < 30 THEN 'Font' ELSE 'Script' END AS kind FROM events),
    k AS (SELECT event_type, url, arg_min(kind, (ts, event_id)) AS kind, min((ts, event_id)) AS at_ FROM e WHERE url IS NOT NULL AND url NOT LIKE '/favicon%' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY at_) AS rank FROM k),
    u AS (SELECT event_type, kind FROM k UNION ALL SELECT event_type, kind FROM e WHERE url IS NULL)
    SELECT event_type, count(*) AS failed, count(DISTINCT kind) AS kinds, count(*) FILTER (kind = 'Image') AS images,
    (SELECT string_agg(url, chr(10) ORDER BY rank) FROM r WHERE r.event_type = u.event_type) AS listed FROM u GROUP BY event_type""",
)
def failure_summary(spark, sf):
    e = table(spark, sf, "events").selectExpr(
        "event_type", "ts", "event_id",
        "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '/favicon.ico?v=1' ELSE concat('/a/', cast(floor(value) AS INT)) END AS url",
        "CASE WHEN value < 10 THEN 'Image' WHEN value < 30 THEN 'Font' ELSE 'Script' END AS kind",
    )
    return A.failure_summary(e, ["event_type"], "url", "kind", ["ts", "event_id"])


@query(
    "distinct_errors",
    """WITH e AS (SELECT user_id, concat('k', json_extract_string(props, '$.k')) AS message, min((ts, event_id)) AS at_ FROM events WHERE event_type = 'error' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_) AS rank FROM e)
    SELECT user_id, string_agg(message, '; ' ORDER BY rank) AS listed, count(*) AS n, 0::BIGINT AS more FROM r GROUP BY user_id""",
)
def distinct_errors(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'error'")
    m = e.select("user_id", "ts", "event_id", F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("message"))
    return A.distinct_errors(m, ["user_id"], "message", ["ts", "event_id"])


PROFILE_SQL = """WITH r AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, value, ts, row_number() OVER (PARTITION BY event_type, strftime(ts, '%Y-%m-%d') ORDER BY value) AS rn,
    count(*) OVER (PARTITION BY event_type, strftime(ts, '%Y-%m-%d')) AS n FROM events)"""


@query(
    "latency_profile",
    f"""{PROFILE_SQL} SELECT event_type, day, count(*) AS n, min(value) AS lo, max(value) AS hi, count(*) FILTER (value < 100) AS ok, count(*) FILTER (value >= 100) AS refused,
    round(CASE WHEN epoch_us(max(ts)) > epoch_us(min(ts)) THEN count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) END, 9) AS per_second, max(value) FILTER (rn = floor(n / 2) + 1) AS p50
    FROM r GROUP BY ALL""",
)
def latency_profile(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = A.latency_profile(e, ["event_type", "day"], "value", F.col("value") < 100, F.col("value") >= 100, "ts")
    return out.withColumn("per_second", F.round("per_second", 9))


@query(
    "upper_median",
    """WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT l_returnflag, v AS p50 FROM r WHERE rn = floor(n / 2) + 1""",
)
def upper_median(spark, sf):
    return A.upper_median(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query(
    "cost_ratio",
    """SELECT l_returnflag, l_linestatus, floor(sum((l_extendedprice * l_tax)::DECIMAL(28,6))::DOUBLE * 1000 / sum(l_extendedprice::DECIMAL(28,6))::DOUBLE + 0.5) / 10 AS pct FROM lineitem GROUP BY ALL""",
)
def cost_ratio(spark, sf):
    money = "decimal(28,6)"
    s = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum((F.col("l_extendedprice") * F.col("l_tax")).cast(money)).cast("double").alias("part"),
        F.sum(F.col("l_extendedprice").cast(money)).cast("double").alias("whole"),
    )
    return s.select("l_returnflag", "l_linestatus", A.cost_ratio(F.col("part"), F.col("whole")).alias("pct"))


@query(
    "quality_profile",
    r"""SELECT source, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS bytes, sum(1 + doc_id % 3)::BIGINT AS pages, sum(len(list_filter(string_split_regex(text, '[\s\x{A0}]+'), lambda x: x <> '')))::BIGINT AS words,
    count(*) FILTER (lang = 'en') AS english, count(*) FILTER (n_chars > 1000) AS long, floor(sum(octet_length(encode(text))) / 1024 / sum(1 + doc_id % 3) + 0.5)::BIGINT AS kb_per_page FROM documents GROUP BY source""",
)
def quality_profile(spark, sf):
    d = table(spark, sf, "documents").withColumn("bytes", F.octet_length("text")).withColumn("pages", 1 + F.col("doc_id") % 3)
    return A.quality_profile(d, ["source"], "bytes", "pages", "text", english=F.col("lang") == "en", long=F.col("n_chars") > 1000)


LONG_WORD = r"[A-Za-z0-9\x{00C0}-\x{024F}\x{4E00}-\x{9FFF}]{3,}"
# What came out of a page: its heading or its article, for one in eleven nothing, for one in five with characters that stand for several letters.
REPORT_SQL = rf"""WITH w AS (SELECT page_id, html, len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '(?i)&[a-z#0-9]+;', ' ', 'g'), '{LONG_WORD}')) AS source_words,
      CASE WHEN page_id % 11 > 0 THEN len(regexp_extract_all(regexp_replace(regexp_replace(regexp_extract(html, CASE WHEN page_id % 3 = 0 THEN '(?s)<h1>(.*?)</h1>' ELSE '(?s)<article>(.*?)</article>' END, 1), '<[^>]+>', ' ', 'g'), '(?i)&[a-z#0-9]+;', ' ', 'g'), '{LONG_WORD}')) END AS got FROM pages),
    b AS (SELECT *, coalesce(got, 0) / source_words AS retention, concat_ws(', ', CASE WHEN len(regexp_extract_all(html, '<p>')) <> len(regexp_extract_all(replace(html, '"</p>"', ''), '</p>')) THEN 'p' END,
      CASE WHEN len(regexp_extract_all(html, '<b>')) <> len(regexp_extract_all(html, '</b>')) THEN 'b' END) AS off FROM w),
    n AS (SELECT page_id, source_words, coalesce(got, 0) AS got, round(retention, 9) AS retention, list_filter([CASE WHEN off <> '' THEN concat('not verified: ', off) END,
      CASE WHEN page_id % 7 = 0 THEN '2 rewrites rejected' END, CASE WHEN got IS NULL THEN 'no text extracted' END,
      CASE WHEN retention < 0.5 THEN concat('lost text: ', floor(retention * 100 + 0.5)::BIGINT, ' of 100 words left, source has ', source_words) END,
      CASE WHEN page_id % 7 = 0 THEN '1 metrics without source' END, CASE WHEN page_id % 5 = 0 AND got IS NOT NULL THEN '2 ligatures left' END], lambda x: x IS NOT NULL) AS l FROM b)"""


def reported(spark, sf):
    pages = table(spark, sf, "pages")
    part = F.when(F.col("page_id") % 3 == 0, H.heading_of(F.col("html"))).otherwise(F.regexp_extract("html", r"(?is)<article>(.*?)</article>", 1))
    plain = F.regexp_replace(part, r"(?s)<[^>]+>|&[a-zA-Z#0-9]+;", " ")
    extracted = pages.where("page_id % 11 > 0").select("page_id", F.concat(plain, F.when(F.col("page_id") % 5 == 0, " \ufb01 \ufb02 \ufb01").otherwise("")).alias("text"))
    counts = pages.where("page_id % 7 = 0").select("page_id", F.lit(2).alias("rejected"), F.lit(1).alias("metrics"))
    return A.corpus_report(pages, extracted, counts)


@query("corpus_report", REPORT_SQL + " SELECT page_id, source_words, got, retention, array_to_string(l, '; ') AS notes, len(l) = 0 AS clean FROM n")
def corpus_report(spark, sf):
    return reported(spark, sf).withColumn("retention", F.round("retention", 9)).withColumn("notes", F.array_join("notes", "; "))


@query("corpus_totals", REPORT_SQL + " SELECT count(*) FILTER (len(l) = 0) AS clean, count(*) AS documents, sum(len(l))::BIGINT AS observations FROM n")
def corpus_totals(spark, sf):
    return A.corpus_totals(reported(spark, sf))


@query(
    "coverage_floor",
    """WITH s AS (SELECT source, count(*) AS l, count(x.doc_id) AS h FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) x USING (doc_id) GROUP BY source)
    SELECT sum(l) FILTER (source <> 'src3')::BIGINT AS lines, sum(h) FILTER (source <> 'src3')::BIGINT AS hits, coalesce(sum(l) FILTER (source = 'src3'), 0)::BIGINT AS skipped_lines,
    coalesce(sum(h) FILTER (source = 'src3'), 0)::BIGINT AS skipped_hits, round(100 * sum(h) FILTER (source <> 'src3') / sum(l) FILTER (source <> 'src3'), 9) AS pct,
    100 * sum(h) FILTER (source <> 'src3') / sum(l) FILTER (source <> 'src3') >= 38 AS passes FROM s""",
)
def coverage_floor(spark, sf):
    labelled = table(spark, sf, "labels").select("doc_id").distinct().withColumn("hit", F.lit(1))
    s = table(spark, sf, "documents").select("doc_id", "source").join(labelled, "doc_id", "left")
    per = s.groupBy("source").agg(F.count("*").alias("l"), F.count("hit").alias("h"))
    return A.coverage_floor(per, "source", "l", "h", 38.0, ("src3",)).withColumn("pct", F.round("pct", 9))


@query(
    "run_profile",
    r"""WITH m AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|(<script[^>]*>).*?(</script>)|(<style[^>]*>).*?(</style>)', '\1\2\3\4', 'g') AS h FROM pages)
    SELECT page_id, length(regexp_replace(regexp_replace(h, '</?[a-zA-Z][^>]*>', '', 'g'), '[\s\x{A0}]', '', 'g')) AS glyphs, len(regexp_extract_all(h, '(?:</?[a-zA-Z][^>]*>)+')) AS runs,
    len(regexp_extract_all(h, '<(?:p|li|h1|div|nav|footer|article)\b')) AS blocks FROM m""",
)
def run_profile(spark, sf):
    return A.run_profile(table(spark, sf, "pages"))


@query(
    "unresolved_expansions",
    """SELECT 'ﬁ' AS ch, count(*) AS n_rows, 'fi' AS expands_to FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'ﬄ', count(*), 'ffl' FROM documents WHERE doc_id % 3 = 0""",
)
def unresolved_expansions(spark, sf):
    text = F.expr("concat(text, CASE WHEN doc_id % 2 = 0 THEN ' ﬁsh ﬁ' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN ' waﬄe Ａ' ELSE '' END)")
    return A.unresolved_expansions(table(spark, sf, "documents").select(text.alias("text")), "text")


@query(
    "expand_ligatures",
    r"""SELECT doc_id, md5(concat(text, CASE WHEN doc_id % 2 = 0 THEN ' fish ﹅' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN ' waffle Ａ' ELSE '' END)) AS digest FROM documents""",
)
def expand_ligatures(spark, sf):
    text = F.expr("concat(text, CASE WHEN doc_id % 2 = 0 THEN ' ﬁsh ﹅' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN ' waﬄe Ａ' ELSE '' END)")
    return table(spark, sf, "documents").select("doc_id", F.md5(T.expand_ligatures(text)).alias("digest"))
