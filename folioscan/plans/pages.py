"""Queries over ``pages``: style sheets, page rules, links, assets, elements.

The pages hold no page rules, images or form controls. Where a query needs them they are written into
the page by ``SEED``, a fixed expression over the page's own columns that both engines evaluate.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions import css
from folioscan.functions import html as H
from folioscan.functions import values as V
from folioscan.functions.text import normalize_text
from folioscan.operators import elements as E
from folioscan.operators import findings as FD
from folioscan.operators import windows as WN
from folioscan.plans.registry import query, table



def html():
    """The page text. A function, because a column needs a running session."""
    return F.col("html")


# The page rule a page declares in the derived queries, chosen by its number.
DECL = (
    "concat('size:', CASE page_id % 5 WHEN 0 THEN 'A4' WHEN 1 THEN '297mm  210MM' WHEN 2 THEN 'letter landscape' "
    "WHEN 3 THEN 'auto' ELSE '210mm 297mm' END, ';margin:', cast(page_id % 30 AS STRING), 'mm')"
)
SIZE_SQL = (
    "CASE page_id % 5 WHEN 0 THEN 'a4' WHEN 1 THEN '297mm 210mm' WHEN 2 THEN 'letter landscape' "
    "WHEN 3 THEN 'auto' ELSE '210mm 297mm' END"
)
ORIENTATION_SQL = "CASE page_id % 5 WHEN 1 THEN 'landscape' WHEN 2 THEN 'landscape' ELSE 'portrait' END"
AT_SQL = (
    "CASE WHEN instr(lower(html), '</body') > 0 THEN instr(lower(html), '</body') - 1 "
    "WHEN instr(lower(html), '</html') > 0 THEN instr(lower(html), '</html') - 1 ELSE length(html) END"
)


def injected_sql(decl: str = DECL) -> str:
    return f"concat(substr(html, 1, {AT_SQL}), '<style>@page{{', {decl}, '}}</style>', substr(html, {AT_SQL} + 1))"


def ruled(spark, sf):
    """Pages with the rule of their number written in."""
    return table(spark, sf, "pages").select("page_id", "url", H.inject_page_rule(html(), F.expr(DECL)).alias("html"))


@query(
    "strip_html_comments",
    r"""SELECT page_id, length(t) AS n, md5(t) AS digest
    FROM (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g') AS t FROM pages)""",
)
def strip_html_comments(spark, sf):
    t = table(spark, sf, "pages").select("page_id", css.strip_html_comments(html()).alias("t"))
    return t.select("page_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


@query(
    "strip_css_comments",
    r"""SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id,
    regexp_replace(regexp_replace(concat('/* ', url, ' */', html, CASE WHEN page_id % 2 = 0 THEN '/* open' ELSE '' END),
      '(?s)/\*.*?\*/', ' ', 'g'), '(?s)/\*.*$', '') AS t FROM pages)""",
)
def strip_css_comments(spark, sf):
    text = F.expr("concat('/* ', url, ' */', html, CASE WHEN page_id % 2 = 0 THEN '/* open' ELSE '' END)")
    t = table(spark, sf, "pages").select("page_id", css.strip_css_comments(text).alias("t"))
    return t.select("page_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


@query(
    "mask_css_strings",
    r"""SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, regexp_replace(regexp_replace(html,
    '(?s)"[^"\\]*(?:\\.[^"\\]*)*"', '""', 'g'), '(?s)''[^''\\]*(?:\\.[^''\\]*)*''', '''''', 'g') AS t FROM pages)""",
)
def mask_css_strings(spark, sf):
    t = table(spark, sf, "pages").select("page_id", css.mask_css_strings(html()).alias("t"))
    return t.select("page_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


@query(
    "style_blocks",
    f"""WITH p AS (SELECT page_id, {injected_sql()} AS h FROM pages),
    b AS (SELECT page_id, regexp_extract_all(h, '(?is)<style[^>]*>(.*?)</style', 1) AS l FROM p)
    SELECT page_id, i - 1 AS pos, l[i] AS body FROM b, unnest(range(1, len(l) + 1)) AS u(i)""",
)
def style_blocks(spark, sf):
    return ruled(spark, sf).select("page_id", F.posexplode(css.style_blocks(html())).alias("pos", "body")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


@query("page_rules", f"SELECT page_id, 0 AS pos, concat('@page{{', {DECL}, '}}') AS body FROM pages")
def page_rules(spark, sf):
    return ruled(spark, sf).select("page_id", F.posexplode(css.page_rules(html())).alias("pos", "body"))


@query(
    "declared_page_props",
    f"SELECT page_id, {SIZE_SQL} AS size, concat(cast(page_id % 30 AS VARCHAR), 'mm') AS declared_margin FROM pages",
)
def declared_page_props(spark, sf):
    return FD.page_declarations(ruled(spark, sf))


@query("declared_orientation", f"SELECT page_id, {ORIENTATION_SQL} AS orientation FROM pages")
def declared_orientation(spark, sf):
    d = FD.page_declarations(ruled(spark, sf))
    return d.select("page_id", css.declared_orientation(F.col("size")).alias("orientation"))


LENGTH_TEXT = (
    "concat(cast(cast(l_quantity AS INT) - 1 AS STRING), CASE l_linenumber WHEN 1 THEN 'mm' WHEN 2 THEN 'in' WHEN 3 THEN ' CM' "
    "WHEN 4 THEN 'pt' WHEN 5 THEN 'em' WHEN 6 THEN '' ELSE 'furlong' END)"
)


@query(
    "length_to_inches",
    f"""WITH l AS (SELECT {LENGTH_TEXT} AS len, cast(l_quantity AS INT) - 1 AS v, l_linenumber AS u FROM lineitem),
    g AS (SELECT len, v, u, count(*) AS n FROM l GROUP BY ALL)
    SELECT len, round(CASE u WHEN 1 THEN v / 25.4::DOUBLE WHEN 2 THEN v WHEN 3 THEN v / 2.54::DOUBLE WHEN 4 THEN v / 72.0::DOUBLE
      WHEN 6 THEN CASE WHEN v = 0 THEN 0 END END, 9) AS inches,
    CASE WHEN u = 5 THEN 'relative' WHEN u = 6 AND v <> 0 THEN 'unit-missing' WHEN u = 7 THEN 'unknown-unit' END AS error, n FROM g""",
)
def length_to_inches(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.expr(LENGTH_TEXT).alias("len")).agg(F.count("*").alias("n"))
    g = g.withColumn("i", css.to_inches(F.col("len")))
    return g.select("len", F.round("i.inches", 9).alias("inches"), F.col("i.error").alias("error"), "n")


TURNED_SQL = (
    "CASE page_id % 5 WHEN 0 THEN ' a4 landscape' WHEN 4 THEN ' 297mm 210mm' END"
)


@query(
    "transpose_size",
    f"""WITH p AS (SELECT page_id, {injected_sql("concat('size:', " + TURNED_SQL + ", ';margin:', cast(page_id % 30 AS STRING), 'mm')")} AS t,
      {TURNED_SQL} AS turned FROM pages)
    SELECT page_id, CASE WHEN turned IS NOT NULL THEN md5(t) END AS digest FROM p""",
)
def transpose_size(spark, sf):
    return ruled(spark, sf).select("page_id", F.md5(css.transpose_size(html())).alias("digest"))


@query(
    "strip_page_size",
    f"""WITH p AS (SELECT page_id, {injected_sql("concat('margin:', cast(page_id % 30 AS STRING), 'mm')")} AS t FROM pages)
    SELECT page_id, length(t) AS n, md5(t) AS digest FROM p""",
)
def strip_page_size(spark, sf):
    t = ruled(spark, sf).select("page_id", css.strip_page_size(html()).alias("t"))
    return t.select("page_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


@query("inject_page_rule", f"SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, {injected_sql()} AS t FROM pages)")
def inject_page_rule(spark, sf):
    t = ruled(spark, sf)
    return t.select("page_id", F.length("html").cast("bigint").alias("n"), F.md5("html").alias("digest"))


@query(
    "page_analysis",
    f"""SELECT page_id, 1 AS rules, {SIZE_SQL} AS size, concat(cast(page_id % 30 AS VARCHAR), 'mm') AS margin, {ORIENTATION_SQL} AS orientation,
    CASE page_id % 5 WHEN 1 THEN 'already landscape' WHEN 2 THEN 'already landscape' WHEN 3 THEN 'refused' ELSE 'transposed' END AS outcome
    FROM pages""",
)
def page_analysis(spark, sf):
    return FD.page_analysis(ruled(spark, sf)).withColumn("rules", F.size("rules"))


# The request a page is printed with, chosen by its number.
REQUEST = {
    "format": "CASE page_id % 3 WHEN 1 THEN 'a4' END",
    "landscape": "page_id % 2 = 0",
    "margin": "CASE WHEN page_id % 4 = 0 THEN '1in' END",
}


@query(
    "page_override",
    f"""WITH p AS (SELECT page_id, page_id % 3 = 1 AS fmt, page_id % 2 = 0 AS land, page_id % 4 = 0 AS marg, page_id % 5 AS k, html,
      {injected_sql()} AS h,
      {injected_sql("concat('margin:', cast(page_id % 30 AS STRING), 'mm')")} AS stripped,
      {injected_sql("concat('size:', " + TURNED_SQL + ", ';margin:', cast(page_id % 30 AS STRING), 'mm')")} AS turned FROM pages),
    q AS (SELECT *, concat('<style>@page{{size:a4', CASE WHEN land THEN ' landscape' ELSE '' END, CASE WHEN marg THEN ';margin:1in' ELSE '' END, '}}</style>') AS add_
      FROM p),
    r AS (SELECT *, instr(stripped, '</body>') AS b, instr(stripped, '</html>') AS r FROM q)
    SELECT page_id, CASE WHEN fmt THEN 'requested' WHEN land AND k IN (0, 3, 4) THEN 'transposed' ELSE 'untouched' END AS outcome,
    CASE WHEN fmt THEN md5(CASE WHEN b > 0 THEN concat(substr(stripped, 1, b - 1), add_, substr(stripped, b))
        WHEN r > 0 THEN concat(substr(stripped, 1, r - 1), add_, substr(stripped, r)) ELSE concat(stripped, add_) END)
      WHEN land AND k IN (0, 4) THEN md5(turned) END AS digest FROM r""",
)
def page_override(spark, sf):
    asked = {k: F.expr(v) for k, v in REQUEST.items()}
    rules = ruled(spark, sf).withColumn("rules", css.page_rules(html()))
    sized = rules.withColumn("size", css.declared_prop(F.col("rules"), "size"))
    return sized.select(
        "page_id",
        H.override_outcome(F.col("size"), asked["format"], asked["landscape"]).alias("outcome"),
        F.md5(H.page_override(html(), F.col("size"), asked["format"], asked["landscape"], asked["margin"])).alias("digest"),
    )


@query(
    "printable_width",
    f"""SELECT page_id, round(greatest(0, (CASE WHEN page_id % 3 = 1 THEN 8.2677::DOUBLE ELSE CASE page_id % 5 WHEN 0 THEN 8.2677::DOUBLE WHEN 1 THEN 297 / 25.4::DOUBLE
      WHEN 2 THEN 8.5::DOUBLE WHEN 3 THEN 8.2677::DOUBLE ELSE 210 / 25.4::DOUBLE END END
      - 2 * CASE WHEN page_id % 4 = 0 THEN 1.0::DOUBLE ELSE (page_id % 30) / 25.4::DOUBLE END) * 96), 4) AS px FROM pages""",
)
def printable_width(spark, sf):
    asked = {k: F.expr(v) for k, v in REQUEST.items()}
    d = FD.page_declarations(ruled(spark, sf))
    px = H.printable_width(F.col("size"), F.col("declared_margin"), asked["format"], asked["margin"])
    return d.select("page_id", F.round(px, 4).alias("px"))


META = (
    "concat('<html><head><meta charset=\"utf-8\">', CASE c_custkey % 4 WHEN 0 THEN concat('<meta name=\"author\" content=\" ', c_name, ' \">') "
    "WHEN 1 THEN concat('<meta property=\"article:author\" content=\"', c_name, '\"/>') "
    "WHEN 2 THEN concat('<meta name=\"author\" content=\"\"><META name=''DC.creator'' content=''', c_name, '''>') ELSE '' END, "
    "'<meta name=\"description\" content=\"', c_mktsegment, '\">', "
    "CASE WHEN c_nationkey > 12 THEN concat('<meta content=\"', cast(c_nationkey AS STRING), '\" name=\"keywords\">') ELSE '' END, '</head>')"
)


@query(
    "doc_meta",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 <> 3 THEN c_name END AS author, c_mktsegment AS subject,
    CASE WHEN c_nationkey > 12 THEN cast(c_nationkey AS VARCHAR) END AS keywords FROM customer""",
)
def doc_meta(spark, sf):
    t = table(spark, sf, "customer").select("c_custkey", H.meta_entries(H.tags(F.expr(META))).alias("metas"))
    return t.select("c_custkey", *[H.doc_meta(F.col("metas"), f).alias(f) for f in ("author", "subject", "keywords")])


@query(
    "link_descriptions",
    r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a [^>]*>.*?</a>') AS l FROM pages),
    u AS (SELECT page_id, i - 1 AS pos, l[i] AS a FROM a, unnest(range(1, len(l) + 1)) AS u(i))
    SELECT page_id, pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href,
    trim(regexp_replace(replace(regexp_replace(a, '<[^>]+>', '', 'g'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM u""",
)
def link_descriptions(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.posexplode(H.anchors(html(), F.col("url"))).alias("pos", "a"))
    return p.select("page_id", F.col("pos").cast("bigint").alias("pos"), "a.href", "a.text")


ASSETS = (
    "concat('<link rel=\"stylesheet\" href=\"css/', replace(p_brand, '#', ''), '.css?v=1\">"
    "<link rel=stylesheet href=data:text/css,x><a href=\"nav.html\">x</a><img src=''../img/', cast(p_partkey AS STRING), "
    "'.png'' srcset=\"a.png 1x, b', cast(p_size AS STRING), '.png 2x\"><style>@import \"base.css\"; p{background:url( \"bg-', p_type, '.png\" )}"
    "</style><script type=module>import x from \"./m.js\"; import(\"lazy.js\")</script>')"
)


@query(
    "asset_refs",
    """WITH r AS (SELECT p_partkey, unnest([concat('css/', replace(p_brand, '#', ''), '.css?v=1'), 'data:text/css,x',
      concat('../img/', p_partkey, '.png'), 'a.png', concat('b', p_size, '.png'), 'base.css', 'base.css', concat('bg-', p_type, '.png'), './m.js', 'lazy.js']) AS ref FROM part)
    SELECT p_partkey, ref, count(*) AS n FROM r GROUP BY ALL""",
)
def asset_refs(spark, sf):
    # Parts are short: one split holds millions, and their references would be counted in one task. So the parts are dealt out before.
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size").repartition("p_partkey")
    p = parts.select("p_partkey", F.explode(H.asset_refs(F.expr(ASSETS))).alias("ref"))
    return p.groupBy("p_partkey", "ref").agg(F.count("*").alias("n"))


@query(
    "relative_assets",
    """SELECT p_partkey, p_size > 25 AS relative FROM part""",
)
def relative_assets(spark, sf):
    text = F.expr(
        "CASE WHEN p_size > 25 THEN concat('<img src=\"i/', p_name, '.png\">') ELSE concat('<img src=\"https://x.example/', p_name, '\"><img src=\"#', p_type, '\">') END"
    )
    return table(spark, sf, "part").select("p_partkey", H.has_relative_assets(text).alias("relative"))


SHEETS = (
    "array_join(transform(sequence(1, 5 + cast(p_size % 7 AS INT)), i -> concat('<link rel=\"stylesheet\" href=\"', "
    "CASE WHEN i = 2 THEN 'data:,x' ELSE concat('s', i, '-', p_partkey, '.css') END, '\">')), '')"
)


@query(
    "linked_css",
    """WITH r AS (SELECT p_partkey, unnest(range(1, 6 + p_size % 7)) AS i FROM part),
    k AS (SELECT p_partkey, i, row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS pos FROM r WHERE i <> 2)
    SELECT p_partkey, pos, concat('s', i, '-', p_partkey, '.css') AS href FROM k""",
)
def linked_css(spark, sf):
    sheets = H.linked_css(F.expr(SHEETS))
    p = table(spark, sf, "part").select("p_partkey", F.posexplode(sheets).alias("pos", "href"))
    return p.withColumn("pos", F.col("pos").cast("bigint"))


MASKED_SQL = (
    r"""regexp_replace(html, '(?is)<!--.*?-->|(<script[^>]*>).*?(</script>)|(<style[^>]*>).*?(</style>)', '\1\2\3\4', 'g')"""
)


@query(
    "elements",
    rf"""WITH t AS (SELECT page_id, regexp_extract_all({MASKED_SQL}, '</?[a-zA-Z][^>]*>') AS l FROM pages),
    u AS (SELECT page_id, i - 1 AS idx, l[i] AS token FROM t, unnest(range(1, len(l) + 1)) AS u(i)),
    n AS (SELECT *, lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9-]*)', 1)) AS tag FROM u)
    SELECT page_id, idx, tag, CASE WHEN token LIKE '</%' THEN 'close' WHEN tag IN ('br', 'meta') THEN 'void' ELSE 'open' END AS kind FROM n""",
)
def elements(spark, sf):
    e = E.elements(table(spark, sf, "pages"))
    return e.select("page_id", F.col("idx").cast("bigint").alias("idx"), "tag", "kind")


@query(
    "landmark_census",
    rf"""WITH m AS (SELECT page_id, {MASKED_SQL} AS h FROM pages),
    l AS (SELECT page_id, 'nav' AS tag, regexp_extract(h, '(?s)<nav[^>]*>(.*?)</nav>', 1) AS body, instr(h, '<nav') AS pos FROM m
      UNION ALL SELECT page_id, 'footer', regexp_extract(h, '(?s)<footer[^>]*>(.*?)</footer>', 1), instr(h, '<footer') FROM m)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS idx, tag,
    regexp_replace(replace(replace(replace(replace(regexp_replace(body, '<[^>]+>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&amp;', '&'), '\s', '', 'g') AS text,
    -1 AS owner FROM l WHERE pos > 0""",
)
def landmark_census(spark, sf):
    return E.landmark_census(table(spark, sf, "pages")).withColumn("idx", F.col("idx").cast("bigint"))


WORDS_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(TEXT, '(?is)<script.*?</script>', ' ', 'g'),
  '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '(?i)&[a-z#0-9]+;', ' ', 'g')"""
WORD_SQL = r"'[A-Za-z0-9\x{00C0}-\x{024F}\x{4E00}-\x{9FFF}]{3,}'"


@query("page_source_words", f"SELECT page_id, len(regexp_extract_all({WORDS_SQL.replace('TEXT', 'html')}, {WORD_SQL})) AS words FROM pages")
def page_source_words(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.source_words(html()).cast("bigint").alias("words"))


@query("document_source_words", f"SELECT doc_id, len(regexp_extract_all({WORDS_SQL.replace('TEXT', 'text')}, {WORD_SQL})) AS words FROM documents")
def document_source_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", H.source_words(F.col("text")).cast("bigint").alias("words"))


TITLE = (
    "CASE page_id % 4 WHEN 0 THEN concat('127.0.0.1:', cast(8000 + page_id AS STRING), '/input.html') WHEN 1 THEN 'about:blank' "
    "WHEN 2 THEN concat('LOCALHOST:80/', cast(page_id AS STRING), ' x') ELSE url END"
)


@query(
    "fix_volatile_title",
    rf"""SELECT page_id, page_id % 4 < 3 AS volatile, CASE WHEN page_id % 4 < 3 THEN regexp_extract(url, '://([^/?#]*)', 1) ELSE {TITLE} END AS title FROM pages""",
)
def fix_volatile_title(spark, sf):
    title = F.expr(TITLE)
    volatile = V.volatile_title(title)
    return table(spark, sf, "pages").select(
        "page_id",
        volatile.alias("volatile"),
        V.steady_title(title, F.col("url")).alias("title"),
    )


@query(
    "default_output_name",
    r"""WITH s AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS l FROM pages)
    SELECT page_id, concat(CASE WHEN len(l) = 0 THEN 'index' ELSE regexp_replace(l[len(l)], '(?i)\.html?$', '') END, '.pdf') AS name FROM s""",
)
def default_output_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", V.default_name(F.col("url")).alias("name"))


@query(
    "marker_segments",
    rf"""WITH m AS (SELECT page_id, string_split_regex({MASKED_SQL}, '<(?:h1|p)\b[^>]*>') AS l FROM pages)
    SELECT page_id, i - 2 AS pos, regexp_matches(l[i], '[A-Za-z]{{3,}}') AS shows_text FROM m, unnest(range(2, len(l) + 1)) AS u(i)""",
)
def marker_segments(spark, sf):
    m = WN.marker_segments(table(spark, sf, "pages"), r"<(?:h1|p)\b[^>]*>", "[A-Za-z]{3,}")
    return m.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "assemble_text",
    rf"""WITH m AS (SELECT page_id, {MASKED_SQL} AS h FROM pages),
    t AS (SELECT page_id, regexp_extract_all(h, '</?[a-zA-Z][^>]*>|[^<]+|<') AS l FROM m),
    u AS (SELECT page_id, i - 1 AS idx, l[i] AS k FROM t, unnest(range(1, len(l) + 1)) AS u(i)),
    v AS (SELECT page_id, idx, lower(regexp_extract(k, '^<([a-zA-Z0-9]+)', 1)) AS tag, l2, k FROM (SELECT *, lower(regexp_extract(k, '^</([a-zA-Z0-9]+)', 1)) AS l2 FROM u)),
    o AS (SELECT page_id, idx, tag, row_number() OVER (PARTITION BY page_id, tag ORDER BY idx) AS n FROM v WHERE tag IN ('nav', 'li', 'h1', 'footer')),
    c AS (SELECT page_id, idx, l2 AS tag, row_number() OVER (PARTITION BY page_id, l2 ORDER BY idx) AS n FROM v WHERE l2 IN ('nav', 'li', 'h1', 'footer')),
    s AS (SELECT o.page_id, o.idx, o.tag, c.idx AS e FROM o JOIN c USING (page_id, tag, n)),
    x AS (SELECT v.page_id, v.idx AS ti, v.k, max(s.idx) AS mark FROM v JOIN s ON v.page_id = s.page_id AND v.idx > s.idx AND v.idx < s.e
      WHERE v.tag = '' AND v.l2 = '' GROUP BY ALL),
    y AS (SELECT page_id, mark, string_agg(k, '' ORDER BY ti) AS raw FROM x GROUP BY ALL)
    SELECT s.page_id, s.idx, s.tag, regexp_replace(replace(replace(replace(replace(coalesce(raw, ''), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&amp;', '&'), '\s', '', 'g') AS text
    FROM s LEFT JOIN y ON s.page_id = y.page_id AND s.idx = y.mark""",
)
def assemble_text(spark, sf):
    t = E.tokens(table(spark, sf, "pages"))
    return WN.assemble_text(t, "page_id", ("nav", "li", "h1", "footer")).withColumn("idx", F.col("idx").cast("bigint"))


@query(
    "title_equals_heading",
    r"""SELECT count(*) AS pages, count(*) FILTER (regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s', '', 'g')
      = regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '\s', '', 'g')) AS same FROM pages""",
)
def title_equals_heading(spark, sf):
    same = normalize_text(H.title_of(html())) == normalize_text(H.heading_of(html()))
    return table(spark, sf, "pages").agg(F.count("*").alias("pages"), F.count_if(same).alias("same"))
