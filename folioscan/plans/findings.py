"""Queries over findings.

``SEED`` writes defects into the pages by their number; both engines evaluate the same expression, and the SQL
counts the defects in the resulting text by its own patterns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions import css
from folioscan.functions import html as H
from folioscan.functions import values as V
from folioscan.operators import elements as E
from folioscan.operators import findings as FD
from folioscan.operators.gates import manifest_diff
from folioscan.operators.ordered import numbered
from folioscan.plans.pages import REQUEST, ruled
from folioscan.plans.registry import query, table
from folioscan.sources.manifest import MANIFEST, manifest
from folioscan.sources.sinks import result_json

SEED = (
    "concat(html, "
    "CASE WHEN page_id % 5 = 0 THEN '<p>{{company}} owes {{#total}} {{/total}} {{a b}}</p>' ELSE '' END, "
    "CASE WHEN page_id % 3 = 0 THEN '<img src=\"a.png\"><img src=\"b.png\" alt=\" \"><img alt=\"\" role=\"presentation\" src=\"c\">' ELSE '' END, "
    "CASE WHEN page_id % 4 = 0 THEN '<figure><img src=\"d\" alt=\"tree\"></figure><figure id=\"f\"><img src=\"e\" alt=\"\"></figure>"
    "<figure><figcaption>x</figcaption></figure><figure><figure><figcaption>y</figcaption></figure></figure>' ELSE '' END, "
    "CASE WHEN page_id % 6 = 0 THEN '<select><option>1</option></select><input type=\"hidden\"><input type=\"text\"><button>b</button><textarea></textarea>"
    "<canvas>fallback</canvas><canvas title=\"chart\"></canvas>' ELSE '' END, "
    "CASE WHEN page_id % 7 = 0 THEN '<style>a::after{content: target-counter(attr(href), page)} /* content: leader(x) */ b{content:\"string(\"; color:red}"
    " i{content: leader(\".\") string(x)}</style>' ELSE '' END, "
    "CASE WHEN page_id % 8 = 0 THEN '<style>@font-face{font-family:\"Own Face\";src:url(data:x)} body{font-family: \"Own Face\", serif} h1{font-family:Other, serif}"
    " h2{font-family: serif} h3{font-family:Third; color:red}</style>' ELSE '' END, "
    "CASE WHEN page_id % 9 = 0 THEN '<div dir=\"rtl\"><p>رقم 2026-10-03 و 971 50 123 4567</p><p>ISO 8601: 2026-10-03</p><bdi dir=\"ltr\">2026-10-03</bdi></div>'"
    " WHEN page_id % 9 = 3 THEN '<p dir=\"auto\">تاريخ 2026-10-03</p><p>سنة <b>ABC</b> 2026-10-03</p>' ELSE '' END)"
)


def seeded(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", F.expr(SEED).alias("html"))


S_SQL = f"s AS (SELECT page_id, {SEED} AS html FROM pages)"
N = r"len(regexp_extract_all(html, '{}'))"
IMG = "regexp_extract_all(html, '<img[^>]*>')"
COUNTS_SQL = rf"""c AS (SELECT page_id, html,
    len(regexp_extract_all(html, '\{{\{{[#/]?[a-zA-Z0-9_]+\}}\}}')) AS "unfilled-placeholder",
    len([x for x in {IMG} if x NOT LIKE '% alt=%' AND x NOT LIKE '%presentation%']) AS "missing-alt",
    len([x for x in {IMG} if regexp_matches(x, ' alt="\s*"') AND x NOT LIKE '%presentation%']) AS "empty-alt",
    {N.format('<select')} AS "select-untagged",
    {N.format('<input type="text"|<button|<textarea')} AS "form-fields-static",
    {N.format('<canvas[^>]*>[^<]')} AS "canvas-fallback-unnamed",
    {N.format('<canvas title=[^>]*></canvas')} AS "canvas-unpainted",
    CASE WHEN page_id % 7 = 0 THEN 3 ELSE 0 END AS "unsupported-paged-media",
    CASE WHEN html LIKE '%<figure id="f"><img src="e" alt=""></figure>%' THEN 1 ELSE 0 END AS "figure-uncaptioned",
    len([x for x in list_distinct(regexp_extract_all(html, 'font-family: ?"?([A-Z][a-z ]*)', 1)) if x NOT LIKE 'Own%']) AS "font-fallback",
    len(list_distinct(regexp_extract_all(html, ' src="([a-z.]+)"', 1))) AS "subresource-failed",
    CASE page_id % 9 WHEN 0 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS "rtl-digit-run",
    ({N.format(r'<p[ >]')} <> len(regexp_extract_all(replace(html, '"</p>"', ''), '</p>')))::INT
      + ({N.format(r'<b>')} <> {N.format(r'</b>')})::INT AS "output-unverified" FROM s)"""
LONG_SQL = (
    f"WITH {S_SQL}, {COUNTS_SQL}, f AS (SELECT * FROM (UNPIVOT (SELECT * EXCLUDE (html) FROM c) ON COLUMNS(* EXCLUDE (page_id)) INTO NAME code VALUE n) WHERE n > 0)"
)
SEV_SQL = ", ".join(f"('{c}', '{s}')" for c, (s, _) in sorted(MANIFEST.items()))


@query("page_findings", f"{LONG_SQL} SELECT page_id, code, n FROM f")
def page_findings(spark, sf):
    return FD.page_findings(seeded(spark, sf)).select("page_id", "code", "n")


ERRORS_TEXT = """SELECT c.page_id, f.code, f.n, count(*) OVER (PARTITION BY f.code) AS pages
    FROM page_checks c, LATERAL page_findings(c.found) f WHERE f.severity = 'error' AND f.n > 0"""


@query("findings_in_sql", f"{LONG_SQL}, m(code, severity) AS (VALUES {SEV_SQL}) SELECT page_id, code, n, count(*) OVER (PARTITION BY code) AS pages FROM f JOIN m USING (code) WHERE severity = 'error'")
def findings_in_sql(spark, sf):
    """The audit asked for in SQL text alone."""
    FD.register_findings(seeded(spark, sf))
    return spark.sql(ERRORS_TEXT)


VERDICT_SQL = f""", m(code, severity) AS (VALUES {SEV_SQL}), j AS (SELECT * FROM f JOIN m USING (code)),
    v AS (SELECT page_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warn') AS warns,
      count(*) FILTER (severity = 'info') AS infos, coalesce(string_agg(DISTINCT code, ',' ORDER BY code) FILTER (severity = 'error'), '') AS error_codes
      FROM j GROUP BY page_id)
    SELECT p.page_id, coalesce(errors, 0) = 0 AS ok, coalesce(errors, 0) AS errors, coalesce(warns, 0) AS warns, coalesce(infos, 0) AS infos,
    coalesce(error_codes, '') AS error_codes FROM pages p LEFT JOIN v USING (page_id)"""


RTL_SEED = """CASE page_id % 6
    WHEN 0 THEN concat('<div dir="rtl"><ul><li>رقم 2026-10-', day, '<li>قيمة ', day, '-07-2026 ثم 2026-10-', day, '</ul></div>')
    WHEN 1 THEN concat('<section style="direction: rtl"><b>رقم</b> <i>+9715012345', day, '</i> <bdi>2026-10-', day, '</bdi></section>')
    WHEN 2 THEN concat('<table dir="rtl"><tr><td dir="ltr">رقم 2026-10-', day, '<td>ref A: 2026-10-', day, '</table>')
    WHEN 3 THEN concat('<p dir="auto">تاريخ 2026-10-', day, ' . INV-2026-0147</p><p dir="ltr">رقم 2026-10-', day, '</p><p>2026-10-', day, '</p>')
    WHEN 4 THEN concat('<style>body, p {direction:rtl}</style><p>رقم 971 50 123 45', day, '<!-- x --> <br>&#1585; 2026-10-', day, '</p>')
    ELSE '' END"""
RTL_DAY = "lpad(cast(page_id % 28 + 1 AS {}), 2, '0')"


@query(
    "page_digit_runs",
    f"""WITH s AS (SELECT page_id, {RTL_DAY.format('VARCHAR')} AS day FROM pages),
    r AS (SELECT page_id, unnest(CASE page_id % 6
      WHEN 0 THEN [struct_pack(token := concat('2026-10-', day), occurrences := 2, sample := concat('رقم 2026-10-', day), shown := concat(day, '-10-2026')),
        struct_pack(token := concat(day, '-07-2026'), occurrences := 1, sample := concat('قيمة ', day, '-07-2026 ثم 2026'), shown := concat('2026-07-', day))]
      WHEN 1 THEN [struct_pack(token := concat('+9715012345', day), occurrences := 1, sample := concat('+9715012345', day), shown := NULL)]
      WHEN 4 THEN [struct_pack(token := concat('971 50 123 45', day), occurrences := 1, sample := concat('رقم 971 50 123 45', day), shown := NULL),
        struct_pack(token := concat('2026-10-', day), occurrences := 1, sample := concat('ر 2026-10-', day), shown := concat(day, '-10-2026'))]
      ELSE [] END) AS x FROM s)
    SELECT page_id, x.token AS token, x.occurrences AS occurrences, x.sample AS sample, x.shown AS shown FROM r""",
)
def page_digit_runs(spark, sf):
    """Numbers at risk in right-to-left blocks that are written into the pages."""
    pages = table(spark, sf, "pages").withColumn("day", F.expr(RTL_DAY.format("STRING")))
    return FD.page_digit_runs(pages.select("page_id", F.concat("html", F.expr(RTL_SEED)).alias("html")))


@query("page_verdict", LONG_SQL + VERDICT_SQL)
def page_verdict(spark, sf):
    return FD.page_verdict(seeded(spark, sf))


@query("verdict_from_findings", LONG_SQL + VERDICT_SQL)
def verdict_from_findings(spark, sf):
    raw = FD.page_findings(seeded(spark, sf)).select("page_id", "code", "n")
    return FD.verdict(FD.checked_findings(raw), "page_id", table(spark, sf, "pages"))


@query(
    "manifest_join",
    f"""{LONG_SQL}, m(code, severity) AS (VALUES {SEV_SQL}),
    r AS (SELECT page_id, code, n FROM f UNION ALL SELECT page_id, 'no-such-code', 1 FROM pages)
    SELECT severity, code, count(*) AS pages, sum(n)::BIGINT AS n FROM r JOIN m USING (code) GROUP BY ALL""",
)
def manifest_join(spark, sf):
    raw = FD.page_findings(seeded(spark, sf)).select("page_id", "code", "n")
    unknown = table(spark, sf, "pages").select("page_id", F.lit("no-such-code").alias("code"), F.lit(1).cast("bigint").alias("n"))
    return (
        FD.checked_findings(raw.unionByName(unknown))
        .groupBy("severity", "code")
        .agg(F.count("*").alias("pages"), F.sum("n").alias("n"))
    )


@query(
    "placeholders",
    r"""WITH s AS (SELECT doc_id, regexp_extract_all(concat(text, CASE WHEN n_chars % 2 = 0 THEN concat(' {{', source, '}} {{ x }} {{/', lang, '}}') ELSE '' END),
      '\{\{[#/]?[a-zA-Z0-9_]+\}\}') AS l FROM documents)
    SELECT doc_id, len(l) AS n, array_to_string(l[1:4], ', ') AS sample FROM s WHERE len(l) > 0""",
)
def placeholders(spark, sf):
    text = F.expr("concat(text, CASE WHEN n_chars % 2 = 0 THEN concat(' {{', source, '}} {{ x }} {{/', lang, '}}') ELSE '' END)")
    found = table(spark, sf, "documents").select("doc_id", FD.placeholders(text).alias("f"))
    return found.filter("f.n > 0").select("doc_id", "f.n", "f.sample")


@query(
    "json_as_document",
    r"""SELECT event_id, event_type IN ('click', 'view') AS json FROM events""",
)
def json_as_document(spark, sf):
    text = F.expr(
        "CASE event_type WHEN 'click' THEN props WHEN 'view' THEN concat('<pre>', props, '</pre>') WHEN 'error' THEN concat('<h1>x</h1>', props) "
        "WHEN 'signup' THEN concat('value ', props) ELSE concat('<pre></pre><pre></pre><pre></pre>', props) END"
    )
    found = table(spark, sf, "events").select("event_id", FD.json_as_document(H.mask_raw(text), H.tags(text)).alias("f"))
    return found.select("event_id", (F.col("f.n") > 0).alias("json"))


@query(
    "unsupported_css",
    """SELECT page_id, 'target-counter' AS name FROM pages WHERE page_id % 7 = 0 UNION ALL SELECT page_id, 'leader(' FROM pages WHERE page_id % 7 = 0
    UNION ALL SELECT page_id, 'string(' FROM pages WHERE page_id % 7 = 0""",
)
def unsupported_css(spark, sf):
    s = seeded(spark, sf)
    return s.select("page_id", F.explode(css.unsupported_names(css.clean_styles(F.col("html")))).alias("name"))


RTL_PAGE = (
    "concat(CASE WHEN page_id % 2 = 0 THEN '<html dir=\"rtl\">' ELSE '<html lang=\"ar\">' END, '<style>@page{@bottom-center{content:counter(page) \" / \" counter(pages)}"
    "@top-left{content:\"counter(page)\"}', CASE WHEN page_id % 3 = 0 THEN '@top-right{direction:ltr;content:counter(page)}' ELSE '@top-right{content: counter( page )}' END, '}</style>', html)"
)


@query(
    "rtl_page_counter",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 2 END AS n, CASE WHEN page_id % 3 = 0 THEN 'bottom-center' ELSE 'bottom-center, top-right' END AS boxes
    FROM pages WHERE page_id % 2 = 0""",
)
def rtl_page_counter(spark, sf):
    text = F.expr(RTL_PAGE)
    found = table(spark, sf, "pages").select("page_id", FD.rtl_page_counter(text, css.clean_styles(text)).alias("f"))
    return found.filter("f.n > 0").select("page_id", "f.n", F.col("f.sample").alias("boxes"))


@query(
    "rtl_digit_runs",
    r"""WITH d AS (SELECT doc_id, concat('تاريخ ', text, ' السعر 2026-10-03 ثم ', cast(doc_id AS VARCHAR), '-7 و ISO 2026-10-03 نهاية 2026-10-03') AS t FROM documents),
    g AS (SELECT doc_id, regexp_extract_all(t, P) AS r, string_split_regex(t, P) AS k FROM d),
    u AS (SELECT doc_id, i, r[i] AS token, array_to_string(list_resize(k, i, ''), ' ') AS before, array_to_string(r[1:i - 1], ' ') AS ignored FROM g, unnest(range(1, len(r) + 1)) AS u(i)),
    l AS (SELECT doc_id, token, regexp_extract(before, '(?s).*([A-Za-z\x{00C0}-\x{02AF}\x{0370}-\x{03FF}\x{0400}-\x{04FF}\x{1E00}-\x{1FFF}\x{0590}-\x{05FF}\x{0600}-\x{06FF}])', 1) AS letter FROM u)
    SELECT doc_id, token, count(*) AS occurrences, nullif(array_to_string(list_reverse(string_split_regex(token, '\s*[-–—_−×÷]\s*')), '-'), token) AS shown
    FROM l WHERE letter = '' OR letter >= chr(1424) GROUP BY ALL""".replace(
        "P)", r"'[0-9]+(?:\s*[-‐‑‒_−]\s*[0-9]+)+|\+[0-9]{2,}|[0-9][0-9\s]{5,}[0-9]|[0-9]+\s*[-−]\s*[0-9]*\s*(?:ريال|درهم|د\.إ)?')"
    ),
)
def rtl_digit_runs(spark, sf):
    text = F.concat(
        F.lit("تاريخ "), F.col("text"), F.lit(" السعر 2026-10-03 ثم "), F.col("doc_id").cast("string"),
        F.lit("-7 و ISO 2026-10-03 نهاية 2026-10-03"),
    )
    d = table(spark, sf, "documents").select("doc_id", text.alias("text"))
    return FD.rtl_digit_runs(d, "doc_id", "text").select("doc_id", "token", "occurrences", "shown")


# What the fonts of the test corpus cover, per language.
COVERAGE = [("de", 0xC0, 0xFF), ("fr", 0xE0, 0xEF), ("es", 0xE0, 0xF0), ("en", 0xA0, 0xA0)]


@query(
    "missing_glyphs",
    f"""WITH c AS (SELECT DISTINCT doc_id, lang AS font, unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS ch FROM documents),
    r(font, lo, hi) AS (VALUES {", ".join(str(x) for x in COVERAGE)}), g AS (SELECT font, ch, count(*) AS n_rows FROM c GROUP BY ALL)
    SELECT font, ch, printf('U+%04X', unicode(ch)) AS label, false AS invisible, n_rows FROM g
    WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.font = g.font AND unicode(ch) BETWEEN lo AND hi)""",
)
def missing_glyphs(spark, sf):
    cov = spark.createDataFrame(COVERAGE, "font string, lo int, hi int")
    return FD.missing_glyphs(table(spark, sf, "documents"), "lang", "text", cov)


@query(
    "figure_audit",
    """SELECT page_id, 1 AS uncaptioned FROM pages WHERE page_id % 4 = 0""",
)
def figure_audit(spark, sf):
    return uncaptioned_figures(spark, sf).groupBy("page_id").agg(F.count("*").alias("uncaptioned"))


def uncaptioned_figures(spark, sf):
    return E.figure_audit(E.elements(seeded(spark, sf)))


def _count(states, state):
    return F.size(F.filter(states, lambda x: x == state)).cast("bigint")


@query(
    "alt_audit",
    rf"""WITH {S_SQL} SELECT page_id, len([x for x in {IMG} if x NOT LIKE '% alt=%' AND x NOT LIKE '%presentation%']) AS missing,
    len([x for x in {IMG} if regexp_matches(x, ' alt="\s*"') AND x NOT LIKE '%presentation%']) AS empty,
    len([x for x in {IMG} if x LIKE '%presentation%']) AS decorative FROM s""",
)
def alt_audit(spark, sf):
    images = F.filter(H.tags(F.col("html")), lambda t: t.rlike(r"(?i)^<img\b"))
    s = seeded(spark, sf).select("page_id", F.transform(images, FD.alt_state).alias("states"))
    return s.select(
        "page_id",
        *[_count("states", k).alias(k) for k in ("missing", "empty", "decorative")],
    )


@query(
    "control_audit",
    """SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 1 ELSE 0 END AS selects, CASE WHEN page_id % 6 = 0 THEN 3 ELSE 0 END AS controls,
    CASE WHEN page_id % 6 = 0 THEN 1 ELSE 0 END AS fallbacks, CASE WHEN page_id % 6 = 0 THEN 1 ELSE 0 END AS named FROM pages""",
)
def control_audit(spark, sf):
    s = seeded(spark, sf).select("page_id", H.mask_raw(F.col("html")).alias("m"))
    return s.select("page_id", FD.control_counts(H.tags(F.col("m")), F.col("m")).alias("c")).select("page_id", "c.*")


@query(
    "lang_audit",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE regexp_extract(html, '<html lang="([^"]*)"', 1) END AS lang, page_id % 3 = 0 AS undeclared FROM pages""",
)
def lang_audit(spark, sf):
    text = F.expr("CASE WHEN page_id % 6 = 0 THEN regexp_replace(html, '<html [^>]*>', '<html>') WHEN page_id % 3 = 0 THEN regexp_replace(html, '<html [^>]*>', '<html lang=\" \">') ELSE html END")
    p = table(spark, sf, "pages").select("page_id", text.alias("html"))
    return p.select("page_id", H.html_lang(F.col("html")).alias("lang"), (FD.lang_audit(F.col("html"))["n"] > 0).alias("undeclared"))


BOXES = (
    "l_orderkey AS page_id, CASE l_returnflag WHEN 'A' THEN 'table' WHEN 'N' THEN 'img' ELSE 'pre' END AS tag, "
    "l_extendedprice / 50 AS width, l_linestatus = 'F' AS fixed, 700.0 AS printable, 900.0 AS page_width"
)
BOX_ORDER = "l_partkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax"


@query(
    "overflow_audit",
    f"""WITH b AS (SELECT {BOXES}, row_number() OVER (PARTITION BY l_orderkey ORDER BY {BOX_ORDER}) AS pos FROM lineitem),
    w AS (SELECT *, CASE WHEN fixed THEN printable ELSE page_width END AS lim FROM b),
    o AS (SELECT * FROM w WHERE width > lim AND abs(width - lim) >= 0.5),
    f AS (SELECT page_id, tag, min(pos) AS pos, arg_min(width, pos) AS width, max(width) AS widest FROM o GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS r FROM f)
    SELECT page_id, tag, pos, floor(width * 10 + 0.5) / 10 AS width_px, round(widest, 6) AS widest FROM k""",
)
def overflow_audit(spark, sf):
    placed = numbered(table(spark, sf, "lineitem"), ["l_orderkey"], BOX_ORDER.split(", "), "pos")
    boxes = placed.selectExpr(*[x.strip() for x in BOXES.split(", ")], "pos")
    return FD.overflow_audit(boxes).withColumn("widest", F.round("widest", 6))


@query(
    "image_ppi",
    """SELECT p_partkey, floor(p_retailprice / (p_size / 96.0) + 0.5) AS ppi, greatest(1, floor(p_size / 96.0 * 2400 + 0.5))::BIGINT AS target_px
    FROM part WHERE p_size > 0 AND p_retailprice / (p_size / 96.0) > 2400""",
)
def image_ppi(spark, sf):
    images = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("natural_px"), F.col("p_size").alias("rendered_px"))
    return FD.image_ppi(images, 2400).select("p_partkey", "ppi", "target_px")


@query(
    "precedence_findings",
    """WITH p AS (SELECT page_id, page_id % 5 AS k, page_id % 3 = 1 AS fmt, page_id % 2 = 0 AS land, page_id % 4 = 0 AS marg FROM pages),
    f AS (SELECT page_id, 'page-size-override' AS code FROM p WHERE fmt AND NOT (CASE k WHEN 0 THEN NOT land WHEN 1 THEN true WHEN 4 THEN true ELSE false END)
    UNION ALL SELECT page_id, 'orientation-overridden' FROM p WHERE land AND k IN (0, 3, 4) AND (fmt OR k IN (0, 4))
    UNION ALL SELECT page_id, 'orientation-ignored' FROM p WHERE land AND k = 3 AND NOT fmt
    UNION ALL SELECT page_id, 'margin-ignored' FROM p WHERE marg)
    SELECT * FROM f""",
)
def precedence_findings(spark, sf):
    requests = table(spark, sf, "pages").select("page_id", *[F.expr(v).alias(k) for k, v in REQUEST.items()])
    return FD.precedence_findings(ruled(spark, sf), requests)


HREF = (
    "CASE page_id % 6 WHEN 0 THEN concat('../up', cast(page_id AS STRING), '.css') WHEN 1 THEN concat('img/../a', cast(page_id AS STRING), '.png?x#y') "
    "WHEN 2 THEN 'input.html' WHEN 3 THEN concat('/srv/site/', cast(page_id AS STRING), '.js') WHEN 4 THEN concat('/etc/', cast(page_id AS STRING)) ELSE url END"
)


@query(
    "confine_refs",
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat('/srv/up', page_id, '.css') WHEN 1 THEN concat('/srv/site/a', page_id, '.png')
      WHEN 2 THEN '/srv/site/input.html' WHEN 3 THEN concat('/srv/site/', page_id, '.js') ELSE concat('/etc/', page_id) END AS path,
    CASE page_id % 6 WHEN 0 THEN 'outside-root' WHEN 2 THEN 'document' WHEN 4 THEN 'outside-root' ELSE 'ok' END AS why FROM pages WHERE page_id % 6 < 5""",
)
def confine_refs(spark, sf):
    refs = table(spark, sf, "pages").select("page_id", F.expr(HREF).alias("ref"))
    return FD.confine_refs(refs.unionByName(refs), "/srv/site").select("page_id", "path", "why")


@query(
    "blocked_requests",
    """WITH r AS (SELECT p.p_brand, p.p_partkey AS pos, concat('https://cdn.example/', p_name, p_partkey) AS ref FROM part p WHERE p_size > 10),
    k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY pos) AS r FROM r) SELECT p_brand, pos, ref FROM k""",
)
def blocked_requests(spark, sf):
    ref = F.expr("CASE WHEN p_size > 10 THEN concat('https://cdn.example/', p_name, p_partkey) ELSE concat('local/', p_name) END")
    refs = table(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("pos"), ref.alias("ref"))
    return FD.blocked_requests(refs, key="p_brand")


@query(
    "declared_length",
    """SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 AND l.doc_id IS NULL THEN 'missing-target'
      WHEN d.doc_id % 3 = 0 AND l.quality = 0 THEN 'not-a-number' WHEN d.n_chars <> octet_length(encode(d.text)) THEN 'mismatch' END AS problem
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def declared_length(spark, sf):
    d = table(spark, sf, "documents")
    lookup = (
        table(spark, sf, "labels")
        .join(d.select("doc_id", "n_chars"), "doc_id")
        .select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "n/a").otherwise(F.col("n_chars").cast("string")).alias("value"))
    )
    rows = d.select("doc_id", "n_chars", F.octet_length("text").alias("actual"), F.expr("CASE WHEN doc_id % 3 = 0 THEN doc_id END").alias("ref"))
    return FD.declared_length(rows, "doc_id", "n_chars", "actual", "ref", lookup).select("doc_id", "problem")


@query(
    "balance_check",
    r"""WITH b AS (SELECT page_id, len(regexp_extract_all(html, '<p>')) - len(regexp_extract_all(replace(html, '"</p>"', ''), '</p>')) AS p_off,
      len(regexp_extract_all(html, '<b>')) - len(regexp_extract_all(html, '</b>')) AS b_off FROM pages)
    SELECT page_id, p_off, b_off, CASE WHEN p_off <> 0 THEN 'p' WHEN b_off <> 0 THEN 'b' END AS first FROM b""",
)
def balance_check(spark, sf):
    masked = table(spark, sf, "pages").select("page_id", H.mask_raw(F.col("html")).alias("m"))
    m = F.col("m")
    return masked.select(
        "page_id",
        H.balance(m, "p").cast("bigint").alias("p_off"),
        H.balance(m, "b").cast("bigint").alias("b_off"),
        FD.balance_check(m)["sample"].alias("first"),
    )


@query(
    "marker_check",
    r"""SELECT page_id, CASE WHEN NOT regexp_matches(html, '(?i)^<!doctype html') THEN '(?i)^<!doctype html' WHEN NOT regexp_matches(html, '(?i)</html\s*>') THEN '(?i)</html\s*>'
      WHEN page_id % 3 = 0 THEN 'pointer' END AS problem FROM pages""",
)
def marker_check(spark, sf):
    # The last line points at the root element, or one character past it.
    text = F.expr("concat(html, 'startxref ', cast(instr(html, '<html') - CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END AS STRING))")
    problem = FD.marker_check(text, (r"(?i)^<!doctype html", r"(?i)</html\s*>"), r"startxref (\d+)", "<html")
    return table(spark, sf, "pages").select("page_id", problem.alias("problem"))


@query(
    "offset_index_check",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'offset' WHEN doc_id % 7 = 0 THEN 'count' END AS problem, count(*) AS n
    FROM documents, range(3) GROUP BY ALL""",
)
def offset_index_check(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("alpha beta gamma "), F.col("text")).alias("text"))
    entries = d.select(
        "doc_id",
        F.expr("inline(array(named_struct('pos', 0, 'offset', 0, 'expected', 'alpha'), named_struct('pos', 1, 'offset', 6, 'expected', 'beta'), named_struct('pos', 2, 'offset', 11, 'expected', 'gamma')))"),
    ).select(
        "doc_id", "pos", "expected",
        (F.col("offset") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("offset"),
        F.when(F.col("doc_id") % 7 == 0, 4).otherwise(3).alias("declared"),
    )
    return FD.offset_index_check(entries, d).groupBy("doc_id", "problem").agg(F.count("*").alias("n"))


@query("unreadable_rows", "SELECT event_id FROM events WHERE event_id % 2 = 0")
def unreadable_rows(spark, sf):
    cut = F.expr("CASE WHEN event_id % 2 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END")
    return FD.unreadable_rows(table(spark, sf, "events").select("event_id", cut.alias("props")), "props").select("event_id")


BODY = (
    "CASE event_id % 14 WHEN 0 THEN concat('{\"html\":\"', event_type, '\"}') WHEN 1 THEN concat('[', props, ']') WHEN 2 THEN substr(props, 1, 4) "
    "WHEN 3 THEN concat('{\"path\":\"x\",\"html\":\"', event_type, '\"}') WHEN 4 THEN props WHEN 5 THEN '{\"html\":\"  \"}' "
    "WHEN 6 THEN concat('{\"html\":\"a\",\"format\":', cast(user_id AS STRING), '}') WHEN 7 THEN concat('{\"html\":\"a\",\"format\":\"', event_type, '\"}') "
    "WHEN 8 THEN '{\"html\":\"a\",\"pageRanges\":\"3-1\"}' WHEN 9 THEN '{\"html\":\"a\",\"margin\":\"2em\"}' WHEN 10 THEN '{\"html\":\"a\",\"margin\":\"2cm\"}' "
    "WHEN 11 THEN '{\"html\":\"a\",\"landscape\":\"yes\"}' WHEN 12 THEN concat('{\"html\":\"a\",\"format\":\"A4\",\"margin\":\"1in\",\"timeoutMs\":', cast(value AS STRING), ',\"responseFormat\":\"xml\"}') "
    "ELSE concat('{\"html\":\"a\",\"settleMs\":\"', cast(value AS STRING), '\",\"author\":null}') END"
)


@query(
    "validate_requests",
    """SELECT event_id, CASE event_id % 14 WHEN 1 THEN 'not-object' WHEN 2 THEN 'invalid-json' WHEN 3 THEN 'path' WHEN 4 THEN 'html' WHEN 5 THEN 'empty'
    WHEN 6 THEN 'format-type' WHEN 7 THEN 'format' WHEN 8 THEN 'ranges' WHEN 9 THEN 'margin' WHEN 10 THEN 'margin-format' WHEN 11 THEN 'flag:landscape'
    WHEN 12 THEN 'response-format' WHEN 13 THEN 'number:settleMs' END AS problem FROM events""",
)
def validate_requests(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.expr(BODY).alias("body"))
    return FD.validate_requests(e, "body").select("event_id", "problem")


RANGE_SPEC = (
    "concat(CASE WHEN l_linenumber = 7 THEN '0' WHEN l_linenumber = 6 THEN 'a' ELSE cast(l_linenumber AS STRING) END, ', ', cast(cast(l_quantity AS INT) AS STRING), '-', "
    "cast(l_linenumber * 5 AS STRING))"
)


@query(
    "page_ranges_problem",
    """SELECT problem, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 7 THEN 'malformed: 0' WHEN l_linenumber = 6 THEN 'malformed: a'
      WHEN cast(l_quantity AS INT) > l_linenumber * 5 THEN concat('reversed: ', cast(l_quantity AS INT), '-', l_linenumber * 5) END AS problem FROM lineitem)
    GROUP BY ALL""",
)
def page_ranges_problem(spark, sf):
    return table(spark, sf, "lineitem").groupBy(V.page_ranges_problem(F.expr(RANGE_SPEC)).alias("problem")).agg(F.count("*").alias("n"))


@query(
    "clamp_values",
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 30 ELSE floor(least(greatest(value, 5), 100))::BIGINT END AS clamped FROM events""",
)
def clamp_values(spark, sf):
    raw = F.expr("CASE WHEN event_id % 20 = 0 THEN 'soon' WHEN event_id % 10 = 0 THEN 'NaN' ELSE cast(value AS STRING) END")
    return table(spark, sf, "events").select("event_id", V.clamp_col(raw, 5, 100, 30).alias("clamped"))


@query(
    "unresolved_metrics",
    """SELECT c_custkey, c_acctbal, coalesce(n_name, 'unknown') AS owner FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) n ON c_nationkey = n_nationkey
    WHERE c_acctbal < 0""",
)
def unresolved_metrics(spark, sf):
    owners = table(spark, sf, "nation").filter("n_regionkey <> 0")
    d = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return FD.unresolved_metrics(d, owners, "c_acctbal", None, "c_nationkey", "n_nationkey", "n_name").drop("c_nationkey")


@query(
    "capped_read",
    """SELECT doc_id, running, running <= 20000 AND n_chars <= 6000 AS accepted FROM (SELECT doc_id, n_chars,
      sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS running FROM documents)""",
)
def capped_read(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars", F.when(F.col("n_chars") > 6000, F.col("n_chars") * 10).alias("declared"))
    return FD.capped_read(d, ["source"], ["doc_id"], "n_chars", 20000, "declared").select("doc_id", "running", "accepted")


@query(
    "union_findings",
    f"""WITH {S_SQL}, {COUNTS_SQL} SELECT 0 AS set_rank, 'unfilled-placeholder' AS code, count(*) FILTER ("unfilled-placeholder" > 0) AS pages FROM c
    UNION ALL SELECT 1, 'figure-uncaptioned', count(*) FILTER (page_id % 4 = 0) FROM c UNION ALL SELECT 2, 'scripts-disabled', count(*) FROM c""",
)
def union_findings(spark, sf):
    s = seeded(spark, sf)
    first = s.select("page_id", FD.placeholders(F.col("html")).alias("f")).filter("f.n > 0").select("page_id", "f.code")
    figures = uncaptioned_figures(spark, sf).select("page_id", F.lit("figure-uncaptioned").alias("code")).distinct()
    flag = table(spark, sf, "pages").select("page_id", F.lit("scripts-disabled").alias("code"))
    return FD.union_findings(first, figures, flag).groupBy("set_rank", "code").agg(F.count("*").alias("pages"))


@query(
    "manifest_agreement",
    f"""{LONG_SQL}, m(code, severity) AS (VALUES {SEV_SQL}), e AS (SELECT DISTINCT code FROM f)
    SELECT code, 'not-emitted' AS problem FROM m WHERE code NOT IN (SELECT code FROM e)
    UNION ALL SELECT 'made-up', 'not-listed' UNION ALL SELECT 'missing-alt', 'wrong-severity' UNION ALL SELECT 'missing-alt', 'two-severities'""",
)
def manifest_agreement(spark, sf):
    raw = FD.page_findings(seeded(spark, sf)).select("code", FD.severity_of(F.col("code")).alias("severity"))
    odd = table(spark, sf, "pages").select(
        F.when(F.col("page_id") % 2 == 0, "made-up").otherwise("missing-alt").alias("code"), F.lit("error").alias("severity")
    )
    return manifest_diff(raw.unionByName(odd), manifest(spark))


@query(
    "manifest_codes_used",
    f"""{LONG_SQL}, m(code, severity) AS (VALUES {SEV_SQL}) SELECT m.code, m.severity, count(f.page_id) AS pages FROM m LEFT JOIN f USING (code)
    WHERE m.severity = 'error' GROUP BY ALL""",
)
def manifest_codes_used(spark, sf):
    used = FD.page_findings(seeded(spark, sf)).groupBy("code").agg(F.count("*").alias("pages"))
    codes = manifest(spark, "error").select("code", "severity")
    return codes.join(used, "code", "left").select("code", "severity", F.coalesce("pages", F.lit(0)).alias("pages"))


@query(
    "findings_result_json",
    f"""{LONG_SQL}, m(code, severity) AS (VALUES {SEV_SQL}), j AS (SELECT * FROM f JOIN m USING (code))
    SELECT page_id, concat('{{"ok":', CASE WHEN count(*) FILTER (severity = 'error') = 0 THEN 'true' ELSE 'false' END, ',"findings":[',
      string_agg(concat('{{"code":"', code, '","severity":"', severity, '","n":', n, '}}'), ',' ORDER BY code), ']}}') AS result,
    concat(count(*), ';', coalesce(string_agg(code, ',' ORDER BY code) FILTER (severity = 'error'), '')) AS header FROM j GROUP BY page_id""",
)
def findings_result_json(spark, sf):
    raw = FD.page_findings(seeded(spark, sf)).select("page_id", "code", "n")
    return result_json(FD.checked_findings(raw), "page_id")


@query(
    "sniff_pages",
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'PDF' WHEN 1 THEN 'GIF' WHEN 2 THEN 'zip' WHEN 3 THEN NULL ELSE 'null byte' END AS kind FROM pages""",
)
def sniff_pages(spark, sf):
    content = F.expr(
        "encode(CASE page_id % 5 WHEN 0 THEN concat(' %PDF-1.7', html) WHEN 1 THEN concat('GIF89a', html) WHEN 2 THEN concat('PK', chr(3), chr(4), html) "
        "WHEN 3 THEN html ELSE concat('%PDF-', decode(unhex('00'), 'UTF-8'), html) END, 'UTF-8')"
    )
    return table(spark, sf, "pages").select("page_id", H.sniff(content).alias("kind"))


@query("sniff_documents", "SELECT doc_id, NULL::VARCHAR AS kind FROM documents")
def sniff_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", H.sniff(F.encode("text", "UTF-8")).alias("kind"))

