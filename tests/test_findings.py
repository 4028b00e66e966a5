"""Documents as strings, with the codes each must and must not raise."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from folioscan.functions import css
from folioscan.functions import html as H
from folioscan.functions import text as T
from folioscan.functions import values as V
from folioscan.operators import elements as E
from folioscan.operators import findings as FD
from folioscan.sources.manifest import MANIFEST, manifest

LANG = '<html lang="en">'


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("r")).first()["r"]


def codes(spark, html):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    return {r["code"]: r["n"] for r in FD.page_findings(df).collect()}


@pytest.mark.parametrize(
    ("html", "code", "n"),
    [
        (LANG + "<p>{{company}} owes {{total}}</p>", "unfilled-placeholder", 2),
        (LANG + "<p>{company} {{a b}}</p>", "unfilled-placeholder", None),
        ('{"a": 1}', "json-rendered", 1),
        (LANG + "<h1>x</h1>[1]", "json-rendered", None),
        (LANG + "<style>a::after{content: target-counter(attr(href), page)}</style>", "unsupported-paged-media", 1),
        (LANG + "<style>a{content: leader('.') leader('-')} b{content: string(x)} c{content: running(y)}</style>", "unsupported-paged-media", 3),
        (LANG + '<style>a{content: "a string( of text"} /* content: leader(x) */ .leader(x){}</style>', "unsupported-paged-media", None),
        ('<html lang="ar" dir="rtl"><style>@page{@top-right{content: counter(page)}}</style>', "rtl-page-counter", 1),
        ('<html lang="ar" dir="rtl"><style>@page{@top-right{direction: ltr; content: counter(page)}}</style>', "rtl-page-counter", None),
        (LANG + "<style>@page{@top-right{content: counter(page)}}</style>", "rtl-page-counter", None),
        (LANG + "<img src=a><img alt='' src=b><img role=none src=c><img alt='x'>", "missing-alt", 1),
        (LANG + "<img src=a><img alt='' src=b><img role=none src=c><img alt='x'>", "empty-alt", 1),
        (LANG + "<select></select>", "select-untagged", 1),
        (LANG + "<input type=hidden><input><button>x</button>", "form-fields-static", 2),
        (LANG + "<canvas>text</canvas>", "canvas-fallback-unnamed", 1),
        ("<p>x</p>", "lang-undeclared", 1),
        (LANG + "<p>x</p>", "lang-undeclared", None),
        (LANG + '<meta name="author" content="A">', "metadata-authored", 1),
        (LANG + "<p>x", "output-unverified", 1),
        (LANG + '<script>"<p><img>"</script><!-- <select> -->', "missing-alt", None),
        (LANG + '<script>"<p><img>"</script><!-- <select> -->', "select-untagged", None),
    ],
)
def test_page_codes(spark, html, code, n):
    assert codes(spark, html).get(code) == n


@pytest.mark.parametrize(
    ("text", "direction", "expected"),
    [
        ("تاريخ 2026-10-03 نهاية", None, {"2026-10-03": (1, "03-10-2026")}),
        ("هاتف 971 50 123 4567 نهاية", None, {"971 50 123 4567": (1, None)}),
        ("نص ISO 8601: 2026-10-03 نهاية", None, {}),
        ("plain 2026-10-03", None, {}),
        ("تاريخ 2026-10-03 ثم 2026-10-03 نهاية", None, {"2026-10-03": (2, "03-10-2026")}),
        ("2026-10-03 only", "rtl", {"2026-10-03": (1, "03-10-2026")}),
        ("تاريخ 2026-10-03", "ltr", {}),
    ],
)
def test_rtl_digit_runs(spark, text, direction, expected):
    df = spark.createDataFrame([(1, text, direction)], "id long, text string, dir string")
    got = {r["token"].strip(): (r["occurrences"], r["shown"]) for r in FD.rtl_digit_runs(df, "id", "text", "dir").collect()}
    assert got == expected


def test_rtl_sample_shows_the_place(spark):
    df = spark.createDataFrame([(1, "ابجدهوزحطي تاريخ 2026-10-03 نهاية الكلام")], "id long, text string")
    sample = FD.rtl_digit_runs(df, "id", "text").first()["sample"]
    assert "2026-10-03" in sample and sample.endswith("نهاية ا")


def test_missing_glyphs(spark):
    rows = [("a", " x "), ("a", "᠎⁦︂︟"), ("b", "é")]
    cov = spark.createDataFrame([("a", 0xA0, 0xFF), ("b", 0xE9, 0xE9), ("b", 9, 3)], "font string, lo int, hi int")
    got = {(r["font"], r["label"], r["invisible"]) for r in FD.missing_glyphs(spark.createDataFrame(rows, "font string, text string"), "font", "text", cov).collect()}
    assert got == {("a", "U+E000", False), ("a", "U+180E", True), ("a", "U+2066", True), ("a", "U+FE02", True), ("a", "U+FE1F", False)}


@pytest.mark.parametrize(
    ("size", "margin", "fmt", "landscape", "asked", "expected"),
    [
        ("a4", None, None, True, None, ["orientation-overridden"]),
        ("auto", None, None, True, None, ["orientation-ignored"]),
        ("297mm 210mm", None, None, True, None, []),
        ("a4", "2cm", None, False, "1in", ["margin-ignored"]),
        ("a4", None, "a4", False, None, []),
        ("210mm 297mm", None, "a4", False, None, []),
        ("letter", None, "a4", False, None, ["page-size-override"]),
        (None, None, "a4", True, "1in", []),
    ],
)
def test_precedence(spark, size, margin, fmt, landscape, asked, expected):
    df = spark.createDataFrame([(size, margin, fmt, landscape, asked)], "s string, m string, f string, l boolean, a string")
    got = df.select(FD.precedence_codes(*[F.col(c) for c in "smfla"]).alias("r")).first()["r"]
    assert got == expected


@pytest.mark.parametrize(
    ("length", "inches", "error"),
    [("15mm", 15 / 25.4, None), ("1in", 1.0, None), ("0", 0.0, None), ("12", None, "unit-missing"), ("2em", None, "relative"),
     ("3 PT", 3 / 72, None), ("x", None, "no-length"), ("1.2.3mm", None, "no-number"), ("4foo", None, "unknown-unit")],
)
def test_lengths(spark, length, inches, error):
    r = one(spark, css.to_inches(F.col("c")), c=length)
    assert r["error"] == error and (r["inches"] == pytest.approx(inches) if inches is not None else r["inches"] is None)


@pytest.mark.parametrize(
    ("spec", "problem"),
    [("2-3", None), ("1,4-6", None), ("5", None), ("0", 'malformed: 0'), ("3-1", 'reversed: 3-1'),
     ("a, 0", 'malformed: a, 0')],
)
def test_page_ranges(spark, spec, problem):
    assert one(spark, V.page_ranges_problem(F.col("c")), c=spec) == problem


def test_page_rules_skip_comments_and_strings(spark):
    html = "<!-- <style>@page{size:a3}</style> --><style>/* @page{size:a5} */ q{content:\"@page{size:b5}\"} @page :first{@top-left{content:'x'} size: A4  landscape; margin : 1cm}</style>"
    rules = css.page_rules(F.col("c"))
    assert one(spark, css.declared_prop(rules, "size"), c=html) == "a4 landscape"
    assert one(spark, css.declared_prop(rules, "margin"), c=html) == "1cm"
    assert one(spark, css.declared_prop(rules, "size"), c="<style>@page{font-size:9pt}</style>") == "9pt"


def test_strip_and_transpose_leave_other_rules_alone(spark):
    html = "<p>size:1</p><style>a{size:x}@page{ size: a4; margin:0 }b{}</style><style>/* @page */</style>"
    assert one(spark, css.strip_page_size(F.col("c")), c=html) == "<p>size:1</p><style>a{size:x}@page{margin:0 }b{}</style><style>/* @page */</style>"
    assert one(spark, css.transpose_size(F.col("c")), c=html) == "<p>size:1</p><style>a{size:x}@page{ size: a4 landscape; margin:0 }b{}</style><style>/* @page */</style>"
    assert one(spark, css.transpose_size(F.col("c")), c="<style>@page{size:auto}</style>") is None


def test_inject_before_the_real_body_end(spark):
    html = "<body><script>'</body>'</script><!-- </body> --><p>x</p></BODY></html>"
    got = one(spark, H.inject_page_rule(F.col("c"), F.lit("size:a4")), c=html)
    assert got.endswith("<p>x</p><style>@page{size:a4}</style></BODY></html>")
    assert one(spark, H.inject_page_rule(F.col("c"), F.lit("m:$1")), c="x</html>") == "x<style>@page{m:$1}</style></html>"
    assert one(spark, H.inject_page_rule(F.col("c"), F.lit("m")), c="x") == "x<style>@page{m}</style>"


def test_unclosed_comments_drop_the_rest(spark):
    assert one(spark, css.strip_html_comments(F.col("c")), c="a<!-- b --> c<!-- d") == "a  c"
    assert one(spark, css.strip_html_comments(F.col("c")), c="a<!-->b") == "a"
    assert one(spark, css.strip_css_comments(F.col("c")), c="a/* b */c") == "a c"


@pytest.mark.parametrize(
    "text",
    ["/*" * 40000, "<!--" * 40000, "<style" * 20000, '"' + "\\x" * 40000 + '"', "<style>@page{" + "a:b;" * 20000 + "}</style>", "<style>@page{" + "{a}" * 20000 + "}</style>",
     "<" * 40000, "<body><script" * 10000],
)
def test_long_input_is_linear(spark, text):
    df = spark.createDataFrame([(1, text)], "page_id long, html string")
    c = F.col("html")
    start = time.time()
    df.select(css.strip_css_comments(c), css.strip_html_comments(c), css.mask_css_strings(c), css.page_rules(c), H.inject_page_rule(c, F.lit("x"))).collect()
    FD.page_findings(df).collect()
    assert time.time() - start < 30


def test_elements_without_end(spark):
    html = "<nav>a<section>b<p>c</nav><footer>d</section>e"
    got = [(r["idx"], r["tag"], r["text"], r["owner"]) for r in E.landmark_census(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("idx").collect()]
    # The closing section tag lies in the footer, so it closes the section that was opened in the nav.
    assert [g[0] for g in got] == [0, 1, 2]
    assert [g[1] for g in got] == ["nav", "section", "footer"]
    assert got[0][2] == "abc" and got[1][3] == 0


def test_nested_landmarks(spark):
    html = "<main>x<section> y <header>h</header></section><section>z</section></main><footer>&amp;f</footer>"
    got = [(r["tag"], r["text"], r["owner"]) for r in E.landmark_census(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("idx").collect()]
    assert got == [("main", "xyhz", -1), ("section", "yh", 0), ("header", "h", 1), ("section", "z", 0), ("footer", "&f", -1)]


def test_unclosed_landmark_ends_with_its_parent(spark):
    html = "<main><section>a<header>b</main><footer>c</footer>"
    got = [(r["tag"], r["text"], r["owner"]) for r in E.landmark_census(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("idx").collect()]
    assert got == [("main", "ab", -1), ("section", "ab", 0), ("header", "b", 1), ("footer", "c", -1)]


def test_figures(spark):
    html = "<figure><img alt='x'></figure><figure id=1><img alt=''></figure><figure><figure><figcaption>c</figcaption></figure><figure></figure></figure><figure><img>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert E.figure_audit(E.elements(df)).count() == 3


def test_asset_refs(spark):
    html = "<link href='a.css'><script src=b.js></script><img srcset=\"c.png 1x, d.png 2x\"><a href=e.html>x</a><style>@import 'f.css'; p{background:url(g.png)}</style><script>import h from './h.js'; import('i.js')</script><img src='#z'><img src='data:x'>"
    got = one(spark, F.transform(H.asset_refs(F.col("c")), H.local_ref), c=html)
    assert {g for g in got if g} == {"a.css", "b.js", "c.png", "d.png", "f.css", "g.png", "./h.js", "i.js"}


def test_scalars(spark):
    assert one(spark, T.iso_from_pdf_date(F.col("c")), c="D:20240102") == "2024-01-02T00:00:00"
    assert one(spark, T.iso_from_pdf_date(F.col("c")), c="2024") is None
    assert one(spark, T.expand_ligatures(F.col("c")), c="ﬁshﬅ Ａ") == "fishst Ａ"
    assert one(spark, T.code_point_label(F.col("c")), c="😀") == "U+1F600"
    assert one(spark, V.clamped_path(F.col("c")), c="../../a/./b/../c") == "a/c"
    assert one(spark, V.loopback_host(F.col("c")), c="localhost:65536") is False
    assert one(spark, V.default_name(F.col("c")), c="https://x.example/a/b.html?q=1") == "b.pdf"
    assert one(spark, V.default_name(F.col("c")), c="https://x.example") == "index.pdf"
    assert one(spark, V.default_name(F.col("c")), c="dir/page.htm") == "page.pdf"
    assert one(spark, H.sniff(F.col("c").cast("binary")), c="GIF89a...") == "GIF"
    assert one(spark, H.sniff(F.encode(F.col("c"), "ISO-8859-1")), c="\x89PNG\r\n") == "PNG"


def test_manifest(spark):
    assert len(MANIFEST) == 53 and manifest(spark, "error").count() == sum(s == "error" for s, _ in MANIFEST.values())
    with pytest.raises(ValueError):
        manifest(spark, "fatal")


def test_request_checks(spark):
    bodies = {
        "nope": "invalid-json", "[1]": "not-object", "null": "not-object", '{"path": "x"}': "path", "{}": "html", '{"html": " "}': "empty",
        '{"html": "a", "format": ["a4"]}': "format-type", '{"html": "a", "format": "A4", "margin": "15mm"}': None, '{"html": "a", "margin": "15mm"}': "margin-format",
        '{"html": "a", "pageRanges": "0"}': "ranges", '{"html": "a", "landscape": 1}': "flag:landscape", '{"html": "a", "timeoutMs": null}': None,
        '{"html": "a", "timeoutMs": "9"}': "number:timeoutMs", '{"html": "a", "responseFormat": "pdf"}': None, '{"html": "a", "author": 5}': "meta:author",
    }
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert {r["body"]: r["problem"] for r in FD.validate_requests(df, "body").collect()} == bodies


def test_balance_check_reads_its_helper(spark, tmp_path):
    from folioscan.plans import findings as plans

    rows = [(1, "<p>a</p><b>x"), (2, "<p>a<b>x</b>"), (3, "<p></p>"), (4, '<!-- <p> --><p title="</p>">a</p>')]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.p_off, r.b_off, r.first) for r in plans.balance_check(spark, str(tmp_path)).collect()}
    assert {k: got[k] for k in (1, 2, 3)} == {1: (0, 1, "b"), 2: (1, 0, "p"), 3: (0, 0, None)} and got[4][1] == 0
