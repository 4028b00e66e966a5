from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions import html as H
from folioscan.operators import graph as G
from folioscan.operators import joins as J
from folioscan.operators import ordered as O


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "html string").select(column(F.col("html")).alias("x")).first()["x"]


def test_quoted_brackets_do_not_end_a_tag(spark):
    text = """<img alt="a > b" src='x>y.png'><p title="x alt=y">t</p><b it's>u</b>"""
    assert one(spark, text, H.tags) == ["""<img alt="a > b" src='x>y.png'>""", '<p title="x alt=y">', "</p>", "<b it's>", "</b>"]
    assert one(spark, text, lambda c: H.attr(F.get(H.tags(c), F.lit(0)), "src")) == "x>y.png"
    assert one(spark, text, lambda c: H.attr(F.get(H.tags(c), F.lit(0)), "alt")) == "a > b"
    assert one(spark, text, lambda c: H.attr(F.get(H.tags(c), F.lit(1)), "alt")) is None


def test_attributes(spark):
    for text, want in (("<img alt>", ""), ("<img alt='' src=x>", ""), ("<img data-alt=z>", None), ("<img src=a alt=b/>", "b/"), ('<IMG ALT = "q">', "q"), ("<img>", None), ("<img alt=1 alt=2>", "1")):
        assert one(spark, text, lambda c: H.attr(c, "alt")) == want, text


def test_bodies_that_are_text(spark):
    assert one(spark, "<title><b></title><textarea><p></textarea><i>", H.tags) == ["<title>", "</title>", "<textarea>", "</textarea>", "<i>"]


def test_entities(spark):
    assert one(spark, "&#39;&rsquo;&eacute;&#160;&#x20AC;&amp;lt;&nope;&#0;& &nbsp;", H.decode_entities) == "'’é\xa0€&lt;&nope;&#0;& \xa0"


def test_a_long_chain_keeps_all_its_rows(spark):
    nodes = spark.range(1000).select(F.lit(1).alias("doc_id"), (999 - F.col("id")).alias("node"), F.when(F.col("id") < 999, 998 - F.col("id")).alias("next"))
    got = G.linked_order(nodes, "node", None, "next").orderBy("rank").collect()
    assert [r.node for r in got] == list(range(999, -1, -1))


def test_first_child_and_sibling_links(spark):
    rows = [(1, 10, 20, None), (1, 20, 30, 21), (1, 21, None, 22), (1, 22, None, 21), (1, 30, None, None), (2, 5, 5, None)]
    nodes = spark.createDataFrame(rows, "doc_id int, node int, kid int, next int")
    got = G.linked_order(nodes, "node", "kid", "next").where("doc_id = 1").orderBy("rank").collect()
    assert [r.node for r in got][:3] == [10, 20, 30]


def test_a_bounded_walk_says_so(spark):
    edges = spark.createDataFrame([(1, i, i + 1, 0) for i in range(9)], "doc_id int, src int, dst int, pos int")
    roots = spark.createDataFrame([(1, 0, 0)], "doc_id int, node int, pos int")
    got = {r.node: r.depth_capped for r in G.graph_walk(edges, roots, max_depth=4).collect()}
    assert got == {0: False, 1: False, 2: False, 3: False, 4: True}
    assert G.graph_walk(edges, roots).count() == 10


def test_codes_of_any_size(spark):
    codes = spark.createDataFrame([(70000,), (70011,), (5,), (10**12,)], "code long")
    ranges = spark.createDataFrame([(70000, 70010, 1, 1), (0, 10, 100, 2), (4, 6, 200, 3), (9, 3, 7, 4), (0, 2 * 10**12, 0, 0)], "lo long, hi long, base long, ord int")
    got = {r.code: r.value for r in J.range_lookup(codes, ranges, "code").collect()}
    assert got == {70000: 1, 70011: 70011, 5: 201, 10**12: 10**12}
    assert {r.code: r.value for r in J.range_lookup(codes, ranges, "code", max_span=65535, max_code=65535).collect()} == {70000: None, 70011: None, 5: 201, 10**12: None}


def test_cut_points_follow_the_rows(spark):
    x = F.when(F.col("id") == 7, 0.0).when(F.col("id") == 9, float("inf")).when(F.col("id") < 8000, 55.5).otherwise(F.col("id") + 1e9)
    rows = spark.range(20000).select(F.when(F.col("id") % 3 > 0, "k").alias("k"), x.alias("x"), ((F.col("id") * 7919) % 20000).alias("y"))
    sizes = [r["count"] for r in O.with_chunks(rows, ["k"], ["x", "y"]).groupBy(O.CHUNK).count().collect()]
    assert max(sizes) <= 2.5 * sum(sizes) / len(sizes)
    got = O.numbered(rows, ["k"], ["x", "y"]).toPandas().sort_values(["k", "x", "y"])
    for _, own in got.groupby("k", dropna=False):
        assert own.rn.tolist() == list(range(1, len(own) + 1))
