"""Recursive tree walks, carried values, findings in SQL text, and the path-first scan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioscan.operators import findings as FD
from folioscan.operators import graph as G
from folioscan.sources import readers as RD

EDGES, ROOTS = "doc long, src long, dst long, pos int, own string", "doc long, node long, pos int, own string"


def tree(seed, docs=3, size=25):
    """Random trees: (edges, roots) and the value of each node by hand."""
    draw = random.Random(seed)
    edges, roots, value = [], [], {}
    for d in range(docs):
        name = lambda: draw.choice([None, None, "x", "y"])
        own = name()
        roots.append((d, 0, 1, own))
        value[d, 0] = own
        for n in range(1, size):
            up, own = draw.randrange(n), name()
            edges.append((d, up, n, n, own))
            value[d, n] = own if own is not None else value[d, up]
    return edges, roots, value


@pytest.mark.parametrize("walk", [G.tree_walk, G.graph_walk])
def test_a_value_goes_down_the_walk(spark, walk):
    edges, roots, value = tree(1)
    got = walk(spark.createDataFrame(edges, EDGES), spark.createDataFrame(roots, ROOTS), doc="doc", carry="coalesce(edge.own, value)", start="own").collect()
    assert {(r.doc, r.node): r.value for r in got} == value


def test_recursion_equals_the_loop(spark):
    edges, roots, _ = tree(2)
    e, r = spark.createDataFrame(edges, EDGES), spark.createDataFrame(roots, ROOTS)
    columns = ["doc", "node", "path", "trail", "depth"]
    a, b = (sorted(map(str, w(e, r, doc="doc").select(*columns).collect())) for w in (G.tree_walk, G.graph_walk))
    assert a == b and len(a) == 75


def test_a_deep_chain_and_a_ring(spark):
    edges = [(1, i, i + 1, 0, None) for i in range(130)] + [(1, 130, 0, 0, None), (None, 1, 2, 0, None)]
    got = G.tree_walk(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(1, 0, 0, None), (None, 1, 0, None)], ROOTS), doc="doc", carry="value + 1", start="1").collect()
    assert max(r.depth for r in got) == 130 and len(got) == 133 and all(r.value == r.depth + 1 for r in got)
    assert G.tree_walk(spark.createDataFrame([], EDGES), spark.createDataFrame([], ROOTS), doc="doc").collect() == []


def test_the_least_path_carries(spark):
    # node 3 is reached by 1 -> 3 (place 9) and 1 -> 2 -> 3 (places 1, 1): a preorder walk meets it below 2
    edges = [(1, 1, 3, 9, "far"), (1, 1, 2, 1, "near"), (1, 2, 3, 1, "here"), (1, 3, 1, 1, "ring")]
    got = G.graph_walk(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(1, 1, 1, "top")], ROOTS), doc="doc", carry="concat(value, '/', edge.own)", start="own").collect()
    assert {r.node: r.value for r in got} == {1: "top", 2: "top/near", 3: "top/near/here"}


@pytest.mark.parametrize("as_tree", [True, False])
def test_inherited_context(spark, as_tree):
    edges, roots, value = tree(3)
    nodes = [(d, n, own) for d, _, n, _, own in edges] + [(d, n, own) for d, n, _, own in roots]
    got = G.inherit_context(spark.createDataFrame(edges, EDGES), spark.createDataFrame(roots, ROOTS), spark.createDataFrame(nodes, "doc long, node long, own string"), "own", "doc", tree=as_tree)
    assert {(r.doc, r.node): r.inherited for r in got.collect()} == value


def test_views_and_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionLevelLimit"), {t.name for t in spark.catalog.listTables()}
    G.tree_walk(spark.createDataFrame([(1, 0, 1, 0, None)], EDGES), spark.createDataFrame([(1, 0, 0, None)], ROOTS), doc="doc")
    assert before == (spark.conf.get("spark.sql.cteRecursionLevelLimit"), {t.name for t in spark.catalog.listTables()})


def test_findings_in_sql_text(spark):
    pages = spark.createDataFrame([(1, "<p>{{a}} {{b}}</p>"), (2, '<html lang="en"><p>ok</p>'), (3, None)], "page_id long, html string")
    FD.register_findings(pages, "checks_here", "findings_here")
    got = spark.sql("SELECT c.page_id, f.* FROM checks_here c, LATERAL findings_here(c.found) f WHERE f.code LIKE 'unfilled%'")
    assert [tuple(r) for r in got.collect()] == [(1, "unfilled-placeholder", "error", 2, "{{a}}, {{b}}")]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    counts = spark.sql("SELECT severity, count(*) AS n FROM checks_here, LATERAL findings_here(found) GROUP BY ALL").collect()
    rows = FD.page_findings(pages).groupBy(FD.severity_of(F.col("code")).alias("severity")).count().collect()
    assert {tuple(r) for r in counts} == {tuple(r) for r in rows}


def test_skipped_folders_are_not_listed(spark, tmp_path):
    for name in ("a.html", "x/b.html", "x/build/c.html", "node_modules/p/d.html", "1/2/3/4/e.html"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("<p>1</p>")
    folders = [f.split(str(tmp_path), 1)[1] for f in RD.corpus_folders(spark, str(tmp_path))]
    assert sorted(folders) == ["", "/1", "/1/2", "/1/2/3", "/x"]
    files = RD.corpus_scan(spark, str(tmp_path)).inputFiles()
    assert sorted(f.rsplit("/", 1)[1] for f in files) == ["a.html", "b.html"]
    assert RD.corpus_scan(spark, str(tmp_path / "1" / "2"), max_depth=2).collect() == []
