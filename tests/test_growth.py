"""Work that follows what is reached, read or dealt out, not the square of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions import html as H
from folioscan.operators import graph as G
from folioscan.operators import joins as J
from folioscan.operators.gates import manifest_diff
from folioscan.sources import readers as RD


def test_only_reached_files_are_parsed(spark, monkeypatch):
    parse = H.asset_refs
    monkeypatch.setattr(H, "asset_refs", lambda c: F.when(c == "boom", F.raise_error(F.lit("parsed")).cast("array<string>")).otherwise(parse(c)))
    files = [("/a.css", '@import "b.css";'), ("/b.css", '@import "a.css"; @import "c.css";'), ("/c.css", '@import "gone.css";'), ("/far.css", "boom")]
    refs = spark.createDataFrame([(1, "/a.css"), (2, "/b.css"), (2, "/c.css")], "page_id long, path string")
    got = G.asset_closure(refs, spark.createDataFrame(files, "path string, content string")).collect()
    assert {(r.page_id, r.path): r.depth for r in got} == {
        (1, "/a.css"): 0, (1, "/b.css"): 1, (1, "/c.css"): 2, (1, "/gone.css"): 3,
        (2, "/a.css"): 1, (2, "/b.css"): 0, (2, "/c.css"): 0, (2, "/gone.css"): 1,
    }


def test_manifest_diff_reads_its_findings_once(spark):
    found = spark.createDataFrame([("a", "error"), ("a", "warn"), ("b", "warn"), ("x", None), (None, "info")], "code string, severity string")
    listed = spark.createDataFrame([("a", "error"), ("b", "warn"), ("c", "info")], "code string, severity string")
    out = manifest_diff(found.withColumn("code", F.expr("concat(code, '')")), listed)
    assert sorted((r.code or "", r.problem) for r in out.collect()) == [
        ("", "not-listed"), ("a", "two-severities"), ("a", "wrong-severity"), ("c", "not-emitted"), ("x", "not-listed"),
    ]
    assert out._jdf.queryExecution().analyzed().toString().count("concat(") == 1


def test_sequences_of_a_null_key_meet(spark):
    a = spark.createDataFrame([(None, 1, 5.0), (None, 2, 6.0), (1, 1, 1.0), (2, 1, 1.0), (2, 2, 2.0)], "k long, p long, v double")
    b = spark.createDataFrame([(None, 1, 5.0), (None, 2, 6.0), (1, 1, 1.5), (2, 1, 1.0)], "k long, p long, v double")
    got = {r.k: (r.same, r.n) for r in J.same_sequence(a, b, "k", ["p"], ["p"], ["v"]).collect()}
    assert got == {None: (True, 2), 1: (False, 1), 2: (False, 2)}


def test_references_of_parts_are_counted_where_the_parts_were_dealt(spark):
    from folioscan.plans.pages import asset_refs

    plan = asset_refs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(p_partkey") == 1 and plan.index("HashAggregate") < plan.index("Exchange hashpartitioning(p_partkey")


def test_documents_are_dealt_out_before_their_words_become_rows(spark, monkeypatch):
    from folioscan.plans import ordered

    monkeypatch.setattr(ordered, "PART_BYTES", 1 << 14)
    for name in ("text_flow", "wide_gaps", "gaps_probe"):
        plan = getattr(ordered, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hash") == 1 and plan.index("Exchange hash") > plan.rindex("Generate"), name
    assert ordered.dealt(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 8


def test_lines_are_dealt_out_by_their_number_before_references_are_counted(spark, monkeypatch):
    from folioscan.plans import joins

    monkeypatch.setattr(joins, "PART_ROWS", 100)
    out = joins.dangling_refs(spark, "/root/testdata/sf0.001")
    assert out._jdf.queryExecution().executedPlan().toString().count("lineitem") == 1
    assert out.rdd.getNumPartitions() > 50


def test_a_catalogue_holds_by_a_condition(spark):
    edges = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (2, 8), (2, None), (None, 7), (3, 9)], "doc long, ref long")
    nodes = spark.createDataFrame([(7, 1), (7, 0), (8, None), (9, 0)], "node long, least long")
    skip = spark.createDataFrame([(3,)], "doc long")
    out = J.dangling_refs(edges, nodes, "ref", "node", "doc", skip, F.col("doc") <= F.col("least"))
    assert {(r.doc, r.ref): r.refs for r in out.collect()} == {(2, 7): 1, (2, 8): 1, (2, None): 1, (None, 7): 1}


def test_files_beside_folders_do_not_come_to_the_driver(spark, tmp_path, monkeypatch):
    from py4j.java_gateway import GatewayClient

    send, calls = GatewayClient.send_command, []
    monkeypatch.setattr(GatewayClient, "send_command", lambda self, *a, **k: calls.append(1) or send(self, *a, **k))

    def asked(root, files):
        for place in ("", "x", "x/a[1]{b}*", "dist/y", "z.html"):
            (root / place).mkdir(parents=True, exist_ok=True)
            for i in range(files):
                (root / place / f"{i}.html").write_text("<p>")
        calls.clear()
        return sorted(f.split(str(root), 1)[1] for f in RD.corpus_folders(spark, str(root))), len(calls)

    folders, few = asked(tmp_path / "few", 1)
    again, many = asked(tmp_path / "many", 200)
    assert folders == again == ["", "/x", "/x/a[1]{b}*", "/z.html"]
    assert many < few + 100


def test_many_small_files_are_few_tasks(spark, tmp_path):
    for i in range(2100):
        (tmp_path / f"{i}.html").write_text("<p>")
    found = RD.corpus_scan(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism and found.count() == 2100
