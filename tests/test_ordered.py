"""Chunked scans against plain windows and sequential walks, with one key that holds a third of the rows."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.operators import graph as G
from folioscan.operators import joins as J
from folioscan.operators import ordered as O
from folioscan.operators import rewrites as R
from folioscan.operators import windows as WN


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(7)
    rows = []
    for i in range(6000):
        key = 0 if rng.random() < 0.34 else rng.randrange(1, 400)
        rows.append((key, rng.randrange(0, 3000), i, rng.randrange(1, 9), rng.choice("aab")))
    return spark.createDataFrame(rows, "k long, t long, id long, v long, c string")


def same(a, b):
    assert a.count() == b.count()
    assert a.exceptAll(b.select(*a.columns)).isEmpty()


@pytest.mark.parametrize("chunks", [1, 3, 64])
def test_scan_equals_windows(hot, chunks):
    odd = F.when(F.col("v") % 2 == 1, F.col("v"))
    got = O.ordered_scan(hot, ["k"], ["t", "id"], sums={"s": F.col("v")}, lasts={"p": odd}, nexts={"q": odd}, chunks=chunks)
    w = W.partitionBy("k").orderBy("t", "id")
    back = W.partitionBy("k").orderBy(F.col("t").desc(), F.col("id").desc())
    want = hot.select(
        "*",
        F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"),
        F.last(odd, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("p"),
        F.last(odd, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1)).alias("q"),
    )
    same(got, want)


def test_null_key_is_a_group(spark):
    df = spark.createDataFrame([(None, 1), ("a", 1), (None, 3), (None, 2)], "k string, pos int")
    got = {(r["k"], r["pos"]): r["rn"] for r in O.numbered(df, ["k"], ["pos"]).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, (None, 3): 3, ("a", 1): 1}


@pytest.mark.parametrize("chunks", [1, 5, 64])
def test_islands(hot, chunks):
    w = W.partitionBy("k").orderBy("t", "id")
    runs = hot.withColumn("g", F.row_number().over(w) - F.row_number().over(W.partitionBy("k", "c").orderBy("t", "id")))
    want = runs.groupBy("k", "c", "g").agg(F.min(F.struct("t", "id")).alias("first"), F.max(F.struct("t", "id")).alias("last"), F.count("*").alias("n")).drop("g")
    same(O.islands(hot, ["k"], ["t", "id"], "c", chunks), want)


@pytest.mark.parametrize("chunks", [1, 5, 64])
def test_restarting_sum(hot, chunks):
    w = W.partitionBy("k").orderBy("t", "id")
    g = hot.withColumn("g", F.sum((F.col("v") == 1).cast("int")).over(w))
    part = W.partitionBy("k", "g").orderBy("t", "id").rowsBetween(W.unboundedPreceding, -1)
    want = g.withColumn("x", F.coalesce(F.sum("v").over(part), F.lit(0))).drop("g")
    same(O.restarting_sum(hot, ["k"], ["t", "id"], F.col("v"), F.col("v") == 1, "x", chunks), want)


@pytest.mark.parametrize("chunks", [1, 7, 64])
def test_sessions(spark, hot, chunks):
    df = hot.select("k", F.timestamp_micros(F.col("t") * 100).alias("ts"), F.col("id").cast("string").alias("id"))
    got = O.sessions(df, ["k"], "ts", 1000, "id", chunks)
    us = F.unix_micros("ts")
    w = W.partitionBy("k").orderBy("ts", "id")
    s = df.withColumn("u", us).withColumn("new", F.coalesce(F.col("u") - F.lag("u").over(w) >= 1000, F.lit(True)).cast("int"))
    s = s.withColumn("sid", F.sum("new").over(w))
    want = s.groupBy("k", "sid").agg(F.min("u").alias("first"), F.max("u").alias("last"), F.count("*").alias("n"), F.max_by("id", F.struct("u", "id")).alias("id")).drop("sid")
    same(got, want)


def walk_gaps(items):
    """One item after another, as a reader would."""
    out, prev, two = [], None, [" ", " "]
    for x, y, width, size, ch, blank, unknown in items:
        if unknown:
            out.append("unknown")
            prev, two = None, [" ", " "]
            continue
        if blank:
            out.append("blank")
            two = [two[1], " "]
            continue
        if prev is None:
            out.append("first")
        else:
            px, py, pw, ps = prev
            gap = x - (px + pw)
            if abs(y - py) > 0.25 * ps:
                out.append("line")
                prev, two = None, [" ", " "]
                continue
            if gap < -0.2 * ps:
                out.append("back")
                two = [" ", " "]
            else:
                em = gap / ps
                if em <= 0.03:
                    two = [" ", " "]
                if em <= 0.102:
                    if two[0] != " " and two[1] == " ":
                        out.append("thin")
                        two = [" ", " "]
                    else:
                        out.append("tight")
                else:
                    out.append("flow" if em <= 0.6 else "wide" if em <= 3 else "jump")
        two = [two[1], ch or " "]
        prev = (x, y, width, size)
    return out


def test_classify_gaps_equals_the_walk(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for stream in range(800):
        x, items = 0.0, []
        for pos in range(rng.randrange(1, 25)):
            x += rng.choice([10, 10, 10.5, 10.8, 11, 14, 30, 60, -5])
            item = (x, rng.choice([0.0, 0.0, 0.0, 9.0]), 10.0, 10.0, rng.choice(["a", "b", ""]), rng.random() < 0.25, rng.random() < 0.06)
            items.append(item)
            rows.append((1, stream, pos, *item))
        want[stream] = walk_gaps(items)
    df = spark.createDataFrame(rows, "doc long, stream long, pos long, x double, y double, width double, size double, ch string, blank boolean, unknown boolean")
    got = {}
    for r in WN.classify_gaps(df, ["doc", "stream"], ["pos"]).orderBy("stream", "pos").collect():
        got.setdefault(r["stream"], []).append(r["gap_class"])
    assert got == want


def preorder_walk(edges, roots):
    seen, out = set(), []

    def go(n):
        if n in seen:
            return
        seen.add(n)
        out.append(n)
        for _, child in sorted((p, d) for s, d, p in edges if s == n):
            go(child)

    for r in roots:
        go(r)
    return out


def test_graph_walk_equals_preorder(spark):
    rng = random.Random(5)
    edges, want = [], {}
    for doc in range(60):
        mine = []
        for pos in range(rng.randrange(1, 14)):
            mine.append((rng.randrange(7), rng.randrange(7), pos))
        edges += [(doc, *e) for e in mine]
        want[doc] = preorder_walk(mine, [0])
    e = spark.createDataFrame(edges, "doc_id long, src long, dst long, pos int")
    roots = spark.createDataFrame([(d, 0, 0) for d in want], "doc_id long, node long, pos int")
    got = {}
    for r in G.graph_walk(e, roots).orderBy("doc_id", "path").collect():
        got.setdefault(r["doc_id"], []).append(r["node"])
    assert got == want


def test_match_by_text_takes_the_outermost(spark):
    left = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "d"), (4, "xy"), (5, " ")], "id long, text string")
    right = spark.createDataFrame([(10, "ab"), (11, "a b "), (12, "c"), (13, "c"), (14, "yx")], "num long, text string")
    anc = spark.createDataFrame([(10, 11)], "ancestor long, descendant long")
    got = {r["first_left"]: (r["outcome"], r["how"], r["first_right"]) for r in J.match_by_text(left, right, "id", "num", "text", "text", anc).collect()}
    assert got[1] == ("matched", "exact", 10) and got[2][0] == "ambiguous" and got[3] == ("none", None, None) and got[4] == ("matched", "mirror", 14)
    assert set(got) == {1, 2, 3, 4}


def test_hot_text_group_is_counted_not_paired(spark):
    df = spark.range(20000).select("id", F.when(F.col("id") % 3 == 0, "same text").otherwise(F.col("id").cast("string")).alias("text"))
    m = J.match_by_text(df, df, "id", "id", "text", "text")
    row = m.filter("n_left > 1").collect()
    assert len(row) == 1 and row[0]["n_left"] == row[0]["n_right"] == 6667


def test_diffused_round_keeps_the_total(spark, hot):
    out = WN.diffused_round(hot, ["k"], ["t", "id"], F.col("v") / 7, 2)
    worst = out.groupBy("k").agg(F.sum("rounded").cast("double").alias("a"), (F.sum("v") / 7).alias("b")).select(F.max(F.abs(F.col("a") - F.col("b"))).alias("d"))
    assert worst.first()["d"] <= 0.00501


def test_range_expansion_caps(spark):
    rows = [(1, 1, 10, 0), (5, 4, 0, 1), (0, 2_000_000_000, 0, 2), (65530, 65600, 1, 3), (1, 3, 100, 4)]
    df = spark.createDataFrame(rows, "lo long, hi long, base long, ord long")
    got = {r["code"]: r["value"] for r in R.expand_ranges(df, [], max_span=65535, max_code=65535).collect()}
    assert got[1] == 100 and got[3] == 102 and max(got) == 65535 and len(got) == 9


def test_first_difference(spark):
    pairs = [("abc", "abc", True, None), ("abc", "abx", False, 2), ("abc", "ab", False, -1), ("", "x", False, -1), ("x", "y", False, 0)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    got = [r["d"] for r in df.select(R.first_difference(F.col("a"), F.col("b")).alias("d")).collect()]
    assert [(g["same"], g["at"]) for g in got] == [(p[2], p[3]) for p in pairs]


def test_upper_median_is_the_upper_one(spark):
    from folioscan.operators.aggregates import upper_median

    df = spark.createDataFrame([("a", float(v)) for v in (4, 1, 3, 2)] + [("b", 5.0), ("b", 5.0), ("b", 9.0)], "k string, v double")
    assert {r["k"]: r["p50"] for r in upper_median(df, ["k"], "v").collect()} == {"a": 3.0, "b": 5.0}


RANGES = "lo long, hi long, base long, ord long"


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_equal_the_plain_loop(spark, seed):
    draw = random.Random(seed)
    ranges = [(lo, lo + draw.choice([-1, 0, 1, 6, 7, 8, 63, 64, 700]), draw.randint(0, 99), i) for i, lo in enumerate(draw.choices(range(-80, 900), k=120))]
    want = {}
    for lo, hi, base, _ in ranges:
        want.update({c: base + c - lo for c in range(lo, hi + 1)})
    df = spark.createDataFrame(ranges, RANGES)
    assert {r["code"]: r["value"] for r in R.expand_ranges(df, []).collect()} == {c: v for c, v in want.items() if c >= 0}
    codes = spark.createDataFrame([(c,) for c in range(-100, 1700)], "code long")
    assert {r["code"]: r["value"] for r in J.range_lookup(codes, df, "code").collect()} == {c: want.get(c) for c in range(-100, 1700)}


def test_widest_ranges(spark):
    top = 2**63 - 1
    df = spark.createDataFrame([(-(2**63), top, 0, 1), (top - 2, top, 5, 2), (0, top, 7, 0)], RANGES)
    codes = spark.createDataFrame([(top,), (-(2**63),)], "code long")
    small = df.filter("ord <> 1")
    assert {r["code"]: r["value"] for r in J.range_lookup(codes, df.withColumn("base", F.col("lo")), "code").collect()} == {top: top, -(2**63): -(2**63)}
    assert {r["code"]: r["value"] for r in J.range_lookup(codes, small, "code").collect()} == {top: 7, -(2**63): None}


def test_ranges_over_each_other_are_not_paired(spark):
    """40,000 ranges of 40,000 codes each are 1.6 billion pairs."""
    df = spark.range(40_000).selectExpr("id AS lo", "id + 39999 AS hi", "id * 3 AS base", "id AS ord")
    began = time.time()
    got = R.expand_ranges(df, []).agg(F.count("*"), F.sum("value")).first()
    found = J.range_lookup(spark.range(80_000).withColumnRenamed("id", "code"), df, "code").agg(F.count("value"), F.sum("value")).first()
    assert tuple(got) == tuple(found) == (79_999, sum(3 * min(c, 39_999) + c - min(c, 39_999) for c in range(79_999)))
    assert time.time() - began < 60
