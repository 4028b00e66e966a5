"""Merged runs with text and places, their replay, and the corpus report."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioscan.operators import aggregates as A
from folioscan.operators import rewrites as R

ITEMS = "doc long, block int, pos int, font string, ch string, x double, width double, simple boolean"
BLOCKS = (["doc"], ["pos"], "font", "simple", "block")


def laid(seed, blocks=12):
    """Items set one after another with odd gaps; a block in four holds an item that is not simple."""
    draw = random.Random(seed)
    rows = []
    for b in range(blocks):
        x = draw.uniform(0, 100)
        for pos in range(draw.randint(1, 30)):
            width = draw.uniform(0, 9)
            rows.append((b % 3 if b % 5 else None, b, pos, draw.choice("AB") if draw.random() < 0.4 else "A", draw.choice("abc "), x, width, b % 4 != 3 or pos != 0))
            x += width + draw.choice([0.0, 0.3333, -0.1277, 5.0005])
    return rows


def plain_runs(rows, places):
    """Runs by reading each block in order; what a rounding leaves over goes into the next."""
    out, by = {}, {}
    for r in rows:
        by.setdefault((r[0], r[1]), []).append(r)
    for key, items in by.items():
        if not all(r[7] for r in items):
            continue
        runs, residue = [], 0.0
        for r in items:
            if not runs or runs[-1][0] != r[3]:
                runs.append([r[3], "", r[5], []])
                residue, gap = 0.0, 0.0
            else:
                exact = r[5] - end + residue  # noqa: F821
                gap = round(exact, places)
                residue = exact - gap
            runs[-1][1] += r[4]
            runs[-1][3].append(gap)
            end = r[5] + r[6]  # noqa: F841
        out[key] = runs
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_carry_text_and_gaps(spark, seed):
    rows = laid(seed)
    want = plain_runs(rows, 3)
    got = R.merge_runs(spark.createDataFrame(rows, ITEMS).repartition(3), *BLOCKS, text="ch").collect()
    merged = {}
    for r in sorted((r for r in got if r.state != "refused"), key=lambda r: (r.block, r.run)):
        merged.setdefault((r.doc, r.block), []).append([r.font, r.text, r.start, r.gaps])
        assert r.n == len(r.gaps) and r.state == ("merged" if r.n > 1 else "single")
    assert merged.keys() == want.keys()
    for key, runs in want.items():
        assert [(f, t, s) for f, t, s, _ in merged[key]] == [(f, t, s) for f, t, s, _ in runs]
        for mine, theirs in zip(merged[key], runs):
            assert mine[3] == pytest.approx(theirs[3], abs=2e-3) and sum(mine[3]) == pytest.approx(sum(theirs[3]), abs=2e-3)
    refused = [r for r in got if r.state == "refused"]
    assert {(r.doc, r.block) for r in refused} == {(r[0], r[1]) for r in rows} - want.keys() and all(r.text is None and r.gaps == [] for r in refused)


def test_replay_finds_what_was_changed(spark):
    rows = laid(4)
    items = spark.createDataFrame(rows, ITEMS)
    merged = R.merge_runs(items, *BLOCKS, text="ch")
    play = lambda runs: R.replay(items, runs, *BLOCKS).collect()
    good = play(merged)
    assert len(good) == sum(1 for r in rows if (r[0], r[1]) in plain_runs(rows, 3)) and all(r.same for r in good)
    first = merged.where("state = 'merged'").orderBy("block", "run").first()
    here = (F.col("block") == first.block) & (F.col("run") == first.run)
    moved = play(merged.withColumn("gaps", F.when(here, F.transform("gaps", lambda g, i: g + F.when(i == 1, 0.5).otherwise(0.0))).otherwise(F.col("gaps"))))
    assert sum(not r.same for r in moved) == first.n - 1  # all behind the gap are shifted
    shorter = play(merged.withColumn("gaps", F.when(here, F.slice("gaps", 1, first.n - 1)).otherwise(F.col("gaps"))))
    assert any(not r.same for r in shorter) and len(shorter) == len(good)
    renamed = play(merged.withColumn("font", F.when(here, "Z").otherwise(F.col("font"))))
    assert sum(not r.same for r in renamed) == first.n
    doubled = play(merged.union(merged.where(here).withColumn("run", F.lit(99))))
    assert len(doubled) == len(good) + first.n and sum(not r.same for r in doubled) == first.n


def test_odd_blocks(spark):
    rows = [(None, None, 1, None, None, 1.0, 1.0, True), (None, None, 2, None, "b", 2.0, 1.0, True), (1, 1, 1, "A", "x", None, None, True), (2, 1, 1, "A", "x", 0.0, 0.0, None)]
    got = {(r.doc, r.block): r for r in R.merge_runs(spark.createDataFrame(rows, ITEMS), *BLOCKS, text="ch").collect()}
    assert got[None, None].text == "b" and got[None, None].n == 2 and got[1, 1].start is None
    assert R.merge_runs(spark.createDataFrame([], ITEMS), *BLOCKS, text="ch").collect() == []


def test_corpus_report(spark):
    pages = spark.createDataFrame([(1, "<p>one two three four</p>"), (2, "<p>one<p>two three"), (3, "<p></p>"), (4, "<p>alpha beta</p>")], "page_id long, html string")
    out = spark.createDataFrame([(1, "one two three four"), (2, "one"), (3, None), (9, "stray")], "page_id long, text string")
    counts = spark.createDataFrame([(1, 0, None), (2, 3, 1)], "page_id long, rejected int, failed int")
    got = {r.page_id: r for r in A.corpus_report(pages, out, counts).collect()}
    assert got[1].notes == [] and got[1].clean and got[1].retention == 1.0
    assert got[2].notes == ["not verified: p", "3 rewrites rejected", "lost text: 33 of 100 words left, source has 3", "1 assets failed"]
    assert got[3].retention == 1.0 and got[3].notes == ["no text extracted"]  # null came out
    assert got[4].notes == ["no text extracted", "lost text: 0 of 100 words left, source has 2"]
    total = A.corpus_totals(A.corpus_report(pages, out, counts)).first()
    assert (total.clean, total.documents, total.observations) == (1, 4, 7)
    bare = A.corpus_report(pages.limit(1), out)
    assert bare.first().clean and A.corpus_totals(bare.limit(0)).first() == (0, 0, 0)
    ligatures = A.corpus_report(pages, spark.createDataFrame([(1, "ofﬁce ﬂow ﬁn one two three")], "page_id long, text string"))
    assert ligatures.where("page_id = 1").first().notes == ["2 ligatures left"]
