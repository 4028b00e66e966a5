"""Mixing by weighted fair queueing."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest

from folioscan.llm.mixing import mix, mix_totals, targets

SF = "/root/testdata/sf0.001"


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights, repeats):
    """Share the budget by weight, stop a target at its bound, share what is left, until none is above."""
    out, free = {s: 0.0 for s in sizes}, set(sizes)
    left = float(sum(sizes.values()))
    while free:
        unit = left / sum(weights[s] for s in free)
        over = {s for s in free if unit * weights[s] >= repeats * sizes[s]}
        if not over:
            for s in free:
                out[s] = unit * weights[s]
            break
        for s in over:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize(("weights", "repeats"), [((1, 2, 3), 3), ((5, 1), 1), ((1, 1, 40), 2)])
def test_targets_fill_up(spark, weights, repeats):
    sizes = {"a": 10, "b": 500, "c": 3, "é": 0, "z": 70, None: 41, "B": 1}
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = plain_targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}, repeats)
    got = targets(spark.createDataFrame(list(sizes.items()), "s string, source_size long"), weights, repeats).collect()
    assert {r.s: r.rank for r in got} == {s: i + 1 for i, s in enumerate(order)}
    assert {r.s: r.target for r in got} == pytest.approx(want)


def test_a_named_weight(spark):
    table = spark.createDataFrame([("a", 100), ("b", 100), (None, 100)], "s string, source_size long")
    assert {r.s: r.target for r in targets(table, {"b": 2, None: 3}, 3).collect()} == {"a": 50.0, "b": 100.0, None: 150.0}


def check_totals(rows, repeats=3, slack=0):
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= repeats * r.size and (r.first_position is None) == (r.taken == 0)
        by[r.source_size, r.target].append(r.taken)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 1 + slack
    return by


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mix_totals(docs).collect()
    assert {r.doc_id: r.size for r in got} == {r.doc_id: size_of(r.text) for r in docs.collect()}
    check_totals(got)
    again = mix_totals(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


@pytest.mark.parametrize("cut", [True, False])
def test_entries_are_the_mix(spark, cut):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    entries = sorted(mix(docs, cut=cut).collect(), key=lambda r: r.position)
    totals = mix_totals(docs, cut=cut).collect()
    budget = sum(r.size for r in totals)
    at = 0
    for before, r in zip([None, *entries], entries):
        assert r.position == at and 0 < r.words <= r.size and (cut or r.words == r.size)
        assert before is None or (before.finish, before.source_rank) <= (r.finish, r.source_rank)
        at += r.words
    assert at <= budget and budget - at <= (30 if cut else max(r.size for r in totals))
    taken = defaultdict(int)
    for r in entries:
        taken[r.doc_id] += r.words
    assert {r.doc_id: r.taken for r in totals if r.taken} == dict(taken)
    check_totals(totals, slack=0 if cut else 2 * max(r.size for r in totals))


def test_hot_source_and_odd_rows(spark):
    rows = [(i, f"w{i} " * (1 + i % 7), "hot") for i in range(900)] + [(i, "a b " * (1 + i % 5), f"s{i % 5}") for i in range(300)]
    rows += [(None, None, None), (None, "", "s1"), (7, " \t ", "empty"), (8, "x " * 30_000, None), (8, "x y", "twice"), (8, "x y", "twice"), (None, "n n", "s1"), (None, "n n", "s1")]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size int, target double")
    got = mix_totals(docs).collect()
    assert len(got) == len(rows)
    check_totals(got)
    assert sorted(r.size for r in got) == sorted(size_of(r[1]) for r in rows)
    assert {(r.taken, r.target) for r in got if r.source_size == 0} == {(0, 0.0)}
    assert mix_totals(docs.limit(0)).collect() == [] and mix(docs.limit(0)).collect() == []
    assert [(r.taken, r.target) for r in mix_totals(docs.where("text = ''")).collect()] == [(0, 0.0)]


def test_no_python_in_the_plan(spark):
    plan = mix_totals(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
