"""Streams that keep state of their own, and sinks that may be written again."""

from __future__ import annotations

import random
import tempfile
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioscan.operators.findings import page_verdict
from folioscan.streaming import operators as S
from folioscan.streaming import stateful as ST
from folioscan.streaming.runner import Upserts, with_state

START = datetime(2026, 1, 1)
EVENTS = "k long, ts timestamp, id long, kind string"


class Feed:
    """Files that land one after another, and a query that takes up what has landed."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.base = spark, schema, tempfile.mkdtemp(dir="/tmp")
        self.stream = lambda: spark.readStream.schema(schema).parquet(f"{self.base}/in")

    def land(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.base}/in")

    def run(self, df, keys, mode="update", clock=False):
        table = Upserts(f"{self.base}/out", keys)
        with with_state(self.spark, clock):
            df.writeStream.foreachBatch(table.write).option("checkpointLocation", f"{self.base}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return table

    def all(self, df):
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/out")


def test_lower_sequences_never_come_back(spark):
    feed = Feed(spark, "k long, seq long, v string")
    new = lambda: ST.newest_results(feed.stream(), "k", "seq")
    feed.land([(1, 5, "a"), (1, 4, "b"), (None, 1, "n"), (2, None, "none")])
    table = feed.run(new(), ["k"], clock=True)
    feed.land([(1, 3, "late"), (1, 5, "same"), (2, 1, "c")])
    feed.run(new(), ["k"], clock=True)
    feed.land([(2, 7, "d")])
    feed.run(new(), ["k"], clock=True)
    assert sorted((r.k or 0, r.seq, r.v) for r in table.read(spark, new().schema).collect()) == [(0, 1, "n"), (1, 5, "a"), (2, 7, "d")]
    assert feed.all(new()).count() == 4  # only what changed was written


def test_state_is_empty_after_its_time(spark):
    feed = Feed(spark, "k long, seq long, v string")
    new = lambda: ST.newest_results(feed.stream(), "k", "seq", ttl_ms=1500)
    feed.land([(1, 9, "a")])
    feed.run(new(), ["k"], clock=True)
    time.sleep(2)
    feed.land([(1, 2, "after")])
    table = feed.run(new(), ["k"], clock=True)
    assert [(r.seq, r.v) for r in table.read(spark, new().schema).collect()] == [(2, "after")]


@pytest.mark.parametrize("seed", [1, 2])
def test_debounce_of_a_stream_equals_batch(spark, seed):
    draw = random.Random(seed)
    rows = [(draw.randint(1, 3), START + timedelta(seconds=draw.randint(0, 300)), i, draw.choice(["key", "key", "enter"])) for i in range(60)]
    rows.sort(key=lambda r: r[1])
    feed = Feed(spark, EVENTS)
    gap = 20_000_000
    acts = lambda df: ST.debounce_events(df, "k", "id", gap, F.col("kind") == "enter", delay="60 seconds")
    # three files; within the delay rows come out of order
    parts = [rows[:25] + rows[30:32], rows[25:30] + rows[32:50], rows[50:]]
    for part in parts:
        draw.shuffle(part)
        feed.land(part)
        feed.run(acts(feed.stream()), ["k"], mode="append")
    feed.land([(9, START + timedelta(hours=1), 999, "key")])  # the watermark passes all others
    feed.run(acts(feed.stream()), ["k"], mode="append")
    want = S.debounce_batch(spark.createDataFrame(rows, EVENTS), ["k"], ["ts", "id"], gap, F.col("kind") == "enter")
    got = feed.all(acts(feed.stream()))
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_main_answers_while_a_page_runs(spark):
    schema = "page long, ts timestamp, type string, status int, error string"
    at = lambda s: START + timedelta(seconds=s)
    feed = Feed(spark, schema)
    live = lambda: ST.main_answers(feed.stream(), "page", 3600 * 1_000_000)
    rows = [(1, at(5), "Document", 200, None), (1, at(1), "Document", 301, "e1"), (1, at(9), "Image", 500, "no"), (2, at(3), "Document", None, None)]
    feed.land(rows)
    feed.run(live(), ["page"])
    more = [(1, at(0), "Document", None, "e0"), (1, at(4), "Document", 404, "e4"), (2, at(8), "Document", 503, None)]
    feed.land(more)
    table = feed.run(live(), ["page"])
    got = sorted(map(tuple, table.read(spark, live().schema).collect()))
    want = S.main_responses(spark.createDataFrame(rows + more, schema), "page").collect()
    assert got == sorted(map(tuple, want)) == [(1, 200, "e0"), (2, 503, None)]
    feed.land([(3, at(50_000), "Document", 200, None)])  # the watermark passes the gap of pages 1 and 2
    feed.run(live(), ["page"])
    feed.land([(1, at(50_001), "Document", 410, None)])
    table = feed.run(live(), ["page"])
    assert {r.page: (r.main_status, r.main_error) for r in table.read(spark, live().schema).collect()}[1] == (410, None)


def test_a_batch_may_be_written_again(spark):
    pages = spark.createDataFrame([(1, "<p>{{x}}</p>"), (2, '<html lang="en"><p>ok</p></html>'), (3, "")], "page_id long, html string")
    sink = S.AuditSink(tempfile.mkdtemp(dir="/tmp"))
    tables = ("checks", "findings", "verdicts")
    sink.write(pages.limit(2), 0)
    sink.write(pages.where("page_id = 3"), 1)
    once = {t: sorted(map(str, sink.read(spark, t).collect())) for t in tables}
    sink.write(pages.where("page_id = 3"), 1)
    sink.write(pages.limit(2), 0)
    assert once == {t: sorted(map(str, sink.read(spark, t).collect())) for t in tables}
    assert once["verdicts"] == sorted(map(str, page_verdict(pages).collect()))


def test_only_new_pages_are_audited(spark):
    feed = Feed(spark, "page_id long, html string")
    feed.land([(1, "<p>{{x}}</p>")])
    S.start_verdicts(feed.stream(), f"{feed.base}/audit", f"{feed.base}/mark").awaitTermination()
    feed.land([(2, "<p>fine</p>")])
    S.start_verdicts(feed.stream(), f"{feed.base}/audit", f"{feed.base}/mark").awaitTermination()
    S.start_verdicts(feed.stream(), f"{feed.base}/audit", f"{feed.base}/mark").awaitTermination()
    assert sorted((r.page_id, r.ok) for r in S.AuditSink(f"{feed.base}/audit").read(spark, "verdicts").collect()) == [(1, False), (2, True)]


def test_sketch_of_many_values_is_within_its_bound(spark):
    draw = random.Random(5)
    values = [(START + timedelta(seconds=i % 3600), draw.random()) for i in range(20_000)] + [(START + timedelta(days=2), 0.5)]
    feed = Feed(spark, "ts timestamp, ms double")
    feed.land(values)
    live = S.live_profile(feed.stream(), "1 hour", None, "ms", F.col("ms") < 0.9, F.col("ms") >= 0.9, k=256)
    feed.run(live, ["window_start"], mode="append")
    (row,) = feed.all(live).collect()
    rank = sum(v <= row.p50 for _, v in values[:-1]) / 20_000
    assert row.n == 20_000 and abs(rank - 0.5) <= 1.7 / 256 + 0.001


def test_debounce_keeps_one_row_for_a_long_session(spark):
    """20,000 keystrokes of one key: no timer and no state row for each."""
    rows = [(1, START + timedelta(seconds=i), i, "enter" if i % 5000 == 0 else "key") for i in range(20_000)]
    rows += [(2, START + timedelta(seconds=s), 30_000 + s, "key") for s in (0, 20, 39, 39)] + [(9, START + timedelta(days=9), 99_999, "key")]
    feed = Feed(spark, EVENTS)
    feed.land(rows)
    acts = ST.debounce_events(feed.stream(), "k", "id", 20_000_000, F.col("kind") == "enter")
    began = time.time()
    feed.run(acts, ["k"], mode="append")
    took = time.time() - began
    want = S.debounce_batch(spark.createDataFrame(rows[:-1], EVENTS), ["k"], ["ts", "id"], 20_000_000, F.col("kind") == "enter")
    assert sorted(r.id for r in feed.all(acts).collect()) == sorted(r.id for r in want.collect()) and took < 60


def test_median_of_a_stream_is_exact(spark):
    draw = random.Random(6)
    values = {h: [draw.choice([draw.random(), 0.25]) for _ in range(n)] for h, n in ((0, 5001), (1, 5000), (2, 1), (3, 2))}
    feed = Feed(spark, "ts timestamp, ms double")
    feed.land([(START + timedelta(hours=h, seconds=i % 3600), v) for h, vs in values.items() for i, v in enumerate(vs)] + [(START + timedelta(hours=2), None), (START + timedelta(days=2), 0.5)])
    live = S.live_profile(feed.stream(), "1 hour", None, "ms", F.col("ms") < 0.9, F.col("ms") >= 0.9)
    feed.run(live, ["window_start"], mode="append")
    got = [r.p50 for r in feed.all(live).orderBy("window_start").collect()]
    assert got == [sorted(vs)[len(vs) // 2] for vs in values.values()]
