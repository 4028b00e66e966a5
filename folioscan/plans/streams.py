"""Queries that run a stream over a table and return what it emitted, and their batch twins.

A stream emits a window or an unanswered request once the watermark, the newest event less the delay, has
passed its end. The SQL applies the same bound.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscan.plans.findings import LONG_SQL, SEED, VERDICT_SQL
from folioscan.plans.registry import query, table
from folioscan.session import ensure_checkpoint_dir
from folioscan.streaming import operators as S
from folioscan.streaming import stateful as ST
from folioscan.streaming.runner import run_append, run_updates, stream_table

MARK = "(SELECT epoch_ms(max(ts)) FROM events)"


def micros(c):
    return F.unix_micros(F.col(c))


def events(spark, sf):
    return stream_table(spark, sf, "events", "ts")


def batch_events(spark, sf):
    return S.event_time(table(spark, sf, "events"))


def sessions_sql(gap: str, delay_ms: int | None, key: str = "user_id") -> str:
    closed = "" if delay_ms is None else f" HAVING epoch_us(max(ts) + INTERVAL {gap}) <= ({MARK} - {delay_ms}) * 1000"
    return f"""WITH a AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY {key} ORDER BY ts, event_id) < INTERVAL {gap}) AS same FROM events),
    s AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM a)
    SELECT {key}, epoch_us(min(ts)) AS started, epoch_us(max(ts) + INTERVAL {gap}) AS closed, count(*) AS events FROM s GROUP BY {key}, sid{closed}"""


def sessions(df):
    out = S.idle_sessions(df, "user_id", "5 minutes")
    return out.select("user_id", micros("started").alias("started"), micros("closed").alias("closed"), "events")


@query("idle_sessions", sessions_sql("5 MINUTES", None))
def idle_sessions(spark, sf):
    return sessions(batch_events(spark, sf))


@query("idle_sessions_stream", sessions_sql("5 MINUTES", 0))
def idle_sessions_stream(spark, sf):
    return run_append(sessions(events(spark, sf)))


DEBOUNCE_SQL = """WITH a AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS) AS same FROM events),
    s AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM a)
    SELECT user_id, arg_max(event_id, ts) AS event_id, epoch_us(max(ts) + INTERVAL 6 HOURS) AS acted_at, count(*) AS strokes FROM s GROUP BY user_id, sid"""


def debounced(df):
    return S.debounce(df, "user_id", "6 hours", "event_id").withColumn("acted_at", micros("acted_at"))


@query("debounce", DEBOUNCE_SQL)
def debounce(spark, sf):
    return debounced(batch_events(spark, sf))


@query("debounce_stream", f"SELECT * FROM ({DEBOUNCE_SQL}) WHERE acted_at <= {MARK} * 1000")
def debounce_stream(spark, sf):
    return run_append(debounced(events(spark, sf)))


@query(
    "debounce_by_next_event",
    """WITH n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)
    SELECT event_id, user_id FROM n WHERE nx IS NULL OR nx - ts >= INTERVAL 6 HOURS OR event_type = 'purchase'""",
)
def debounce_by_next_event(spark, sf):
    e = batch_events(spark, sf).select("event_id", "user_id", "ts", "event_type")
    out = S.debounce_batch(e, ["user_id"], ["ts", "event_id"], 6 * 3600 * 1000000, F.col("event_type") == "purchase")
    return out.select("event_id", "user_id")


@query(
    "debounce_events_stream",
    f"""WITH n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)
    SELECT event_id, user_id FROM n WHERE event_type = 'purchase' OR (nx IS NULL OR nx - ts >= INTERVAL 6 HOURS) AND ts + INTERVAL 6 HOURS <= epoch_ms({MARK})""",
)
def debounce_events_stream(spark, sf):
    """The same from a stream, as far as the watermark has come: purchases act at once, all else after a quiet time."""
    e = events(spark, sf).select("event_id", "user_id", "ts", "event_type")
    out = ST.debounce_events(e, "user_id", "event_id", 6 * 3600 * 1000000, F.col("event_type") == "purchase")
    return run_append(out.select("event_id", "user_id"))


def answers(df):
    """Events as answers: status, kind and address follow from the event."""
    return df.select(
        F.col("event_id").alias("request_id"), "ts", (F.lit(200) + F.expr("cast(value AS INT) * 10")).alias("status"),
        F.when(F.col("event_type") == "view", "Document").otherwise("Image").alias("type"),
        F.when(F.col("event_type") == "click", "/favicon.ico").otherwise(F.concat(F.lit("/u/"), F.col("user_id").cast("string"))).alias("url"),
    )


FAILED_SQL = """SELECT event_id AS request_id, 200 + floor(value)::INT * 10 AS status, concat('/u/', user_id) AS url FROM events WHERE 200 + floor(value)::INT * 10 >= 400 AND event_type NOT IN ('view', 'click')"""


@query("response_failures", FAILED_SQL)
def response_failures(spark, sf):
    return S.response_failures(answers(batch_events(spark, sf))).select("request_id", "status", "url")


@query("response_failures_stream", FAILED_SQL)
def response_failures_stream(spark, sf):
    """Every answer arrives twice, each request is reported once."""
    twice = events(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return run_append(S.response_failures(answers(twice)).select("request_id", "status", "url"))


def clicks(df):
    return df.filter("event_type = 'click'").select(
        F.col("user_id").alias("request_id"), F.concat(F.lit("/c/"), F.col("event_id").cast("string")).alias("url"), "ts", F.col("event_id").alias("click_id")
    )


def errors(df):
    return df.filter("event_type = 'error'").select(F.col("user_id").alias("request_id"), "ts", "event_id")


MAIN_SQL = """WITH m AS (SELECT user_id AS page_id, ts, 200 + floor(value)::INT * 10 AS status, CASE WHEN value > 50 THEN concat('e', event_id) END AS error FROM events WHERE event_type = 'view')
    SELECT page_id, arg_max(status, (ts, status)) AS main_status, arg_min(error, (ts, error)) FILTER (error IS NOT NULL) AS main_error FROM m GROUP BY page_id"""


@query("main_responses", MAIN_SQL)
def main_responses(spark, sf):
    given = answers(batch_events(spark, sf).filter("event_type = 'view'"))
    own = batch_events(spark, sf).select(F.col("event_id").alias("request_id"), F.col("user_id").alias("page_id"), F.expr("CASE WHEN value > 50 THEN concat('e', event_id) END AS error"))
    return S.main_responses(given.join(own, "request_id"), "page_id")


@query("main_responses_stream", MAIN_SQL)
def main_responses_stream(spark, sf):
    """The same while the pages run: each change is an update of its page."""
    e = events(spark, sf).filter("event_type = 'view'")
    named = e.select("ts", F.col("user_id").alias("page_id"), (F.lit(200) + F.expr("cast(value AS INT) * 10")).alias("status"), F.lit("Document").alias("type"), F.expr("CASE WHEN value > 50 THEN concat('e', event_id) END AS error"))
    return run_updates(ST.main_answers(named, "page_id", 365 * 86400 * 1000000), ["page_id"])


JOIN_SQL = """SELECT e.event_id, e.user_id AS request_id, concat('/c/', c.event_id) AS req_url FROM events e JOIN events c ON e.user_id = c.user_id AND c.event_type = 'click' AND e.event_type = 'error'
    AND e.ts >= c.ts AND e.ts <= c.ts + INTERVAL 2 HOURS"""


@query("join_failures", JOIN_SQL)
def join_failures(spark, sf):
    e = batch_events(spark, sf)
    return S.join_failures(clicks(e), errors(e), "2 HOURS").select("event_id", "request_id", "req_url")


@query("join_failures_stream", JOIN_SQL)
def join_failures_stream(spark, sf):
    joined = S.join_failures(clicks(events(spark, sf)), errors(events(spark, sf)), "2 HOURS")
    return run_append(joined.select("event_id", "request_id", "req_url"))


TIMEOUT_SQL = """SELECT event_id AS click_id, user_id AS request_id FROM events c WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error'
    AND e.user_id = c.user_id AND e.ts >= c.ts AND e.ts <= c.ts + INTERVAL 2 HOURS)"""


@query("timeouts", TIMEOUT_SQL)
def timeouts(spark, sf):
    e = batch_events(spark, sf)
    return S.timeouts(clicks(e), errors(e), "2 HOURS").select("click_id", "request_id")


@query(
    "timeouts_stream",
    TIMEOUT_SQL + " AND epoch_us(c.ts) < (SELECT least(epoch_ms(max(ts) FILTER (event_type = 'click')), epoch_ms(max(ts) FILTER (event_type = 'error'))) FROM events) * 1000 - 7200000000",
)
def timeouts_stream(spark, sf):
    out = S.timeouts(clicks(events(spark, sf)), errors(events(spark, sf)), "2 HOURS")
    return run_append(out.select("click_id", "request_id"))


LATEST_SQL = "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id"


@query("latest_wins", LATEST_SQL)
def latest_wins(spark, sf):
    return S.latest_wins(batch_events(spark, sf).select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("latest_wins_stream", LATEST_SQL)
def latest_wins_stream(spark, sf):
    """Only results that are newer than the newest of their key are written."""
    newer = ST.newest_results(events(spark, sf).select("user_id", "event_id", "event_type"), "user_id", "event_id")
    return run_updates(newer, ["user_id"], clock=True)


COUNTS_SQL = """SELECT event_type, epoch_us(date_trunc('hour', ts)) AS window_start, count(*) AS events, count(DISTINCT props) AS messages FROM events GROUP BY ALL"""


def counted(df):
    return S.live_counts(df, "event_type", "1 hour", "props").withColumn("window_start", micros("window_start"))


@query("live_counts", COUNTS_SQL)
def live_counts(spark, sf):
    return counted(batch_events(spark, sf))


@query("live_counts_stream", f"SELECT * FROM ({COUNTS_SQL}) WHERE window_start + 3600000000 <= ({MARK} - 600000) * 1000")
def live_counts_stream(spark, sf):
    return run_append(counted(events(spark, sf)))


def profile(df, slide):
    out = S.live_profile(df, "2 hours", slide, "value", F.col("value") < 100, F.col("value") >= 100)
    return out.withColumn("window_start", micros("window_start")).withColumn("per_second", F.round("per_second", 9))


SLIDING = """w AS (SELECT value, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) - k * 3600000000 AS window_start FROM events, (SELECT unnest([0, 1]) AS k)),
    r AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY value) AS rn, count(*) OVER (PARTITION BY window_start) AS n FROM w)"""


@query(
    "live_profile",
    f"""WITH {SLIDING} SELECT window_start, count(*) AS n, count(*) FILTER (value < 100) AS ok, count(*) FILTER (value >= 100) AS refused, max(value) FILTER (rn = floor(n / 2) + 1) AS p50,
    max(value) AS hi, round(count(*) / 7200, 9) AS per_second FROM r GROUP BY window_start""",
)
def live_profile(spark, sf):
    return profile(batch_events(spark, sf), "1 hour")


@query(
    "live_profile_stream",
    f"""WITH w AS (SELECT value, epoch_us(time_bucket(INTERVAL 2 HOURS, ts, TIMESTAMP '2024-01-01')) AS window_start FROM events) SELECT window_start, count(*) AS n, count(*) FILTER (value < 100) AS ok, count(*) FILTER (value >= 100) AS refused,
    max(value) AS hi, list_sort(list(value))[count(*) // 2 + 1] AS p50, true AS p50_holds, round(count(*) / 7200, 9) AS per_second FROM w GROUP BY window_start HAVING window_start + 7200000000 <= ({MARK} - 600000) * 1000""",
)
def live_profile_stream(spark, sf):
    """``p50_holds`` compares the rank of the stream's median with that of the runs."""
    live = run_append(profile(events(spark, sf), None))
    runs = batch_events(spark, sf).select(micros_of_window("2 hours").alias("window_start"), "value")
    held = live.select("window_start", "p50").join(runs, "window_start").groupBy("window_start").agg(
        (F.count_if(F.col("value") < F.col("p50")) / F.count("*")).alias("below"), (F.count_if(F.col("value") <= F.col("p50")) / F.count("*")).alias("upto")
    )
    bound = F.lit(2 / 1024)
    return live.join(held, "window_start").withColumn("p50_holds", (F.col("below") <= 0.5 + bound) & (F.col("upto") >= 0.5 - bound)).drop("below", "upto")


def micros_of_window(size):
    return F.unix_micros(F.window("ts", size)["start"])


AUDIT_SQL = r"""WITH b AS (SELECT page_id, (len(regexp_extract_all(html, '<p>')) <> len(regexp_extract_all(replace(html, '"</p>"', ''), '</p>')))::INT
      + (len(regexp_extract_all(html, '<b>')) <> len(regexp_extract_all(html, '</b>')))::INT AS n FROM pages)
    SELECT page_id, 'output-unverified' AS code, 'error' AS severity, n FROM b WHERE n > 0"""


@query("audit_stream", AUDIT_SQL)
def audit_stream(spark, sf):
    return run_append(S.audit_stream(stream_table(spark, sf, "pages")).select("page_id", "code", "severity", "n"))


@query("audit_verdicts_stream", LONG_SQL + VERDICT_SQL)
def audit_verdicts_stream(spark, sf):
    """Verdicts of pages as they land, with defects written into them."""
    folder = f"{ensure_checkpoint_dir(spark)}/audit-{uuid.uuid4().hex}"
    pages = stream_table(spark, sf, "pages").select("page_id", "url", F.expr(SEED).alias("html"))
    S.start_verdicts(pages, f"{folder}/out", f"{folder}/state").awaitTermination()
    return S.AuditSink(f"{folder}/out").read(spark, "verdicts")


@query(
    "request_deadlines",
    "SELECT event_id, CASE WHEN event_id % 5 = 0 OR value < 1 THEN 30 ELSE least(floor(value), 120)::BIGINT END AS deadline FROM events",
)
def request_deadlines(spark, sf):
    wanted = F.when(F.col("event_id") % 5 != 0, F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", S.deadline_seconds(wanted).cast("bigint").alias("deadline"))
