"""Gates that compare a result with what was recorded before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ratchet(current: DataFrame, baseline: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Keys that are not as recorded: ``key, was, now, problem`` and a last row for a grown total.

    Problems: ``added``, ``fixed`` (the baseline is stale), ``grown`` and ``total-grown``.
    """
    now = current.groupBy(F.col(key).alias("key")).agg(F.sum(n).alias("now"))
    was = baseline.groupBy(F.col(key).alias("key")).agg(F.sum(n).alias("was"))
    both = now.join(was, "key", "full_outer")
    problem = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("now").isNull(), "fixed")
        .when(F.col("now") > F.col("was"), "grown")
    )
    rows = both.select("key", "was", "now", problem.alias("problem")).filter(F.col("problem").isNotNull())
    total = both.agg(F.sum("was").alias("was"), F.sum("now").alias("now")).filter(F.col("now") > F.col("was"))
    return rows.unionByName(total.select(F.lit("(total)").alias("key"), "was", "now", F.lit("total-grown").alias("problem")))


def manifest_diff(found: DataFrame, listed: DataFrame) -> DataFrame:
    """Disagreements of emitted codes with a manifest, both ``code, severity``: ``code, problem``."""
    emitted = found.select("code", "severity").distinct().groupBy("code").agg(F.lit(True).alias("emitted"), F.count("*").alias("n"), F.collect_set("severity").alias("found"))
    known = listed.select("code", "severity").groupBy("code").agg(F.lit(True).alias("known"), F.collect_set("severity").alias("listed"))
    # One full join: the findings, which may be costly to make, are read once.
    both = emitted.join(known, "code", "full_outer")
    differs = F.exists("found", lambda f: F.exists("listed", lambda k: f != k))
    problems = F.array_compact(
        F.array(
            F.when(F.col("known").isNull(), "not-listed"), F.when(F.col("emitted").isNull(), "not-emitted"),
            F.when(differs, "wrong-severity"), F.when(F.col("n") > 1, "two-severities"),
        )
    )
    return both.select("code", F.explode(problems).alias("problem"))


def distinct_set(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of the columns."""
    return df.select(*columns).distinct()
