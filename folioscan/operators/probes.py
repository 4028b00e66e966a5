"""Named probes over tables, and the hook that prepares a table before them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.errors import PySparkException

from folioscan.operators.aggregates import css_families, family_census
from folioscan.operators.windows import wide_gaps
from folioscan.session import cut


def _fonts(df: DataFrame) -> DataFrame:
    none = df.sparkSession.createDataFrame([], "family string")
    return family_census(css_families(df), "family", none)


PROBES: dict[str, Callable[[DataFrame], DataFrame]] = {"fonts": _fonts, "gaps": wide_gaps}


def run_probe(name: str, df: DataFrame, before: Callable[[DataFrame], DataFrame] | None = None, eager: bool = False) -> DataFrame:
    """Run a probe by name. A probe that cannot be planned on the table yields a finding, not an empty answer.

    With ``eager`` it also runs now, into the checkpoint folder, and a failure of its tasks yields a finding too.
    """
    if name not in PROBES:
        raise ValueError(f"unknown probe {name!r}; known: {', '.join(sorted(PROBES))}")
    try:
        found = PROBES[name](df if before is None else df.transform(before))
        return cut(found) if eager else found
    except PySparkException as error:
        row = df.sparkSession.range(1)
        return row.select(
            F.lit("page-probe-failed").alias("code"), F.lit("warn").alias("severity"), F.lit(f"{name}: {error.getCondition() or type(error).__name__}").alias("message")
        )
