"""Running values along an order that do not put a whole key into one task.

A plain window sends every row of a key to one task, which fails when one key holds a third of the
rows. Here the rows of a key are cut into chunks along the order. Each chunk is scanned by a window
of its own, one summary row per chunk is scanned per key, and the carry of the earlier chunks is
joined back. The cut points are quantiles of the first order column, so outliers do not matter; where
many rows share one value of it, they are cut again by quantiles of the second column. The number of
chunks follows the parallelism of the session. A null key is a group like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "__chunk"


def chunk_count(df: DataFrame) -> int:
    return max(16, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _as_number(df: DataFrame, name: str) -> Column | None:
    """A column as a number in the same order, or nothing if it has no such number."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    return c.cast("double") if isinstance(kind, (T.NumericType, T.BooleanType)) else None


def _numbers(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def _steps(x: Column, table: Column, size: int) -> Column:
    """How many of the ascending numbers in a table of at most ``size`` are not over x, by halving."""
    top = 1 << size.bit_length()
    halves = F.array(*[F.lit(top >> k) for k in range(1, top.bit_length())])
    return F.aggregate(halves, F.lit(0), lambda at, step: at + F.when(F.get(table, at + step - 1) <= x, step).otherwise(0))


def with_chunks(df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """Add the chunk number, which grows with the order; nulls of the first order column come first.

    A value that fills several of the equal shares gets as many cut points along the second order column.
    """
    n = chunks or chunk_count(df)
    x = _as_number(df, order[0])
    if x is None:
        raise TypeError(f"{order[0]}: the first order column has to be a number, a date or a time")
    shares = [k / n for k in range(1, n)]
    found = [v for v in df.agg(F.percentile_approx(x, shares, 20 * n)).first()[0] or [] if v == v]
    cuts = sorted(set(found))
    if not cuts:
        return df.withColumn(CHUNK, F.when(x.isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long"))
    second = _as_number(df, order[1]) if len(order) > 1 else None
    hot = {v: found.count(v) for v in cuts if found.count(v) > 1}
    inside: dict[float, list[float]] = {}
    if hot and second is not None:
        for row in df.where(x.isin(list(hot))).groupBy(x.alias("x")).agg(F.percentile_approx(second, shares, 20 * n).alias("q")).collect():
            q = [v for v in row["q"] or [] if v == v]
            inside[row["x"]] = sorted({q[len(q) * k // hot[row["x"]]] for k in range(1, hot[row["x"]]) if q})
    place = _steps(x, _numbers(cuts), len(cuts))
    within: Column = F.lit(0)
    if inside:
        tables = F.array(*[_numbers(inside.get(v, [])) for v in cuts])
        within = F.when(F.get(_numbers(cuts), place - 1) == x, _steps(second, F.get(tables, place - 1), n)).otherwise(n)
    return df.withColumn(CHUNK, F.when(x.isNull(), F.lit(-1)).otherwise(place * (n + 1) + within).cast("long"))


def _matches(keys: list[str]) -> list[Column]:
    """Join condition of rows and carries; null keys meet."""
    return [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, CHUNK]]


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    nexts: dict[str, Column] | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Add running values per key along the order (ascending, complete tie-break).

    ``sums``: running total up to and with the row. ``lasts``: nearest value before the row that is
    not null. ``nexts``: nearest value after the row that is not null.
    """
    sums, lasts, nexts = sums or {}, lasts or {}, nexts or {}
    base = df.columns
    work = with_chunks(df, keys, order, chunks)
    for name, expr in {**sums, **lasts, **nexts}.items():
        work = work.withColumn(f"__v_{name}", expr)

    here = W.partitionBy(*keys, CHUNK).orderBy(*order)
    back = W.partitionBy(*keys, CHUNK).orderBy(*[F.col(c).desc() for c in order])
    past, seen = (W.unboundedPreceding, -1), (W.unboundedPreceding, W.currentRow)
    local = work.select(
        "*",
        *[F.sum(f"__v_{n}").over(here.rowsBetween(*seen)).alias(f"__l_{n}") for n in sums],
        *[F.last(f"__v_{n}", ignorenulls=True).over(here.rowsBetween(*past)).alias(f"__l_{n}") for n in lasts],
        *[F.last(f"__v_{n}", ignorenulls=True).over(back.rowsBetween(*past)).alias(f"__l_{n}") for n in nexts],
    )

    def at(name: str) -> Column:
        return F.when(F.col(f"__v_{name}").isNotNull(), F.struct(*[F.col(c) for c in order]))

    summary = work.groupBy(*keys, CHUNK).agg(
        *[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in sums],
        *[F.max_by(f"__v_{n}", at(n)).alias(f"__s_{n}") for n in lasts],
        *[F.min_by(f"__v_{n}", at(n)).alias(f"__s_{n}") for n in nexts],
    )
    over = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(*past)
    under = W.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(*past)
    carry = summary.select(
        *keys,
        CHUNK,
        *[F.sum(f"__s_{n}").over(over).alias(f"__c_{n}") for n in sums],
        *[F.last(f"__s_{n}", ignorenulls=True).over(over).alias(f"__c_{n}") for n in lasts],
        *[F.last(f"__s_{n}", ignorenulls=True).over(under).alias(f"__c_{n}") for n in nexts],
    )
    on = _matches(keys)
    joined = local.alias("a").join(carry.alias("b"), on, "left")

    def total(n: str) -> Column:
        carried, own = F.col(f"b.__c_{n}"), F.col(f"a.__l_{n}")
        return F.when(carried.isNull(), own).when(own.isNull(), carried).otherwise(carried + own)

    return joined.select(
        *[F.col(f"a.{c}") for c in base],
        *[total(n).alias(n) for n in sums],
        *[F.coalesce(f"a.__l_{n}", f"b.__c_{n}").alias(n) for n in [*lasts, *nexts]],
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """Add the position of a row within its key, from 1."""
    return ordered_scan(df, keys, order, sums={name: F.lit(1).cast("long")})


def islands(df: DataFrame, keys: list[str], order: list[str], value: str, chunks: int | None = None) -> DataFrame:
    """Runs of equal values: ``keys, value, first, last`` (structs of the order columns) and ``n``.

    Runs are found per chunk. Only the first and the last run of a chunk can continue in a
    neighbour, so only these meet in a window per key, at most two rows per chunk.
    """
    work = with_chunks(df.select(*dict.fromkeys([*keys, *order, value])), keys, order, chunks)
    here = W.partitionBy(*keys, CHUNK).orderBy(*order)
    at = F.struct(*[F.col(c) for c in order])
    change = ~F.col(value).eqNullSafe(F.lag(value).over(here)) | (F.row_number().over(here) == 1)
    runs = (
        work.withColumn("__change", change.cast("int"))
        .withColumn("__run", F.sum("__change").over(here.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .groupBy(*keys, CHUNK, "__run")
        .agg(F.first(value).alias(value), F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
        .withColumn("__runs", F.max("__run").over(W.partitionBy(*keys, CHUNK)))
    )
    edge = (F.col("__run") == 1) | (F.col("__run") == F.col("__runs"))
    along = W.partitionBy(*keys).orderBy(CHUNK, "__run")
    differs = ~F.col(value).eqNullSafe(F.lag(value).over(along)) | (F.lag(CHUNK).over(along) == F.col(CHUNK))
    merged = (
        runs.filter(edge)
        .withColumn("__new", F.coalesce(differs | (F.row_number().over(along) == 1), F.lit(True)).cast("int"))
        .withColumn("__id", F.sum("__new").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .groupBy(*keys, "__id")
        .agg(F.first(value).alias(value), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
        .drop("__id")
    )
    inner = runs.filter(~edge).drop(CHUNK, "__run", "__runs")
    return merged.unionByName(inner)


def restarting_sum(
    df: DataFrame, keys: list[str], order: list[str], value: Column, restart: Column, name: str, chunks: int | None = None
) -> DataFrame:
    """Sum of the values before a row since the last restart (the restarting row itself starts at 0)."""
    work = with_chunks(df, keys, order, chunks).withColumn("__v", value).withColumn("__r", restart.cast("int"))
    here = W.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = here.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = work.withColumn("__g", F.sum("__r").over(upto))
    part = W.partitionBy(*keys, CHUNK, "__g").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = local.withColumn("__s", F.coalesce(F.sum("__v").over(part), F.lit(0)))
    tails = local.groupBy(*keys, CHUNK, "__g").agg(F.sum("__v").alias("__t"))
    tails = tails.groupBy(*keys, CHUNK).agg(F.max("__g").alias("__last"), F.max_by("__t", "__g").alias("__tail"))
    along = W.partitionBy(*keys).orderBy(CHUNK)
    seen = F.sum((F.col("__last") > 0).cast("int")).over(along.rowsBetween(W.unboundedPreceding, W.currentRow))
    carry = tails.withColumn("__grp", seen)
    group = W.partitionBy(*keys, "__grp").orderBy(CHUNK).rowsBetween(W.unboundedPreceding, W.currentRow)
    carry = carry.withColumn("__sofar", F.sum("__tail").over(group))
    carry = carry.withColumn("__carry", F.lag("__sofar").over(along)).select(*keys, CHUNK, "__carry")
    on = _matches(keys)
    joined = local.alias("a").join(carry.alias("b"), on, "left")
    own = F.col("a.__s") + F.when(F.col("a.__g") == 0, F.coalesce("b.__carry", F.lit(0))).otherwise(F.lit(0))
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], own.alias(name))


def sessions(df: DataFrame, keys: list[str], ts: str, gap_micros: int, last: str | None = None, chunks: int | None = None) -> DataFrame:
    """Sessions closed by a pause: ``keys, first, last, n`` in microseconds, and the last value of a column.

    Sessions are found per chunk of time. Only the first and the last session of a chunk can go on in
    a neighbour, so only these meet in a window per key.
    """
    value = F.lit(None).cast("string") if last is None else F.col(last)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    work = with_chunks(df.select(*keys, micros.alias("__us"), value.alias("__value")), keys, ["__us"], chunks)
    here = W.partitionBy(*keys, CHUNK).orderBy("__us")
    opens = F.coalesce(F.col("__us") - F.lag("__us").over(here) >= gap_micros, F.lit(True))
    at = F.struct("__us", "__value")
    runs = (
        work.withColumn("__new", opens.cast("int"))
        .withColumn("__run", F.sum("__new").over(here.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .groupBy(*keys, CHUNK, "__run")
        .agg(F.min("__us").alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
        .withColumn("__runs", F.max("__run").over(W.partitionBy(*keys, CHUNK)))
    )
    edge = (F.col("__run") == 1) | (F.col("__run") == F.col("__runs"))
    along = W.partitionBy(*keys).orderBy(CHUNK, "__run")
    apart = F.coalesce(F.col("first") - F.lag("last.__us").over(along) >= gap_micros, F.lit(True))
    merged = (
        runs.filter(edge)
        .withColumn("__new", apart.cast("int"))
        .withColumn("__id", F.sum("__new").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .groupBy(*keys, "__id")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
        .drop("__id")
    )
    out = merged.unionByName(runs.filter(~edge).drop(CHUNK, "__run", "__runs"))
    extra = [] if last is None else [F.col("last.__value").alias(last)]
    return out.select(*keys, "first", F.col("last.__us").alias("last"), "n", *extra)
