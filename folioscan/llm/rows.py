"""Rows in, rows out: result columns beside the columns of a table, and the small things all operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.session import ensure_checkpoint_dir

# The columns of the documents table, which every stage but the last hands on.
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def without(df: DataFrame, names) -> DataFrame:
    """The table without the columns that a result replaces; names are compared as Spark compares them."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def unclashed(df: DataFrame, keep: list[str]) -> DataFrame:
    """Only the named columns."""
    return df.select(*[F.col(f"`{c}`") for c in keep])


def map_texts(df: DataFrame, text: str, added: str, work: Callable, drop: bool = False) -> DataFrame:
    """Add columns that a function makes of the texts, batch by batch.

    ``work(array)`` gets the text column of a batch and returns (columns, mask or None): one array per added column, and
    which rows stay. A column of the table with the name of a result is replaced. The row keeps its other columns.
    """
    extra = T._parse_datatype_string(added)
    base = without(df, [f.name for f in extra if f.name.lower() != text.lower()])
    replaces = any(f.name.lower() == text.lower() for f in extra)
    schema = T.StructType([f for f in base.schema if not (replaces and f.name.lower() == text.lower())] + list(extra))
    names = base.columns
    at = next(i for i, c in enumerate(names) if c.lower() == text.lower())
    kept = [i for i, f in enumerate(base.schema) if not (replaces and f.name.lower() == text.lower())]
    labels = [schema[i].name for i in range(len(schema))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, mask = work(batch.column(at))
            out = pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + list(columns), names=labels)
            yield out.filter(mask) if mask is not None else out
        pa.default_memory_pool().release_unused()  # a worker serves many tasks

    return base.mapInArrow(run, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


class Bits:
    """A bitmap over hashes: says no only to hashes that are not in it. Its size is fixed, so it may be broadcast whatever it holds."""

    WORDS = 1 << 20

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def of(keys: DataFrame, column: str) -> Bits:
        """The bitmap of a column of 64-bit hashes. Tasks put the bits together; the driver gets WORDS numbers at most."""
        bit = F.expr(f"shiftleft(1L, cast(pmod(shiftright(`{column}`, 20), 64) AS INT))")
        found = keys.groupBy(F.pmod(column, F.lit(Bits.WORDS)).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
        words = np.zeros(Bits.WORDS, np.int64)
        words[found["w"].to_numpy()] = found["b"].to_numpy()
        return Bits(words)

    def maybe(self, hashes) -> np.ndarray:
        """For each hash: may it be in the set?"""
        h = np.asarray(hashes, np.int64)
        return (self.words[h & (self.WORDS - 1)] >> ((h >> 20) & 63)) & 1 == 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, as its files are."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share(key, divisor: int):
    """crc32 of a key written as text, modulo a number; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % divisor
