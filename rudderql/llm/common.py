"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialize, new_path

__all__ = ["materialize", "new_path"]

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table of at most so many rows of a few numbers and a short key may be broadcast.
SMALL_ROWS = 10_000
SMALL_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table. A small one in fewer files than cores may be one row group, hence one task; it is written anew, a file a core.

    Dealing it out within the query would not do: filters, with the patterns
    that they search for, are moved below a repartition.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES and len(df.inputFiles()) < cores:
        return materialize(df.repartition(cores), name)
    return df


def small(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` if counting shows that it is small; else leave the join to Spark."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(s: Column) -> Column:
    """Lower-case A-Z only; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def two_hashes(*cols: Column) -> tuple[Column, Column]:
    """128 bits of hash as two independent longs."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)
