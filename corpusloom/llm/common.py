"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the cluster's checkpoint folder and continue from those files.

    The folder is the session's `spark.checkpoint.dir`; only where that is unset (tests, a
    laptop) is a local one made.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def top(counts: DataFrame, n_col: str, name_col: str, limit: int) -> pa.Table:
    """The rows of `counts` with the largest `n_col`, about `limit` at most. The least count that is
    needed is read from a short table of how many rows have counts of each size (64 sizes between a
    number and its double), so that only rows that are wanted leave their tasks; of the least size,
    those with the smallest hash of `name_col` are taken."""
    size = F.floor(F.log2(F.col(n_col).cast("double")) * 64)
    spread = counts.groupBy(size.alias("size")).agg(F.count("*").alias("rows")).orderBy(F.desc("size")).collect()
    left, least, part = limit, -1, 1.0
    for r in spread:
        least, part = r["size"], min(1.0, left / r["rows"])
        left -= r["rows"]
        if left <= 0:
            break
    turn = F.pmod(F.xxhash64(name_col), F.lit(1 << 30))
    return counts.where((size > least) | ((size == least) & (turn < int(part * (1 << 30))))).toArrow()


def bounded(df: DataFrame, turn_col: str, limit: int) -> DataFrame:
    """All rows of `df`, or, if they are more than `limit`, about so many: those whose hash `turn_col` is small.
    The rows are counted first, so none but these leave their tasks."""
    n = df.count()
    return df if n <= limit else df.where(F.pmod(turn_col, F.lit(1 << 30)) < int(limit / n * (1 << 30)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc32_of(value: Column) -> Column:
    """CRC-32 of a value's text (null: of the empty text), as an unsigned long."""
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
