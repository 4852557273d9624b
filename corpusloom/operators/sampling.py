"""Head, middle and tail samples, and the first lines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_lines(df: DataFrame, n: int, order: str = "line_no") -> DataFrame:
    """The lines before the n-th, by their numbers (gapless from 0)."""
    return df.where(F.col(order) < n)


def sample(df: DataFrame, k: int = 10, order: str = "line_no", seed: int = 0, middle: bool = True) -> DataFrame:
    """The first k lines, k random ones between, and the last k, in order; `order` is gapless from 0.
    Up to 2k lines there is no middle, and up to k lines only a head. The middle is drawn by a
    hash of the line number and the seed, so it is the same each time."""
    if k <= 0:
        return df.limit(0)
    n = (df.agg(F.max(order)).first()[0] or 0) + 1
    ends = df.where((F.col(order) < k) | (F.col(order) >= max(n - k, k)))
    if not middle or n <= 2 * k:
        return ends.orderBy(order)
    between = df.where((F.col(order) >= k) & (F.col(order) < n - k))
    drawn = between.orderBy(F.xxhash64(order, F.lit(seed)), order).limit(k)  # k is the size of a preview
    return ends.unionByName(drawn).orderBy(order)


def sample_all(corpora: Mapping[str, DataFrame], folder: str, k: int = 10, order: str = "line_no", force: bool = False) -> dict[str, str | Exception]:
    """Write the sample of each corpus to `folder`/name as Parquet; samples that are there are kept unless `force`.
    Returns what became of each: "written", "kept" or the error; an error does not stop the others."""
    done: dict[str, str | Exception] = {}
    for name, df in corpora.items():
        try:
            path = f"{folder.rstrip('/')}/{name}"
            if not force and _exists(df, path):
                done[name] = "kept"
                continue
            sample(df, k, order).write.mode("overwrite").parquet(path)
            done[name] = "written"
        except Exception as error:  # reported to the caller, corpus by corpus
            done[name] = error
    return done


def _exists(df: DataFrame, path: str) -> bool:
    from corpusloom.operators.scoring import read_if_present

    return read_if_present(df.sparkSession, path) is not None
