"""Common suffixes of consecutive lines.

A run of `min_occurrences` lines or more with a common suffix loses it, and so do the lines after
them while they end so. Within a run all neighbours share `min_length` characters at least; where
two neighbours share fewer, no run crosses. Lines are dealt into ranges of their order, so no task has
all of them; what a range needs of the ranges before it is its neighbour's last line and where the last
such island began, a row for each range. Only within an island of sufficient length is the order of
decisions followed, line after line as they stream through a task, on the lengths of the shared
suffixes alone.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import common_suffix_length
from corpusloom.operators.learned import pairs_checkpoint
from corpusloom.operators.spec import MONOLINGUAL, Param, define


class Island:
    """Decides, line after line, how many characters each loses. At most `occurrences` lines are undecided."""

    def __init__(self, min_length: int, occurrences: int):
        self.least, self.occurrences = max(min_length, 1), occurrences
        self.waiting: deque[tuple[int, int, int]] = deque()
        self.run: int | None = None

    def add(self, place: int, shared: int, length: int) -> list[tuple[int, int]]:
        """The next line, and what it shares with the one before. Returns (place, characters) of the lines that this
        decides and that lose any."""
        if self.run is not None and shared >= self.run:
            return [(place, self.run)]
        self.run = None
        self.waiting.append((place, shared, length))
        if len(self.waiting) < self.occurrences:
            return []
        first, *others = self.waiting
        suffix = min(first[2], *(line[1] for line in others))
        if suffix < self.least:
            self.waiting.popleft()
            return []
        self.run = suffix
        found = [(line[0], suffix) for line in self.waiting]
        self.waiting.clear()
        return found


def _settle(min_length: int, min_occurrences: int, keys: int):
    """Rows (keys, order, island, length, shared), sorted, into (keys, order, suffix_length) of lines that lose any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        island, last, tail = Island(min_length, min_occurrences), None, None
        for batch in batches:
            # Lines that were undecided at the end of the batch before are still in `tail`.
            table = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])])
            skip = 0 if tail is None else len(tail)
            waiting = [(k, shared, length) for k, (_, shared, length) in enumerate(island.waiting)]
            island.waiting = deque(waiting)
            names = [table.column(k).to_pylist() for k in (*range(keys), keys + 1, keys + 2, keys + 3)]
            found: list[tuple[int, int]] = []
            for place in range(skip, len(table)):
                own = tuple(column[place] for column in names[: keys + 1])
                if own != last:
                    island, last = Island(min_length, min_occurrences), own
                found += island.add(place, names[-1][place], names[-2][place])
            kept = table.take(pa.array([p for p, _ in found], pa.int64())).select(range(keys + 1))
            out = kept.append_column("suffix_length", pa.array([n for _, n in found], pa.int32()))
            yield from out.combine_chunks().to_batches()
            tail = table.take(pa.array([line[0] for line in island.waiting], pa.int64()))

    return run


def shared_ending(a: str, b: str, least: int) -> int:
    """Characters in the longest common suffix; 0 if it is shorter than `least`."""
    if a[-least:] != b[-least:] or min(len(a), len(b)) < least:
        return 0
    n = least
    while n < min(len(a), len(b)) and a[-n - 1] == b[-n - 1]:
        n += 1
    return n


def _neighbours(least: int):
    """Rows (group, order, text), sorted, into (group, order, range, length, shared, edge): what a line shares with the one before it, and the
    text of the first and last line of each group in the task, which have neighbours elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, before, group, names = TaskContext.get().partitionId(), None, None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = (*names[1], pa.int32(), pa.int32(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*names[0], "range", "length", "shared", "edge"])

        for batch in batches:
            names = batch.schema.names[:2], [batch.schema.field(k).type for k in (0, 1)]
            rows = []
            for own, order, value in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                value = value or ""
                if before is not None:
                    line, text = before
                    rows.append(line if own == group else (*line[:-1], text))
                first = before is None or own != group
                line = (own, order, here, len(value), None if first else shared_ending(before[1], value, least), value if first else None)
                before, group = (line, value), own
            if rows:
                yield out(rows)
        if before is not None:
            yield out([(*before[0][:-1], before[1])])

    return run


def group_of(within: Sequence[str]) -> Column:
    """A line's group as text, which is never null."""
    return F.to_json(F.struct(*[F.col(c).cast("string") for c in within])) if within else F.lit("")


def in_ranges(df: DataFrame, column: str, order: str, within: Sequence[str]) -> DataFrame:
    """(__group, __order, __text), dealt into ranges and sorted."""
    keyed = df.select(group_of(within).alias("__group"), F.col(order).alias("__order"), F.col(column).alias("__text"))
    return keyed.repartitionByRange("__group", "__order").sortWithinPartitions("__group", "__order")


def with_suffix_lengths(
    df: DataFrame, column: str, min_length: int = 4, min_occurrences: int = 10, order: str = "line_no", within: Sequence[str] = ()
) -> DataFrame:
    """`df` with suffix_length, the characters that each line of `column` loses. Lines follow each
    other in `order`, in each group of `within` by themselves (null is a group); together they tell all lines apart.

    Texts are sorted into ranges once. What is left of a line after that is its length and what it shares with the line before; this is written
    down, so that ranges stay what they are, and all that follows works on it."""
    if min_occurrences < 2:
        raise ValueError("min_occurrences must be 2 or more")
    least, ranged = max(min_length, 1), in_ranges(df, column, order, within)
    kind = df.schema[order].dataType.simpleString()
    marked = pairs_checkpoint(ranged.mapInArrow(_neighbours(least), f"__group string, __order {kind}, range int, length int, shared int, edge string"))

    # The first line of a range is compared with the last line of the range before it: both kept their texts.
    edges = marked.where("edge is not null")
    before = F.lag("edge").over(Window.partitionBy("__group").orderBy("__order"))
    firsts = edges.select("__group", "__order", "shared", F.coalesce(common_suffix_length(before, F.col("edge"), least), F.lit(0)).alias("across"))
    firsts = firsts.where("shared is null").drop("shared")
    marked = marked.drop("edge").join(firsts, ["__group", "__order"], "left")
    marked = marked.select("__group", "__order", "range", "length", F.coalesce("shared", "across").alias("shared"))

    start = F.when(F.col("shared") < least, F.col("__order"))
    ranges = Window.partitionBy("__group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = marked.groupBy("__group", "range").agg(F.max(start).alias("start"))
    earlier = earlier.withColumn("carried", F.max("start").over(ranges)).drop("start")
    lines = Window.partitionBy("__group", "range").orderBy("__order").rowsBetween(Window.unboundedPreceding, 0)
    island = F.coalesce(F.max(start).over(lines), F.col("carried"))
    marked = marked.join(earlier, ["__group", "range"]).select("__group", "__order", island.alias("island"), "length", "shared")
    keys = ["__group", "island"]
    long_enough = marked.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= min_occurrences).drop("n")
    candidates = marked.join(long_enough, keys).repartition(*keys).sortWithinPartitions(*keys, "__order")
    candidates = candidates.select("__group", "__order", "island", "length", "shared")

    found = candidates.mapInArrow(_settle(min_length, min_occurrences, 1), f"__group string, __order {kind}, suffix_length int")
    own = df.withColumn("__group", group_of(within)).withColumn("__order", F.col(order))
    return own.join(found, ["__group", "__order"], "left").select(*df.columns, F.coalesce("suffix_length", F.lit(0)).alias("suffix_length"))


def strip_suffixes(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """The columns without their common suffixes."""
    for c in columns:
        kept = F.left(F.col(c), F.length(c) - F.col("suffix_length"))
        df = with_suffix_lengths(df, c, **options).withColumn(c, kept).drop("suffix_length")
    return df


def suffix_counts(df: DataFrame, column: str, **options) -> DataFrame:
    """Each suffix that `column` loses, and on how many lines, most frequent first."""
    found = with_suffix_lengths(df, column, **options).where("suffix_length > 0")
    suffix = F.right(F.col(column), F.col("suffix_length")).alias("suffix")
    return found.groupBy(suffix).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "suffix")


@define(
    "strip_suffix", MONOLINGUAL, "Strip the common suffix of consecutive lines.", "frame",
    MINLEN=Param("int", 4), MINOCC=Param("int", 10, minimum=2), COUNT=Param("bool", False),
)
def strip_suffix(df: DataFrame, langs: list[str], p: dict) -> DataFrame:
    within = [c for c in ("dataset",) if c in df.columns]
    return strip_suffixes(df, langs, min_length=p["MINLEN"], min_occurrences=p["MINOCC"], within=within)
