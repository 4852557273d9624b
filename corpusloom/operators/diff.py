"""What a step has changed, by line number, by content or in order; and differences within a text."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.functions.sequences import patience, rising, spans


def diff_rows(before: DataFrame, after: DataFrame, columns: Sequence[str], order: str = "line_no") -> DataFrame:
    """Rows (line_no, status, before, after): identical, changed, removed or added. Lines are matched by
    number, not by content; of several rows with one number (after a split), the first is matched
    and the others are added."""
    value = F.struct(*columns)
    part = F.col("part") if "part" in after.columns else F.lit(0)
    a = before.select(order, F.lit(0).alias("part"), value.alias("before"))
    b = after.select(order, part.alias("part"), value.alias("after"))
    joined = a.join(b, [order, "part"], "full_outer")
    status = (
        F.when(F.col("after").isNull(), "removed")
        .when(F.col("before").isNull(), "added")
        .when(F.col("before") == F.col("after"), "identical")
        .otherwise("changed")
    )
    return joined.select(order, "part", status.alias("status"), "before", "after")


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("n"))


def diff_by_content(before: DataFrame, after: DataFrame, columns: Sequence[str], order: str = "line_no") -> DataFrame:
    """Rows (status, before_no, after_no, before, after), matched by content, wherever they are: equal rows are
    identical, each matched once, in order; of the others, those with an equal column (the first of `columns` that
    matches) are changed; the rest is removed or added. Rows are matched by joins on content and the number of
    equal rows before, so no frame is held in one task."""
    value = F.struct(*columns)
    a = before.select(F.col(order).alias("before_no"), value.alias("before"))
    b = after.select(F.col(order).alias("after_no"), value.alias("after"))
    matched = None
    for how, keys in (("identical", None), *(("changed", c) for c in columns)):
        key_a, key_b = ("before", "after") if keys is None else (f"before.{keys}", f"after.{keys}")
        left = a.withColumn("key", F.col(key_a)).withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy("before_no")))
        right = b.withColumn("key", F.col(key_b)).withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy("after_no")))
        found = left.join(right, ["key", "turn"]).select(F.lit(how).alias("status"), "before_no", "after_no", "before", "after")
        matched = found if matched is None else matched.unionByName(found)
        a = a.join(found.select("before_no"), "before_no", "left_anti")
        b = b.join(found.select("after_no"), "after_no", "left_anti")
    none = F.lit(None)
    removed = a.select(F.lit("removed").alias("status"), "before_no", none.cast(b.schema["after_no"].dataType).alias("after_no"), "before",
                       none.cast(b.schema["after"].dataType).alias("after"))
    added = b.select(F.lit("added").alias("status"), none.cast(a.schema["before_no"].dataType).alias("before_no"), "after_no",
                     none.cast(a.schema["before"].dataType).alias("before"), "after")
    return matched.unionByName(removed).unionByName(added)


def row_name(columns: Sequence[str]) -> Column:
    """128 bits for the values of several columns, nulls told apart from the rest."""
    values = [v for c in columns for v in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(*values).alias("high"), F.xxhash64(F.lit(1), *values).alias("low"))


#: Lines that both frames have once in a cell: a task's call takes time, however short its cell.
CELL_ANCHORS = 1000


def coarse_path(before: DataFrame, after: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of lines that are unique in both frames and rise in both. `most` bounds what is brought to the driver: of more such lines,
    those with a small hash are taken. Of their longest rising chain so many are kept that a cell has about CELL_ANCHORS."""
    sides = []
    for df, name in ((before, "before_no"), (after, "after_no")):
        once = df.groupBy("name").agg(F.count("*").alias("n"), F.min(name).alias(name)).where("n = 1")
        sides.append(once.select("name", name))
    anchors = sides[0].join(sides[1], "name").select("before_no", "after_no", F.pmod(F.col("name.low"), F.lit(1 << 30)).alias("turn"))
    n = anchors.count()
    rows = anchors.where(F.col("turn") < int(min(1.0, most / max(n, 1)) * (1 << 30))).select("before_no", "after_no").toPandas().sort_values("before_no")
    kept = rows.iloc[rising(rows["after_no"].tolist())]
    kept = kept.iloc[:: max(1, len(kept) * CELL_ANCHORS // max(n, 1))]
    return kept["before_no"].to_numpy(np.int64), kept["after_no"].to_numpy(np.int64)


def numbered(sides: Sequence[Sequence[pa.Array]]) -> list[list[tuple]]:
    """The rows of some columns of two frames, texts as numbers that are equal where the texts are."""
    columns = []
    for a, b in zip(*sides, strict=True):
        both = pa.concat_arrays([a, b])
        columns.append(both.dictionary_encode(null_encoding="encode").indices.to_pylist() if pa.types.is_string(both.type) else both.to_pylist())
    rows, n = list(zip(*columns, strict=True)), len(sides[0][0])
    return [rows[:n], rows[n:]]


def diff_ordered(before: DataFrame, after: DataFrame, columns: Sequence[str], order: str = "line_no", most_anchors: int = 200_000) -> DataFrame:
    """An edit script: rows (status, before_no, after_no, before, after), matched by content so that matches rise in both frames. Rows with
    the same `columns` are identical, those with one column in common changed, the rest removed or added.

    Lines that both frames have once are anchors. A longest rising chain of them (of about `most_anchors`, by hash, where there are more)
    cuts both frames into cells, at the same lines; each cell is a task's work: anchors within it, again in a longest rising
    chain, and between them longest common subsequences. A cell holds as many lines as lie between two anchors of the chain. Null
    columns are equal to each other; `order`, a number, tells the rows of a frame apart."""
    value, types = F.struct(*columns), before.select(F.struct(*columns).alias("v")).schema["v"].dataType.simpleString()
    ids = F.col(order).cast("long")
    a = before.select(ids.alias("before_no"), row_name(columns).alias("name"), value.alias("before"))
    b = after.select(ids.alias("after_no"), row_name(columns).alias("name"), value.alias("after"))
    paths = coarse_path(a, b, most_anchors)

    def in_cells(df: DataFrame, name: str, path: np.ndarray) -> DataFrame:
        @F.pandas_udf("long")
        def cell(numbers: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(path, numbers.to_numpy(np.int64), side="right"))

        return df.select(cell(name).alias("cell"), F.col(name).alias("no"), F.col("before" if name == "before_no" else "after").alias("v"))

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("no"), right.sort_by("no")
        names = range(left.column("v").type.num_fields)
        x, y = numbered([[t.column("v").combine_chunks().field(k) for k in names] for t in (left, right)])
        pairs = patience(x, y)
        gone = sorted(set(range(len(x))) - {i for i, _ in pairs})
        new = sorted(set(range(len(y))) - {j for _, j in pairs})
        i = pa.array([i for i, _ in pairs] + gone + [None] * len(new), pa.int64())
        j = pa.array([j for _, j in pairs] + [None] * len(gone) + new, pa.int64())
        status = ["identical" if x[m] == y[n] else "changed" for m, n in pairs] + ["removed"] * len(gone) + ["added"] * len(new)
        nullable = pa.struct([pa.field(f.name, f.type) for f in left.column("v").type])
        values = (t.column("v").take(k).cast(nullable) for t, k in ((left, i), (right, j)))
        parts = [pa.array(status, pa.string()), left.column("no").take(i), right.column("no").take(j), *values]
        return pa.Table.from_arrays(parts, ["status", "before_no", "after_no", "before", "after"])

    left, right = in_cells(a, "before_no", paths[0]).groupBy("cell"), in_cells(b, "after_no", paths[1]).groupBy("cell")
    return left.cogroup(right).applyInArrow(match, f"status string, before_no long, after_no long, before {types}, after {types}")


def inline_diff(before: Column, after: Column, most: float = 0.5) -> Column:
    """Spans (equal, delete, insert) that turn one text into the other, a shortest script by characters. Null where more characters go and come
    than `most` of the longer text, or where a text is null. Equal texts, and texts whose lengths alone say no, stay with Spark."""

    @F.arrow_udf("array<struct<kind:string,text:string>>")
    def found(befores: pa.Array, afters: pa.Array) -> pa.Array:
        kinds, texts, ends = [], [], [0]
        for x, y in zip(befores.to_pylist(), afters.to_pylist(), strict=True):
            for kind, part in (x is not None and y is not None and spans(x, y, most)) or ():
                kinds.append(kind)
                texts.append(part)
            ends.append(len(kinds))
        parts = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(texts, pa.string())], ["kind", "text"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)

    found = found.asNondeterministic()  # or a condition on the spans has them made once more, for itself

    equal = F.filter(F.array(F.struct(F.lit("equal").alias("kind"), before.alias("text"))), lambda s: s["text"] != "")
    hopeless = F.abs(F.length(before) - F.length(after)) > F.lit(most) * F.greatest(F.length(before), F.length(after))
    open_pair = before.isNotNull() & after.isNotNull() & (before != after) & ~hopeless
    answer = found(F.when(open_pair, before), F.when(open_pair, after))
    # Texts that differ have a span at least, so none is said by an empty list.
    return F.when(before == after, equal).otherwise(text.let(answer, lambda s: F.when(F.size(s) > 0, s)))


def visible_spaces(c: Column) -> Column:
    """Spaces as middle dots, other blanks of their kind as open boxes."""
    blanks = "               　"
    return F.translate(c, " " + blanks, "·" + "␣" * len(blanks))
