"""Recipes over files that keep arriving."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.operators.dedup import KEYS, named
from corpusloom.plans.pipeline import Pipeline
from corpusloom.sources.corpus import split_columns


def read_stream(spark: SparkSession, folder: str, langs: Sequence[str], files_per_trigger: int = 100) -> DataFrame:
    """Tab-separated lines of the text files that come into `folder`, with the file's path."""
    lines = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r+$", "").alias("__line"))
    return split_columns(lines, langs, "__line", strict=False)


def clean_stream(
    stream: DataFrame, pipeline: Pipeline, langs: Sequence[str], output: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Run the stateless steps of a recipe over the stream, into Parquet."""
    writer = pipeline.run(stream, langs).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).outputMode("append").start()


def with_places(stream: DataFrame) -> DataFrame:
    """Adds `__place`, which tells a batch's rows apart and rises in the order in which tasks read them."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = TaskContext.get().partitionId() << 33
        for batch in batches:
            numbers = pa.array(range(after, after + batch.num_rows), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, numbers], [*batch.schema.names, "__place"])
            after += batch.num_rows

    return stream.mapInArrow(place, StructType([*stream.schema.fields, StructField("__place", LongType())]))


def dedup_stream(
    stream: DataFrame, columns: Sequence[str], output: str, checkpoint: str, key: str = "plain", available_now: bool = False
) -> StreamingQuery:
    """Rows in which the key of every one of `columns` occurs for the first time, over all batches, into Parquet folders of `output`, one for
    each batch, so that a batch that is run again replaces its own rows. That a key was seen is state, kept by Spark's state store with the
    checkpoint and looked up by key; no batch reads the keys of others again. Within a batch rows come in the order in which its tasks read them."""
    keys = F.array(*[F.struct(F.lit(k).alias("column"), named(KEYS[key](F.col(c))).alias("key")) for k, c in enumerate(columns)])
    placed = with_places(stream)
    names, schema = stream.columns, placed.schema
    key_parts = {"__column": F.col("__k.column"), **{f"__{x}": F.coalesce(f"__k.key.{x}", F.lit(0)) for x in ("high", "low")}}
    placed = placed.withColumn("__k", F.explode(keys)).withColumns(key_parts).drop("__k")

    def first(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        best = None
        for rows in batches:
            row = rows.loc[[rows["__place"].idxmin()]]
            best = row if best is None or row["__place"].iloc[0] < best["__place"].iloc[0] else best
        state.update((True,))
        yield best[[*names, "__place"]]

    firsts = placed.groupBy(*key_parts).applyInPandasWithState(first, schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)

    def batch(df: DataFrame, number: int) -> None:
        everywhere = df.groupBy("__place").agg(F.count("*").alias("n"), *[F.any_value(c).alias(c) for c in names]).where(F.col("n") == len(columns))
        everywhere.select(*names).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = firsts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def best_stream(stream: DataFrame, group: str, rank: str, output: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Of each group the row with the highest `rank` so far, the first of equal ones. A group's best rank is its state; a batch writes the rows that beat
    it to a folder of its own. `best_so_far` reads the result. Rows without group or rank are none."""
    placed = with_places(stream.where(F.col(group).isNotNull() & F.col(rank).isNotNull()))

    names = stream.columns

    def better(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        most, best = state.get[0] if state.exists else None, None
        for rows in batches:
            row = rows.sort_values([rank, "__place"], ascending=[False, True]).iloc[:1]
            place = (float(row[rank].iloc[0]), -int(row["__place"].iloc[0]))
            if best is None or place > best[0]:
                best = place, row
        if best is not None and (most is None or best[0][0] > most):
            state.update((best[0][0],))
            yield best[1][names]

    found = placed.groupBy(group).applyInPandasWithState(better, stream.schema, "rank double", "append", GroupStateTimeout.NoTimeout)

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def best_so_far(spark: SparkSession, output: str, group: str, rank: str) -> DataFrame:
    """The best row of each group after the batches that `best_stream` has written; a group has a row for each batch that improved it."""
    found = spark.read.parquet(output)
    top = found.groupBy(group).agg(F.max(rank).alias(rank))
    return found.join(top, [group, rank], "left_semi").drop("batch")
