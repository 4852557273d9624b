"""Corpora as DataFrames: a file for each language with a line for each row, or tab-separated lines.

Each frame has line_no (gapless from 0, the order of the lines) and a string column for each
language.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """(line_no, column) of one text file, compressed or not. Lines end with a line feed; carriage
    returns before it are cut off. A file is read in blocks; each block counts its lines, and the
    counts, one for each block, give the first number of the next."""
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    # One row for each block of the file, so the window and the broadcast are as short as its list of blocks.
    blocks = raw.groupBy("block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    numbered = raw.join(F.broadcast(starts), "block")
    return numbered.select((F.col("place") + F.col("shift")).alias("line_no"), F.regexp_replace("value", "\r+$", "").alias(column))


def read_parallel(spark: SparkSession, paths: dict[str, str], pad: bool = True) -> DataFrame:
    """Line-aligned files, {language: path}. Shorter files are padded with empty lines, or with
    pad=False all are cut to the shortest."""
    frames = [read_lines(spark, path, lang) for lang, path in paths.items()]
    if not pad:
        return reduce(lambda a, b: a.join(b, "line_no"), frames)
    joined = reduce(lambda a, b: a.join(b, "line_no", "full_outer"), frames)
    return joined.select("line_no", *[F.coalesce(lang, F.lit("")).alias(lang) for lang in paths])


def split_columns(lines: DataFrame, langs: Sequence[str], column: str = "text", strict: bool = True) -> DataFrame:
    """Tab-separated lines as columns. Quotes are characters like others. Lines with another number of
    fields are an error with `strict`; else missing fields are empty and others dropped."""
    fields = F.split(F.col(column), "\t", -1)
    if strict:
        message = F.concat(F.lit(f"{len(langs)} fields are needed in: "), F.col(column))
        fields = F.when(F.size(fields) == len(langs), fields).otherwise(F.raise_error(message).cast("array<string>"))
    parts = [F.coalesce(F.get(fields, F.lit(k)), F.lit("")).alias(lang) for k, lang in enumerate(langs)]
    return lines.select(*[c for c in lines.columns if c != column], *parts)


def read_tsv(spark: SparkSession, path: str, langs: Sequence[str], strict: bool = True) -> DataFrame:
    return split_columns(read_lines(spark, path, "__line"), langs, "__line", strict)


def write_tsv(df: DataFrame, path: str, langs: Sequence[str], order: str | None = "line_no", compression: str | None = None) -> None:
    """Tab-separated text, in order over the part files."""
    ordered = df if order is None else df.orderBy(order)
    ordered.select(F.concat_ws("\t", *langs).alias("value")).write.text(path, compression=compression)


def write_parallel(df: DataFrame, paths: dict[str, str], order: str = "line_no", compression: str = "gzip") -> None:
    """A text folder for each language; lines are aligned by part file and place."""
    ordered = df.orderBy(order).persist()
    for lang, path in paths.items():
        ordered.select(F.col(lang).alias("value")).write.text(path, compression=compression)
    ordered.unpersist()


def spread(df: DataFrame) -> DataFrame:
    """`df` in at least as many partitions as the session has cores. Only input that lies in fewer pieces, such as one file
    that cannot be split, is dealt anew; larger input stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pairs_of_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, src, trg): each line of a document with the next. The lines are paired within their
    row, so nothing is shuffled but documents in too few pieces."""
    several = spread(docs.select(id_col, text_col)).where(F.contains(text_col, F.lit("\n")))
    lines = several.select(id_col, F.split(text_col, "\n", -1).alias("lines"))
    n = F.size("lines") - 1
    both = F.arrays_zip(F.slice("lines", 1, n).alias("src"), F.slice("lines", 2, n).alias("trg"))
    paired = lines.select(id_col, F.posexplode(both).alias("line_no", "pair"))
    return paired.select(id_col, F.col("line_no").cast("long").alias("line_no"), "pair.src", "pair.trg")


def pairs_of_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, line_no, src, trg): each user turn with the assistant's answer, line breaks as spaces."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    one_line = F.replace("text", F.lit("\n"), F.lit(" "))
    paired = turns.select(
        "conv_id",
        F.col("turn").alias("line_no"),
        F.lag("role").over(order).alias("before"),
        "role",
        F.lag(one_line).over(order).alias("src"),
        one_line.alias("trg"),
    )
    return paired.where("before = 'user' and role = 'assistant'").drop("before", "role")
