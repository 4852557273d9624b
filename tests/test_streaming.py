"""Streams with state: their results are those of the batch operators, over several triggers and a new start."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import dedup
from corpusloom.streaming import clean


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join("\t".join(r) + "\n" for r in rows))


def some_rows(r, n):
    return [(r.choice(["a", "A!", "b", "c", "d d", "e", ""]) + str(r.randrange(6)), r.choice("uvwxyz") + r.choice(["", "?", "1"])) for _ in range(n)]


def test_first_occurrences_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    r, folder, seen = random.Random(2), tmp_path / "in", []
    for k in range(3):
        rows = some_rows(r, 25)
        seen += rows
        put(folder, f"{k}.tsv", rows)
        stream = clean.read_stream(spark, str(folder), ["src", "trg"]).drop("path")  # each trigger is a new start from the checkpoint
        query = clean.dedup_stream(stream, ["src", "trg"], str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
        query.awaitTermination(120)
        whole = spark.createDataFrame([(i, *row) for i, row in enumerate(seen)], "line_no long, src string, trg string")
        want = sorted((x.src, x.trg) for x in dedup.keep_first(whole, ["src", "trg"], key="plain").collect())
        assert sorted((x.src, x.trg) for x in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    query = clean.dedup_stream(stream, ["src", "trg"], str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
    query.awaitTermination(120)  # nothing new
    assert sorted((x.src, x.trg) for x in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_best_of_a_stream_is_that_of_a_batch(spark, tmp_path):
    r, folder, seen = random.Random(3), tmp_path / "in", []
    for k in range(3):
        rows = [(f"g{r.randrange(8)}", str(r.randrange(12)), f"t{k}.{n}") for n in range(20)]
        seen += rows
        put(folder, f"{k}.tsv", rows)
        stream = clean.read_stream(spark, str(folder), ["g", "rank", "t"]).select("g", F.col("rank").cast("int").alias("rank"), "t")
        clean.best_stream(stream, "g", "rank", str(tmp_path / "out"), str(tmp_path / "state"), available_now=True).awaitTermination(120)
        whole = spark.createDataFrame([(i, g, int(n), t) for i, (g, n, t) in enumerate(seen)], "line_no long, g string, rank int, t string")
        want = sorted((x.g, x["rank"], x.t) for x in dedup.best_of_duplicates(whole, "g", "rank").collect())
        assert sorted((x.g, x["rank"], x.t) for x in clean.best_so_far(spark, str(tmp_path / "out"), "g", "rank").collect()) == want
