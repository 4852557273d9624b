"""Shared embeddings of both languages' words, from the rows they stand in together.

Words and rows make a sparse matrix; aligned rows hold words of both sides, so words that translate each other have similar
rows. Its main directions are found by randomised power iteration: vectors drawn by hash are sent from words to rows and back
by joins and means, and made orthonormal with the help of their products, a small square matrix, which is all that comes to the
driver. The embedding of a sentence is the weighted sum of its words' vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators.learned import pairs_checkpoint

WORDS = ["side", "word"]


def occurrences(pairs: DataFrame, src: str, trg: str, row: str) -> DataFrame:
    """(row, side, word): the distinct words of both sides of each row, in lower case; side 0 and 1."""
    none = F.array().cast("array<struct<side:int,word:string>>")

    def words(c: str, side: int) -> Column:
        return F.coalesce(F.transform(F.array_distinct(text.tokens(F.lower(c))), lambda w: F.struct(F.lit(side).alias("side"), w.alias("word"))), none)

    both = F.concat(words(src, 0), words(trg, 1))
    return pairs.select(F.col(row).alias("row"), F.explode(both).alias("w")).select("row", "w.side", "w.word")


def named(size: int) -> list[str]:
    return [f"v{k}" for k in range(size)]


def means(columns: list[str], weight: Column) -> list[Column]:
    return [(F.sum(F.col(c) * weight) / F.sum(weight)).alias(c) for c in columns]


def orthonormal(vectors: DataFrame, columns: list[str]) -> DataFrame:
    """`vectors` less their mean, which is what all words have in common, turned and scaled so that their columns are orthonormal (by the Cholesky
    factor of their products)."""
    size = len(columns)
    middle = vectors.agg(*[F.avg(c).alias(c) for c in columns]).first()
    vectors = vectors.select(*WORDS, "weight", *[(F.col(c) - F.lit(middle[c] or 0.0)).alias(c) for c in columns])
    products = vectors.agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"p{i}_{j}") for i in range(size) for j in range(i + 1)]).first()
    gram = np.zeros((size, size))
    for i in range(size):
        for j in range(i + 1):
            gram[i, j] = gram[j, i] = products[f"p{i}_{j}"] or 0.0
    turn = np.linalg.inv(np.linalg.cholesky(gram + 1e-9 * max(np.trace(gram), 1e-300) * np.eye(size)))
    turned = [sum((F.col(columns[j]) * float(turn[i, j]) for j in range(i + 1)), F.lit(0.0)).alias(columns[i]) for i in range(size)]
    return vectors.select(*WORDS, "weight", *turned)


def learn_embeddings(pairs: DataFrame, src: str, trg: str, size: int = 16, rounds: int = 5, least_rows: int = 2, seed: int = 0) -> DataFrame:
    """A table (side, word, weight, v0, v1, ...): the weight of each word that stands in `least_rows` rows (the logarithm of how rare it is) and its vector. Words are
    kept apart by side. The table grows with the vocabulary and is never broadcast by this module; vectors are drawn by hash, so reruns agree."""
    columns, number = named(size), F.monotonically_increasing_id()
    found = pairs_checkpoint(occurrences(pairs.withColumn("__row", number), src, trg, "__row"))
    rows = max(found.select("row").distinct().count(), 1)
    weights = found.groupBy(*WORDS).agg(F.count("*").alias("n")).where(F.col("n") >= least_rows).select(*WORDS, F.log(1 + F.lit(rows) / F.col("n")).alias("weight"))
    drawn = [(F.pmod(F.xxhash64(*WORDS, F.lit(seed), F.lit(k)), F.lit(1 << 20)) / (1 << 20) - 0.5).alias(c) for k, c in enumerate(columns)]
    vectors = pairs_checkpoint(weights.select(*WORDS, "weight", *drawn))
    for _ in range(rounds):
        of_rows = found.join(vectors, WORDS).groupBy("row").agg(*means(columns, F.col("weight")))
        back = found.join(of_rows, "row").join(weights, WORDS).groupBy(*WORDS).agg(F.max("weight").alias("weight"), *means(columns, F.col("weight")))
        vectors = orthonormal(pairs_checkpoint(back), columns)
    return pairs_checkpoint(vectors)


def similarity(pairs: DataFrame, src: str, trg: str, table: DataFrame, name: str = "similarity") -> DataFrame:
    """`pairs` with the cosine of the two sides' embeddings; null where a side has no known word."""
    columns = [c for c in table.columns if c not in (*WORDS, "weight")]
    rows = pairs_checkpoint(pairs.withColumn("__row", F.monotonically_increasing_id()))
    known = occurrences(rows, src, trg, "__row").join(table, WORDS)
    sides = [F.sum(F.when(F.col("side") == k, F.col(c) * F.col("weight"))).alias(f"{c}_{k}") for k in (0, 1) for c in columns]
    summed = known.groupBy("row").agg(*sides)

    def dot(a: int, b: int) -> Column:
        return sum((F.col(f"{c}_{a}") * F.col(f"{c}_{b}") for c in columns), F.lit(0.0))

    scores = summed.select(F.col("row").alias("__row"), F.try_divide(dot(0, 1), F.sqrt(dot(0, 0)) * F.sqrt(dot(1, 1))).alias(name))
    return rows.join(scores, "__row", "left").drop("__row")
