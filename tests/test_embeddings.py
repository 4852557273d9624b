"""Embeddings shared by both sides, on made pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import embeddings


def made(r, n):
    """Pairs of sentences about one of 12 subjects, with words of their own in each language."""
    rows = []
    for _ in range(n):
        subject = r.randrange(12)
        pick = lambda side: " ".join(f"{side}{subject}.{r.randrange(6)}" if r.random() < 0.8 else f"{side}x{r.randrange(9)}" for _ in range(r.randint(4, 9)))  # noqa: B023, E731
        rows.append((subject, pick("a"), pick("b")))
    return rows


def test_paired_lines_are_more_similar_than_shuffled_ones(spark):
    r = random.Random(5)
    rows = made(r, 500)
    df = spark.createDataFrame(rows, "subject int, s string, t string").repartition(4)
    table = embeddings.learn_embeddings(df, "s", "t")
    vectors = np.array([[x[c] for c in embeddings.named(16)] for x in table.collect()])
    assert vectors.T @ vectors == pytest.approx(np.eye(16), abs=1e-5)
    held_out = made(r, 100)
    other = [next(t for u, _, t in r.sample(held_out, len(held_out)) if u != subject) for subject, _, _ in held_out]
    pairs = [(k, s, t, o) for k, ((_, s, t), o) in enumerate(zip(held_out, other, strict=True))]
    judged = spark.createDataFrame(pairs, "k int, s string, t string, o string")
    judged = embeddings.similarity(embeddings.similarity(judged, "s", "t", table, "own"), "s", "o", table, "others").collect()
    assert len(judged) == 100 and sum(x.own > x.others for x in judged) >= 90


def test_unknown_and_blank_sides_have_no_similarity(spark):
    df = spark.createDataFrame([("a b", "c d"), ("a b", "c d"), ("a", None), ("", "c"), ("zz", "c")], "s string, t string")
    table = embeddings.learn_embeddings(df, "s", "t", size=2, rounds=2)
    got = embeddings.similarity(df, "s", "t", table)
    assert got.count() == 5 and got.where("s = 'zz' or s = '' or t is null").where(F.col("similarity").isNotNull()).count() == 0
    assert len({x.similarity for x in got.where("t = 'c d'").collect()}) == 1
