"""Duplicates: first occurrences, the best of each group, and keys that ignore small differences.

First occurrences come from an aggregate of each key's smallest position, which combines before
the shuffle, and a join on the position, which is unique; so a key that many rows have is no
bottleneck.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators.rewrites import FLAG, deescape
from corpusloom.operators.spec import BILINGUAL, Param, define


def plain_key(c: Column) -> Column:
    """Lower case, letters only."""
    return F.regexp_replace(F.lower(c), r"\P{L}+", "")


MARKS = re.compile("[\u0300-\u036f]")


def latin_key(c: Column) -> Column:
    """As `plain_key`, without diacritics; only texts beyond ASCII are handed to Python, others travel as null. Arrow
    batches are read text by text: by way of pandas, a worker's memory grew with the input."""
    @F.arrow_udf("string")
    def bare(values: pa.Array) -> pa.Array:
        texts = (v.as_py() for v in values)
        return pa.array((t and MARKS.sub("", unicodedata.normalize("NFKD", t)) for t in texts), pa.string())

    special = F.translate(c, "ßøłđðþæœıØŁĐÐÞÆŒ", "sold" + "dtaoiOLDDTAO")
    return plain_key(F.coalesce(bare(F.when(c.rlike(r"[^\x00-\x7f]"), special)), c))


def named(key: Column) -> Column:
    """128 bits that stand for a key, in shuffles and in stored tables: two hashes with seeds of their own. A null key, whatever its
    column, is null."""
    return text.let(key, lambda k: F.when(k.isNotNull(), F.struct(F.xxhash64(k).alias("high"), F.xxhash64(F.lit(1), k).alias("low"))))


KEYS = {"exact": lambda c: c, "plain": plain_key, "latin": latin_key}


def with_keys(df: DataFrame, columns: Sequence[str], key: str = "exact") -> DataFrame:
    """`df` with a key column `<name>_key` for each of `columns`."""
    return df.withColumns({f"{c}_key": KEYS[key](F.col(c)) for c in columns})


def keep_first(df: DataFrame, columns: Sequence[str], order: Sequence[str] = ("line_no",), key: str = "exact", once: bool = False) -> DataFrame:
    """Rows in which the key of every one of `columns` occurs for the first time in `order`. A row that
    is dropped for one column still counts as the first for the others. `order` must tell all rows
    apart. Keys are shuffled by their names, 128 bits. `df` is read for its keys and again for the join; `once`, where it costs more
    to make than to shuffle, deals it by `order` first, and both read that one shuffle."""
    rows = df.select(F.struct(*order).alias("__order"), *[F.col(c) for c in df.columns if c not in order])
    rows = rows.repartition("__order") if once else rows
    whole = [F.col("__order")[c].alias(c) if c in order else F.col(c) for c in df.columns]
    keys = [F.struct(F.lit(k).alias("column"), named(KEYS[key](F.col(c))).alias("key")) for k, c in enumerate(columns)]
    keyed = rows.select("__order", *whole).select("__order", F.explode(F.array(*keys)).alias("k"))
    firsts = keyed.groupBy("k").agg(F.min("__order").alias("__order"))
    everywhere = firsts.groupBy("__order").count().where(F.col("count") == len(columns)).select("__order")
    # Not a left_semi join, which would be taken back below the shuffle of one side. Of each order there is one row.
    return rows.join(everywhere, "__order").select(*whole)


def drop_known(df: DataFrame, seen: DataFrame, columns: Sequence[str], key: str = "exact") -> DataFrame:
    """Rows none of whose keys are in `seen`, a table of (column, key) from `known_keys`."""
    out = df
    for c in columns:
        own = seen.where((F.col("column") == c) & F.col("key").isNotNull()).select(F.col("key").alias("__known"))
        out = out.join(own, named(KEYS[key](out[c])) == own["__known"], "left_anti")
    return out


def known_keys(df: DataFrame, columns: Sequence[str], key: str = "exact") -> DataFrame:
    """The distinct keys of each column by their names, to be stored for later runs."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), named(KEYS[key](F.col(c))).alias("key")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def dedup_files(files: Sequence[DataFrame], columns: Sequence[str], key: str = "plain") -> DataFrame:
    """`keep_first` over several corpora in order; adds file_rank. Each needs a line_no."""
    ranked = [f.withColumn("file_rank", F.lit(k)) for k, f in enumerate(files)]
    every = ranked[0]
    for other in ranked[1:]:
        every = every.unionByName(other)
    return keep_first(every, columns, ("file_rank", "line_no"), key)


def best_of_duplicates(df: DataFrame, group: str, rank: str, order: str = "line_no") -> DataFrame:
    """Of each group the row with the highest rank, the first of equal ones; `first_place` is where the
    group was first seen, for ordering the result."""
    best = df.groupBy(group).agg(
        F.max(F.struct(F.col(rank), (-F.col(order)).alias("o"))).alias("b"), F.min(order).alias("first_place")
    )
    return df.join(best.select((-F.col("b.o")).alias(order), "first_place"), order)


@define(
    "bifixer", BILINGUAL, "Clean both sides and keep the best of near-identical pairs (a substitute for the external tool).", "frame",
    SRCLANG=Param("str"), TRGLANG=Param("str"), IGNORE_CHARACTERS=FLAG, IGNORE_NORMALIZATION=FLAG, IGNORE_HTML=FLAG,
    IGNORE_EMPTY=FLAG, IGNORE_LONG=FLAG, IGNORE_ORTHOGRAPHY=FLAG, IGNORE_DETOKENIZATION=FLAG, IGNORE_DUPLICATES=FLAG,
    AGGRESSIVE_DEDUP=FLAG, IGNORE_SEGMENTATION=Param("bool", True), WORDS_BEFORE_SEGMENTING=Param("int", 15),
    SEGMENTER=Param("str", "nltk"),
)
def bifixer(df: DataFrame, langs: list[str], p: dict) -> DataFrame:
    """White space, entities and HTML tags; empty and overlong rows; then of pairs with equal keys the one
    with the most letters. Needs a line_no unless IGNORE_DUPLICATES."""
    for c in langs[:2]:
        column = F.col(c)
        if not p["IGNORE_HTML"]:
            column = F.regexp_replace(deescape(column), r"</?[A-Za-z][^<>]*>", "")
        if not p["IGNORE_CHARACTERS"]:
            column = F.translate(column, "‘’‚‛“”„‟­​﻿", "''''\"\"\"\"")
        if not p["IGNORE_NORMALIZATION"]:
            column = text.collapse(column)
        df = df.withColumn(c, column)
    if not p["IGNORE_EMPTY"]:
        for c in langs[:2]:
            df = df.where(~text.is_blank(F.col(c)))
    if not p["IGNORE_LONG"]:
        for c in langs[:2]:
            df = df.where(F.length(c) <= 5000)
    if p["IGNORE_DUPLICATES"]:
        return df
    key = plain_key if p["AGGRESSIVE_DEDUP"] else (lambda c: c)
    letters = sum((F.regexp_count(F.col(c), F.lit(r"\p{L}")) for c in langs[1:2]), F.regexp_count(F.col(langs[0]), F.lit(r"\p{L}")))
    keyed = df.withColumn("__key", F.struct(*[key(F.col(c)) for c in langs[:2]])).withColumn("__rank", letters)
    return best_of_duplicates(keyed, "__key", "__rank").select(*df.columns)
