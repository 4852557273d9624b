"""Scores of rows, computed once for each distinct text, and thresholds on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.vectors import cosine
from corpusloom.operators.predicates import FLAG
from corpusloom.operators.spec import BILINGUAL, Param, define

Scorer = Callable[..., Column]
COMPARISONS = {
    "lt": lambda s, t: s < t,
    "le": lambda s, t: s <= t,
    "eq": lambda s, t: s == t,
    "ne": lambda s, t: s != t,
    "ge": lambda s, t: s >= t,
    "gt": lambda s, t: s > t,
}


def with_score(
    df: DataFrame, columns: Sequence[str], scorer: Scorer, name: str = "score", cache: str | None = None, distinct: bool = True
) -> DataFrame:
    """`df` with the score (a double) that `scorer` gives to the columns.

    `scorer` is a function of columns: an expression, or a pandas UDF around a model. With `distinct`
    each different text is scored once, which pays for expensive scorers; `cache` is a Parquet table
    of texts and scores that is read first and to which new ones are added. Texts are compared in
    full, not by hashes.
    """
    columns = list(columns)
    if not distinct and cache is None:
        return df.withColumn(name, scorer(*[F.col(c) for c in columns]).cast("double"))
    spark = df.sparkSession
    texts = df.select(*columns).distinct()
    known = read_if_present(spark, cache)
    if known is not None:
        new = texts.join(known, columns, "left_anti")
        fresh = new.select(*columns, scorer(*[F.col(c) for c in columns]).cast("double").alias("score"))
        fresh.write.mode("append").parquet(cache)
    else:
        fresh = texts.select(*columns, scorer(*[F.col(c) for c in columns]).cast("double").alias("score"))
        if cache is not None:
            fresh.write.mode("append").parquet(cache)
    scored = (fresh if cache is None else spark.read.parquet(cache)).withColumnRenamed("score", name)
    return df.drop(name).join(scored, columns, "left")


def read_if_present(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The Parquet table at `path`, or None if there is none yet."""
    if path is None:
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def threshold(df: DataFrame, score: Column | str, value: float, comparison: str = "ge") -> DataFrame:
    """Rows whose score compares so with `value`; rows without a score go."""
    score = F.col(score) if isinstance(score, str) else score
    return df.where(COMPARISONS[comparison](score, F.lit(float(value))))


def length_agreement(src: Column, trg: Column) -> Column:
    """A scorer that needs no model: the shorter length over the longer."""
    low, high = F.least(F.length(src), F.length(trg)), F.greatest(F.length(src), F.length(trg))
    return F.coalesce(F.try_divide(low.cast("double"), high), F.lit(0.0))


def trigram_embedding(c: Column, size: int = 64) -> Column:
    """Counts of hashed character trigrams: an embedding that needs no model."""
    n = F.length(c)
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.pmod(F.xxhash64(F.lower(F.substring(c, i, F.lit(3)))), F.lit(size))))
    numbers = F.sequence(F.lit(0), F.lit(size - 1))
    counts = F.transform(
        F.array(grams), lambda found: F.transform(numbers, lambda k: F.size(F.filter(found, lambda g: g == k)).cast("double"))
    )
    return F.when(n >= 3, F.element_at(counts, 1))


EMBEDDINGS: dict[str, Callable[[Column], Column]] = {"trigram": trigram_embedding}
SCORERS: dict[str, Scorer] = {"length": length_agreement}


@define(
    "laser_similarity", BILINGUAL, "Keep pairs whose embeddings (of a plugged-in model) are similar.", "keep",
    THRESHOLD=Param("float", 0.5), SRCLANG=Param("str"), TGTLANG=Param("str"), EMBEDDING=Param("str", "trigram"),
)
def laser_similarity(p, columns):
    embed = EMBEDDINGS[p["EMBEDDING"]]
    return F.coalesce(cosine(embed(columns[0]), embed(columns[1])) >= p["THRESHOLD"], F.lit(False))


@define(
    "bicleaner_hardrules", BILINGUAL, "Keep pairs that a plugged-in scorer of hard rules gives 1.", "keep",
    LANG1=Param("str", ""), LANG2=Param("str", ""), LM_THRESHOLD=Param("float", 0.5), DISABLE_LM_FILTER=FLAG,
    DISABLE_PORN_REMOVAL=FLAG, DISABLE_MINIMAL_LENGTH=FLAG, SCORER=Param("str", ""),
)
def bicleaner_hardrules(p, columns):
    """Without a plugged-in scorer, a few rules of its kind: neither side empty, too short (three
    words), overlong, equal to the other, or without letters."""
    from corpusloom.functions import text

    if p["SCORER"]:
        return SCORERS[p["SCORER"]](*columns) == 1
    keep = F.lower(columns[0]) != F.lower(columns[1])
    for c in columns:
        keep = keep & c.rlike(r"\p{L}") & (F.length(c) <= 1024)
        if not p["DISABLE_MINIMAL_LENGTH"]:
            keep = keep & (text.n_tokens(c) >= 3)
    return keep
