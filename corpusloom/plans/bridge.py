"""Filters of the registry as objects with score and accept, or process, as other corpus tools call them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import REGISTRY, Registry
from corpusloom.operators.reasons import MEASURES
from corpusloom.plans.pipeline import Pipeline, Step


class Filter:
    """`score` adds a column with what a row is judged by, `accept` is the condition on it, `filter` keeps the accepted
    rows and `decisions` has both side by side. For a condition the score is 1.0 or 0.0."""

    def __init__(self, name: str, language: str | None = None, registry: Registry = REGISTRY, **parameters: Any):
        spec = registry.get(name)
        if spec.keep is None or spec.rewrite is not None:
            raise ValueError(f"{name} is no condition on rows")
        self.step = Step(name, spec.fill(parameters)[0], language)
        self.pipeline = Pipeline([self.step], (), registry)

    def score(self, df: DataFrame, langs: Sequence[str], column: str = "score") -> DataFrame:
        _, keep = self.pipeline._apply(df, self.pipeline.steps[0], langs)
        return df.withColumn(column, F.coalesce(keep, F.lit(False)).cast("double"))

    def measures(self, df: DataFrame, langs: Sequence[str], column: str = "measures") -> DataFrame:
        """Adds the numbers (array<double>) that the filter compares with its thresholds, as `reasons.MEASURES` has them; null for
        filters that compare no numbers."""
        _, chosen = self.pipeline._parts(self.step, langs)
        measure = MEASURES.get(self.step.filter)
        values = measure(self.step.parameters, [F.col(c) for c in chosen]) if measure else None
        none = F.lit(None).cast("array<double>")
        return df.withColumn(column, F.array(*[v.cast("double") for v in values]) if values is not None else none)

    def accept(self, score: Column) -> Column:
        return score > 0

    def filter(self, df: DataFrame, langs: Sequence[str]) -> DataFrame:
        return self.pipeline.run(df, langs)

    def decisions(self, df: DataFrame, langs: Sequence[str], column: str = "accepted") -> DataFrame:
        scored = self.score(df, langs, "__score")
        return scored.withColumn(column, self.accept(F.col("__score"))).drop("__score")


class Preprocessor:
    """`process` rewrites the rows; none are dropped unless the filter's rewrite says so."""

    def __init__(self, name: str, language: str | None = None, registry: Registry = REGISTRY, **parameters: Any):
        spec = registry.get(name)
        if spec.rewrite is None and spec.frame is None:
            raise ValueError(f"{name} rewrites nothing")
        self.pipeline = Pipeline([Step(name, spec.fill(parameters)[0], language)], (), registry)

    def process(self, df: DataFrame, langs: Sequence[str]) -> DataFrame:
        return self.pipeline.run(df, langs)
