"""Recipes: ordered filter steps over a DataFrame with a string column for each language."""

from __future__ import annotations

import hashlib
import json
import shlex
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corpusloom.operators import REGISTRY, FilterSpec, Registry
from corpusloom.operators.sampling import sample
from corpusloom.operators.spec import BILINGUAL, MONOLINGUAL

VERSION = 1


@dataclass(frozen=True)
class Step:
    """A filter with its parameters; `language` names the columns of a monolingual one."""

    filter: str
    parameters: dict[str, Any] = field(default_factory=dict)
    language: str | None = None

    def as_dict(self) -> dict[str, Any]:
        return {"filter": self.filter, "parameters": self.parameters, "language": self.language}

    @property
    def languages(self) -> list[str]:
        return [x.strip() for x in (self.language or "").split(",") if x.strip()]


@dataclass(frozen=True)
class Observed:
    """What a run counts by the way."""

    filters: tuple[str, ...]
    rows: tuple[Observation, ...]

    def counts(self) -> list[tuple[int, str, int, int]]:
        """(step, filter, rows_in, rows_out), once an action on the run's result has ended; waits for it until then."""
        n = [r.get["n"] for r in self.rows]
        return [(k, name, n[k], n[k + 1]) for k, name in enumerate(self.filters)]


def rewritten(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """`df` with `new` columns in place of those of the same names. They come from a generator of one row: conditions on them are not
    taken back to what they are made of, as they are through a projection, so they are made once a row however many steps follow."""
    made = F.inline(F.array(F.struct(*[c.alias(name) for name, c in new.items()])))
    return df.select(*[F.col(c) for c in df.columns if c not in new], made).select(*[F.col(c) for c in df.columns])


class Pipeline:
    """Checked steps. Parameters that are missing get their defaults; unknown ones stay and are warned
    about; a monolingual step needs a language, a bilingual one must have none."""

    def __init__(self, steps: Sequence[Step], files: Sequence[str] = (), registry: Registry = REGISTRY, strict: bool = True):
        self.files, self.registry = list(files), registry
        self.steps: list[Step] = []
        self.warnings: list[str] = []
        for step in steps:
            spec = registry.get(step.filter)
            if spec.kind == MONOLINGUAL and not step.languages:
                raise ValueError(f"{step.filter} works on one language at a time: name it")
            if spec.kind == BILINGUAL and step.language is not None:
                raise ValueError(f"{step.filter} works on all languages: name none")
            parameters, found = spec.fill(step.parameters, strict)
            self.warnings += found
            self.steps.append(Step(step.filter, parameters, step.language))
        for message in self.warnings:
            warnings.warn(message, stacklevel=2)

    @classmethod
    def from_json(cls, text: str | list | dict, registry: Registry = REGISTRY, strict: bool = True) -> Pipeline:
        """From {version, files, filters}, or from the bare list of filters that older recipes are."""
        data = json.loads(text) if isinstance(text, str) else text
        data = {"filters": data} if isinstance(data, list) else data
        if data.get("version", VERSION) != VERSION:
            raise ValueError(f"unknown version {data['version']}")
        steps = [Step(s["filter"], s.get("parameters") or {}, s.get("language")) for s in data.get("filters", [])]
        return cls(steps, data.get("files", ()), registry, strict)

    def to_json(self) -> str:
        steps = [s.as_dict() for s in self.steps]
        return json.dumps({"version": VERSION, "files": self.files, "filters": steps}, ensure_ascii=False, indent=2)

    # Running

    def _parts(self, step: Step, langs: Sequence[str]) -> tuple[FilterSpec, list[str]]:
        spec = self.registry.get(step.filter)
        chosen = step.languages if spec.kind == MONOLINGUAL else list(langs)
        missing = [c for c in chosen if c not in langs]
        if missing:
            raise ValueError(f"{step.filter}: no column {', '.join(missing)}")
        return spec, chosen

    def _apply(self, df: DataFrame, step: Step, langs: Sequence[str]) -> tuple[DataFrame, Column | None]:
        """`df` after the step's rewrite, and the condition on which rows stay."""
        spec, chosen = self._parts(step, langs)
        if spec.frame is not None:
            return spec.frame(df, chosen, step.parameters), None
        if spec.rewrite is not None:
            new = spec.rewrite(step.parameters, [F.col(c) for c in chosen])
            df = rewritten(df, dict(zip(chosen, new, strict=True)))
        keep = spec.keep(step.parameters, [F.col(c) for c in chosen]) if spec.keep is not None else None
        return df, keep

    def run(self, df: DataFrame, langs: Sequence[str]) -> DataFrame:
        """The rows that all steps keep, as they leave them. Columns beside `langs` are carried along."""
        for step in self.steps:
            df, keep = self._apply(df, step, langs)
            df = df if keep is None else df.where(keep)
        return df

    def run_observed(self, df: DataFrame, langs: Sequence[str]) -> tuple[DataFrame, Observed]:
        """As `run`, and counts of rows that come with whatever action is run on the result, by `DataFrame.observe`: no second
        pass. A step is not pushed past the count before it."""
        rows = [Observation()]
        df = df.observe(rows[0], F.count(F.lit(1)).alias("n"))
        for step in self.steps:
            df, keep = self._apply(df, step, langs)
            rows.append(Observation())
            df = (df if keep is None else df.where(keep)).observe(rows[-1], F.count(F.lit(1)).alias("n"))
        return df, Observed(tuple(s.filter for s in self.steps), tuple(rows))

    def annotate(self, df: DataFrame, langs: Sequence[str]) -> DataFrame:
        """All rows, with rejected_by (the step that drops the row, else null), reject_step (its number) and
        reject_reason (why, for filters that tell). Steps after that still rewrite. Steps that are neither
        rewrites nor conditions drop their rows."""
        df = df.withColumn("rejected_by", F.lit(None).cast("string")).withColumn("reject_step", F.lit(None).cast("int"))
        df = df.withColumn("reject_reason", F.lit(None).cast("string"))
        for k, step in enumerate(self.steps):
            df, keep = self._apply(df, step, langs)
            if keep is not None:
                new = F.col("reject_step").isNull() & ~F.coalesce(keep, F.lit(False))
                spec, chosen = self._parts(step, langs)
                why = spec.reason(step.parameters, [F.col(c) for c in chosen]) if spec.reason is not None else F.lit(None).cast("string")
                df = df.withColumn("__new", new).withColumns(
                    {
                        "rejected_by": F.when(F.col("__new"), step.filter).otherwise(F.col("rejected_by")),
                        "reject_step": F.when(F.col("__new"), k).otherwise(F.col("reject_step")),
                        "reject_reason": F.when(F.col("__new"), why).otherwise(F.col("reject_reason")),
                    }
                )
                df = df.drop("__new")
        return df

    def trail(self, df: DataFrame, langs: Sequence[str]) -> Iterator[tuple[Step | None, DataFrame]]:
        """The input, and what each step leaves."""
        yield None, df
        for step in self.steps:
            df, keep = self._apply(df, step, langs)
            df = df if keep is None else df.where(keep)
            yield step, df

    def stats(self, df: DataFrame, langs: Sequence[str]) -> DataFrame:
        """A row for each step: step, filter, rows_in, rows_out. All steps up to one that works on the whole
        frame are counted in one pass, by the step that drops a row; after it counting begins anew."""
        frames = [k for k, s in enumerate(self.steps) if self.registry.get(s.filter).frame is not None]
        counts, current, start = None, df, 0
        for stop in [*frames, len(self.steps)]:
            part = Pipeline(self.steps[start:stop], (), self.registry)
            dropped = F.col("reject_step")
            kept = [F.count(F.when(dropped.isNull() | (dropped > k), 1)) for k in range(-1, stop - start)]
            one = part.annotate(current, langs).agg(F.array(*kept).alias("rows"))
            one = one.select(F.posexplode("rows").alias("after", "rows")).withColumn("after", F.col("after") + start)
            counts = one if counts is None else counts.unionByName(one)
            if stop < len(self.steps):
                current, _ = self._apply(part.run(current, langs), self.steps[stop], langs)
                start = stop + 1
        # What is left after a step is what the next one gets.
        roles = counts.select("after", "rows", F.explode(F.array(F.lit(0), F.lit(1))).alias("back"))
        found = roles.groupBy((F.col("after") - F.col("back")).alias("step")).agg(
            F.max(F.when(F.col("back") == 0, F.col("rows"))).alias("rows_in"),
            F.max(F.when(F.col("back") == 1, F.col("rows"))).alias("rows_out"),
        )
        names = df.sparkSession.createDataFrame([(k, s.filter) for k, s in enumerate(self.steps)], "step int, filter string")
        return names.join(found, "step").select("step", "filter", "rows_in", "rows_out")

    def preview(self, df: DataFrame, langs: Sequence[str], k: int = 1000, cache: dict[str, DataFrame] | None = None):
        """[(step, DataFrame or the error)] over a sample of `df`. `cache` keeps steps by key for the next
        call: after a change, only the steps from there on are new."""
        cache = {} if cache is None else cache
        keys = self.keys()
        if "sample" not in cache:
            cache["sample"] = sample(df, k).persist()
        out: list[tuple[Step | None, DataFrame | Exception]] = [(None, cache["sample"])]
        current = cache["sample"]
        for step, key in zip(self.steps, keys, strict=True):
            if key not in cache:
                try:
                    after, keep = self._apply(current, step, langs)
                    cache[key] = (after if keep is None else after.where(keep)).persist()
                except Exception as error:  # a step that fails is part of the preview
                    out.append((step, error))
                    break
            current = cache[key]
            out.append((step, current))
        return out

    def keys(self) -> list[str]:
        """A key for each step that depends on it, its definition and all steps before it."""
        out, last = [], ""
        for step in self.steps:
            definition = self.registry.get(step.filter).describe()
            content = json.dumps([step.as_dict(), definition, last], sort_keys=True, default=str)
            last = hashlib.sha256(content.encode()).hexdigest()
            out.append(last)
        return out

    # Exports

    def to_yaml(self, module: str = "corpusloom.operators") -> str:
        """A preprocess step with the rewrites and a filter step with the rest, as other corpus tools
        take them. Rewrites so move before all filters; a warning says if that changes the order."""
        rewrites = [s for s in self.steps if self.registry.get(s.filter).rewrite is not None]
        others = [s for s in self.steps if s not in rewrites]
        if self.steps[: len(rewrites)] != rewrites:
            warnings.warn("filters come before rewrites here, but after them in the export", stacklevel=2)

        def block(kind: str, source: list[str], target: list[str], key: str, steps: list[Step]) -> list[str]:
            lines = [f"- type: {kind}", "  parameters:", f"    inputs: {json.dumps(source)}", f"    outputs: {json.dumps(target)}", f"    {key}:"]
            for s in steps:
                name = s.filter.removeprefix("opus.")
                body = s.parameters if s.filter.startswith("opus.") else {"filter": s.filter, "parameters": s.parameters, "language": s.language}
                lines.append(f"    - {name if s.filter.startswith('opus.') else 'CorpusloomStep'}: {json.dumps(body, ensure_ascii=False, default=list)}")
                if not s.filter.startswith("opus."):
                    lines.append(f"      module: {module}")
            return lines

        middle = [f"preprocessed.{k}.gz" for k in range(len(self.files))]
        final = [f"filtered.{k}.gz" for k in range(len(self.files))]
        out = ["steps:"]
        if rewrites:
            out += block("preprocess", self.files, middle, "preprocessors", rewrites)
        if others:
            out += block("filter", middle if rewrites else self.files, final, "filters", others)
        return "\n".join(out) + "\n"

    def to_shell(self) -> str:
        """The steps as shell commands of this package, one pipe."""
        if not self.steps:
            return "cat\n"
        parts = [f"python -m corpusloom.cli step {shlex.quote(json.dumps(s.as_dict(), ensure_ascii=False))}" for s in self.steps]
        return " |\n".join(parts) + "\n"

    def explain(self, df: DataFrame, langs: Sequence[str]) -> None:
        self.run(df, langs).explain("formatted")
