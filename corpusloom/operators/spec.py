"""Filter definitions: typed parameters, and what a filter does to rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame

MONOLINGUAL, BILINGUAL = "monolingual", "bilingual"
_MISSING = object()


@dataclass(frozen=True)
class Param:
    """A parameter. kind: float, int, bool, str, list (of `items`) or tuple (of each in `items`)."""

    kind: str
    default: Any = None
    minimum: float | None = None
    maximum: float | None = None
    choices: tuple | None = None
    items: Any = None

    def initial(self) -> Any:
        if self.default is not None:
            return self.default
        if self.kind == "tuple":
            return tuple(p.initial() for p in self.items)
        return {"str": "", "list": []}.get(self.kind)

    def convert(self, value: Any, name: str = "value", strict: bool = True) -> Any:
        """`value` as this type; with `strict`, out of range or not among the choices is an error."""
        if value is None:
            return None
        if self.kind == "list":
            return [self.items.convert(v, f"{name}[{k}]", strict) for k, v in enumerate(value)]
        if self.kind == "tuple":
            if len(value) != len(self.items):
                raise ValueError(f"{name}: {len(self.items)} values are needed, not {len(value)}")
            return tuple(p.convert(v, f"{name}[{k}]", strict) for k, (p, v) in enumerate(zip(self.items, value, strict=True)))
        if self.kind == "bool" and isinstance(value, str):
            value = value.strip().lower() not in ("", "0", "false", "no")
        out = {"float": float, "int": int, "bool": bool, "str": str}[self.kind](value)
        if strict:
            if self.minimum is not None and out < self.minimum or self.maximum is not None and out > self.maximum:
                raise ValueError(f"{name}: {out} is outside {self.minimum} to {self.maximum}")
            if self.choices is not None and out not in self.choices:
                raise ValueError(f"{name}: {out!r} is none of {', '.join(map(str, self.choices))}")
        return out

    def describe(self) -> dict[str, Any]:
        out: dict[str, Any] = {"type": self.kind, "default": self.initial()}
        for key, value in (("min", self.minimum), ("max", self.maximum), ("allowed_values", self.choices)):
            if value is not None:
                out[key] = value
        return out


Columns = list[Column]


@dataclass(frozen=True)
class FilterSpec:
    """A filter. `rewrite` maps the columns to new ones, `keep` tells which rows stay (after the
    rewrite), `reason` names why not, and `frame` is for what neither can express."""

    name: str
    kind: str
    params: dict[str, Param] = field(default_factory=dict)
    doc: str = ""
    rewrite: Callable[[dict, Columns], Columns] | None = None
    keep: Callable[[dict, Columns], Column] | None = None
    frame: Callable[[DataFrame, list[str], dict], DataFrame] | None = None
    reason: Callable[[dict, Columns], Column] | None = None

    def __post_init__(self):
        bad = [p for p in self.params if not re.fullmatch(r"[A-Za-z_]\w*", p)]
        if bad:
            raise ValueError(f"{self.name}: not an identifier: {', '.join(bad)}")

    def fill(self, given: dict[str, Any], strict: bool = True) -> tuple[dict[str, Any], list[str]]:
        """Parameters with defaults, and warnings about missing and unknown ones."""
        warnings = [f"{self.name}: missing parameter {p}" for p in self.params if p not in given]
        warnings += [f"{self.name}: unknown parameter {p}" for p in given if p not in self.params]
        out = dict(given)
        for name, param in self.params.items():
            value = given.get(name, _MISSING)
            out[name] = param.initial() if value is _MISSING else param.convert(value, name, strict)
        return out, warnings

    def describe(self) -> dict[str, Any]:
        """The definition, as data."""
        parameters = {n: p.describe() for n, p in self.params.items()}
        return {"name": self.name, "type": self.kind, "description": self.doc, "parameters": parameters}


class Registry:
    """Filters by name; a later definition of a name wins."""

    def __init__(self):
        self.specs: dict[str, FilterSpec] = {}

    def add(self, spec: FilterSpec) -> FilterSpec:
        self.specs[spec.name] = spec
        return spec

    def get(self, name: str) -> FilterSpec:
        if name not in self.specs:
            raise KeyError(f"unknown filter {name!r}")
        return self.specs[name]

    def names(self) -> list[str]:
        return sorted(self.specs)

    def find(self, text: str) -> list[FilterSpec]:
        """Filters with `text` in the name or the description, whatever the case."""
        wanted = text.lower()
        return [s for _, s in sorted(self.specs.items()) if wanted in s.name.lower() or wanted in s.doc.lower()]

    def copy(self) -> Registry:
        out = Registry()
        out.specs.update(self.specs)
        return out


REGISTRY = Registry()


def explain(name: str, registry: Registry = REGISTRY):
    """Register the decorated function as what names the reason for which filter `name` drops a row."""

    def put(f):
        registry.add(replace(registry.get(name), reason=f))
        return f

    return put


def define(name: str, kind: str, doc: str, role: str, **params: Param):
    """Register the decorated function as the `rewrite`, `keep` or `frame` of a filter."""

    def put(f):
        REGISTRY.add(FilterSpec(name, kind, params, doc, **{role: f}))
        return f

    return put
