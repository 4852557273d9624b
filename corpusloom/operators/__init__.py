"""The filters and the operations on corpora. Importing this registers all filters."""

from corpusloom.operators import dedup, predicates, reasons, rewrites, scoring, suffixes  # noqa: F401
from corpusloom.operators.spec import REGISTRY, FilterSpec, Param, Registry, define  # noqa: F401
