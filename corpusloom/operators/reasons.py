"""What filters measure: numbers that their thresholds are compared with, and texts that say why a row goes.

`MEASURES` gives, for each filter that has any, the numbers of a row: one for each column, or one for all of them. The reject reason of such a
filter lists them; filters that compare lists or labels tell those of each side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import entities, text
from corpusloom.operators import predicates
from corpusloom.operators.spec import Columns, explain

Measure = Callable[[dict, Columns], list[Column]]


def ratio(p: dict, columns: Columns) -> list[Column]:
    a, b = (text.n_tokens(c).cast("double") for c in columns[:2])
    return [F.try_divide(F.log10(F.least(a, b) + 1), F.log10(F.greatest(a, b) + 1)) if p["LOG"] else F.try_divide(a, b)]


def length_ratio(p: dict, columns: Columns) -> list[Column]:
    lengths = [predicates.measured(c, p["unit"]) for c in columns]
    return [F.try_divide(F.greatest(*lengths).cast("double"), F.least(*lengths))] if len(lengths) > 1 else [F.lit(1.0)]


def longest_part(c: Column) -> Column:
    return F.array_max(F.transform(F.split(c, " ", -1), lambda w: F.length(w)))


#: The numbers that filters compare with their thresholds.
MEASURES: dict[str, Measure] = {
    "max_length": lambda p, columns: [text.n_tokens(c) for c in columns[-2:]],
    "max_word_length": lambda p, columns: [longest_part(c) for c in columns],
    "remove_empty_lines": lambda p, columns: [F.length(text.strip(c)) for c in columns],
    "src_trg_ratio": ratio,
    "opus.LengthFilter": lambda p, columns: [predicates.measured(c, p["unit"]) for c in columns],
    "opus.LengthRatioFilter": length_ratio,
    "opus.LongWordFilter": lambda p, columns: [predicates.longest_word(c) for c in columns],
    "opus.AverageWordLengthFilter": lambda p, columns: [predicates.average_word(c) for c in columns],
    "opus.AlphabetRatioFilter": lambda p, columns: [predicates.alphabetic_share(c, p["exclude_whitespace"]) for c in columns],
    "opus.CharacterScoreFilter": lambda p, columns: [predicates.script_share(c, s) for c, s in zip(columns, p["scripts"], strict=False)],
    "opus.HtmlTagFilter": lambda p, columns: [F.regexp_count(c, F.lit("(?is)" + predicates.HTML_TAG)) for c in columns],
}


def sides(values: list[Column]) -> Column:
    """The sides' values as one text; a missing one is empty."""
    return F.concat_ws(" | ", *[F.coalesce(v.cast("string"), F.lit("")) for v in values])


def tell_numbers(name: str) -> None:
    @explain(name)
    def reason(p, columns):
        return sides(MEASURES[name](p, columns))


def tell_languages(name: str) -> None:
    @explain(name)
    def reason(p, columns):
        return sides([predicates.DETECTORS[p["DETECTOR"]](c)["lang"] for c in columns[:2]])


for _name in MEASURES:
    tell_numbers(_name)
for _name in ("langid", "langid_heliport", "fasttext_filter"):
    tell_languages(_name)


@explain("url_mismatch")
def url_mismatch_reason(p, columns):
    """The urls of each side."""
    return sides([F.array_join(entities.urls(c), " ") for c in columns[:2]])


@explain("opus.RegExpFilter")
def regexp_filter_reason(p, columns):
    """Whether each side matches."""
    return sides([c.rlike(text.java_pattern(r)) for c, r in zip(columns, p["regexps"], strict=False)])
