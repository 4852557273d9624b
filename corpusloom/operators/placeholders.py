"""Placeholders for what a translation model should copy: urls, addresses, odd characters.

Matches of the rules become placeholders of a fixed vocabulary; text that looks like one becomes a
placeholder too. Each distinct match of a line gets its own; repeats share it. Lines with more
matches than placeholders keep the rest as text. The mapping comes back as a map column. All is done
with column expressions: a text is split at its matches and joined again with their placeholders.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_IN_ADDRESS = "[A-Za-z0-9_-]+"
#: Web addresses (with a protocol, or beginning with www) and mail addresses.
RULES = (
    rf"(?:https?://|\bwww[.]){WORD_IN_ADDRESS}(?:[.]{WORD_IN_ADDRESS})+(?:/[\w~%+-]*)*",
    rf"[\w.+-]+@{WORD_IN_ADDRESS}(?:[.]{WORD_IN_ADDRESS})+",
)
#: Texts without any of these have no match of the rule. Rules that are not here are looked for in all texts.
NEEDED = {RULES[0]: ("://", "www."), RULES[1]: ("@",)}
EMOJI = r"[\x{1F000}-\x{1FAFF}☀-➿]"


def options(config: str) -> dict:
    """Options of `encode` from a configuration in YAML or JSON: regexes, placeholder-symbol, num-placeholders; keys
    that lack have their defaults, others are ignored (a vocabulary file goes through `pieces_of` to `pieces`). Groups in the regexes do not matter."""
    try:
        import yaml

        data = yaml.safe_load(config) or {}
    except ImportError:
        data = json.loads(config or "{}")
    if not isinstance(data, dict):
        raise ValueError("a mapping is needed")
    names = (("regexes", "rules"), ("placeholder-symbol", "symbol"), ("num-placeholders", "n"))
    return {ours: data[theirs] for theirs, ours in names if theirs in data}


def pieces_of(model_file: str) -> list[str]:
    """The pieces of a sentencepiece model, without control symbols and the one for unknown text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [model.id_to_piece(k) for k in range(model.vocab_size()) if not model.is_control(k) and not model.is_unknown(k)]


def outside_vocabulary(pieces: Sequence[str], symbols: Sequence[str] = ()) -> str | None:
    """A rule for what a vocabulary of pieces cannot write: runs of characters that are no piece by themselves, white space aside. None if it has
    pieces for bytes, and so can write everything. A piece may begin with the mark for a space (U+2581). `symbols`, the placeholders, must be
    written in known characters."""
    if {f"<0x{b:02X}>" for b in range(256)} <= set(pieces):
        return None
    known = sorted({ord(p) for p in (p.removeprefix("\u2581") for p in pieces) if len(p) == 1})
    lost = sorted({c for s in symbols for c in s if ord(c) not in known})
    if lost:
        raise ValueError(f"the vocabulary has no {' '.join(lost)}, so placeholders would be unknown themselves: choose another symbol")
    ranges: list[list[int]] = []
    for c in known:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[^" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + r"\s]+"


def vocabulary(symbol: str = "@", n: int = 20) -> list[str]:
    """The placeholders: the number before the symbol's last character."""
    return [f"{symbol[:-1]}{i}{symbol[-1]}" for i in range(n)]


def _pattern(rules: Sequence[str], names: Sequence[str]) -> str:
    """What is replaced: the names themselves, longest first, and what the rules match."""
    literal = [re.escape(n) for n in sorted(names, key=len, reverse=True)]
    return "|".join([*literal, *(f"(?:{r})" for r in rules)])


def may_match(c: Column, rules: Sequence[str], names: Sequence[str]) -> Column:
    """Whether a text has what a match of the rules or names needs; a search for short strings, where the rules are known to need some."""
    if any(r not in NEEDED for r in rules):
        return c.isNotNull()
    needed = sorted({*(s for r in rules for s in NEEDED[r]), *(n[-1] for n in names)})
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(s)) for s in needed], F.lit(False))


def _rejoined(c: Column, pattern: str, mapping: Column) -> Column:
    """The text with its matches replaced by what `mapping` (match: placeholder) has for them."""
    between = F.split(c, pattern, -1)
    matches = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    put_in = F.transform(matches, lambda m: F.coalesce(F.try_element_at(mapping, m), m))
    return F.array_join(F.zip_with(between, put_in, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def encode(
    df: DataFrame, columns: Sequence[str], rules: Sequence[str] = RULES, symbol: str = "@", n: int = 20,
    seed: int = 0, strict: bool = False, order: str = "line_no", mapping: str = "mapping", pieces: Sequence[str] | None = None,
) -> DataFrame:
    """`df` with placeholders in `columns`, and their `mapping`. The sides of a line share one mapping:
    the placeholders in an order by a hash of the seed, the line number and each placeholder, given
    to the distinct matches from first to last. With `strict`, a match that is not as often on each
    side stays as text. A null text stays null and has no matches. With `pieces`, a model's vocabulary, what it cannot write
    becomes placeholders too."""
    names, columns = vocabulary(symbol, n), list(columns)
    unknown = outside_vocabulary(pieces, names) if pieces is not None else None
    pattern = _pattern([*rules, *([unknown] if unknown else [])], names)

    asked = [*rules, *([unknown] if unknown else [])]
    none = F.array().cast("array<string>")
    matches = {c: F.when(may_match(F.col(c), asked, names), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))).otherwise(none) for c in columns}
    df = df.withColumns({f"__matches_{c}": m for c, m in matches.items()})

    drawn = F.array(*[F.struct(F.xxhash64(F.lit(seed), F.col(order), F.lit(name)).alias("turn"), F.lit(name).alias("name")) for name in names])
    given = F.array_distinct(F.flatten(F.array(*[F.col(f"__matches_{c}") for c in columns])))
    entries = F.arrays_zip(F.slice(given, 1, n).alias("found"), F.array_sort(drawn).alias("drawn"))
    entries = F.filter(entries, lambda e: e["found"].isNotNull())
    out = df.withColumn("__entries", entries)
    if strict:
        def times(c: str, found: Column) -> Column:
            return F.size(F.filter(f"__matches_{c}", lambda m: m == found))

        def even(e: Column) -> Column:
            counts = F.array(*[times(c, e["found"]) for c in columns])
            return F.array_min(counts) == F.array_max(counts)

        out = out.withColumn("__entries", F.filter("__entries", even))
    names_of = F.map_from_entries(F.transform("__entries", lambda e: F.struct(e["found"], e["drawn"]["name"])))
    back = F.map_from_entries(F.transform("__entries", lambda e: F.struct(e["drawn"]["name"], e["found"])))
    out = out.withColumn("__names", names_of).withColumn(mapping, back)
    coded = {c: F.when(F.size("__names") > 0, _rejoined(F.col(c), pattern, F.col("__names"))).otherwise(F.col(c)) for c in columns}
    return out.withColumns(coded).drop("__entries", "__names", *[f"__matches_{c}" for c in columns])


def decode(c: Column, mapping: Column) -> Column:
    """The texts back in place of their placeholders. One pass: what is put in is not looked at again."""
    keys = F.map_keys(mapping)
    longest_first = F.transform(keys, lambda k, i: F.struct((-F.length(k)).alias("n"), k.alias("k"), i.alias("i")))
    marked = F.aggregate(
        F.array_sort(longest_first),
        c,
        lambda t, p: F.replace(t, p["k"], F.concat(F.lit("\x01"), p["i"].cast("string"), F.lit("\x02"))),
    )
    entries = F.transform(F.map_values(mapping), lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    back = F.aggregate(
        entries, marked, lambda t, p: F.replace(t, F.concat(F.lit("\x01"), p["i"].cast("string"), F.lit("\x02")), p["v"])
    )
    return F.when(F.coalesce(F.size(keys), F.lit(0)) > 0, back).otherwise(c)


def decode_lines(df: DataFrame, mappings: DataFrame, columns: Sequence[str], order: str = "line_no", mapping: str = "mapping") -> DataFrame:
    """As `decode`, with the mappings in a table of their own, by line number."""
    joined = df.join(mappings.select(order, mapping), order, "left")
    return joined.withColumns({c: decode(F.col(c), F.col(mapping)) for c in columns}).drop(mapping)
