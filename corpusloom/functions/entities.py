"""Numbers, urls and currencies in text, as array columns.

Numbers are found by patterns. Urls grow from their hosts and currencies from their amounts, by small routines on the
texts that may have any.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import locale

# A number is a chain of words that are all digits, held together by single separators. A sign belongs
# to it if nothing but white space or the start of the text is before the sign.
DIGITS = r"(?<!\w)\d+(?!\w)"
SEPARATOR = r"[.,:]"
SIGN = r"(?<!\S)[-+]"
NUMBER = rf"(?U)(?:{SIGN})?{DIGITS}(?:{SEPARATOR}{DIGITS})*"

# Characters of parts of a web address by the generic syntax: before an at sign, in a path, and after a
# question mark or number sign.
USER_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-._~!$&'()*+,;=%:")
PATH_CHARACTERS = USER_CHARACTERS | frozenset("@/")
QUERY_CHARACTERS = PATH_CHARACTERS | frozenset("?")
#: Names with dots in them, and addresses in brackets.
DOTTED = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\[[0-9A-Fa-f:.]+\]")
#: Texts without one of these have no address.
MAY_HAVE_ADDRESS = r"[A-Za-z0-9-]\.[A-Za-z0-9-]|\[[0-9A-Fa-f:.]"

#: Web addresses that name their protocol: a name with a dot and a short ending, and all that follows.
WEB_NAME = "[-A-Za-z0-9@:%._+~#=]{1,256}[.][0-9A-Za-z()]{1,6}"
WEB = rf"(?Ud)https?://(?={WEB_NAME}\b)[-A-Za-z0-9@:%._+~#=()?&/]+"

#: Where locale data cannot be read: symbols of currencies in English text.
SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "CNY": "CN¥", "INR": "₹", "KRW": "₩", "ILS": "₪", "CAD": "CA$", "AUD": "A$"}
AMOUNT = re.compile(r"\d[\d.,]*")


def numbers(text: Column) -> Column:
    """The distinct numbers, signs kept, leading zeros dropped, separators as `*`."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))

    def plain(n: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(n, SEPARATOR, "*"), r"(?U)^([-+]?)0+(?=\d)", "$1")

    return F.array_distinct(F.transform(found, plain))


def overlap(a: Column, b: Column) -> Column:
    """(|a ∩ b| + 1) / (|a △ b| + 1) of two arrays of distinct values; null if both are empty."""
    pair = F.array(F.struct(a.alias("a"), b.alias("b")))  # evaluated once

    def share(p: Column) -> Column:
        both = F.size(F.array_intersect(p["a"], p["b"]))
        either = F.size(F.array_union(p["a"], p["b"]))
        return F.when(either > 0, (both + 1).cast("double") / (either - both + 1))

    return F.element_at(F.transform(pair, share), 1)


def is_word(character: str) -> bool:
    return character.isalnum() or character == "_"


def at_edge(text: str, place: int) -> bool:
    """Whether a word begins or ends at `place`."""
    before = place > 0 and is_word(text[place - 1])
    return before != (place < len(text) and is_word(text[place]))


def host_at(text: str, start: int, end: int) -> int | None:
    """Where a host that begins at `start` ends, looking no further than `end`; None if there is none. A host is an address in
    brackets, labels of which the last is of letters, or four short numbers."""
    if text[start] == "[":
        return end
    found, place, labels = None, start, text[start:end].split(".")
    for k, label in enumerate(labels):
        letters = next((n for n, c in enumerate(label) if not c.isalpha()), len(label))
        if k and 2 <= letters <= 63 and at_edge(text, place + letters):
            found = place + letters
        if not 1 <= len(label) <= 63:
            break
        place += len(label) + 1
    if found is None and len(labels) >= 4 and all(x.isdigit() and len(x) <= 3 for x in labels[:3]):
        digits = next((n for n, c in enumerate(labels[3]) if not c.isdigit()), len(labels[3]))
        last = start + sum(map(len, labels[:3])) + 3 + digits
        if 1 <= digits <= 3 and at_edge(text, last):
            found = last
    return found


def first_host(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The first host within a dotted name, from the edge of a word on."""
    for place in range(start, end):
        if at_edge(text, place) and text[place] != "." and (stop := host_at(text, place, end)) is not None:
            return place, stop
    return None


def reach(text: str, place: int, allowed: frozenset[str]) -> int:
    while place < len(text) and text[place] in allowed:
        place += 1
    return place


def address_end(text: str, host_end: int) -> int:
    """The end of an address: port, path, query and fragment as far as they go, then back to the edge of a word."""
    place = host_end
    if text[place : place + 1] == ":":
        digits = reach(text, place + 1, frozenset("0123456789")) - place - 1
        if 2 <= digits <= 5:
            place += 1 + digits
    if text[place : place + 1] == "/":
        place = reach(text, place, PATH_CHARACTERS)
    for sign in "?#":
        if text[place : place + 1] == sign:
            place = reach(text, place + 1, QUERY_CHARACTERS)
    while place > host_end and not at_edge(text, place):
        place -= 1
    return host_end if text[host_end:place] == ":" else place


def address_start(text: str, host_start: int, least: int) -> int:
    """The start of an address: the host's, or that of the user before it, or of the scheme before both."""
    start = host_start
    if start > least and text[start - 1] == "@":
        user = start - 1
        while user > least and text[user - 1] in USER_CHARACTERS:
            user -= 1
        start = next((k for k in range(user, start - 1) if at_edge(text, k)), start)
    if start - 3 > least and text[start - 3 : start] == "://":
        scheme = start - 3
        while scheme > least and text[scheme - 1].isascii() and (text[scheme - 1].isalnum() or text[scheme - 1] in "+.-"):
            scheme -= 1
        start = next((k for k in range(scheme, start - 3) if text[k].isalpha() and at_edge(text, k)), start)
    return start


def addresses_in(text: str) -> list[tuple[str, str]]:
    """The web addresses in a text, in order, and their hosts. Hosts are looked for first; each is then extended to both sides. A
    dotted name before an at sign or a scheme's colon belongs to the host behind it."""
    found, done = [], 0
    for name in DOTTED.finditer(text):
        start = max(name.start(), done)
        while start < name.end() and (host := first_host(text, start, name.end())):
            sign = reach(text, host[0], USER_CHARACTERS)
            later = sign + 1 if text[sign : sign + 1] == "@" else None
            if text.startswith("://", name.end()):
                later = name.end() + 3
            behind = DOTTED.match(text, later) if later is not None else None
            if behind and host_at(text, behind.start(), behind.end()) is not None:
                break
            start, end = address_start(text, host[0], done), address_end(text, host[1])
            if not at_edge(text, end):
                break
            found.append((text[start:end], text[host[0] : host[1]]))
            start = done = end
    return found


def url_list(text: str) -> list[str]:
    """The addresses of a text without those whose host is two sentences that lack a space, as in `end.Start`."""
    return [a for a, host in addresses_in(text) if not re.search(r"[a-z0-9]\.[A-Z]", host)]


def lists_of(text: Column, find: Callable[[str], list[str]], possible: Column) -> Column:
    """`find` for the texts where it is possible that there is something to find; others stay with Spark."""

    @F.pandas_udf("array<string>")
    def found(values: pd.Series) -> pd.Series:
        return values.map(find, na_action="ignore")

    return F.coalesce(found(F.when(possible, text)), F.when(text.isNotNull(), F.array().cast("array<string>")))


def addresses(text: Column) -> Column:
    """All web addresses in order."""
    return lists_of(text, lambda t: [a for a, _ in addresses_in(t)], text.rlike(MAY_HAVE_ADDRESS))


def urls(text: Column) -> Column:
    """The urls in order; hosts like `end.Start`, where a space is missing, are none."""
    return lists_of(text, url_list, text.rlike(MAY_HAVE_ADDRESS))


def currency_codes(currencies: dict[str, str] | None = None) -> dict[str, list[str]]:
    """What each code and symbol may stand for; `currencies` (code: symbol) are those of the locale data
    unless given. A plain dollar stands for all currencies that have one in their symbol."""
    known = currencies or locale.currencies() or SYMBOLS
    symbols = {s: [c for c in known if known[c] == s] for s in sorted(set(known.values()))}
    dollars = [c for c in known if "$" in known[c]]
    return {c: [c] for c in known} | {s: sorted(c) for s, c in symbols.items()} | ({"$": sorted(dollars)} if dollars else {})


def names_beside_amounts(text: str, names: Sequence[str]) -> list[str]:
    """The names next to the amounts of a text, in order; `names` with long ones first. Amounts are looked for first. A name
    may stand before an amount or, if none does, after it; white space may be between, but no letter of a name or amount may be
    cut off from a word. What an amount has taken is not taken again."""
    letter = lambda k: 0 <= k < len(text) and text[k].isascii() and text[k].isalpha()
    found, done, place = [], 0, 0
    while amount := AMOUNT.search(text, place):
        start, end = amount.span()
        edge = start
        while edge > done and text[edge - 1].isspace():
            edge -= 1
        # Digits, dots and commas are given back where a letter follows.
        whole = next((e for e in range(end, start, -1) if not letter(e)), None)
        before = next((n for n in names if text.endswith(n, done, edge) and not letter(edge - len(n) - 1)), None)
        if before and whole:
            found.append(before)
            done = place = whole
            continue
        place = start + 1 if letter(start - 1) else end
        for stop in range(end, start, -1) if not letter(start - 1) else ():
            gap = next((k for k in range(stop, len(text)) if not text[k].isspace()), len(text))
            after = next((n for n in names if text.startswith(n, gap) and not letter(gap + len(n))), None)
            if after:
                found.append(after)
                done = place = gap + len(after)
                break
    return found


def currencies_of(text: Column, currencies: dict[str, str] | None = None) -> Column:
    """The codes and symbols next to an amount, in order."""
    names = sorted(currency_codes(currencies), key=lambda n: (-len(n), n))
    return lists_of(text, lambda t: names_beside_amounts(t, names), text.rlike(r"(?U)\d"))


def currency_keys(names: Column, currencies: dict[str, str] | None = None) -> Column:
    """For each name, the codes it may stand for and whether it is a code or a symbol."""
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in currency_codes(currencies).items() for x in kv])
    return F.transform(names, lambda n: F.struct(F.element_at(table, n).alias("codes"), n.rlike(r"\p{L}").alias("is_code")))
