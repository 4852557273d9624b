"""String columns with the semantics that text filters in Python have."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str methods see it: Unicode white space and U+001C to U+001F. As characters, and all but the space as a class.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
OTHER_BLANK = r"\x09-\x0d\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[ {OTHER_BLANK}]+"
#: Texts without one of these, nearly all, have no white space but spaces. Two ranges are looked through much faster than `OTHER_BLANK`.
MAY_BE_BLANK = r"[^\x20-\x7e\xa1-\u167f]"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends. Texts that are so already, nearly all, are only looked at."""

    def collapsed(t: Column) -> Column:
        space = F.lit(" ")
        other = F.contains(t, F.lit("  ")) | F.startswith(t, space) | F.endswith(t, space) | (t.rlike(MAY_BE_BLANK) & t.rlike(f"[{OTHER_BLANK}]"))
        return F.when(other, F.btrim(F.regexp_replace(t, WS, " "), space)).otherwise(t)

    return let(text, collapsed)


def words_of(plain: Column) -> Column:
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def n_words_of(plain: Column) -> Column:
    return F.when(plain == "", 0).otherwise(n_dropped(plain, F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("long")


def tokens(text: Column) -> Column:
    """The words between white space."""
    return let(collapse(text), words_of)


def n_tokens(text: Column) -> Column:
    """The number of words. Spaces are counted; no list of words is made."""
    return let(collapse(text), n_words_of)


def n_dropped(text: Column, rest: Column) -> Column:
    return F.length(text) - F.length(rest)


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def last(text: Column, n: int = 1, before: int = 0) -> Column:
    """The `n` characters that end `before` characters from the end."""
    ending = F.right(text, F.lit(n + before))
    return ending if before == 0 else F.left(ending, F.greatest(F.length(ending) - before, F.lit(0)))


def without_last(text: Column, n: int) -> Column:
    return F.left(text, F.greatest(F.length(text) - n, F.lit(0)))


def java_pattern(pattern: str) -> str:
    """A Python pattern for Spark: eight-digit escapes, and classes that know Unicode."""
    out = re.sub(r"\\U([0-9A-Fa-f]{8})", lambda m: "\\x{%x}" % int(m[1], 16), pattern)
    out = re.sub(r"\(\?P<", "(?<", out)
    return "(?Ud)" + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)


def java_replacement(replacement: str) -> str:
    """A replacement with backslash group references for Spark."""
    return re.sub(r"\\(?:g<(\d+)>|(\d+))", lambda m: "$" + (m[1] or m[2]), replacement.replace("$", r"\$"))


def common_suffix_length(a: Column, b: Column, at_least: int = 1) -> Column:
    """Characters in the longest common suffix; 0 if it is shorter than `at_least`."""
    same = F.zip_with(
        F.split(F.reverse(a), "(?s)(?<=.)(?=.)"), F.split(F.reverse(b), "(?s)(?<=.)(?=.)"), lambda x, y: F.coalesce(x == y, F.lit(False))
    )
    first_difference = F.array_position(same, False)
    length = F.when(first_difference == 0, F.size(same)).otherwise(first_difference - 1)
    likely = (F.right(a, F.lit(at_least)) == F.right(b, F.lit(at_least))) & (F.least(F.length(a), F.length(b)) >= at_least)
    return F.when(likely, length).otherwise(0).cast("int")
