"""Public locale data (CLDR), read from the ICU library that Spark brings along.

`jvm()` is the virtual machine of the active session. Without one (a client that is not in the same
process) the callers fall back to the short tables that they state.
"""

from __future__ import annotations

import functools

from pyspark.sql import SparkSession


def jvm():
    session = SparkSession.getActiveSession()
    return getattr(session, "_jvm", None) if session is not None else None


@functools.lru_cache(maxsize=None)
def _languages() -> frozenset[str]:
    return frozenset(x.getLanguage() for x in jvm().com.ibm.icu.util.ULocale.getAvailableLocales())


@functools.lru_cache(maxsize=None)
def _exemplars(language: str) -> str | None:
    icu = jvm().com.ibm.icu.util
    if language not in _languages():
        return None
    found = icu.LocaleData.getInstance(icu.ULocale(language)).getExemplarSet(0, 0)
    ranges = [(found.getRangeStart(k), found.getRangeEnd(k)) for k in range(found.getRangeCount())]
    return "".join(rf"\x{{{a:x}}}" if a == b else rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) or None


def exemplars(language: str) -> str | None:
    """The main exemplar characters of a language (lower case) as the inside of a character class, or
    None if there are none."""
    return _exemplars(language) if jvm() is not None else None


@functools.lru_cache(maxsize=None)
def _currencies() -> dict[str, str]:
    icu = jvm().com.ibm.icu.util
    english = icu.ULocale("en")
    return {c.getCurrencyCode(): c.getSymbol(english) for c in icu.Currency.getAvailableCurrencies()}


def currencies() -> dict[str, str] | None:
    """The ISO codes of all currencies, old ones too, and the symbols by which English text has them."""
    return _currencies() if jvm() is not None else None
