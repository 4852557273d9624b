"""Alphabets: the characters of a language's writing, from public locale data."""

from __future__ import annotations

from corpusloom.functions import locale

#: Languages by script, for languages without exemplar characters in the locale data (or where that data cannot be read).
SCRIPTS = {
    "Arabic": "ar fa ur ps ckb sd ug",
    "Cyrillic": "ru uk bg be mk sr kk ky tg mn tt ba",
    "Devanagari": "hi mr ne sa mai bho",
    "Greek": "el",
    "Han": "zh yue",
    "Hangul": "ko",
    "Hebrew": "he yi",
    "Latin": "en de fr es it pt nl sv da nb nn no fi et lv lt pl cs sk sl hr hu ro tr la fo gl ht jv ku oc rw so sq sw tl uz vi wo xh yo zu",
}

Extra = dict[str, str] | None


def char_class(characters: str) -> str:
    """A character class of single characters and ranges, as a user writes it; brackets may lack."""
    return characters if characters.startswith("[") else f"[{characters}]"


def alphabet(language: str, extra: Extra = None) -> str | None:
    """The character class of a language's letters, or None if it is unknown. `extra` ({language: class})
    adds to or overrides the known ones."""
    if extra and language in extra:
        return char_class(extra[language])
    characters = locale.exemplars(language) if language else None
    if characters:
        return f"[{characters}]"
    for script, languages in SCRIPTS.items():
        if language in languages.split():
            return rf"\p{{Is{script}}}"
    return None
