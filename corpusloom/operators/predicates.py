"""Filters that keep or drop rows."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import entities, text
from corpusloom.functions.scripts import alphabet
from corpusloom.operators.rewrites import FLAG, ON, no_field_empty
from corpusloom.operators.spec import BILINGUAL, REGISTRY, FilterSpec, Param, define, explain


def every(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


@define("max_length", BILINGUAL, "Keep rows whose number of words is in a range.", "keep", MAXLENGTH=Param("int", 150), MINLENGTH=Param("int", 1))
def max_length(p, columns):
    return every(text.let(text.n_tokens(c), lambda n: n.between(p["MINLENGTH"], p["MAXLENGTH"])) for c in columns[-2:])


@define("max_word_length", BILINGUAL, "Drop rows with a longer word (between single spaces).", "keep", MAXWORDLENGTH=Param("int", 150))
def max_word_length(p, columns):
    return every(~F.exists(F.split(c, " ", -1), lambda w: F.length(w) > p["MAXWORDLENGTH"]) for c in columns)


@define(
    "src_trg_ratio", BILINGUAL, "Keep pairs of similar length in words.", "keep",
    RATIO=Param("float", 0.6), LOG=FLAG, IDENTICAL=FLAG,
)
def src_trg_ratio(p, columns):
    """Rows without words on a side are dropped where the ratio has no value. IDENTICAL: drop pairs
    that differ in case at most."""
    if len(columns) != 2:
        return F.lit(False)


    def alike(n: Column) -> Column:
        a, b = n["a"], n["b"]
        if p["LOG"]:
            return F.try_divide(F.log10(F.least(a, b) + 1), F.log10(F.greatest(a, b) + 1)) >= p["RATIO"]
        return text.let(F.try_divide(a, b), lambda r: r.between(p["RATIO"], 1 / p["RATIO"]))

    numbers = F.struct(*[text.n_tokens(c).cast("double").alias(name) for c, name in zip(columns, "ab", strict=True)])
    keep = F.coalesce(text.let(numbers, alike), F.lit(False))
    return keep & (F.lower(columns[0]) != F.lower(columns[1])) if p["IDENTICAL"] else keep


@define("remove_empty_lines", BILINGUAL, "Drop rows with a blank field.", "keep")
def remove_empty_lines(p, columns):
    return every(~text.is_blank(c) for c in columns)


def composed(c: Column) -> Column:
    """Unicode normal form C; only texts that can change are handed to Python, others travel as null."""
    @F.pandas_udf("string")
    def nfc(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFC")

    needed = F.when(c.rlike("[^\\x{0}-\\x{2ff}]"), c)
    return F.coalesce(nfc(needed), c)


def in_alphabet(c: Column, letters: str, words: float, characters: float) -> Column:
    """Enough words begin with a letter, and enough characters are letters. Both are counted by what is left without them."""
    enough = F.try_divide(text.n_dropped(c, F.regexp_replace(c, f"(?iu){letters}+", "")), F.length(F.replace(c, F.lit(" "), F.lit("")))) >= characters

    def begins(plain: Column) -> Column:
        spaced = F.concat(F.lit(" "), plain)
        starts = text.n_dropped(spaced, F.regexp_replace(spaced, f"(?iu) {letters}", "")) / 2
        return F.try_divide(starts, text.n_words_of(plain)) >= words

    return F.coalesce(enough & text.let(text.collapse(c), begins), F.lit(False))


@define(
    "alpha_ratio", BILINGUAL, "Keep rows with enough words and characters of the languages' alphabets.", "keep",
    LANG1=Param("str", ""), LANG2=Param("str", ""), SRCWORDRAT=Param("float", 0.4), TRGWORDRAT=Param("float", 0.4),
    SRCALPHARAT=Param("float", 0.5), TRGALPHARAT=Param("float", 0.5), ALPHABET1=Param("str", ""), ALPHABET2=Param("str", ""),
)
def alpha_ratio(p, columns):
    """A side whose language is unknown is not looked at. ALPHABET1 and ALPHABET2, character classes,
    stand in for the alphabets of the languages."""
    sides = (("LANG1", "SRCWORDRAT", "SRCALPHARAT"), ("LANG2", "TRGWORDRAT", "TRGALPHARAT"))
    keep = F.lit(True)
    for c, (language, words, characters) in zip(columns[-2:], sides, strict=False):
        own = p.get(language.replace("LANG", "ALPHABET"))
        letters = alphabet(p[language], {p[language]: own} if own else None)
        if letters:
            keep = keep & text.let(composed(text.strip(c)), lambda x: in_alphabet(x, letters, p[words], p[characters]))  # noqa: B023
    return keep


@explain("alpha_ratio")
def alpha_ratio_reason(p, columns):
    """The first test that fails: EMPTY, RATIO_WORDS or RATIO_ALPHA, and the side."""
    found = F.lit(None).cast("string")
    sides = (("LANG1", "SRCWORDRAT", "SRCALPHARAT", "SRC"), ("LANG2", "TRGWORDRAT", "TRGALPHARAT", "TRG"))
    for c, (language, words, characters, side) in reversed(list(zip(columns[-2:], sides, strict=False))):
        own = p.get(language.replace("LANG", "ALPHABET"))
        letters = alphabet(p[language], {p[language]: own} if own else None)
        if letters:
            whole = composed(text.strip(c))
            found = (
                F.when(text.is_blank(c), f"EMPTY_{side}")
                .when(~in_alphabet(whole, letters, p[words], 0.0), f"RATIO_WORDS_{side}")
                .when(~in_alphabet(whole, letters, 0.0, p[characters]), f"RATIO_ALPHA_{side}")
                .otherwise(found)
            )
    return found


@define("num_mismatch", BILINGUAL, "Keep pairs with much the same numbers.", "keep", RATIO=Param("float", 1.0))
def num_mismatch(p, columns):
    """A pair without numbers stays, whatever the ratio."""
    some = columns[0].rlike(r"(?U)\d") | columns[1].rlike(r"(?U)\d")
    same = entities.overlap(entities.numbers(columns[0]), entities.numbers(columns[1])) >= p["RATIO"]
    return F.when(some, F.coalesce(same, F.lit(True))).otherwise(True)


@explain("num_mismatch")
def num_mismatch_reason(p, columns):
    """The numbers of each side that the other lacks."""
    a, b = (entities.numbers(c) for c in columns[:2])
    return F.concat_ws(" | ", F.array_join(F.array_except(a, b), " "), F.array_join(F.array_except(b, a), " "))


@define("url_mismatch", BILINGUAL, "Keep pairs with the same urls in the same order.", "keep")
def url_mismatch(p, columns):
    return entities.urls(columns[0]) == entities.urls(columns[1])


def _currency_mismatch(df: DataFrame, langs: list[str], p: dict) -> DataFrame:
    """With FIX, a pair with one currency of one style on each side gets the first one's."""
    src, trg = langs[0], langs[1]
    df = df.withColumn("__a", entities.currencies_of(F.col(src))).withColumn("__b", entities.currencies_of(F.col(trg)))
    a, b = entities.currency_keys(F.col("__a")), entities.currency_keys(F.col("__b"))
    df = df.withColumn("__same", a == b)
    if p["FIX"]:
        one = (F.size("__a") == 1) & (F.size("__b") == 1)
        style = F.get("__a", F.lit(0)).rlike(r"\p{L}") == F.get("__b", F.lit(0)).rlike(r"\p{L}")
        df = df.withColumn("__fix", ~F.col("__same") & F.coalesce(one & style, F.lit(False)))
        fixed = F.replace(F.col(trg), F.get("__b", F.lit(0)), F.get("__a", F.lit(0)))
        df = df.withColumn(trg, F.when(F.col("__fix"), fixed).otherwise(F.col(trg))).where("__same OR __fix").drop("__fix")
    else:
        df = df.where("__same")
    return df.drop("__a", "__b", "__same")


define("currency_mismatch", BILINGUAL, "Keep pairs with the same currencies in the same style.", "frame", FIX=FLAG)(_currency_mismatch)


def same_currencies(src: Column, trg: Column) -> Column:
    return entities.currency_keys(entities.currencies_of(src)) == entities.currency_keys(entities.currencies_of(trg))


UNIT = Param("str", "word", choices=("word", "character", "char"))


def measured(c: Column, unit: str) -> Column:
    return (text.n_tokens(c) if unit == "word" else F.length(c)).cast("long")


@define(
    "opus.LengthFilter", BILINGUAL, "Keep rows whose lengths are in a range.", "keep",
    min_length=Param("int", 1), max_length=Param("int", 100), unit=UNIT, pass_empty=FLAG,
)
def length_filter(p, columns):
    lengths = [measured(c, p["unit"]) for c in columns]
    keep = every(n.between(p["min_length"], p["max_length"]) for n in lengths)
    return keep | every(n == 0 for n in lengths) if p["pass_empty"] else keep


@define("opus.LengthRatioFilter", BILINGUAL, "Keep rows whose lengths differ by less than a factor.", "keep", threshold=Param("int", 3), unit=UNIT)
def length_ratio_filter(p, columns):
    lengths = [measured(c, p["unit"]) for c in columns]
    if len(lengths) < 2:
        return F.lit(True)
    low, high = F.least(*lengths), F.greatest(*lengths)
    return F.when(low == 0, high == 0).otherwise(high < low * p["threshold"])


def longest_word(c: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(text.tokens(c), lambda t: F.length(t))), F.lit(0))


@define("opus.LongWordFilter", BILINGUAL, "Drop rows with a word of so many characters.", "keep", threshold=Param("int", 40))
def long_word_filter(p, columns):
    return every(longest_word(c) < p["threshold"] for c in columns)


def average_word(c: Column) -> Column:
    words = text.tokens(c)
    total = F.aggregate(words, F.lit(0), lambda n, t: n + F.length(t))
    return F.coalesce(F.try_divide(total.cast("double"), F.size(words)), F.lit(0.0))


@define(
    "opus.AverageWordLengthFilter", BILINGUAL, "Keep rows whose mean word length is in a range.", "keep",
    min_length=Param("int", 1), max_length=Param("int", 100), pass_empty=FLAG,
)
def average_word_length_filter(p, columns):
    means = [average_word(c) for c in columns]
    keep = every(m.between(p["min_length"], p["max_length"]) for m in means)
    return keep | every(m == 0 for m in means) if p["pass_empty"] else keep


def alphabetic_share(c: Column, exclude_whitespace: bool = False) -> Column:
    """Letters among all characters; 1 for an empty text."""
    of = F.regexp_replace(c, text.WS, "") if exclude_whitespace else c
    return F.coalesce(F.try_divide(F.regexp_count(c, F.lit(r"\p{L}")).cast("double"), F.length(of)), F.lit(1.0))


@define(
    "opus.AlphabetRatioFilter", BILINGUAL, "Keep rows with enough letters.", "keep",
    threshold=Param("float", 0.75), exclude_whitespace=FLAG,
)
def alphabet_ratio_filter(p, columns):
    return every(alphabetic_share(c, p["exclude_whitespace"]) >= p["threshold"] for c in columns)


#: Names of scripts.
SCRIPT_NAMES = (
    "Common Arabic Armenian Bengali Bopomofo Braille Buhid Canadian_Aboriginal Cherokee Cyrillic Devanagari Ethiopic"
    " Georgian Greek Gujarati Gurmukhi Han Hangul Hanunoo Hebrew Hiragana Inherited Kannada Katakana Khmer Lao Latin"
    " Limbu Malayalam Mongolian Myanmar Ogham Oriya Runic Sinhala Syriac Tagalog Tagbanwa TaiLe Tamil Telugu Thaana"
    " Thai Tibetan Yi"
).split()
SCRIPT = Param("str", "Latin", choices=tuple(SCRIPT_NAMES))


def script_share(c: Column, script: str) -> Column:
    """Letters of the script among all letters; 1 without letters."""
    name = {"TaiLe": "Tai_Le"}.get(script, script)
    own = F.regexp_count(c, F.lit(rf"[\p{{L}}&&\p{{Is{name}}}]")).cast("double")
    return F.coalesce(F.try_divide(own, F.regexp_count(c, F.lit(r"\p{L}"))), F.lit(1.0))


@define(
    "opus.CharacterScoreFilter", BILINGUAL, "Keep rows whose letters are of the given scripts.", "keep",
    scripts=Param("tuple", items=(SCRIPT, SCRIPT)), thresholds=Param("tuple", items=(Param("float", 1.0), Param("float", 1.0))),
)
def character_score_filter(p, columns):
    return every(script_share(c, s) >= t for c, s, t in zip(columns, p["scripts"], p["thresholds"], strict=False))


HTML_TAG = r"<(?:/?[A-Za-z][^<>]*|!--.*?--|!DOCTYPE[^<>]*)>"


@define("opus.HtmlTagFilter", BILINGUAL, "Drop rows with an HTML tag (found by a pattern, not by parsing).", "keep")
def html_tag_filter(p, columns):
    return every(~c.rlike("(?is)" + HTML_TAG) for c in columns)


@define(
    "opus.RegExpFilter", BILINGUAL, "Drop rows that match, or with accept_match keep those that do on all sides.", "keep",
    regexps=Param("tuple", items=(Param("str"), Param("str"))), accept_match=FLAG,
)
def regexp_filter(p, columns):
    matches = [c.rlike(text.java_pattern(r)) for c, r in zip(columns, p["regexps"], strict=False)]
    return every(matches) if p["accept_match"] else every(~m for m in matches)


# fix_quotes drops what it has emptied.
_quotes = REGISTRY.get("fix_quotes")
REGISTRY.add(FilterSpec(_quotes.name, _quotes.kind, _quotes.params, _quotes.doc, _quotes.rewrite, no_field_empty))


# Languages. A detector is a function of a column that gives struct<lang: string, reliable: boolean>.
#: Languages that detectors confuse.
SIMILAR = {
    "bg": "mk bg", "bs": "bs hr me sr", "ca": "es ca", "cs": "sk cs", "da": "da nb", "es": "es gl ca", "gl": "es pt gl",
    "hr": "bs hr me sr", "me": "bs hr me sr", "mk": "bg mk", "nb": "nn da nb", "nl": "nl af", "nn": "nb da nn",
    "sk": "cs sk", "sr": "bs hr me sr",
}
#: Codes that macrolanguages share, and those of models with three letters.
MACRO = {"bs": "hbs", "hr": "hbs", "sr": "hbs", "id": "msa", "ms": "msa", "zh": "cmn", "fa": "pes"}
THREE = {"ar": "arb", "fa": "pes", "id": "ind", "ms": "zsm"}

#: Frequent short words of languages: a small profile, a substitute for trained detectors.
PROFILES = {
    "de": "der die das und ist nicht ein eine mit von zu den auf sich für dem im es auch als",
    "en": "the of and to in is that it for was on are with as be this by from not or",
    "es": "el la los las de que y en un una por con para es se del no su al lo",
    "fr": "le la les de des et un une est dans que pour qui sur pas au ne ce il du",
    "it": "il lo gli di che e un una per con è non del della sono si da più anche le",
    "nl": "de het een van en is dat niet op te zijn voor met aan die er maar ook om",
    "pl": "i w na nie z się do to jest że o jak po co tak od za ale by już",
    "pt": "o os as de que e do da em um uma para com não por se mais dos ao na",
    "sv": "och att det som en på är av för med den till inte har om ett var jag men",
}


def profile_detector(c: Column) -> Column:
    """The language most of whose frequent words a text has; reliable if it leads by two or more."""
    words = text.tokens(F.lower(F.regexp_replace(c, r"[\p{Punct}…“”„«»]", " ")))


    def score(lang: str, found: Column) -> Column:
        frequent = PROFILES[lang].split()
        return F.struct(F.size(F.filter(found, lambda t: t.isin(frequent))).alias("n"), F.lit(lang).alias("lang"))

    ranked = F.element_at(
        F.transform(F.array(words), lambda w: F.sort_array(F.array(*[score(x, w) for x in sorted(PROFILES)]), asc=False)), 1
    )
    best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    reliable = best["n"] - second["n"] >= 2
    return F.struct(F.when(best["n"] > 0, best["lang"]).otherwise("un").alias("lang"), reliable.alias("reliable"))


DETECTORS = {"profile": profile_detector}


def accepts(found: Column, language: str, similar: bool, unknown: bool, compat: bool) -> Column:
    """compat: a reliable wrong answer passes for languages without similar ones, if `unknown`."""
    reliable, lang = found["reliable"], found["lang"]
    keep = reliable & (lang == language)
    if similar and language in SIMILAR:
        keep = keep | (reliable & lang.isin(SIMILAR[language].split()))
    if similar and unknown and compat and language not in SIMILAR:
        keep = keep | reliable
    return keep | ~reliable if unknown else keep


DETECTOR = Param("str", "profile")


@define(
    "langid", BILINGUAL, "Keep rows in the given languages, as a plugged-in detector finds them.", "keep",
    SRC_LANG=Param("str", ""), TRG_LANG=Param("str", ""), ALLOW_SIMILAR=ON, ALLOW_UNKNOWN=ON, DETECTOR=DETECTOR, COMPAT=FLAG,
)
def langid(p, columns):
    detect = DETECTORS[p["DETECTOR"]]
    return every(
        accepts(detect(c), lang, p["ALLOW_SIMILAR"], p["ALLOW_UNKNOWN"], p["COMPAT"])
        for c, lang in zip(columns, (p["SRC_LANG"], p["TRG_LANG"]), strict=False)
        if lang
    )


@define(
    "langid_heliport", BILINGUAL, "Keep rows in the given languages; macrolanguages count as one.", "keep",
    SRC_LANG=Param("str", ""), TRG_LANG=Param("str", ""), ALLOW_NOTEXT=ON, DETECTOR=DETECTOR,
)
def langid_heliport(p, columns):
    detect = DETECTORS[p["DETECTOR"]]
    mapping = F.create_map(*[F.lit(x) for kv in MACRO.items() for x in kv])

    def keep(c: Column, lang: str) -> Column:
        found = detect(c)["lang"]
        same = F.coalesce(F.try_element_at(mapping, found), found) == MACRO.get(lang, lang)
        return same | ~c.rlike(r"\p{L}") if p["ALLOW_NOTEXT"] else same

    return every(keep(c, lang) for c, lang in zip(columns, (p["SRC_LANG"], p["TRG_LANG"]), strict=False) if lang)


@define(
    "fasttext_filter", BILINGUAL, "Keep rows whose best label is the given language.", "keep",
    FASTTEXT_MODEL_TYPE=Param("str", "nllb", choices=("small", "large", "openlid-v2", "nllb")),
    LANG1=Param("str", "en"), LANG2=Param("str", "en"), DETECTOR=DETECTOR,
)
def fasttext_filter(p, columns):
    detect = DETECTORS[p["DETECTOR"]]
    long_codes = p["FASTTEXT_MODEL_TYPE"] in ("openlid-v2", "nllb")
    return every(
        detect(c)["lang"].isin(*{lang, THREE.get(lang, lang) if long_codes else lang})
        for c, lang in zip(columns, (p["LANG1"], p["LANG2"]), strict=False)
    )
