"""Filters that rewrite text. One column in, one column out, or all columns of a row together."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import entities, text
from corpusloom.operators.spec import BILINGUAL, MONOLINGUAL, Param, define

FLAG, ON = Param("bool", False), Param("bool", True)


def each(f):
    """A rewrite that treats every column alike."""
    return lambda p, columns: [f(p, c) for c in columns]


@define("normalize_whitespace", MONOLINGUAL, "Trim white space, and collapse runs of it.", "rewrite", COLLAPSE=ON)
def normalize_whitespace(p, columns):
    return [text.collapse(c) if p["COLLAPSE"] else text.strip(c) for c in columns]


@define("opus.WhitespaceNormalizer", BILINGUAL, "Collapse runs of white space and trim.", "rewrite")
def whitespace_normalizer(p, columns):
    return [text.collapse(c) for c in columns]


@define("deescape_tsv", BILINGUAL, "Undo the quoting of tab-separated values.", "rewrite")
def deescape_tsv(p, columns):
    def plain(c: Column) -> Column:
        inside = F.when(F.length(c) > 1, F.substring(c, F.lit(2), F.length(c) - 2)).otherwise("")
        return F.when(c.startswith('"') & c.endswith('"'), F.replace(inside, F.lit('""'), F.lit('"'))).otherwise(c)

    return [plain(c) for c in columns]


#: The escapes, in the order in which they are undone.
ESCAPES = (
    ("&bar;", "|"), ("&#124;", "|"), ("&lt;", "<"), ("&gt;", ">"), ("&bra;", "["), ("&ket;", "]"),
    ("&quot;", '"'), ("&apos;", "'"), ("&#91;", "["), ("&#93;", "]"), ("&amp;", "&"),
)


def deescape(c: Column) -> Column:
    for escape, character in ESCAPES:
        c = F.replace(c, F.lit(escape), F.lit(character))
    return c


@define("deescape-special-chars", MONOLINGUAL, "Undo escapes of special characters.", "rewrite", LANG1=Param("str", "en"))
def deescape_special_chars(p, columns):
    return [deescape(c) for c in columns]


#: Wrongly decoded characters and what they stand for.
WRONG = "\u0083\u0088\u0089\u008d\u008e\u008f\u0090\u0091\u0092\u0094\u0099\u009d\u009eŐăÓ\U0010fcd5"
RIGHT = "Éàâçéèêëíîôùû'''ë"


@define("fix_elitr_eca", MONOLINGUAL, "Repair wrongly decoded French characters.", "rewrite")
def fix_elitr_eca(p, columns):
    return [F.replace(F.translate(c, WRONG, RIGHT), F.lit("¬ "), F.lit("")) for c in columns]


QUOTED = r"""(?d)^['‘"“„](.+?)["”;]*$"""


@define("fix_quotes", BILINGUAL, "Take the quotes off quoted fields; rows with an empty field go.", "rewrite")
def fix_quotes(p, columns):
    return [text.strip(F.regexp_replace(c, QUOTED, "$1")) for c in columns]


def no_field_empty(p, columns) -> Column:
    keep = F.lit(True)
    for c in columns:
        keep = keep & (c != "")
    return keep


@define("fix_un_chinese", MONOLINGUAL, "Chinese punctuation for ASCII punctuation.", "rewrite")
def fix_un_chinese(p, columns):
    def fix(c: Column) -> Column:
        c = text.strip(c)
        c = F.when(c.endswith("，"), F.concat(text.without_last(c, 1), F.lit("。"))).otherwise(c)
        c = F.translate(c, ",", "，")
        return F.when(c.endswith("."), F.concat(text.without_last(c, 1), F.lit("。"))).otherwise(c)

    return [fix(c) for c in columns]


#: What counts as final punctuation.
FINAL = list("!\"#$%&'()*+,./:;<=>?@[\\]^_`{|}~»«“”")


@define("fix_sent_final_punct", BILINGUAL, "Make the final punctuation of both sides agree.", "frame")
def fix_sent_final_punct(df: DataFrame, langs: list[str], p: dict) -> DataFrame:
    """Steps over columns of their own, so that each builds on the one before."""
    src, trg = langs[0], langs[1]

    def final(name: str, back: int = 0) -> Column:
        return text.last(F.col(name), 1, back)

    def is_mark(c: Column) -> Column:
        return c.isin(FINAL)

    def guillemet(c: Column) -> Column:
        return c.isin("»", "«")

    both = (F.length(src) > 0) & (F.length(trg) > 0)
    for name in (src, trg):
        loose = both & (F.length(name) >= 2) & is_mark(final(name)) & (final(name, 1) == " ") & ~guillemet(final(name))
        df = df.withColumn(name, F.when(loose, F.concat(text.without_last(F.col(name), 2), final(name))).otherwise(F.col(name)))
    swapped = both & (F.length(src) >= 2) & (F.length(trg) >= 2) & (final(src, 1) == final(trg)) & (final(src) == final(trg, 1))
    df = df.withColumn(trg, F.when(swapped, F.concat(text.without_last(F.col(trg), 2), final(src, 1), final(src))).otherwise(F.col(trg)))
    for name in (src, trg):
        split = both & (F.length(name) >= 3) & is_mark(final(name)) & (text.last(F.col(name), 2, 1) == " »")
        turned = F.concat(text.without_last(F.col(name), 3), final(name), F.lit(" »"))
        df = df.withColumn(name, F.when(split, turned).otherwise(F.col(name)))
    a, b = final(src), final(trg)
    dash = F.left(F.col(src), F.lit(1)).isin("–", "—") | F.left(F.col(trg), F.lit(1)).isin("–", "—")
    case = (
        F.when(~both, "none")
        .when(guillemet(a) & ~is_mark(b), "quote trg")
        .when(guillemet(b) & ~is_mark(a), "quote src")
        .when(is_mark(a) & ~is_mark(b), "copy to trg")
        .when(is_mark(b) & ~is_mark(a), "copy to src")
        .when(is_mark(a) & is_mark(b) & (a != b) & ~guillemet(a) & ~guillemet(b) & ~dash, "src wins")
        .otherwise("none")
    )
    df = df.withColumn("__case", case).withColumn("__a", a).withColumn("__b", b)
    s, t = F.col(src), F.col(trg)
    new_src = F.when(F.col("__case") == "quote src", F.concat(s, F.lit('"'))).when(F.col("__case") == "copy to src", F.concat(s, "__b"))
    new_trg = (
        F.when(F.col("__case") == "quote trg", F.concat(t, F.lit('"')))
        .when(F.col("__case") == "copy to trg", F.concat(t, "__a"))
        .when(F.col("__case") == "src wins", F.concat(text.without_last(t, 1), "__a"))
    )
    return df.withColumns({src: new_src.otherwise(s), trg: new_trg.otherwise(t)}).drop("__case", "__a", "__b")


# fix_wiki: what is looked for, what it becomes, and how the sides are compared.
#: Footnotes, wiki links (with the label as group 1), headings, and what marks code.
FOOTNOTE, LINK, HEADING, CODE = r"\[[0-9]+\]", r"(?d)\[\[(?:.+?\|)?(.+?)\]\]", r"(?d)(==+)(.+?)\1", ".mw-parser-output"


def _differ_in_set(a: Column, b: Column) -> Column:
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    return both < F.size(F.array_union(a, b)) - both


def _differ_in_count(a: Column, b: Column) -> Column:
    return F.size(F.array_distinct(a)) != F.size(F.array_distinct(b))


@define(
    "fix_wiki", BILINGUAL, "Remove wiki markup where the sides differ in it.", "frame",
    ALWAYS=FLAG, FOOTNOTES=ON, URLS=ON, WIKILINKS=ON, CODE=ON, HEADINGS=ON, REMOVEEMPTYLINES=ON,
)
def fix_wiki(df: DataFrame, langs: list[str], p: dict) -> DataFrame:
    """With REMOVEEMPTYLINES off, rows with empty fields stay."""
    if p["CODE"]:
        df = df.where(~F.exists(F.array(*langs), lambda c: c.contains(CODE)))
    src, trg = langs[0], langs[-1] if len(langs) < 2 else langs[1]
    kinds = (
        ("FOOTNOTES", FOOTNOTE, "", _differ_in_set),
        ("URLS", entities.WEB, "", _differ_in_set),
        ("WIKILINKS", LINK, "$1", _differ_in_count),
        ("HEADINGS", HEADING, "", _differ_in_count),
    )
    for name, pattern, replacement, differ in kinds:
        if p[name]:
            found = [F.regexp_extract_all(F.col(c), F.lit(pattern), F.lit(0)) for c in (src, trg)]
            df = df.withColumn("__fix", F.lit(True) if p["ALWAYS"] else differ(*found))
            df = df.withColumns(
                {c: F.when(F.col("__fix"), F.regexp_replace(c, pattern, replacement)).otherwise(F.col(c)) for c in {src, trg}}
            ).drop("__fix")
    df = df.withColumns({c: text.strip(F.col(c)) for c in langs})
    return df.where(no_field_empty(p, [F.col(c) for c in langs])) if p["REMOVEEMPTYLINES"] else df


#: Patterns that are often on one side only. (guard or None, pattern, replacement).
FREQUENT = (
    (None, r"^ -", ""),
    (None, r" (Ekumenická Bible)", ""),
    (r"^• *[^\t]*\t[^•]", r"^• *", ""),
    (r"^[^•][^\t]*\t•", r"^• *", ""),
)


def parse_patterns(lines: str) -> list[tuple[str | None, str, str]]:
    """A pattern file: pattern, replacement or guard, pattern, replacement between tabs; # comments."""
    out = []
    for line in lines.split("\n"):
        parts = line.rstrip("\r\n").split("\t")
        if not line.strip() or line.startswith("#"):
            continue
        if len(parts) not in (2, 3):
            raise ValueError(f"two or three fields are needed: {line!r}")
        out.append((None, *parts) if len(parts) == 2 else tuple(parts))
    return out


@define(
    "remove_frequent_patterns", BILINGUAL, "Remove patterns that are usually on one side only.", "rewrite",
    PATTERN_FILE=Param("str", "remove_frequent_patterns.txt"),
)
def remove_frequent_patterns(p, columns):
    """PATTERN_FILE: the default name stands for FREQUENT; else a local file's path."""
    name = p["PATTERN_FILE"]
    if name in ("", "remove_frequent_patterns.txt"):
        patterns = FREQUENT
    else:
        with open(name, encoding="utf-8") as file:
            patterns = parse_patterns(file.read())
    line = F.concat_ws("\t", *columns)
    out = list(columns)
    for guard, pattern, replacement in patterns:
        pattern, replacement = text.java_pattern(pattern), text.java_replacement(replacement)
        changed = [F.regexp_replace(c, pattern, replacement) for c in out]
        if guard:
            fits = line.rlike(text.java_pattern(f"^(?:{guard})"))
            changed = [F.when(fits, new).otherwise(old) for new, old in zip(changed, out, strict=True)]
        out = changed
    return out


def _split_expression(body: str, delimiter: str) -> list[str]:
    parts, part, k = [], "", 0
    while k < len(body):
        if body[k] == "\\" and k + 1 < len(body):
            part += body[k + 1] if body[k + 1] == delimiter and not delimiter.isalnum() and delimiter not in ".|()[]{}^$*+?" else body[k : k + 2]
            k += 2
        elif body[k] == delimiter:
            parts.append(part)
            part, k = "", k + 1
        else:
            part, k = part + body[k], k + 1
    return [*parts, part]


def _spelled_out(characters: str) -> str:
    """a-e as abcde."""
    return re.sub(r"(.)-(.)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), characters)


def substitution(expression: str):
    """Perl's s/pattern/replacement/flags, tr/from/to/ and y/from/to/, several between semicolons,
    as a function of a column. Flags g, i, s and m; anything else is an error."""
    changes = []
    rest = expression.strip().rstrip(";")
    while rest:
        found = re.match(r"\s*(s|tr|y)\s*([^\w\s])", rest)
        if not found:
            raise ValueError(f"only s///, tr/// and y/// are known: {rest!r}")
        kind, delimiter = found.groups()
        parts = _split_expression(rest[found.end() :], delimiter)
        if len(parts) < 3:
            raise ValueError(f"unfinished expression: {rest!r}")
        tail = delimiter.join(parts[2:])
        flags = re.match(r"[a-z]*", tail)[0]
        after = tail[len(flags) :].lstrip()
        if after and not after.startswith(";"):
            raise ValueError(f"unexpected {after!r}")
        if set(flags) - set("gism" if kind == "s" else ""):
            raise ValueError(f"unknown flags {flags!r}")
        if kind == "s":
            pattern = text.java_pattern(parts[0])
            marks = "".join(f for f in flags if f in "ism")
            pattern = f"(?{marks}){pattern}" if marks else pattern
            replacement = re.sub(r"\$\{?(\d+)\}?|\\(\d+)|\$&", lambda m: "\\" + (m[1] or m[2] or "0"), parts[1])
            replacement = text.java_replacement(replacement)
            if "g" in flags:
                changes.append(lambda c, a=pattern, b=replacement: F.regexp_replace(c, a, b))
            else:
                changes.append(lambda c, a=pattern, b=replacement: limited_replace(c, a, b, 1))
        else:
            a, b = _spelled_out(parts[0]), _spelled_out(parts[1])
            b = b + b[-1:] * (len(a) - len(b)) if b else a
            changes.append(lambda c, a=a, b=b: F.translate(c, a, b))
        rest = after.lstrip("; \t\n")

    def change(c: Column) -> Column:
        for one in changes:
            c = one(c)
        return c

    return change


@define("regexp", MONOLINGUAL, "Apply Perl substitutions (s///, tr///) to each line.", "rewrite", PATTERN=Param("str", ""))
def regexp(p, columns):
    change = substitution(p["PATTERN"])
    return [change(c) for c in columns]


@define("sed", MONOLINGUAL, "Replace all matches of an extended regular expression.", "rewrite", PATTERN=Param("str", ""), REPLACEMENT=Param("str", ""))
def sed(p, columns):
    if not p["PATTERN"]:
        return columns
    replacement = re.sub(r"(\\.)|&", lambda m: m[1] or r"\0", p["REPLACEMENT"]).replace(r"\&", "&")
    return [F.regexp_replace(c, text.java_pattern(p["PATTERN"]), text.java_replacement(replacement)) for c in columns]


SUBSTITUTION = Param("tuple", items=(Param("str"), Param("str"), Param("int", 0), Param("str", "")))


@define("opus.RegExpSub", MONOLINGUAL, "Replace regular expressions in order.", "rewrite", patterns=Param("list", items=SUBSTITUTION))
def regexp_sub(p, columns):
    """Each of `patterns` is (pattern, replacement, count or 0 for all, flags)."""

    def change(c: Column) -> Column:
        for pattern, replacement, count, flags in p["patterns"]:
            marks = "".join(f.lower() for f in flags if f in "IMS")
            pattern = text.java_pattern(pattern)
            pattern = f"(?{marks}){pattern}" if marks else pattern
            new = text.java_replacement(replacement)
            if not count:
                c = F.regexp_replace(c, pattern, new)
            else:
                c = limited_replace(c, pattern, new, count)
        return c

    return [change(c) for c in columns]


def limited_replace(c: Column, pattern: str, replacement: str, count: int) -> Column:
    """The first `count` matches replaced: the text is cut after the last of them, and only the head
    is changed."""
    if count == 1:
        end = F.regexp_instr(c, F.lit(pattern)) - 1 + F.coalesce(F.length(F.regexp_substr(c, F.lit(pattern))), F.lit(1))
    else:
        end = F.coalesce(F.try_element_at(_match_ends(c, pattern), F.lit(count)), F.length(c))
    return F.concat(F.regexp_replace(F.left(c, end), pattern, replacement), F.substring(c, end + 1, F.length(c)))


def _match_ends(c: Column, pattern: str) -> Column:
    """Where each match ends: matches and the text between them, added up."""
    lengths = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda m: F.length(m))
    gaps = F.transform(F.split(c, pattern, -1), lambda m: F.length(m))
    sums = F.zip_with(lengths, gaps, lambda m, g: m + g)
    places = F.transform(lengths, lambda m, k: k)
    return F.transform(places, lambda k: F.aggregate(F.slice(sums, 1, k + 1), F.lit(0), lambda a, x: a + x))


# Moses-style tokens: punctuation stands alone, and comes back to its word.
@define("opus.Tokenizer", BILINGUAL, "Separate words and punctuation by spaces.", "rewrite",
        tokenizer=Param("tuple", items=(Param("str", "moses"), Param("str", "moses"))),
        languages=Param("tuple", items=(Param("str", "en"), Param("str", "en"))))
def tokenizer(p, columns):
    return [tokenize(c, p["languages"][min(k, len(p["languages"]) - 1)]) for k, c in enumerate(columns)]


def tokenize(c: Column, language: str = "en") -> Column:
    """Rule-based: separators alone, but not inside numbers, abbreviations of single letters or words
    with hyphens; apostrophes as the language joins them."""
    c = text.collapse(c)
    c = F.regexp_replace(c, r"""([^\p{L}\p{N}\s.'`,\-])""", " $1 ")
    c = F.regexp_replace(c, r"(\.\.+)", " $1 ")
    c = F.regexp_replace(c, r"(?<!\p{N}),|,(?!\p{N})", " , ")
    c = F.regexp_replace(c, r"(?<![\p{L}\p{N}])'|'(?![\p{L}\p{N}])", " ' ")
    if language in ("fr", "it", "ca"):
        c = F.regexp_replace(c, r"(?<=\p{L})'(?=\p{L})", "' ")
    elif language == "en":
        c = F.regexp_replace(c, r"(?<=\p{L})'(?=\p{L})", " '")
    c = F.regexp_replace(c, r"(?<=[\p{L}\p{N}]{2}|[\p{N})\"])\.(?=\s*$)", " .")
    return text.collapse(c)


#: Punctuation that belongs to the word before it, and to the word after it.
CLOSING, OPENING = r"[,.?!:;\\%}\])]+", r"[\p{Sc}(\[{¿¡]+"
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
#: Finnish case endings that follow a colon, and what may follow them.
FINNISH = (
    "(?:n|a|ä|ssa|ssä|sta|stä|hun|hyn|han|hän|hön|un|yn|an|än|ön|seen|lla|llä|lta|ltä|lle|ksi|kse|tta|ine)"
    "(?:ni|si|mme|nne|nsa)?(?:ko|kö|han|hän|pa|pä|kaan|kään|kin)?"
)


def detokenize(c: Column, language: str = "en") -> Column:
    """Spaces off where tokens belong together: closing and opening punctuation, currency signs,
    contractions, pairs of quotes, and text without spaces between words."""
    c = F.concat(F.lit(" "), deescape(F.replace(c, F.lit(" @-@ "), F.lit("-"))), F.lit(" "))
    c = F.regexp_replace(c, rf"(?<=[{CJK}]) +(?=[{CJK}])", "")
    for quote in ('"', "'"):
        c = F.regexp_replace(c, rf" {quote} ([^{quote}]*?) {quote}(?= )", f" {quote}$1{quote}")
    c = F.regexp_replace(c, r" „ (.*?) [“”](?= )", " „$1“")
    if language == "en":
        c = F.regexp_replace(c, r"(?<=[\p{L}\p{N}]) ('\p{L})", "$1")
        c = F.regexp_replace(c, r"(?<=s) '(?= )", "'")
    if language in ("fr", "it"):
        c = F.regexp_replace(c, r"(\p{L}') (?=\p{L})", "$1")
    if language == "cs":
        c = F.regexp_replace(c, r"(?<= \d{1,20}) ([.,]) (?=\d+ )", "$1")
        c = F.regexp_replace(c, r"(\p{L}) ([-–]) (?=(?:li|mail\S*) )", "$1$2")
    if language == "fi":
        c = F.regexp_replace(c, rf"(?iu)(?<=:) ({FINNISH})(?= )", "$1")
    if language == "fr":
        c = F.regexp_replace(c, r" ([?!:;%])(?= )", " $1")
    c = F.regexp_replace(c, rf" ({CLOSING})(?= )", "$1")
    c = F.regexp_replace(c, rf"(?<= )({OPENING}) ", "$1")
    return F.btrim(F.regexp_replace(c, " +", " "), F.lit(" "))


@define("detokenizer", MONOLINGUAL, "Join tokens into running text.", "rewrite", LANG1=Param("str", "en"))
def detokenizer(p, columns):
    return [detokenize(c, p["LANG1"]) for c in columns]


@define("opus.Detokenizer", BILINGUAL, "Join tokens into running text.", "rewrite",
        tokenizer=Param("tuple", items=(Param("str", "moses"), Param("str", "moses"))),
        languages=Param("tuple", items=(Param("str", "en"), Param("str", "en"))))
def opus_detokenizer(p, columns):
    return [detokenize(c, p["languages"][min(k, len(p["languages"]) - 1)]) for k, c in enumerate(columns)]


def upper_first(c: Column) -> Column:
    """The first letter after leading punctuation in upper case."""
    lead = F.regexp_extract(c, r"^([\p{Punct}\s]*)", 1)
    rest = F.substring(c, F.length(lead) + 1, F.length(c))
    return F.concat(lead, F.upper(F.left(rest, F.lit(1))), F.substring(rest, F.lit(2), F.length(rest)))


#: Some characters that differ, simplified and traditional. Substitutes for a full table, which
#: `convert_characters` takes as a parameter.
SIMPLIFIED = "国学会来时们说对这个长门开关东车马鸟鱼龙见贝风飞书买卖头实写农医发后里面听声爱万与业乐问间无电话语言读认识让请谢边过还进远运连选点热亲观觉视节华叶号团园图块场坏"
TRADITIONAL = "國學會來時們說對這個長門開關東車馬鳥魚龍見貝風飛書買賣頭實寫農醫發後裡面聽聲愛萬與業樂問間無電話語言讀認識讓請謝邊過還進遠運連選點熱親觀覺視節華葉號團園圖塊場壞"


def convert_characters(c: Column, source: str, target: str) -> Column:
    return F.translate(c, source, target)


@define("simplify_chinese", MONOLINGUAL, "Traditional characters to simplified ones.", "rewrite")
def simplify_chinese(p, columns):
    return [convert_characters(c, TRADITIONAL, SIMPLIFIED) for c in columns]


@define("traditionalise_chinese", MONOLINGUAL, "Simplified characters to traditional ones.", "rewrite")
def traditionalise_chinese(p, columns):
    return [convert_characters(c, SIMPLIFIED, TRADITIONAL) for c in columns]


def segment_characters(c: Column) -> Column:
    """A substitute for dictionary segmenters: every character of scripts without spaces alone, runs
    of other characters together."""
    one = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
    return text.collapse(F.regexp_replace(c, f"({one})", " $1 "))


#: Segmenters by name. `learned.segmenter` makes one from a lexicon that was learned from a table.
SEGMENTERS = {"characters": segment_characters}
SEGMENTER = Param("str", "characters")


@define("segment_chinese", MONOLINGUAL, "Spaces between Chinese words, by a plugged-in segmenter.", "rewrite", SEGMENTER=SEGMENTER)
def segment_chinese(p, columns):
    return [SEGMENTERS[p["SEGMENTER"]](c) for c in columns]


@define("segment_japanese", MONOLINGUAL, "Spaces between Japanese words, by a plugged-in segmenter.", "rewrite", SEGMENTER=SEGMENTER)
def segment_japanese(p, columns):
    return [SEGMENTERS[p["SEGMENTER"]](c) for c in columns]


#: Abbreviations after which no sentence ends.
ABBREVIATIONS = "Mr|Mrs|Ms|Dr|Prof|St|No|vs|etc|e\\.g|i\\.e|z\\.B|bzw|usw|Hr|Fr|Nr|M|Mme|Sr|Sra|Ud|pág|cf"


def java_quote(value: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", value)


def sentences(c: Column, language: str = "en", abbreviations: Sequence[str] = ()) -> Column:
    """The sentences of a text: it is cut at white space after final punctuation, quotes and brackets
    included, before a capital, digit or opening mark, unless an abbreviation or initial ends there;
    and after full-width marks. `abbreviations`, in lower case and without their last period, as `learned.abbreviations` finds
    them, add to the listed ones."""
    learned = "".join(rf"|(?i:{java_quote(a)})" for a in sorted(abbreviations))
    cut = (
        rf"(?=\s)(?<=[.!?…][\"'”’»)\]]{{0,2}})(?<!\b(?:{ABBREVIATIONS}{learned})\.)(?<!\b\p{{Lu}}\.)\s+(?=[\"'“‘„«(\[¿¡]*[\p{{Lu}}\p{{N}}])"
        r"|(?<=[。！？])(?=[^”’」』）])"
    )
    return F.filter(F.transform(F.split(c, cut, -1), lambda s: text.strip(s)), lambda s: s != "")


@define(
    "split_sentences", BILINGUAL, "Cut rows into sentences where both sides have as many.", "frame",
    LANG1=Param("str", ""), LANG2=Param("str", ""), KEEPUNBALANCED=FLAG, ABBREVIATIONS=Param("list", items=Param("str")),
)
def split_sentences(df: DataFrame, langs: list[str], p: dict) -> DataFrame:
    """A row becomes as many as its sides have sentences (`part` counts them from 0, where the frame
    has a line_no); unequal counts: the row goes, or stays whole with KEEPUNBALANCED."""
    parts = {f"__{c}": sentences(F.col(c), language or "en", p["ABBREVIATIONS"]) for c, language in zip(langs, (p["LANG1"], p["LANG2"]), strict=False)}
    whole = {f"__{c}": F.array(F.col(c)) for c in langs}
    df = df.withColumns({**whole, **parts})
    sizes = [F.size(f"__{c}") for c in langs]
    even = F.lit(True)
    for s in sizes[1:]:
        even = even & (s == sizes[0])
    if p["KEEPUNBALANCED"]:
        df = df.withColumn("__even", even)
        df = df.withColumns({f"__{c}": F.when(F.col("__even"), F.col(f"__{c}")).otherwise(F.array(F.col(c))) for c in langs}).drop("__even")
    else:
        df = df.where(even)
    zipped = F.arrays_zip(*[F.col(f"__{c}").alias(c) for c in langs])
    rest = [c for c in df.columns if c not in langs and c not in whole and c != "part"]
    out = df.select(*rest, F.posexplode(zipped).alias("part", "__row"))
    order = [c for c in df.columns if c in rest or c in langs]
    picked = [F.col(f"__row.{c}").alias(c) if c in langs else F.col(c) for c in order]
    return out.select(*picked, *(["part"] if "line_no" in rest else []))
