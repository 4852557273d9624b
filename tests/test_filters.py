"""Filters on literal rows."""

import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import entities, text
from corpusloom.operators import REGISTRY, Param, predicates, rewrites
from corpusloom.operators.spec import FilterSpec
from corpusloom.plans.pipeline import Pipeline


def run(spark, name, rows, language=None, langs=("src", "trg"), **given):
    """Texts after one step; rows are tuples of texts."""
    parameters = REGISTRY.get(name).fill(given)[0]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "line_no long, " + ", ".join(f"{c} string" for c in langs))
    out = Pipeline.from_json([{"filter": name, "parameters": parameters, "language": language}]).run(df, list(langs))
    return [tuple(r[c] for c in langs) for r in out.orderBy("line_no").collect()]


def mono(spark, name, texts, **given):
    return [r[0] for r in run(spark, name, [(t,) for t in texts], "src", ("src",), **given)]


NUMBERS = [  # pair, ratio, kept
    ("Room 12 is free", "Zimmer 12 ist frei", 1.0, True),
    ("It costs 1,250.75 here", "Es kostet 1.250,75 hier", 1.0, True),
    ("Bus 41 leaves", "Bus 14 fährt", 1.0, False),
    ("From 8 to 9 there are 31 boats", "Um 9 kommen 32 Boote, um 8 keine", 0.5, True),
    ("From 8 to 9 there are 31 boats", "Um 9 kommen 32 Boote", 1.0, False),
    ("Agent 0042 reports", "Nummer 42 meldet sich", 1.0, True),
    ("It fell to -12.25 tonight", "Heute nacht -12,25", 1.0, True),
    ("It fell to -12.25 tonight", "Heute nacht 12,25", 1.0, False),
    ("We scored +3 today", "Heute 3", 1.0, False),
    ("We scored +3 today", "Heute -3", 1.0, False),
    ("The 90s and mp3", "Das x86 und 5th", 1.0, True),
    ("+8 comes first", "Zuletzt kommt +8", 1.0, True),
    ("model-500-b", "Modell 500", 1.0, True),
    ("model-500", "Es sind -500", 1.0, False),
    ("0.5 and 00 and 1:30", "0,5 und 0 und 1.30", 1.0, True),
    ("1..2 are two", "1 und 2", 1.0, True),
    ("7.5x has one", "7", 1.0, True),
    ("No digits", "Keine Ziffern", 2.0, True),
    ("The 90s", "Die 90er", 2.0, True),
    ("Only 3", "Nur 3", 2.0, True),
    ("Only 3", "Nur 4", 2.0, False),
]


def test_numbers(spark):
    for ratio in (0.5, 1.0, 2.0):
        rows = [n for n in NUMBERS if n[2] == ratio]
        got = run(spark, "num_mismatch", [n[:2] for n in rows], RATIO=ratio)
        assert got == [n[:2] for n in rows if n[3]]


def test_urls(spark):
    keep = [
        ("Read it on maps.example.org today", "Heute auf maps.example.org lesen"),
        ("First a.example.net, then 10.0.0.1:8080/x", "Erst a.example.net, dann 10.0.0.1:8080/x"),
        ("The end.Then more", "Das Ende. Dann mehr"),
        ("no link", "kein Verweis"),
        ("see ftp://me:pw@[::1]/a?b=c#d.", "siehe ftp://me:pw@[::1]/a?b=c#d!"),
    ]
    drop = [
        ("at https://shop.example.de/item?id=4&lang=de now", "auf https://shop.example.at/item?id=4&lang=de jetzt"),
        ("at shop.example.de", "auf shop.example.at"),
        ("at shop.example.de", "dort"),
        ("one.example.de before two.example.de", "two.example.de vor one.example.de"),
        ("http://example.de/a", "http://example.de/b"),
    ]
    assert run(spark, "url_mismatch", keep + drop) == keep


CURRENCY = [  # pair, kept, target after the fix (None: dropped)
    ("Tickets: 12.50 € or 3 € off", "Karten: 14,50 € oder 2 € weniger", True, ""),
    ("between £/$ 20 and £/$ 40", "zwischen 20 $ und 40 $", True, ""),
    ("Rooms from £64 a night", "Zimmer ab € 71 die Nacht", False, "Zimmer ab £ 71 die Nacht"),
    ("They paid $900", "Sie zahlten 900 EUR", False, None),
    ("They paid $900", "Sie zahlten 900 Euro", False, None),
    ("They paid 900 USD", "Sie zahlten 900 EUR", False, "Sie zahlten 900 USD"),
    ("for $7.25 only", "nur 7,25 €", False, "nur 7,25 $"),
    ("from $10 to $20 ($30)", "von 10 CAD bis 20 CAD (30 CAD)", False, None),
    ("about $2 NZD", "etwa 2 NZD", False, None),
    ("a fee of $80", "eine Gebühr von 80", False, None),
    ("a fee of 80 THB", "eine Gebühr von 80", False, None),
    ("a fee of 80 SGD", "eine Gebühr von SGD 80", True, ""),
    ("a fee of 80 SGD", "eine Gebühr von 80 HUF", False, "eine Gebühr von 80 SGD"),
    ("stakes of £3,000!", "Einsätze von 3.000 Pfund!", False, None),
    ("500 CZK (1 EUR is 25 CZK)", "500 крон (1 EUR = 25 крон)", False, None),
    ("a 6$ bag", "für 6 $", True, ""),
    ("the $ is up", "der EUR ist oben", True, ""),
    ("a 6$ bag", "für 6 £", False, "für 6 $"),
    ("a 6$ bag", "für 6 EUR", False, None),
    ("a 6$ bag", "für 6 USD", False, None),
    ("6 USDA labels", "6 Siegel", True, ""),
]


def test_currencies(spark):
    pairs = [c[:2] for c in CURRENCY]
    assert run(spark, "currency_mismatch", pairs) == [c[:2] for c in CURRENCY if c[2]]
    fixed = [(c[0], c[1] if c[2] else c[3]) for c in CURRENCY if c[2] or c[3]]
    assert run(spark, "currency_mismatch", pairs, FIX=True) == fixed


def test_symbols_may_stand_for_several_codes(spark):
    codes = entities.currency_codes()
    assert "USD" in codes["$"] and "CAD" in codes["$"] and codes["€"] == ["EUR"]


def test_white_space_is_that_of_python(spark):
    r = random.Random(1)
    alphabet = "ab \t\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0      　​﻿é😀"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 12))) for _ in range(300)]
    assert mono(spark, "normalize_whitespace", texts) == [" ".join(t.split()) for t in texts]
    assert mono(spark, "normalize_whitespace", texts, COLLAPSE=False) == [t.strip() for t in texts]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k")
    assert [r.n for r in df.select("k", text.n_tokens(F.col("t")).alias("n")).orderBy("k").collect()] == [len(t.split()) for t in texts]
    assert run(spark, "remove_empty_lines", [(t, "x") for t in texts]) == [(t, "x") for t in texts if t.strip()]


def test_lengths(spark):
    rows = [("a b c", "a b"), ("", "a"), ("a b c d", "a b"), ("a", "b")]
    assert run(spark, "max_length", rows, MAXLENGTH=3, MINLENGTH=1) == [rows[0], rows[3]]
    assert run(spark, "max_word_length", [("aaaa bb", "c"), ("aa\tbb", "c"), ("😀😀", "c")], MAXWORDLENGTH=4) == [("aaaa bb", "c"), ("😀😀", "c")]
    assert run(spark, "src_trg_ratio", [("a b c", "a b"), ("a", "a b"), ("", ""), ("a", "")]) == [("a b c", "a b")]
    assert run(spark, "src_trg_ratio", [("a", "a b"), ("", ""), ("a", "")], RATIO=0.5, LOG=True) == [("a", "a b")]
    assert run(spark, "src_trg_ratio", [("A b", "a B"), ("A b", "a c")], IDENTICAL=True) == [("A b", "a c")]


def test_alphabet(spark):
    rows = [("hello world", "hallo welt"), ("12345 67890", "hallo"), ("", "x"), ("café été", "ok")]
    assert run(spark, "alpha_ratio", rows, LANG1="en", LANG2="de") == [rows[0], rows[3]]
    assert run(spark, "alpha_ratio", rows, LANG1="fr", SRCALPHARAT=0.99) == [rows[0], rows[3]]
    assert run(spark, "alpha_ratio", rows, LANG1="xx") == rows
    assert run(spark, "alpha_ratio", [("привет мир", "x")], LANG1="mk") == [("привет мир", "x")]


def test_composition(spark):
    texts = ["é", "Å", "x", "한", ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.c for r in df.select("k", predicates.composed(F.col("t")).alias("c")).orderBy("k").collect()]
    assert got == [unicodedata.normalize("NFC", t) for t in texts]


def test_escapes(spark):
    assert mono(spark, "deescape-special-chars", ["&amp;lt; &lt;b&gt; &#124;&bar; &quot;&apos;&#91;&#93;&bra;&ket;"]) == ["&lt; <b> || \"'[][]"]
    rows = [('"a ""b"""', "c"), ('"', '""'), ('"open', 'close"')]
    assert run(spark, "deescape_tsv", rows) == [('a "b"', "c"), ("", ""), ('"open', 'close"')]


def test_encoding_repairs(spark):
    assert mono(spark, "fix_elitr_eca", ["D\u0083claration lŐan ¬ x financi\U0010fcd5le"]) == ["DÉclaration l'an x financiële"]


def test_quotes(spark):
    rows = [("„Hallo” ;", "'x"), ('"a";', "“b”"), ('"x"', '""'), ("plain", "text ")]
    model = lambda s: re.sub(r"""^['‘"“„](.+?)["”;]*$""", r"\1", s).strip()
    assert run(spark, "fix_quotes", rows) == [tuple(map(model, r)) for r in rows if all(map(model, r))]


def test_final_punctuation(spark):
    rows = [
        ("Hello !", "Hallo!"), ("Hello.", "Hallo"), ("Hello", "Hallo?"), ("Hello!", "Hallo."), ("Bonjour »", "Hello"),
        ("x ».", "y."), ('a."', 'b".'), ("", "x."), ("– a!", "b."), ("a-", "b"),
    ]
    expected = [
        ("Hello!", "Hallo!"), ("Hello.", "Hallo."), ("Hello?", "Hallo?"), ("Hello!", "Hallo!"), ("Bonjour »", 'Hello"'),
        ("x. »", "y."), ('a."', 'b."'), ("", "x."), ("– a!", "b."), ("a-", "b"),
    ]
    assert run(spark, "fix_sent_final_punct", rows) == expected


def test_chinese(spark):
    assert mono(spark, "fix_un_chinese", [" 你好, 世界.", "你好，", "", "a,"]) == ["你好， 世界。", "你好。", "", "a，"]
    assert mono(spark, "traditionalise_chinese", ["学国"]) == ["學國"]
    assert mono(spark, "simplify_chinese", ["學國"]) == ["学国"]
    assert mono(spark, "segment_chinese", ["我是 Bob"]) == ["我 是 Bob"]


def test_wiki(spark):
    rows = [
        ("a[1] b", "c"), ("a[1] b", "c[1]"), ("see [[x|y]] z", "w"), ("http://x.org/a b", "c"), ("== T == b", "c"),
        ("k .mw-parser-output", "c"), ("[1]", "c"),
    ]
    expected = [("a b", "c"), ("a[1] b", "c[1]"), ("see y z", "w"), ("b", "c"), ("b", "c")]
    assert run(spark, "fix_wiki", rows) == expected
    assert run(spark, "fix_wiki", rows[1:2], ALWAYS=True) == [("a b", "c")]
    assert run(spark, "fix_wiki", rows[6:], REMOVEEMPTYLINES=False) == [("", "c")]


def test_wiki_markup_of_all_kinds(spark):
    rows = [
        ("See Hello.World and example.com now", "x"), ("See https://example.com/a?b now", "x"), ("to http://localhost/x", "x"),
        ("k ==A=B== z", "x"), ("k === A === z", "x"), ("[[p|q|r]] s", "x"), ("[[p]] and [[q|r]]", "x [[y]]"), ("[1] a [2]", "[1] b [3]"),
    ]
    assert [a for a, _ in run(spark, "fix_wiki", rows)] == [
        "See Hello.World and example.com now", "See  now", "to http://localhost/x", "k  z", "k  z", "q|r s", "[[p]] and [[q|r]]", "a",
    ]


def test_alphabets_come_from_locale_data(spark):
    from corpusloom.functions.scripts import alphabet

    assert len([x for x in ("en de fr pl tr el ka hy am sw is cy eu yo zu vi ta my km ckb").split() if alphabet(x)]) == 20
    assert alphabet("xx") is None and alphabet("") is None and alphabet("xx", {"xx": "a-f"}) == "[a-f]"
    rows = [("žluťoučký kůň", "x"), ("ведмідь", "x")]
    assert run(spark, "alpha_ratio", rows, LANG1="cs") == rows[:1]
    assert run(spark, "alpha_ratio", rows, LANG1="uk") == rows[1:]
    assert run(spark, "alpha_ratio", rows, LANG1="tlh", ALPHABET1="[а-яі]") == rows[1:]


def test_frequent_patterns(spark, tmp_path):
    rows = [(" -x", "y"), ("• a", "b"), ("• a", "• b"), ("a (Ekumenická Bible)", "b")]
    got = run(spark, "remove_frequent_patterns", rows, PATTERN_FILE="remove_frequent_patterns.txt")
    assert got[:3] == [("x", "y"), ("a", "b"), ("• a", "• b")]
    path = tmp_path / "patterns"
    path.write_text("# comment\n(b)c\t\\1\\1\n^x\ta\tz\n", encoding="utf-8")
    assert run(spark, "remove_frequent_patterns", [("abc", "a"), ("xa", "a")], PATTERN_FILE=str(path)) == [("abb", "a"), ("xz", "z")]
    with pytest.raises(ValueError):
        rewrites.parse_patterns("one")


def test_substitutions(spark):
    assert mono(spark, "regexp", ["abcabc"], PATTERN="s/b(c)/<$1>/") == ["a<c>abc"]
    assert mono(spark, "regexp", ["abcabc"], PATTERN=r"s|B(c)|\1$&|gi; y/a-b/x-y/") == ["xcycxcyc".replace("y", "y")]
    assert mono(spark, "regexp", ["a/b"], PATTERN=r"s/\//-/") == ["a-b"]
    for bad in ("print 1", "s/a/b", "s/a/b/e", "tr/a/b/c"):
        with pytest.raises(ValueError):
            rewrites.substitution(bad)
    assert mono(spark, "sed", ["a1b22 $"], PATTERN="([0-9]+)", REPLACEMENT=r"<\1&>") == ["a<11>b<2222> $"]
    assert mono(spark, "sed", ["same"]) == ["same"]
    patterns = [("a", "x", 2, ""), ("B", "$", 0, "I")]
    assert mono(spark, "opus.RegExpSub", ["aaab"], patterns=patterns) == ["xxa$"]
    assert mono(spark, "opus.RegExpSub", ["baab"], patterns=[("a", "x", 1, "")]) == ["bxab"]


def test_tokens_there_and_back(spark):
    texts = ["Hello, world!", 'He said "no" twice.', "It's 3.5 (or so).", "Price: $5"]
    coded = run(spark, "opus.Tokenizer", [(t, t) for t in texts])
    assert coded[0][0] == "Hello , world !" and coded[1][0] == 'He said " no " twice .'
    assert [r[0] for r in run(spark, "opus.Detokenizer", coded)] == texts
    assert mono(spark, "detokenizer", ["l' homme , oui"], LANG1="fr") == ["l'homme, oui"]
    assert mono(spark, "detokenizer", ["EU :ssa a @-@ b &amp; c"], LANG1="fi")[0].endswith("a-b & c")
    assert mono(spark, "detokenizer", ["我 是 人"], LANG1="zh") == ["我是人"]


def test_sentences(spark):
    rows = [("One here. Two there!", "Eins da. Zwei dort!"), ("Dr. No is here. Yes.", "Nur eins"), ("one", "eins")]
    assert run(spark, "split_sentences", rows, LANG1="en", LANG2="de") == [
        ("One here.", "Eins da."), ("Two there!", "Zwei dort!"), ("one", "eins"),
    ]
    assert rows[1] in run(spark, "split_sentences", rows, LANG1="en", LANG2="de", KEEPUNBALANCED=True)


def test_opus_filters(spark):
    rows = [("a b", "c"), ("", ""), ("<b>x</b>", "y"), ("x < y", "z"), ("я", "a"), ("a1", "b")]
    assert ("", "") not in run(spark, "opus.LengthFilter", rows) and ("", "") in run(spark, "opus.LengthFilter", rows, pass_empty=True)
    assert rows[2] not in run(spark, "opus.HtmlTagFilter", rows) and rows[3] in run(spark, "opus.HtmlTagFilter", rows)
    assert rows[4] not in run(spark, "opus.CharacterScoreFilter", rows)
    assert rows[4] in run(spark, "opus.CharacterScoreFilter", rows, scripts=("Cyrillic", "Latin"))
    assert rows[5] not in run(spark, "opus.RegExpFilter", rows, regexps=("[0-9]", "[0-9]"))
    assert run(spark, "opus.RegExpFilter", rows, regexps=("[0-9]", "b"), accept_match=True) == [rows[5]]
    assert rows[5] not in run(spark, "opus.AlphabetRatioFilter", rows)
    assert run(spark, "opus.LongWordFilter", [("abc", "de"), ("ab", "de")], threshold=3) == [("ab", "de")]
    assert run(spark, "opus.AverageWordLengthFilter", [("", "ab"), ("", "")], pass_empty=True) == [("", "")]
    assert run(spark, "opus.LengthRatioFilter", [("a b c", "a"), ("a b", "a"), ("", "")]) == [("a b", "a"), ("", "")]


def test_languages(spark):
    rows = [("the cat is on the mat and it is not", "die Katze ist auf der Matte und das ist nicht"), ("zzz", "yyy"),
            ("die Katze ist auf der Matte und das ist nicht", "the cat is on the mat")]
    given = {"SRC_LANG": "en", "TRG_LANG": "de"}
    assert run(spark, "langid", rows, **given) == rows[:2]
    assert run(spark, "langid", rows, ALLOW_UNKNOWN=False, **given) == rows[:1]
    assert run(spark, "langid", rows, COMPAT=True, **given) == rows
    assert run(spark, "langid_heliport", [*rows, ("12", "34")], **given) == [rows[0], ("12", "34")]
    assert run(spark, "fasttext_filter", rows, LANG1="en", LANG2="de") == rows[:1]


def test_plug_in_detector(spark):
    predicates.DETECTORS["constant"] = lambda c: F.struct(F.lit("hr").alias("lang"), F.lit(True).alias("reliable"))
    try:
        assert run(spark, "langid", [("a", "b")], SRC_LANG="bs", TRG_LANG="sr", DETECTOR="constant") == [("a", "b")]
        assert run(spark, "langid", [("a", "b")], SRC_LANG="bs", ALLOW_SIMILAR=False, DETECTOR="constant") == []
        assert run(spark, "langid_heliport", [("a", "b")], SRC_LANG="bs", DETECTOR="constant") == [("a", "b")]
    finally:
        del predicates.DETECTORS["constant"]


def test_parameters():
    spec = REGISTRY.get("max_length")
    assert spec.fill({})[0] == {"MAXLENGTH": 150, "MINLENGTH": 1}
    filled, warnings = spec.fill({"MAXLENGTH": "20", "X": 1})
    assert filled == {"MAXLENGTH": 20, "MINLENGTH": 1, "X": 1} and len(warnings) == 2
    with pytest.raises(ValueError):
        REGISTRY.get("opus.LengthFilter").fill({"unit": "line"})
    assert Param("str", "a", choices=("a",)).convert("b", strict=False) == "b"
    assert Param("float", minimum=0).convert("0.5") == 0.5
    assert Param("bool").convert("false") is False
    assert Param("tuple", items=(Param("int", 1), Param("str"))).initial() == (1, "")
    assert Param("list", items=Param("int")).convert(["1"]) == [1]
    with pytest.raises(ValueError):
        FilterSpec("x", "bilingual", {"not an id": Param("int")})
    assert json.dumps([s.describe() for s in REGISTRY.find("length")], default=list)
