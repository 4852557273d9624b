"""Corpora, recipes, duplicates, samples, suffixes, scores, differences, placeholders, streams."""

import gzip
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.functions.vectors import cosine
from corpusloom.operators import dedup, diff, placeholders, sampling, scoring, suffixes
from corpusloom.plans.bridge import Filter, Preprocessor
from corpusloom.plans.pipeline import Pipeline, Step
from corpusloom.sources import catalog, corpus
from corpusloom.streaming import clean

PAIRS = "line_no long, src string, trg string"


def pairs(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], PAIRS)


def put(path, lines, end="\n"):
    opener = gzip.open if str(path).endswith(".gz") else open
    with opener(path, "wt", encoding="utf-8", newline="") as file:
        file.write("".join(line + end for line in lines))
    return str(path)


def test_lines_are_numbered(spark, tmp_path):
    lines = [f"line {k} {'x' * (k % 50)}" for k in range(3000)]
    path = put(tmp_path / "a.en", lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        read = corpus.read_lines(spark, path)
        assert read.rdd.getNumPartitions() > 1
        assert [(r.line_no, r.text) for r in read.orderBy("line_no").collect()] == list(enumerate(lines))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_parallel_files(spark, tmp_path):
    paths = {"de": put(tmp_path / "x.de.gz", ["a", "b c", "d\re"], "\r\n"), "en": put(tmp_path / "x.en.gz", ["1"])}
    padded = corpus.read_parallel(spark, paths).orderBy("line_no").collect()
    assert [tuple(r) for r in padded] == [(0, "a", "1"), (1, "b c", ""), (2, "d\re", "")]
    assert [tuple(r) for r in corpus.read_parallel(spark, paths, pad=False).collect()] == [(0, "a", "1")]


def test_tab_separated(spark, tmp_path):
    rows = [("Hello", "Hallo"), ("Beep", ""), ("", ""), ('"quoted', 'x"')]
    path = put(tmp_path / "x.tsv", ["\t".join(r) for r in rows])
    df = corpus.read_tsv(spark, path, ["c0", "c1"])
    assert [tuple(r)[1:] for r in df.orderBy("line_no").collect()] == rows
    corpus.write_tsv(df, str(tmp_path / "out"), ["c0", "c1"])
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["\t".join(r) for r in rows]
    for bad in (["only one"], ["a\tb\tc"]):
        with pytest.raises(Exception, match="fields are needed"):
            corpus.read_tsv(spark, put(tmp_path / "bad.tsv", bad), ["c0", "c1"]).collect()
    loose = corpus.read_tsv(spark, put(tmp_path / "bad.tsv", ["a\tb\tc", "d"]), ["c0", "c1"], strict=False)
    assert [tuple(r)[1:] for r in loose.orderBy("line_no").collect()] == [("a", "b"), ("d", "")]


STEPS = [
    {"filter": "remove_empty_lines", "parameters": {}, "language": None},
    {"filter": "normalize_whitespace", "parameters": {"COLLAPSE": True}, "language": "src, trg"},
    {"filter": "max_length", "parameters": {"MAXLENGTH": 3, "MINLENGTH": 1}, "language": None},
]
ROWS = [(" a  b ", "c"), ("", "x"), ("a b c d", "e"), ("a", "b")]


def test_recipe(spark):
    recipe = Pipeline.from_json(json.dumps({"version": 1, "files": ["x.src.gz", "x.trg.gz"], "filters": STEPS}))
    assert Pipeline.from_json(recipe.to_json()).steps == recipe.steps == Pipeline.from_json(STEPS).steps
    df = pairs(spark, ROWS)
    assert [tuple(r)[1:] for r in recipe.run(df, ["src", "trg"]).orderBy("line_no").collect()] == [("a b", "c"), ("a", "b")]
    marked = {r.line_no: (r.rejected_by, r.reject_step) for r in recipe.annotate(df, ["src", "trg"]).collect()}
    assert marked == {0: (None, None), 1: ("remove_empty_lines", 0), 2: ("max_length", 2), 3: (None, None)}
    stats = [tuple(r) for r in recipe.stats(df, ["src", "trg"]).orderBy("step").collect()]
    assert stats == [(0, "remove_empty_lines", 4, 3), (1, "normalize_whitespace", 3, 3), (2, "max_length", 3, 2)]
    assert [left.count() for _, left in recipe.trail(df, ["src", "trg"])] == [4, 3, 3, 2]


def test_recipe_checks(spark):
    with pytest.raises(KeyError):
        Pipeline([Step("no such filter")])
    with pytest.raises(ValueError):
        Pipeline([Step("max_length", {}, "de")])
    with pytest.raises(ValueError):
        Pipeline([Step("normalize_whitespace", {})])
    with pytest.warns(UserWarning, match="missing parameter MAXLENGTH"):
        recipe = Pipeline([Step("max_length", {"EXTRA": 1})])
    assert recipe.steps[0].parameters == {"MAXLENGTH": 150, "MINLENGTH": 1, "EXTRA": 1}
    with pytest.raises(ValueError):
        Pipeline([Step("normalize_whitespace", {"COLLAPSE": True}, "fr")]).run(pairs(spark, ROWS), ["src", "trg"])


def test_preview_keeps_what_has_not_changed(spark):
    cache = {}
    recipe = Pipeline.from_json(STEPS)
    first = recipe.preview(pairs(spark, ROWS), ["src", "trg"], 10, cache)
    assert [d.count() for _, d in first] == [4, 3, 3, 2]
    changed = Pipeline.from_json([*STEPS[:2], {**STEPS[2], "parameters": {"MAXLENGTH": 1, "MINLENGTH": 1}}])
    again = changed.preview(pairs(spark, ROWS), ["src", "trg"], 10, cache)
    assert again[1][1] is first[1][1] and again[2][1] is first[2][1] and again[3][1].count() == 1
    assert recipe.keys()[:2] == changed.keys()[:2] and recipe.keys()[2] != changed.keys()[2]
    failing = Pipeline.from_json([{"filter": "regexp", "parameters": {"PATTERN": "system('x')"}, "language": "src"}])
    assert isinstance(failing.preview(pairs(spark, ROWS), ["src", "trg"], 10)[-1][1], ValueError)


def test_exports():
    recipe = Pipeline([Step(s["filter"], s["parameters"], s["language"]) for s in STEPS], files=["x.src.gz", "x.trg.gz"])
    with pytest.warns(UserWarning, match="before rewrites"):
        yaml = recipe.to_yaml()
    assert yaml.index("preprocess") < yaml.index("type: filter") and "normalize_whitespace" in yaml
    assert recipe.to_shell().count("|\n") == 2 and Pipeline([]).to_shell() == "cat\n"


def test_first_occurrences_are_those_of_the_loop(spark):
    r = random.Random(3)
    rows = [(r.choice("abcdefgh") * r.randint(1, 2), r.choice("uvwxyz") * r.randint(1, 2)) for _ in range(300)]
    seen, expected = (set(), set()), []
    for k, row in enumerate(rows):
        new = [x not in s for x, s in zip(row, seen, strict=True)]
        for x, s in zip(row, seen, strict=True):
            s.add(x)
        expected += [k] if all(new) else []
    got = dedup.keep_first(pairs(spark, rows), ["src", "trg"])
    assert sorted(r.line_no for r in got.collect()) == expected
    halves = [pairs(spark, rows[:150]), pairs(spark, rows[150:])]
    both = dedup.dedup_files(halves, ["src", "trg"], "exact")
    assert sorted(r.file_rank * 150 + r.line_no for r in both.collect()) == expected


def test_cleaned_rows_are_made_once(spark):
    """Conditions after a rewrite do not repeat it, and both uses of what is left read one shuffle."""
    rows = pairs(spark, [(" a  b ", "c d"), ("a b", "e f"), ("  ", "g h"), ("i\u3000j", "c d"), ("k l", "m")])
    steps = [("normalize_whitespace", {"COLLAPSE": True}, "src,trg"), ("max_length", {"MAXLENGTH": 5, "MINLENGTH": 1}, None)]
    cleaned = Pipeline.from_json([{"filter": f, "parameters": p, "language": lang} for f, p, lang in steps]).run(rows, ["src", "trg"])
    assert "Generate inline" in cleaned._jdf.queryExecution().optimizedPlan().toString()
    firsts = dedup.keep_first(cleaned, ["src", "trg"], once=True)
    assert sorted((r.line_no, r.src) for r in firsts.collect()) == [(0, "a b"), (4, "k l")]
    assert "ReusedExchange" in firsts._jdf.queryExecution().executedPlan().toString()


def test_keys(spark):
    df = spark.createDataFrame([("Çà, va? 12",), ("ca va",), ("Straße",)], "t string")
    got = [r.k for r in df.select(dedup.latin_key(F.col("t")).alias("k")).collect()]
    assert got[:2] == ["cava", "cava"]
    assert [r.k for r in df.select(dedup.plain_key(F.col("t")).alias("k")).collect()] == ["çàva", "cava", "straße"]


def test_latin_keys_are_read_as_arrow(spark):
    rows = [(None,), ("",), ("plain",), ("É ß ﬁ 𝐀",)]
    df = spark.createDataFrame(rows, "t string").select(dedup.latin_key(F.col("t")).alias("k"))
    assert [r.k for r in df.collect()] == [None, "", "plain", "esfia"]
    plan = df._jdf.queryExecution().toString()
    assert re.search(r"ArrowEvalPython .*, 250", plan) and not re.search(r"ArrowEvalPython .*, 200", plan)


def test_best_of_duplicates(spark):
    rows = [(0, "x", 1.0), (1, "y", 2.0), (2, "x", 3.0), (3, "x", 3.0), (4, "y", 1.0)]
    got = dedup.best_of_duplicates(spark.createDataFrame(rows, "line_no long, g string, r double"), "g", "r")
    assert [(r.line_no, r.first_place) for r in got.orderBy("first_place").collect()] == [(2, 0), (1, 1)]


@pytest.mark.parametrize(("n", "expected"), [(0, 0), (3, 3), (7, 7), (10, 10), (14, 14), (15, 15), (40, 15)])
def test_samples(spark, n, expected):
    df = spark.range(n).select(F.col("id").alias("line_no"))
    got = [r.line_no for r in sampling.sample(df, 5).collect()]
    assert len(got) == expected and got == sorted(set(got))
    assert got[:5] == list(range(min(5, n))) and got[-5:] == list(range(max(0, n - 5), n))
    assert sampling.first_lines(df, 4).count() == min(4, n)


def loop_suffixes(lines, min_length, min_occurrences):
    """One line after the other."""
    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[-1 - n] == b[-1 - n]:
            n += 1
        return n

    out, k = list(lines), 0
    while k + min_occurrences <= len(lines):
        group = lines[k : k + min_occurrences]
        n = min((common(group[0], x) for x in group), default=0)
        if n < min_length:
            k += 1
            continue
        suffix = group[0][len(group[0]) - n :]
        while k < len(lines) and lines[k].endswith(suffix):
            out[k] = lines[k][: len(lines[k]) - n]
            k += 1
    return out


def test_suffixes_across_ranges_and_batches(spark):
    """Long islands, several datasets, many ranges and small batches, against the loop."""
    r = random.Random(11)
    lines = {d: [r.choice("abc") + str(k % 7) * r.randint(0, 2) + r.choice((" the end", " the end", "the end", " other end", "")) * r.choice((1, 1, 1, 0)) for k in range(400)] for d in (0, 1, 2)}
    lines[1] = [f"{k} same ending" for k in range(300)]
    rows = [(d, 10_000 * d + 3 * k, t) for d, own in lines.items() for k, t in enumerate(own)]
    df = spark.createDataFrame(rows, "dataset long, line long, t string").repartition(5)
    old = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(old, ("7", "false"), strict=True):
            spark.conf.set(k, v)
        got = suffixes.strip_suffixes(df, ["t"], min_length=4, min_occurrences=3, order="line", within=("dataset",)).orderBy("line").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [x.t for x in got] == [t for d in lines for t in loop_suffixes(lines[d], 4, 3)]
    plan = suffixes.in_ranges(df, "t", "line", ())._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan


def test_reasons(spark):
    rows = [("abc def", "abc"), ("  ", "abc"), ("123 4 abc", "abc"), ("a1111 b2222", "abc"), ("abc", "12 3")]
    steps = [Step("alpha_ratio", {"LANG1": "en", "LANG2": "en"}), Step("num_mismatch", {"RATIO": 1.0})]
    with pytest.warns(UserWarning):
        recipe = Pipeline([*steps])
    got = recipe.annotate(pairs(spark, [*rows, ("five 5 or so many words", "six 6 or so many words")]), ["src", "trg"]).orderBy("line_no").collect()
    assert [r.reject_reason for r in got] == [None, "EMPTY_SRC", "RATIO_WORDS_SRC", "RATIO_ALPHA_SRC", "RATIO_WORDS_TRG", "5 | 6"]
    assert [r.reject_step for r in got] == [None, 0, 0, 0, 0, 1]


def test_samples_of_all_corpora(spark, tmp_path):
    good = spark.range(100).withColumnRenamed("id", "line_no")
    bad = good.withColumn("x", F.raise_error(F.lit("broken")).cast("string"))
    got = sampling.sample_all({"a": good, "b": bad, "c": good}, str(tmp_path), 5)
    assert (got["a"], got["c"]) == ("written", "written") and isinstance(got["b"], Exception)
    assert spark.read.parquet(f"{tmp_path}/a").count() == 15
    assert sampling.sample_all({"a": good}, str(tmp_path), 5) == {"a": "kept"}
    assert sampling.sample_all({"a": good}, str(tmp_path), 2, force=True) == {"a": "written"}


def test_entries_of_corpora(spark):
    entries = spark.createDataFrame([(2, "web-v1.de-en", 5), (1, "web-v1.de-en", 6), (3, "x", 7)], "id long, basename string, size long")
    names = spark.createDataFrame([("web-v1.de-en",)], "name string")
    assert [(r.name, r.entry.id, r.entry.size) for r in catalog.entry_of(names, entries).collect()] == [("web-v1.de-en", 1, 6)]
    with pytest.raises(Exception, match="no entry for y"):
        catalog.entry_of(spark.createDataFrame([("y",)], "name string"), entries).collect()


@pytest.mark.parametrize("seed", range(4))
def test_suffixes(spark, seed):
    r = random.Random(seed)
    ends = ["", " | home", " | home page", "e page", " - news"]
    lines = []
    while len(lines) < 300:
        lines += [r.choice(["", "abc", "x y", "z😀"]) + r.choice(ends[:2]) * (r.random() < 0.1) + end for end in [r.choice(ends)] for _ in range(r.randint(1, 9))]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, t string")
    got = suffixes.strip_suffixes(df, ["t"], min_length=4, min_occurrences=3).orderBy("line_no").collect()
    assert [r.t for r in got] == loop_suffixes(lines, 4, 3)
    counted = suffixes.suffix_counts(df, "t", min_length=4, min_occurrences=3).collect()
    assert sum(r.n for r in counted) == sum(a != b for a, b in zip(lines, loop_suffixes(lines, 4, 3), strict=True))


def test_scores_once_for_each_text(spark, tmp_path):
    df = pairs(spark, [("aa", "b"), ("aa", "b"), ("c", "d")])
    cache = str(tmp_path / "scores")
    for _ in range(2):
        got = scoring.with_score(df, ["src", "trg"], scoring.length_agreement, cache=cache)
        assert sorted(r.score for r in got.collect()) == [0.5, 0.5, 1.0]
        assert spark.read.parquet(cache).count() == 2
    assert scoring.threshold(got, "score", 1, "lt").count() == 2
    assert scoring.threshold(got, "score", 1).count() == 1


def test_cosine(spark):
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r.c for r in v.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] == pytest.approx(np.sqrt(0.5)) and got[1] is None


def test_differences(spark):
    before = pairs(spark, [("a", "b"), ("c", "d"), ("e", "f")])
    after = before.where("line_no <> 1").withColumn("src", F.when(F.col("line_no") == 2, "E").otherwise(F.col("src")))
    got = diff.diff_rows(before, after, ["src", "trg"])
    assert {r.line_no: r.status for r in got.collect()} == {0: "identical", 1: "removed", 2: "changed"}
    assert {r.status: r.n for r in diff.diff_counts(got).collect()} == {"identical": 1, "removed": 1, "changed": 1}
    spans = before.select(diff.inline_diff(F.lit("abcdef"), F.lit("abXdef")).alias("s")).first().s
    assert [(s.kind, s.text) for s in spans] == [("equal", "ab"), ("delete", "c"), ("insert", "X"), ("equal", "def")]
    assert before.select(diff.inline_diff(F.lit("abc"), F.lit("xyz")).alias("s")).first().s is None
    assert before.select(diff.visible_spaces(F.lit("a b c")).alias("s")).first().s == "a·b␣c"


def test_rows_matched_by_content(spark):
    before = pairs(spark, [("a", "b"), ("a", "b"), ("c", "d"), ("e", "f"), ("g", "h"), ("i", "j")])
    after = pairs(spark, [("e", "f"), ("a", "b"), ("c", "X"), ("Y", "h"), ("new", "row")])
    got = diff.diff_by_content(before, after, ["src", "trg"]).collect()
    found = sorted((r.status, -1 if r.before_no is None else r.before_no, -1 if r.after_no is None else r.after_no) for r in got)
    assert found == [("added", -1, 4), ("changed", 2, 2), ("changed", 4, 3), ("identical", 0, 1), ("identical", 3, 0), ("removed", 1, -1), ("removed", 5, -1)]


def test_inline_differences(spark):
    cases = [("same", "same"), ("", ""), ("", "x"), ("abc", "abxc"), ("aXa", "aa"), ("über 😀 x", "über 😀😀 x"), (None, "a"), ("one two", "one 2wo")]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, a string, b string")
    for r in df.select("*", diff.inline_diff(F.col("a"), F.col("b")).alias("s")).collect():
        if r.a is None or (r.a, r.b) == ("", "x"):
            assert r.s is None
            continue
        assert "".join(s.text for s in r.s if s.kind != "insert") == r.a and "".join(s.text for s in r.s if s.kind != "delete") == r.b
        assert all(s.text for s in r.s) and [s.kind for s in r.s] == ([] if not r.a else ["equal"] if r.a == r.b else [s.kind for s in r.s])


def test_filters_as_objects(spark):
    df = pairs(spark, [("a b", "c d"), ("a", "b c d e")])
    one = Filter("max_length", MAXLENGTH=3)
    assert [r.score for r in one.score(df, ["src", "trg"]).orderBy("line_no").collect()] == [1.0, 0.0]
    assert one.filter(df, ["src", "trg"]).collect() == one.decisions(df, ["src", "trg"]).where("accepted").drop("accepted").collect()
    assert [r.src for r in Preprocessor("opus.WhitespaceNormalizer").process(pairs(spark, [(" a  b", "c")]), ["src", "trg"]).collect()] == ["a b"]
    with pytest.raises(ValueError):
        Filter("opus.WhitespaceNormalizer")
    with pytest.raises(ValueError):
        Preprocessor("max_length")


def test_placeholder_configuration(spark):
    config = """
placeholder-symbol: "P"
num-placeholders: 3
vocab: "ignored"
regexes:
  - (x+)
"""
    found = placeholders.options(config)
    assert found == {"symbol": "P", "n": 3, "rules": ["(x+)"]}
    got = placeholders.encode(spark.createDataFrame([(0, "axxb x")], "line_no long, t string"), ["t"], **found).first()
    assert sorted(got.mapping.values()) == ["x", "xx"] and set(got.mapping) <= {"0P", "1P", "2P"}
    assert placeholders.options("") == {}


TEXTS = [
    "hello firstname.secondname@domain.com,", "go to www.google.com/,", "then to https://www.google.com/,",
    "twice https://www.google.com/ https://www.google.com/", "this looks like one: 3@ and 13@", "plain", "",
    " ".join(f"https://www.a{k}.com" for k in range(30)),
]


def test_placeholders(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "line_no long, t string")
    coded = placeholders.encode(df, ["t"]).orderBy("line_no")
    rows = coded.collect()
    assert "@domain" not in rows[0].t and len(rows[0].mapping) == 1
    a, b = rows[3].t.split()[1:]
    assert a == b and len(rows[7].mapping) == 20
    back = coded.select("line_no", placeholders.decode(F.col("t"), F.col("mapping")).alias("t")).orderBy("line_no")
    assert [r.t for r in back.collect()] == TEXTS
    apart = placeholders.decode_lines(coded.drop("mapping"), coded, ["t"]).orderBy("line_no")
    assert [r.t for r in apart.collect()] == TEXTS
    assert [r.t for r in placeholders.encode(df, ["t"]).orderBy("line_no").collect()] == [r.t for r in rows]


def test_strict_placeholders(spark):
    df = pairs(spark, [("a 😀 b", "c 😀 d"), ("a 😀", "c")])
    got = placeholders.encode(df, ["src", "trg"], rules=[placeholders.EMOJI], strict=True).orderBy("line_no").collect()
    assert "😀" not in got[0].src and got[0].src.split()[1] == got[0].trg.split()[1]
    assert (got[1].src, got[1].trg, got[1].mapping) == ("a 😀", "c", {})


def test_catalog(spark, tmp_path):
    folder = tmp_path / "data"
    (folder / "sub").mkdir(parents=True)
    for name in ("a.de.gz", "a.en.gz", ".hidden.en.gz", "sub/b-v1.x.en.gz", "note.txt"):
        put(folder / name, ["x"])
    files = catalog.list_files(spark, str(folder))
    got = {r.name: [f.lang for f in r.files] for r in catalog.group_files(files, str(folder)).collect()}
    assert got == {"a": ["de", "en"], "sub/b-v1.x": ["en"]}
    assert catalog.recipe_path("a", "data/*.gz") == "data/a.filters.json"
    assert catalog.sample_path("a", ["en", "de"], "data/*.gz") == "data/.sample.a.de.en"
    with pytest.raises(ValueError):
        catalog.dataset_path("../x")


def test_entries(spark):
    lines = [
        {"id": 1, "corpus": "Web", "version": "v1", "source": "de", "target": "en", "alignment_pairs": "", "size": 2},
        {"id": 2, "corpus": "Web", "version": "v2", "source": "de", "target": "en", "alignment_pairs": "7", "size": 3},
        {"id": 3, "corpus": "laws", "version": "v1", "source": "de", "target": "", "alignment_pairs": "9", "size": 9},
    ]
    raw = spark.createDataFrame([(json.dumps(x),) for x in lines], "value string")
    entries = catalog.entries_from_json(raw, local=["laws-v1.de"])
    assert [(r.id, r.pairs, r.size) for r in catalog.list_entries(entries, order="size").collect()] == [(3, 9, 9216), (2, 7, 3072)]
    assert [r.id for r in catalog.list_entries(entries, "WE", "bilingual", latest=False).collect()] == [1, 2]
    assert [r.id for r in catalog.list_entries(entries, downloadable=True).collect()] == [2]


def test_categories(spark):
    assert [c["name"] for c in catalog.check_categories({})["categories"]] == ["clean", "medium", "dirty"]
    for bad in ({"categories": [{"name": " "}]}, {"categories": [{"name": "a"}, {"name": "a "}]}, {"mapping": {"no": []}}):
        with pytest.raises(ValueError):
            catalog.check_categories(bad)


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "1.tsv", ["a\tb", "\tx", "c\td"])
    recipe = Pipeline.from_json(STEPS)

    def turn():
        stream = clean.read_stream(spark, str(folder), ["src", "trg"])
        q = clean.clean_stream(stream, recipe, ["src", "trg"], str(tmp_path / "out"), str(tmp_path / "c1"), available_now=True)
        q.awaitTermination(60)
        stream = clean.read_stream(spark, str(folder), ["src", "trg"]).drop("path")
        q = clean.dedup_stream(stream, ["src", "trg"], str(tmp_path / "d"), str(tmp_path / "c2"), available_now=True)
        q.awaitTermination(60)

    turn()
    put(folder / "2.tsv", ["a\te", "f\tg", "f\th"])
    turn()
    assert sorted((r.src, r.trg) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "b"), ("a", "e"), ("c", "d"), ("f", "g"), ("f", "h")]
    kept = spark.read.parquet(str(tmp_path / "d"))
    assert sorted((r.src, r.trg) for r in kept.collect()) == [("", "x"), ("a", "b"), ("c", "d"), ("f", "g")]


def test_counts_come_with_the_run(spark, tmp_path):
    df = pairs(spark, [("a b", "c d"), ("", "x"), ("one two three", "y"), ("a  b c", "d e f")])
    recipe = Pipeline.from_json([{"filter": "remove_empty_lines"}, {"filter": "normalize_whitespace", "parameters": {"COLLAPSE": True}, "language": "src"}, {"filter": "max_length", "parameters": {"MAXLENGTH": 2}}], strict=False)
    result, observed = recipe.run_observed(df, ["src", "trg"])
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("observed", "one run")
    result.write.parquet(str(tmp_path / "out"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs.getJobIdsForGroup("observed")) == 1
    assert spark.read.parquet(str(tmp_path / "out")).collect() == recipe.run(df, ["src", "trg"]).collect()
    want = [tuple(r) for r in recipe.stats(df, ["src", "trg"]).orderBy("step").select("step", "filter", "rows_in", "rows_out").collect()]
    assert observed.counts() == want == [(0, "remove_empty_lines", 4, 3), (1, "normalize_whitespace", 3, 3), (2, "max_length", 3, 1)]


def test_what_a_vocabulary_cannot_write(spark):
    pieces = [*"abcdef @0123456789", "\u2581", "\u2581ab", "abc"]
    rule = placeholders.outside_vocabulary(pieces, placeholders.vocabulary())
    assert placeholders.outside_vocabulary([f"<0x{b:02X}>" for b in range(256)]) is None
    with pytest.raises(ValueError, match="another symbol"):
        placeholders.outside_vocabulary(["a", "b"], ["@1"])
    texts = ["abc \u4e2d\u6587 fed", "xyz x", "", None, "1@ \U0001f600a\U0001f600", " ".join(chr(0x4E00 + k) for k in range(30))]
    df = spark.createDataFrame(list(enumerate(texts)), "line_no int, t string")
    coded = placeholders.encode(df, ["t"], rules=(), pieces=pieces).orderBy("line_no")
    rows = coded.select("*", placeholders.decode(F.col("t"), F.col("mapping")).alias("back")).collect()
    assert [r.back for r in rows] == texts
    assert sorted(rows[0].mapping.values()) == ["\u4e2d\u6587"] and sorted(rows[1].mapping.values()) == ["x", "xyz"]
    assert rule.startswith("[^") and rule.endswith("]+")
    assert len(rows[5].mapping) == 20 and all(set(r.t) <= set("abcdef @0123456789") for r in rows[:3])


def test_null_groups_and_null_texts_lose_suffixes_too(spark):
    rows = [(k, g, f"{k} same ending" if t else None) for k in range(24) for g, t in ((None, True), ("g", k != 5))]
    df = spark.createDataFrame(rows, "line_no long, g string, t string").repartition(5)
    got = suffixes.with_suffix_lengths(df, "t", 4, 3, within=("g",)).collect()
    assert len(got) == 48 and all(r.suffix_length == (0 if r.t is None else 12) for r in got)


@pytest.mark.parametrize(
    ("name", "parameters", "row", "reason", "measures"),
    [
        ("max_length", {"MAXLENGTH": 2}, ("a b c", "d"), "3 | 1", [3.0, 1.0]),
        ("max_word_length", {"MAXWORDLENGTH": 3}, ("abcd", "x yy"), "4 | 2", [4.0, 2.0]),
        ("remove_empty_lines", {}, (" ", "x"), "0 | 1", [0.0, 1.0]),
        ("src_trg_ratio", {"RATIO": 0.6}, ("a", "b c d e"), "0.25", [0.25]),
        ("opus.LengthFilter", {"max_length": 1, "unit": "char"}, ("ab", "c"), "2 | 1", [2.0, 1.0]),
        ("opus.LengthRatioFilter", {"threshold": 2}, ("a b c", "d"), "3.0", [3.0]),
        ("opus.LongWordFilter", {"threshold": 3}, ("abc", "d"), "3 | 1", [3.0, 1.0]),
        ("opus.AverageWordLengthFilter", {"max_length": 1}, ("ab abcd", "d"), "3.0 | 1.0", [3.0, 1.0]),
        ("opus.AlphabetRatioFilter", {}, ("a1", "d"), "0.5 | 1.0", [0.5, 1.0]),
        ("opus.CharacterScoreFilter", {"scripts": ["Latin", "Greek"]}, ("a\u03b1", "\u03b1"), "0.5 | 1.0", [0.5, 1.0]),
        ("opus.HtmlTagFilter", {}, ("<b>x</b>", "y"), "2 | 0", [2.0, 0.0]),
        ("url_mismatch", {}, ("see a.example.org", "voir"), "a.example.org | ", None),
        ("langid", {"SRC_LANG": "de", "TRG_LANG": "de"}, ("the cat is on the mat", "der Hund ist in dem Haus"), "en | de", None),
        ("opus.RegExpFilter", {"regexps": ["a", "b"]}, ("a", "b"), "true | true", None),
    ],
)
def test_reasons_and_measures(spark, name, parameters, row, reason, measures):
    df = pairs(spark, [row])
    recipe = Pipeline.from_json([{"filter": name, "parameters": parameters}], strict=False)
    got = recipe.annotate(df, ["src", "trg"]).first()
    assert (got.rejected_by, got.reject_reason) == (name, reason)
    assert Filter(name, **parameters).measures(df, ["src", "trg"]).first().measures == measures


def test_command_line(spark, tmp_path, capsys):
    paths = [put(tmp_path / "x.src.gz", [" a  b", "", "a b c d"]), put(tmp_path / "x.trg.gz", ["c", "d", "e"])]
    recipe = tmp_path / "recipe.json"
    recipe.write_text(json.dumps({"version": 1, "files": paths, "filters": STEPS}))
    assert cli.main(["run", str(recipe), "--output", str(tmp_path / "o"), "--tee", str(tmp_path / "t"), "--first", "2"]) == 0
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["a b\tc"]
    assert spark.read.text(str(tmp_path / "t/step-0")).count() == 2
    cli.main(["sample", *paths, "-n", "1"])
    cli.main(["filters", "sed"])
    cli.main(["list", str(tmp_path / "*.gz")])
    cli.main(["export", str(recipe), "--form", "json"])
    printed = capsys.readouterr().out
    assert " a  b\tc" in printed and '"name": "sed"' in printed and "src\ttrg" in printed
