"""Models that are learned from tables, on made text with known answers."""

import numpy as np
import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import learned, rewrites
from corpusloom.plans.pipeline import Pipeline


def made_runs(r, n):
    """Runs of ideographs from a lexicon of 60 words, and where they are to be cut."""
    characters = [chr(0x4E00 + k) for k in range(70)]
    words = list({"".join(r.choice(characters) for _ in range(r.choice([1, 2, 2, 3]))) for _ in range(60)})
    weights = [1 / (k + 1) for k in range(len(words))]
    return [r.choices(words, weights, k=r.randint(3, 12)) for _ in range(n)]


def boundaries(words):
    return set(itertools.accumulate(map(len, words[:-1])))


def test_lexicon_finds_words_of_held_out_runs(spark):
    r = random.Random(3)
    runs = made_runs(r, 1500)
    train, held_out = runs[:1200], runs[1200:]
    df = spark.createDataFrame([("".join(w),) for w in train] + [(None,), ("latin only",)], "t string").repartition(4)
    lexicon, likelihoods = learned.learn_lexicon(df, "t", longest=4)
    assert len(likelihoods) == 6
    texts = spark.createDataFrame([(k, "".join(w)) for k, w in enumerate(held_out)], "k int, t string")
    got = {x.k: x.s.split(" ") for x in texts.select("k", learned.segmenter(lexicon)(F.col("t")).alias("s")).collect()}
    hits = sum(len(boundaries(got[k]) & boundaries(w)) for k, w in enumerate(held_out))
    found, wanted = sum(len(boundaries(g)) for g in got.values()), sum(len(boundaries(w)) for w in held_out)
    f1 = 2 * hits / (found + wanted)
    by_characters = 2 * wanted / (wanted + sum(len("".join(w)) - 1 for w in held_out))
    assert f1 > 0.9 > by_characters, (f1, by_characters)


def test_cuts_and_expectations_are_those_of_all_ways_to_cut():
    cost, unknown = {"a": -1.5, "b": -2.0, "ab": -2.2, "ba": -1.0, "aba": -4.0}, -9.0
    for run in ("a", "abab", "babxa", "xx"):
        ways = []
        for cuts in itertools.product([0, 1], repeat=len(run) - 1):
            at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(run)]
            words = [run[i:j] for i, j in zip(at, at[1:], strict=False)]
            if all(w in cost or len(w) == 1 for w in words):
                ways.append((sum(cost.get(w, unknown) for w in words), words))
        assert learned.best_cut(run, cost, 3, unknown) == max(ways)[1]
        total = sum(math.exp(p) for p, _ in ways)
        likelihood, found = learned.expected(run, cost, 3, unknown)
        assert likelihood == pytest.approx(math.log(total))
        want, got = defaultdict(float), defaultdict(float)
        for p, words in ways:
            for w in words:
                want[w] += math.exp(p) / total
        for w, n in found:
            got[w] += n
        assert got == pytest.approx(want)


def test_segmenter_is_a_parameter_of_the_filter(spark):
    lexicon, _ = learned.costs_of({"中国": 5.0, "人": 3.0, "中": 1.0, "国": 1.0})
    rewrites.SEGMENTERS["own"] = learned.segmenter(lexicon)
    try:
        recipe = Pipeline.from_json([{"filter": "segment_chinese", "parameters": {"SEGMENTER": "own"}, "language": "t"}])
        df = spark.createDataFrame([(0, "我是中国人 ok"), (1, None), (2, "plain")], "line_no int, t string")
        assert [x.t for x in recipe.run(df, ["t"]).orderBy("line_no").collect()] == ["我 是 中国 人 ok", None, "plain"]
    finally:
        del rewrites.SEGMENTERS["own"]


def test_no_runs_give_an_empty_lexicon(spark):
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    lexicon, _ = learned.learn_lexicon(df, "t")
    assert lexicon == {}
    assert df.select(learned.segmenter(lexicon)(F.lit("中国")).alias("s")).first().s == "中 国"


def test_abbreviations_are_found_and_keep_sentences_whole(spark):
    r = random.Random(4)
    names = ["Smith", "Jones", "Miller", "Brown"]
    verbs = ["walked home", "saw the river", "read a book", "went to town", "met the others"]
    did = lambda: f"{r.choice(names)} {r.choice(verbs)} and {r.choice(verbs)}"
    texts = [f"Then Insp. {did()}. The fee, ca. {r.randint(2, 90)} coins, was paid on {r.choice(['time', 'paid leave'])}. {did()}." for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "t string").repartition(3)
    found = {x.word for x in learned.abbreviations(df, "t").collect()}
    assert {"insp", "ca"} <= found and not found & {"home", "town", "book", "paid", "river", "others"}, found
    cut = rewrites.sentences(F.lit("Then Insp. Brown saw the river. It was ca. 3 m wide."), "en", sorted(found))
    assert spark.range(1).select(cut.alias("s")).first().s == ["Then Insp. Brown saw the river.", "It was ca. 3 m wide."]
    without = rewrites.sentences(F.lit("Then Insp. Brown saw the river."))
    assert len(spark.range(1).select(without.alias("s")).first().s) == 2


def test_profiles_tell_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null and lang is not null")
    profiles = learned.learn_profiles(docs.where("doc_id % 2 = 0"), "text", "lang")
    assert all(len(p) == len(set(p)) <= 400 for p in profiles.values())
    held_out = docs.where("doc_id % 2 = 1").select("lang", learned.rank_detector(profiles)(F.col("text")).alias("d")).collect()
    judged = [x for x in held_out if x.d.lang != "un"]
    assert len(judged) > 40 and sum(x.lang == x.d.lang for x in judged) >= 0.95 * len(judged)
    odd = spark.createDataFrame([(None,), ("",), ("123 !",)], "t string")
    assert {tuple(x.d) for x in odd.select(learned.rank_detector(profiles)(F.col("t")).alias("d")).collect()} == {("un", False)}


def test_profiles_are_those_of_a_loop(spark):
    rows = [("aab ab", "x"), ("ab", "x"), ("zz", "y"), (None, "y"), ("q", None)]
    counts = defaultdict(Counter)
    for t, lang in rows:
        if t and lang:
            counts[lang].update(learned.grams(t, 2))
    want = {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:4]] for lang, c in counts.items()}
    assert learned.learn_profiles(spark.createDataFrame(rows, "t string, l string"), "t", "l", 4, 2) == want


def translated(r, n):
    pairs = []
    for _ in range(n):
        source = [f"w{r.randrange(40)}" for _ in range(r.randint(3, 8))]
        target = ["x" + w[1:] for w in source]
        r.shuffle(target)
        pairs.append((" ".join(source), " ".join(target)))
    return pairs


def test_translations_rank_wrong_pairs_below_true_ones(spark):
    r = random.Random(7)
    rows = translated(r, 400)
    wrong = [(s, t) for (s, _), (_, t) in zip(rows[:40], rows[200:240], strict=True)]
    df = spark.createDataFrame([(k, s, t) for k, (s, t) in enumerate([*rows, *wrong, ("", "x1"), ("w1", ""), (None, None)])], "k int, s string, t string").repartition(3)
    table, likelihoods = learned.learn_translations(df, "s", "t", rounds=4)
    assert all(b > a for a, b in zip(likelihoods, likelihoods[1:], strict=False))
    best = {x.s: x.t for x in table.orderBy("p").collect()}
    assert sum(best.get(f"w{k}") == f"x{k}" for k in range(40)) >= 38
    scores = {x.k: x.adequacy for x in learned.adequacy(df, "s", "t", table).collect()}
    assert len(scores) == 443 and scores[441] is None and scores[442] is None and scores[440] == 0.0
    assert max(scores[400 + k] for k in range(40)) < sorted(scores[k] for k in range(400))[40]


def test_one_round_of_translations_is_that_of_a_loop(spark):
    rows = [("a b", "x y"), ("a", "x x"), ("b c", "y")]
    p = defaultdict(float)
    pairs = [([""] + s.split(), t.split()) for s, t in rows]
    seen = defaultdict(float)
    for s, t in pairs:
        for x, y in {(x, y) for x in s for y in t}:
            seen[x, y] += 1
    for (x, y), n in seen.items():
        p[x, y] = n / sum(v for (u, _), v in seen.items() if u == x)
    counts = defaultdict(float)
    for s, t in pairs:
        for y in t:
            whole = sum(p[x, y] for x in s)
            for x in s:
                counts[x, y] += p[x, y] / whole
    want = {(x, y): n / sum(v for (u, _), v in counts.items() if u == x) for (x, y), n in counts.items()}
    got, _ = learned.learn_translations(spark.createDataFrame(rows, "s string, t string"), "s", "t", rounds=1, prune=0.0)
    assert {(x.s, x.t): x.p for x in got.collect()} == pytest.approx(want)


def shuffled(spark):
    """Bytes that the session has shuffled so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    executors = context.statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_word_pairs_are_not_shuffled(spark):
    r = random.Random(8)
    words = lambda: " ".join(r.sample([f"word{k}" for k in range(3000)], 60))
    df = spark.createDataFrame([(k, words(), words()) for k in range(150)], "k int, s string, t string").repartition(3)
    before = shuffled(spark)
    assert learned.learn_translations(df, "s", "t", rounds=3)[0].count() > 500_000
    learnt = shuffled(spark)
    assert learnt - before < 4 * 150 * 61 * 60
    table = spark.createDataFrame([(f"word{k}", f"word{k}", 0.5) for k in range(3000)], "s string, t string, p double")
    assert learned.adequacy(df, "s", "t", table).where("adequacy > 0").count() > 100
    assert shuffled(spark) - learnt < 150 * 61 * 60


def test_parts_and_pieces_change_no_translation(spark, monkeypatch):
    rows = [*translated(random.Random(9), 60), ("w1 w1 only", "x1 x1 x2"), ("", "x3 \u00fc"), ("w\u00fc  W2", "\u00dc x2"), ("w1", ""), (None, "x1"), ("w1", None), ("w4 " * 90, "x4 x5 x4")]
    df = spark.createDataFrame([(k, s, t) for k, (s, t) in enumerate(rows)], "k int, s string, t string").repartition(3)
    found = []
    for pairs, targets, words in ((10**6, 10**6, 10**6), (400, 30, 40), (150, 10**6, 7)):
        monkeypatch.setattr(learned, "PART_TARGETS", targets)
        monkeypatch.setattr(learned, "PART_WORDS", words)
        table, likelihoods = learned.learn_translations(df, "s", "t", rounds=3, most_pairs=pairs)
        entries = {(x.s, x.t): x.p for x in table.collect()}
        assert len(entries) == table.count()
        want = {}
        for k, (s, t) in enumerate(rows):
            sources, targets_of = (s or "").lower().split(), (t or "").lower().split()
            want[k] = sum(max((entries.get((a, b), 0.0) for a in sources), default=0.0) for b in targets_of) / len(targets_of) if targets_of else None
        got = {x.k: x.adequacy for x in learned.adequacy(df, "s", "t", table).collect()}
        assert got == {k: v if v is None else pytest.approx(v) for k, v in want.items()}
        found.append((entries, likelihoods))
    for entries, likelihoods in found[1:]:
        assert entries == pytest.approx(found[0][0]) and likelihoods == pytest.approx(found[0][1])


def test_parts_are_few_until_their_rows_are_many():
    assert [learned.parts_for(n, n // 30, 16_000_000) for n in (0, 10**6, 40_000_000, 160_000_000)] == [1, 1, 3, 11]
    for n in (10**8, 10**9, 10**10, 10**11):
        parts = learned.parts_for(n, n // 30, 16_000_000)
        assert n // parts <= 16_000_000 and n // 30 * (1 - (1 - 1 / parts) ** 30) <= 1.01 * learned.PART_TARGETS


def test_grams_as_numbers_are_those_of_the_loop():
    for text in ("", "12 _", "a", "Ein Satz, zwei!", "ünï \U00010400x 日本 x-y a", "a b a ab"):
        for longest in (1, 2, 3):
            codes = learned.gram_codes(learned.coded(text), longest)
            assert codes.dtype == np.uint64 and Counter(map(learned.gram_of, codes.tolist())) == learned.grams(text, longest)
            assert all(learned.code_of(learned.gram_of(c)) == c for c in codes.tolist())
