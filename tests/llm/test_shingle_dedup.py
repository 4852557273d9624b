"""Near-duplicates by five-word shingles, against comparing all pairs."""

import random

import numpy as np

from corpusloom.llm import shingle_dedup


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows, least=0.8):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return {min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in group}


def made():
    r = random.Random(6)
    rows = []
    license = [f"l{k}" for k in range(40)]
    for _ in range(30):
        words = [f"w{r.randrange(300)}" for _ in range(r.randint(30, 120))]
        if r.random() < 0.4:
            words[10:10] = license
        for copy in range(r.choice([1, 1, 2, 6])):
            own = list(words)
            for _ in range(copy):
                own[r.randrange(len(own))] = f"x{r.randrange(1000)}"
            rows.append((len(rows), " ".join(own)))
    return [*rows, (900, None), (901, " "), (902, "one two"), (903, "ONE two"), (904, " ".join(license)), (905, rows[0][1])]


def test_groups_are_those_of_all_pairs(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_force(rows)
    assert len(want) < len(rows) - 20
    for block in (1000, 2):
        assert sorted(r.doc_id for r in shingle_dedup.keep_first(docs, block=block).collect()) == sorted(want)


def test_pipeline_stage_drops_looser_copies(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(100)]
    near = [*words[:50], "changed", *words[51:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()] == [1]
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_parities_never_differ_more_than_the_sets():
    rng = np.random.default_rng(1)
    sets = []
    for n in (0, 1, 3, 60, 64, 65, 300, 900):
        own = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets += [np.unique(own), np.unique(np.concatenate((own[n // 8 :], rng.integers(0, 1 << 63, n // 9, dtype=np.uint64))))]
    for a in sets:
        for b in sets:
            x, y = shingle_dedup.folded([shingle_dedup.parity(a), shingle_dedup.parity(b)])
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
            if len(a) and shingle_dedup.similar(a, b, 0.8):
                assert len(np.setxor1d(a, b)) <= shingle_dedup.most_apart(len(a), len(b), 0.8)


def test_sets_of_one_label_or_far_apart_are_not_near():
    rng = np.random.default_rng(2)
    own = [np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64)) for _ in range(3)]
    sets = [own[0], own[0][3:], own[1], own[2], own[2][1:]]
    parities, sizes = shingle_dedup.folded([shingle_dedup.parity(s) for s in sets]), np.array([len(s) for s in sets])
    assert shingle_dedup.near(parities, sizes, np.array([0, 1, 2, 3, 3]), 0.8).tolist() == [True, True, False, False, False]


def test_links_come_from_the_tree_and_are_checked(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    inner, seen = shingle_dedup.through_tree, []

    def spied(prints, max_bits):
        seen.append(({r.fp for r in prints.collect()}, max_bits))
        return inner(prints, max_bits)

    def all_in_one(prints, max_bits):
        return prints.crossJoin(prints.agg(F.min("id").alias("component_id")))

    def none(prints, max_bits):
        return prints.withColumn("component_id", F.col("id"))

    for tree in (spied, all_in_one, none):
        monkeypatch.setattr(shingle_dedup, "through_tree", tree)
        assert sorted(r.doc_id for r in shingle_dedup.keep_first(docs).collect()) == sorted(brute_force(rows))
    codes = shingle_dedup.Codes()
    prints = {shingle_dedup.majority(shingle_dedup.shingles_of((t or "").encode(), 5, codes)) for _, t in rows}
    assert {fp % (1 << 64) for fp in seen[0][0]} == prints and len(seen) == 1
