"""Operators that learn, on held-out rows and against direct computation."""

import math
import random
import zlib
from collections import Counter
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from corpusloom.llm import langid, lm_scoring, toxicity
from corpusloom.llm.gru import Gru, class_bounds

SYLLABLES = {
    "en": ["th", "ing", "ou", "ea", "sh", "er", "and", "the"],
    "de": ["sch", "ein", "ung", "ü", "ß", "zu", "der", "ich"],
    "fr": ["eau", "é", "oi", "aux", "que", "ç", "les", "ment"],
}


def made(lang, r, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    out = []
    for k in range(600):
        lang = r.choice(list(SYLLABLES))
        out.append((k, made(lang, r, r.randint(8, 60)), lang))
    return out


@pytest.fixture(scope="module")
def frame(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string").repartition(3).persist()


def fold(k, n):
    return zlib.crc32(b"" if k is None else str(k).encode()) % n


# 8: languages


def test_languages_of_held_out_rows(frame, corpus):
    got = {r.doc_id: r for r in langid.identify(frame).collect()}
    assert len(got) == len(corpus)
    for k, _, lang in corpus:
        assert got[k].held_out == (fold(k, 5) == 0)
        assert 0 <= got[k].score <= 1
    held = [k for k, _, _ in corpus if fold(k, 5) == 0]
    assert np.mean([got[k].lang_pred == corpus[k][2] for k in held]) > 0.98


def test_language_log_probabilities(spark):
    """Against counting n-grams one by one."""
    rows = [("a", "abcab"), ("b", "Xyz"), (None, "abc"), ("a", "")]
    langs, matrix = langid.train(spark.createDataFrame(rows, "lang string, text string"), bits=10)
    assert langs == ["a", "b"]
    counts = Counter()
    for lang, text in rows:
        for found in langid.buckets_of(text, 10):
            counts.update((lang, int(b)) for b in found)
    total = {lang: sum(n for (x, _), n in counts.items() if x == lang) for lang in langs}
    for k, lang in enumerate(langs):
        for b in range(1 << 10):
            assert matrix[b, k] == pytest.approx(math.log((counts[lang, b] + 0.5) / (total[lang] + 0.5 * 1024)), rel=1e-5)


def test_pieces_of_a_long_text_cover_all_grams(monkeypatch):
    text = made("fr", random.Random(1), 500)
    whole = np.sort(np.concatenate(list(langid.buckets_of(text, 12))))
    monkeypatch.setattr(langid, "PIECE", 100)
    assert (np.sort(np.concatenate(list(langid.buckets_of(text, 12)))) == whole).all()
    assert len(whole) == 2 * len(text) - 3


def test_batches_have_the_grams_of_each_text():
    texts = ["", "a", "ab", made("de", random.Random(2), 40), "", "Ünï\u2028x", "abc", "z"]
    buckets, starts = langid.grams_of(texts, 12)
    for k, text in enumerate(texts):
        want = list(langid.buckets_of(text, 12))
        want = np.sort(np.concatenate(want)) if want else np.zeros(0, np.uint32)
        assert np.sort(buckets[starts[k] : starts[k + 1]]).tolist() == want.tolist()
    assert langid.grams_of([], 12)[0].tolist() == [] and langid.grams_of(["", ""], 12)[1].tolist() == [0, 0, 0]


def test_sums_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    weights, buckets = rng.normal(size=(50, 3)).astype(np.float32), rng.integers(0, 50, 200)
    starts = np.array([0, 0, 7, 7, 100, 199, 200, 200])
    want = [weights[buckets[a:b]].sum(axis=0) for a, b in zip(starts, starts[1:])]
    for cells in (1, 9, 30, 1 << 20):
        monkeypatch.setattr(langid, "CELLS", cells)
        assert np.allclose(langid.sums_of(weights, buckets, starts), want, atol=1e-5)


def test_blocks_of_languages_agree_with_one(spark, frame):
    """Posteriors and ties: languages in blocks of one against all at once, and against a loop."""
    labelled = frame.selectExpr("lang", "text").union(spark.createDataFrame([("zz", "same text"), ("zy", "same text")], "lang string, text string"))
    langs, matrix = langid.train(labelled, bits=10)
    blocks = list(langid.train_blocks(labelled, 10, 0.5, 1))
    assert [b[0] for b in blocks] == [[x] for x in langs] and np.allclose(np.hstack([b[1] for b in blocks]), matrix)
    docs = frame.limit(40).select("doc_id", "text").union(spark.createDataFrame([(9000, "same text"), (9001, "!")], "doc_id long, text string"))
    one = {r.doc_id: r for r in langid.predict(docs, langs, matrix).collect()}
    several = {r.doc_id: r for r in langid.predict_blocks(docs, blocks).collect()}
    for r in docs.collect():
        if r.doc_id == 9001:
            assert one[9001].lang_pred == several[9001].lang_pred == "und" and one[9001].score == 0
            continue
        found = np.concatenate(list(langid.buckets_of(r.text, 10)))
        total = matrix[-1] + matrix[found].astype(float).sum(axis=0)
        share = np.exp((total - total.max()) / np.sqrt(len(found)))
        for got in (one[r.doc_id], several[r.doc_id]):
            assert got.lang_pred == langs[int(np.argmax(total))]
            assert got.score == pytest.approx(1 / share.sum(), rel=1e-3)
    assert one[9000].lang_pred == several[9000].lang_pred == "zy"


def test_language_edge_cases(docs, no_docs, rows):
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (100, 101, 102, 104):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id == 103:
            assert r.lang_pred in ("en", "de", "fr")
    assert langid.identify(no_docs).count() == 0


# 6: language model


def test_base_scores_and_counts(frame, corpus):
    got = {r.doc_id: r for r in lm_scoring.score_documents(frame, vocabulary=128, lookup=100, share=1).collect()}
    counts = Counter()
    for k, text, _ in corpus:
        if fold(k, 10):
            counts.update([*text.split(), None])
    n, v = sum(counts.values()), len(counts)
    better = 0
    for k, text, _ in corpus:
        tokens = [*text.split(), None]
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        r = got[k]
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert r.held_out == (fold(k, 10) == 0)
        better += r.score > r.base_score if r.held_out else 0
    assert better > 0.9 * sum(r.held_out for r in got.values())


def test_language_model_edge_cases(docs, no_docs, rows):
    got = lm_scoring.score_documents(docs, vocabulary=128, share=1, rounds=1).collect()
    assert len(got) == len(rows)
    assert {r.n_tokens for r in got if r.doc_id in (100, 101, 102)} == {1}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) and r.score < 0 for r in got)
    again = [r for r in got if r.doc_id == 1]
    assert len(again) == 2 and again[0].score == pytest.approx(again[1].score)
    assert lm_scoring.score_documents(no_docs).count() == 0


def test_no_training_rows(spark):
    """Every row is held out: fold 0 only."""
    keys = [k for k in range(300) if fold(k, 10) == 0][:5]
    rows = spark.createDataFrame([(k, "some words here") for k in keys], "doc_id long, text string")
    got = lm_scoring.score_documents(rows).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == pytest.approx(0) for r in got)


def test_every_training_row_is_learned_from(frame):
    found = [r.id for p in lm_scoring.portions(frame.selectExpr("doc_id as id", "text")) for r in p.select("id").collect()]
    assert sorted(found) == list(range(600))
    with pytest.raises(ValueError):
        lm_scoring.portions(frame.selectExpr("doc_id as id", "text"), rounds=2, share=24)


def test_symbols_of_documents_are_written_once_and_scored_side_by_side():
    rng = np.random.default_rng(4)
    documents = [rng.integers(0, 150, rng.integers(1, 900)).astype(np.int32) for _ in range(3000)]
    documents += [np.array([70_000, 3], np.int32), np.array([65_535], np.int32)]
    runs = list(lm_scoring.gathered(lm_scoring.packed(documents)))
    assert [x.tolist() for run in runs for x in run] == [x.tolist() for x in documents]
    assert len(runs) == 2 and all(sum(map(len, run[:-1])) < lm_scoring.HELD_SYMBOLS for run in runs)
    assert list(lm_scoring.gathered(lm_scoring.packed([]))) == []
    model, some = small_model(), [np.append(x, 149) for x in documents[:40]]
    for run in lm_scoring.gathered(lm_scoring.packed(some)):
        assert model.score(run) == pytest.approx([model.score([x])[0] for x in some], rel=1e-5)


def test_words_of_documents_are_numbers_within_chunks(monkeypatch):
    monkeypatch.setattr(lm_scoring, "HELD", 5)
    monkeypatch.setattr(lm_scoring, "grouped", lambda batch: ((k, k + 1, [t.as_py().encode()]) for k, t in enumerate(batch.column(3))))
    texts, out = ["a b A", "", "c d e", "f g a", "a"], [False, False, True, False, False]
    batch = pa.RecordBatch.from_arrays([pa.array([*range(5)]), pa.array([*range(5)]), pa.array(out), pa.array(texts)], ["id", "row_key", "held_out", "text"])
    found, words, counts = [], [], Counter()
    for chunk in lm_scoring._code(iter([batch])):
        for r in chunk.to_pylist():
            if r["words"] is not None:
                words = r["words"]
                counts.update(dict(zip(words, r["counts"], strict=True)))
            found.append([words[k].decode() for k in np.frombuffer(zstandard.decompress(r["codes"]), np.int32)])
    assert found == [t.lower().split() for t in texts]
    assert +counts == Counter(w.encode() for t, o in zip(texts, out, strict=True) if not o for w in t.lower().split())


def test_words_are_split_and_get_symbols_as_in_python():
    texts = [f"Aa{chr(c)}bC.{chr(c)}{chr(c)}D!?" for c in range(128)] + ["", None, " ", "\n x\t", "\x85a\xa0É \u3000", ".,;:!?", "...a"]
    words, sizes = lm_scoring._split(pa.array(texts))
    expected = [(t or "").encode().lower().split() for t in texts]
    assert sizes.tolist() == [len(e) for e in expected]
    assert words.to_pylist() == [w for e in expected for w in e]
    assert lm_scoring._others(words.dictionary).tolist() == [lm_scoring.other(w) for w in words.dictionary.to_pylist()]


def test_rows_are_read_by_chunk_across_batches():
    texts = ["the cat sat on the mat", "", "a the rare rare thing", "the end", "the mat: odd", "a b c the"]
    frequent = {b"the": 9, b"a": 5, b"cat": 4, b"mat": 2}
    others = np.linspace(1, 5, lm_scoring.OTHERS)
    lexicon = lm_scoring.Lexicon({b"the": 0, b"a": 1}, frequent, others, 7, 50, 20)
    batch = pa.RecordBatch.from_arrays([pa.array([*range(6)]), pa.array([*range(6)]), pa.array([False] * 6), pa.array(texts)], ["id", "row_key", "held_out", "text"])
    coded = [*lm_scoring._code(iter([batch.slice(0, 4)])), *lm_scoring._code(iter([batch.slice(4)]))]
    coded = pa.Table.from_batches(coded).combine_chunks().to_batches()[0].select([0, 1, 2, 3, 4, 5])
    got = [r for b in lm_scoring._read(iter([coded.slice(0, 2), coded.slice(2, 3), coded.slice(5)]), lexicon) for r in b.to_pylist()]
    assert [r["id"] for r in got] == [*range(6)]
    for r, text in zip(got, texts, strict=True):
        words = [w.encode() for w in text.split()]
        logs = [math.log10(frequent[w] + 0.1) for w in words if w in frequent]
        extra = sum((math.log10(frequent[w] + 0.1) if w in frequent else 0) - math.log10(others[lm_scoring.other(w)]) for w in words if w not in lexicon.symbols)
        assert (r["n_tokens"], r["n_known"]) == (len(words) + 1, len(logs) + 1)
        assert r["base_score"] == pytest.approx(sum(logs) + math.log10(7.1) - lexicon.log_total() * (len(words) + 1))
        assert r["extra"] == pytest.approx(extra)
        assert dict(zip(r["rare"], r["rare_n"], strict=True)) == Counter(w for w in words if w not in frequent)
        symbols = next(lm_scoring.gathered(pa.array([r["symbols"]])))[0]
        assert symbols.tolist() == [lexicon.symbols.get(w, 2 + lm_scoring.other(w)) for w in words] + [lexicon.size - 1]


def test_classes_have_the_fewest_logits():
    def logits(weights, bounds):
        return len(bounds) - 1 + sum(weights[a:b].sum() * (b - a) for a, b in pairwise(bounds)) / weights.sum()

    rng = np.random.default_rng(6)
    for n in (1, 2, 7):
        weights = rng.random(n) + 0.01
        every = [[0, *inner, n] for k in range(n) for inner in combinations(range(1, n), k)]
        assert logits(weights, class_bounds(weights)) == pytest.approx(min(logits(weights, bounds) for bounds in every))
    weights = 1 / np.arange(1, 2049)
    assert logits(weights, class_bounds(weights)) < 0.7 * logits(weights, np.arange(0, 2049, 64))
    model = Gru(weights)
    assert (np.diff(model.bounds) > 0).all() and model.bounds[-1] == 2048
    assert np.exp(model.log_probs(np.zeros((2048, 16), np.float32), np.arange(2048))) == pytest.approx(weights / weights.sum(), rel=1e-4)


def test_documents_of_a_stream_start_anew():
    model, rng = small_model(), np.random.default_rng(5)
    documents = [np.append(rng.integers(0, 149, n), 149) for n in (700, 1, 40, 90, 3, 33, 64)]
    alone = [model.score([d])[0] for d in documents]
    for streams in (1, 2, 512):
        assert model.score(documents, streams=streams) == pytest.approx(alone, rel=1e-5)


def test_no_symbol_is_left_out_of_training():
    model, seen = small_model(), []
    inner = model.gradients
    model.gradients = lambda ids, state: (seen.extend(ids.ravel()), inner(ids, state))[1]
    documents = [np.array([1, 2, 3, 149]), np.array([4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 149])]
    model.train(documents)
    assert set(seen) >= set(np.concatenate(documents).tolist())


def small_model(n=150):
    model = Gru(np.arange(1, n + 1, dtype=float), hidden=5)
    rng = np.random.default_rng(0)
    model.load(rng.normal(0, 0.3, len(model.vector())))
    return model


def test_probabilities_sum_to_one():
    model = Gru(np.arange(1, 129, dtype=float), hidden=5)
    states = np.random.default_rng(1).normal(size=(1, 5)).astype(np.float32)
    every = model.log_probs(np.repeat(states, 128, axis=0), np.arange(128))
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)


def test_gradients_are_those_of_the_loss():
    model = small_model()
    ids = np.random.default_rng(2).integers(0, 150, (7, 3))
    ids[3, 1] = model.end
    start = np.zeros((3, 5), np.float32)

    def loss(vector):
        model.load(vector)
        states, _, _ = model.steps(ids, start)
        return -model.log_probs(states.reshape(-1, 5), ids.reshape(-1)).mean()

    vector = model.vector().astype(np.float64)
    g, _ = model.gradients(ids, start)
    gradient = np.concatenate([g[n].ravel() for n in model.NAMES])
    rng = np.random.default_rng(3)
    for at in rng.choice(np.flatnonzero(np.abs(gradient) > 1e-3), 25):
        step = np.zeros_like(vector)
        step[at] = 1e-2
        numeric = (loss(vector + step) - loss(vector - step)) / 2e-2
        assert numeric == pytest.approx(gradient[at], abs=2e-3, rel=0.05)


def test_state_is_carried_across_windows():
    model = small_model()
    rng = np.random.default_rng(5)
    documents = [np.append(rng.integers(0, 149, n), model.end) for n in (0, 1, 5, 31, 32, 33, 100, 300)]
    got = model.score(documents, streams=3, window=32)
    for d, score in zip(documents, got, strict=True):
        states, _, _ = model.steps(d[:, None], np.zeros((1, 5), np.float32))
        assert score == pytest.approx(model.log_probs(states[:, 0], d).sum() / math.log(10), rel=1e-4)


# 9: toxicity


@pytest.fixture(scope="module")
def labelled():
    r = random.Random(9)
    insults = ["grumblefink", "dratwurz", "blastnoggin", "foulsprat", "mudgrabber"]
    rows = []
    for k in range(1200):
        words = made("en", r, r.randint(30, 120)).split()
        toxic = k % 8 == 0
        for _ in range(4 if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(insults))
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_toxic_documents_are_found(spark, labelled):
    docs = spark.createDataFrame([r[:2] for r in labelled], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in labelled] + [(5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.detect(docs, labels).collect()}
    held = [r for r in labelled if fold(r[0], 4) == 2]
    assert all(got[r[0]].held_out for r in held)
    assert all(got[r[0]].predicted == (got[r[0]].score >= 0.3) and 0 <= got[r[0]].score <= 1 for r in labelled)
    assert np.mean([got[r[0]].predicted for r in held if r[2]]) > 0.9
    assert np.mean([got[r[0]].predicted for r in held if not r[2]]) < 0.05


def test_toxicity_windows_cover_the_text():
    text = " ".join(f"w{k}" for k in range(100)).encode()
    assert set(b" ".join(toxicity.windows_of(text)).split()) == set(text.split())
    assert toxicity.windows_of(b" !!! ") == []


def test_savings_are_differences_of_compressed_lengths(labelled):
    """Against compressing each window with dictionaries made here."""
    import zstandard

    model = toxicity.train([r[1].encode() for r in labelled if r[2]], [r[1].encode() for r in labelled if not r[2]])
    assert len(model.toxic) == len(model.ordinary) and b" dratwurz " in model.toxic and b"dratwurz" not in model.ordinary
    text = labelled[8][1].encode()
    saved = []
    for window in toxicity.windows_of(text):
        size = {}
        for name, content in (("ordinary", model.ordinary), ("toxic", model.toxic)):
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=toxicity.LEVEL)
            size[name] = len(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_dict_id=False).compress(window))
        saved.append(size["ordinary"] - size["toxic"])
    assert toxicity.savings_of(text, *model.compressors()) == max(saved) + sum(s for s in saved if s > 0) / 4


def test_calibration_is_monotone():
    r = random.Random(2)
    edges, scores = toxicity._calibrate([(v, float(r.random() < v / 10)) for v in [r.randint(0, 9) for _ in range(500)]])
    assert (np.diff(scores) > 0).all() and len(scores) == len(edges) + 1


def test_toxicity_edge_cases(spark, docs, no_docs, rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.detect(docs, none).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.detect(no_docs, none).count() == 0


def test_long_toxic_text_does_not_end_the_sample(spark):
    """A text beyond the bound of the sample's bytes is passed over wherever it comes; the others are learned from."""
    r = random.Random(8)
    plain = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    rows = [(k, plain(30) + (" grobword vileword " + plain(5) if k % 3 == 0 else "")) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows] + [(9000 + k, k % 2) for k in range(8)], "doc_id int, toxic int")
    long = [(9000 + k, plain(40_000)) for k in range(8)]
    docs = spark.createDataFrame(rows + long, "doc_id int, text string")
    got = {x.doc_id: x for x in toxicity.detect(docs, labels, max_bytes=150_000).collect()}
    assert len(got) == 408
    held_out = [(k, got[k].predicted) for k, _ in rows if got[k].held_out]
    assert sum(p == (k % 3 == 0) for k, p in held_out) >= 0.95 * len(held_out)
