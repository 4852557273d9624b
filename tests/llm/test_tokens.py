"""Operators on tokens, against the tokenizers' own results and plain loops."""

import hashlib
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import alignment, divergence, queries, word_bpe

ODD = [
    "It's we're I'LL they'd 's's 'tis ''s '' don't've a'b 'RE're",
    "x́é é ẛ̣ ﬁ Å ΣΑΣ ΑΣ ς İi̇ Ǆ ŉ Ⱥ ẞß",
    "ab12345c ½²³ ٣٤ १२ Ⅷ ① x_y #$% …—“quoted” ‘s’ €5 «a»",
    "tab\there\nnew\r\nline\x0b\x0c\x1c\x1d\x85\xa0 　end​﻿",
    "日本語のテキスト 中文 한국어 ไทย العربية हिन्दी 👩‍👩‍👧 🇩🇪",
    "<|startoftext|>a<|endoftext|> b<|endoftext|><|endoftext|> <|other|> <| startoftext|>",
    "",
    " ",
    "\n",
    "a" * 5000,
    "'" * 300 + "s" + "!?" * 200,
    "\x00\x01 nul \x7f",
    "".join(chr(c) for c in range(1, 0x250)),
    " ".join(chr(c) for c in range(1, 0x250)),
    " ".join(chr(c) for c in range(0x2000, 0x20D0)),
    "<s> </s> <unk> ▁ a▁b <0x41> ▁▁",
    "  two  spaces   three \n \n  lines \r\n\r\n;\r\n x;\ry  ",
]


def odd_rows(rows, start=5000):
    r = random.Random(2)
    pool = "ab 'sst.,\néß́Σ中　\r\t1½<|>▁"
    texts = ODD + ["".join(r.choice(pool) for _ in range(r.randint(1, 80))) for _ in range(200)]
    return [*rows, *((start + k, t, None, None, 0, *rows[0][5:]) for k, t in enumerate(texts))]


@pytest.fixture(scope="module")
def odd(spark, docs, rows):
    return spark.createDataFrame(odd_rows(rows), docs.schema).repartition(6)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11: encoding and decoding


@pytest.fixture(scope="module")
def word_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def told(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), ids, tokenizer.decode(ids, skip_special_tokens=False)


def test_words_are_encoded_and_decoded_as_by_the_library(odd, rows, word_tokenizer):
    path = queries.vocabulary("word_bpe_49k.json")
    got = word_bpe.encode_words(odd, path, keep=("doc_id", "text"), buckets=5)
    assert got.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    found = got.collect()
    assert len(found) == len(odd_rows(rows))
    for r in found:
        assert (r.n_tokens, r.ids, r.decoded) == told(word_tokenizer, r.text), repr(r.text)[:200]


def test_word_digests(odd, word_tokenizer):
    path = queries.vocabulary("word_bpe_49k.json")
    got = word_bpe.digests(word_bpe.encode_words(odd, path, keep=("text",))).collect()
    for r in got:
        _, ids, decoded = told(word_tokenizer, r.text)
        assert (r.ids_sha256, r.decoded_sha256) == (sha(" ".join(map(str, ids))), sha(decoded))


def test_array_splitter_gives_the_tokenizers_words(word_tokenizer):
    tokens = word_bpe.tokens_of(queries.vocabulary("word_bpe_49k.json"))
    assert tokens.latin
    r = random.Random(5)
    letters = [chr(c) for c in [*range(0x180), *range(0x2010, 0x2028), 0x20AC] if c != 0x130]
    texts = ["".join(letters), " ".join(letters), *("".join(r.choice("'sretvmdl LL12éÉ.’\n\x1c\x85") for _ in range(40)) for _ in range(2000)), "", "'", "'s", "x'l", "x'll"]
    assert all(tokens.is_latin(t) for t in texts)
    words, counts = word_bpe.split_latin(texts)
    flat, at = words.to_pylist(), 0
    for text, n in zip(texts, counts, strict=True):
        assert flat[at : at + n] == tokens.split(text), repr(text)
        at += n
    for text in letters:  # characters that the array splitter takes keep their form
        assert unicodedata.normalize("NFC", text) == text


def test_words_on_empty_and_blank_tables(spark, no_docs, docs):
    path = queries.vocabulary("word_bpe_49k.json")
    assert word_bpe.encode_words(no_docs, path).count() == 0
    blank = docs.where(F.col("text").isNull() | (F.col("doc_id") == 102))
    assert {(r.n_tokens, tuple(r.ids), r.decoded) for r in word_bpe.encode_words(blank, path).collect()} == {(0, (), "")}


def test_blocks_that_change_between_readings_are_an_error(spark, docs):
    path = queries.vocabulary("word_bpe_49k.json")
    changing = docs.withColumn("text", F.udf(lambda t: f"{t} {random.SystemRandom().random()}")("text"))
    with pytest.raises(Exception, match="stable=False"):
        word_bpe.encode_words(changing, path, stable=True).collect()
    assert word_bpe.encode_words(changing, path).count() == docs.count()


# 12: divergence of sources


def terms_of(text):
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def audit(rows, least_docs=3, top=200):
    """Plain loops over (text, lang, source)."""
    groups, within = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = terms_of(text)
        groups[lang or "", source or ""].update(found)
        within[lang or ""].update(set(found))
    out = []
    for lang in within:
        kept = sorted(t for t, n in within[lang].items() if n >= least_docs)
        counts = {s: [c[t] for t in kept] for (x, s), c in groups.items() if x == lang}
        whole = [sum(c) for c in zip(*counts.values(), strict=True)]
        share = lambda c: [1 + 10**9 * (n + 1) // (sum(c) + len(kept)) for n in c]  # noqa: B023, E731
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in p:
            pairs = sorted((-sum((x - y) ** 2 // y for x, y in zip(p[s], p[o], strict=True)), o.encode()) for o in p if o != s)
            higher = sorted((-((x - y) ** 2 // y), t.encode()) for x, y, n, t in zip(p[s], q, counts[s], kept, strict=True) if n and x > y)[:top]
            for part, found in (("pair", pairs), ("term", higher)):
                out += [(lang, s, part, t.decode(), -v, k + 1) for k, (v, t) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("buckets", "top"), [(3, 5), (7, 200)])
def test_divergences_match_loops(odd, rows, buckets, top):
    got = divergence.divergences(odd, top=top, buckets=buckets)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audit([(r[1], r[2], r[3]) for r in odd_rows(rows)], top=top)


def test_divergences_of_empty_blank_and_termless_tables(spark, no_docs, docs):
    assert divergence.divergences(no_docs).count() == 0
    made = [("a b", "en", "x"), ("a c", "en", "y"), ("12", "en", None), (None, None, "z")]
    few = spark.createDataFrame(made, "text string, lang string, source string")
    assert sorted(map(tuple, divergence.divergences(few, buckets=3).collect())) == audit(made)


def test_large_counts_have_exact_shares():
    counts = np.array([[0, 5, 10**15, 10**17]])
    total = counts.sum(axis=1, keepdims=True)
    assert divergence.shares(counts, total, 4).tolist()[0] == [1 + 10**9 * (n + 1) // (int(total[0, 0]) + 4) for n in counts.tolist()[0]]
    small = np.array([[0, 5, 10**13, 7]])
    assert divergence.shares(small, small.sum(axis=1, keepdims=True), 4).tolist()[0] == [1 + 10**9 * (n + 1) // (10**13 + 16) for n in small.tolist()[0]]


def test_pairs_in_pieces(monkeypatch):
    p = np.random.default_rng(1).integers(1, 10**9, (5, 40))
    whole = divergence.pair_sums(p)
    monkeypatch.setattr(divergence, "PIECE", 12)
    assert np.array_equal(divergence.pair_sums(p), whole)
    assert whole[1, 2] == sum((int(x) - int(y)) ** 2 // int(y) for x, y in zip(p[1], p[2], strict=True))


# 13: alignment of two tokenizers


def aligned_by_loops(texts, a_path, b_path):
    """texts -> tuples, by plain loops over whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer
    A=Tokenizer.from_file(a_path); A.no_truncation(); A.no_padding(); A.encode_special_tokens=True
    B=sentencepiece.SentencePieceProcessor(model_file=b_path)
    pr=[*range(33,127),*range(161,173),*range(174,256)]
    dec={chr(b):b for b in pr}
    k=0
    for b in range(256):
        if b not in pr: dec[chr(256+k)]=b; k+=1
    docs=[]
    for t in texts:
        if not t: docs.append(([],[],[])); continue
        full=(' '+t).encode()
        ai=A.encode(' '+t,add_special_tokens=False).ids; bi=B.encode(t)
        ab=[bytes(dec[c] for c in A.id_to_token(i)) for i in ai]
        bb=[]
        for i in bi:
            p=B.id_to_piece(i)
            bb.append(bytes([int(p[3:5],16)]) if B.is_byte(i) else p.replace('▁',' ').encode())
        if b''.join(ab)!=full or b''.join(bb)!=full: docs.append(([],[],[])); continue
        ae,be=set(),set(); x=0
        for y in ab: x+=len(y); ae.add(x)
        x=0
        for y in bb: x+=len(y); be.add(x)
        cuts=sorted(ae&be)
        groups=[]; pa_=pb_=0; xa=xb=0
        for c in cuts:
            ga,gb=[],[]
            while xa<c: ga.append(ai[pa_]); xa+=len(ab[pa_]); pa_+=1
            while xb<c: gb.append(bi[pb_]); xb+=len(bb[pb_]); pb_+=1
            groups.append((ga,gb))
        docs.append((ai,bi,groups))
    count=Counter()
    for _,_,g in docs:
        count.update({(x,y) for ga,gb in g for x in ga for y in gb})
    best=defaultdict(int)
    for (x,_),n in count.items(): best[x]=max(best[x],n)
    out=[]
    for ai,bi,g in docs:
        nl=nb=cs=0
        for ga,gb in g:
            for x in ga:
                for y in gb:
                    n=count[x,y]; nl+=1; cs+=n; nb+=n==best[x]
        s=';'.join(','.join(map(str,ga))+'|'+','.join(map(str,gb)) for ga,gb in g)
        out.append((len(ai),len(bi),len(g),nl,nb,cs,s))
    return out


PATHS = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def test_alignment_matches_loops(odd, rows):
    paths = [queries.vocabulary(p) for p in PATHS]
    got = alignment.align(odd, *paths, keep=("doc_id", "text"), buckets=5).collect()
    want = Counter(zip((r[0] for r in odd_rows(rows)), aligned_by_loops([r[1] for r in odd_rows(rows)], *paths), strict=True))
    assert Counter((r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups)) for r in got) == want
    assert all(r.n_overlaps >= max(r.n_a, r.n_b) for r in got if r.n_a)


def test_large_groups_and_small_calls_change_nothing(monkeypatch):
    tokenizers = alignment.tokenizers_of(*[queries.vocabulary(p) for p in PATHS])
    texts = [*ODD, "\u00e9\u4e2d\ud55c" * 50, "\U0001f469" * 40]
    stretches, counts = alignment.stretches_of(texts, tokenizers.cut_bytes)
    assert b"".join(stretches.to_pylist()) == b"".join(b" " + t.encode() if t else b"" for t in texts) and counts.sum() == len(stretches)
    distinct = list(dict.fromkeys(stretches.to_pylist()))
    one = alignment.encode_stretches(distinct, tokenizers)
    links = alignment.Aligned(*one[:4], tokenizers).links(32000)
    monkeypatch.setattr(alignment, "CALL_BYTES", 1)
    monkeypatch.setattr(alignment, "PLAIN_LINKS", 2)
    two = alignment.encode_stretches(distinct, tokenizers)
    assert all(np.array_equal(x, y) for x, y in zip(one, two, strict=True))
    assert all(np.array_equal(x, y) for x, y in zip(links, alignment.Aligned(*two[:4], tokenizers).links(32000), strict=True))


def test_cuts_are_only_where_no_piece_goes_across():
    free = alignment.cut_bytes(iter([" a", "b\r", "\n\n", "x"]))
    assert {chr(k) for k in range(256) if free[k]} == set("\t\n\x0b\x0c ")


def test_alignment_of_empty_and_blank_tables(no_docs, docs):
    paths = [queries.vocabulary(p) for p in PATHS]
    assert alignment.align(no_docs, *paths).count() == 0
    got = alignment.align(docs.where(F.col("text").isNull() | (F.col("text") == "")), *paths).collect()
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, 0, "")}
