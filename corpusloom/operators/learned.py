"""Models that filters learn from a table: word lexicons, abbreviations, language profiles and translation tables.

Counting is Spark's: tasks add up what they see, aggregates add up the tasks. What goes to the tasks that apply a
model has a bound in its parameters (words of a lexicon, abbreviations, n-grams of a language's profile); the
translation table, which grows with the corpus, stays a table and is dealt into parts, as are the rows that learn it and use it.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text

#: Runs of characters of scripts that are written without spaces.
UNSPACED = "[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+"
#: Entries of a task's counts before it hands them on.
HELD = 200_000


def counted(df: DataFrame, count: Callable[[pa.RecordBatch], Iterator[tuple[tuple, float]]], keys: str, kind: str = "double") -> DataFrame:
    """The sums of what `count` gives for the batches of `df`: a row for each key (columns `keys`) with its `n`. A task
    adds up before the shuffle."""
    names = [k.split()[0] for k in keys.split(",")]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def out() -> pa.RecordBatch:
            columns = list(zip(*sums, strict=True)) if sums else [[] for _ in names]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(sums.values(), pa.float64())], [*names, "n"])

        for batch in batches:
            for key, n in count(batch):
                sums[key] += n
            if len(sums) > HELD:
                yield out()
                sums.clear()
        yield out()

    return df.mapInArrow(partial, f"{keys}, n double").groupBy(*names).agg(F.sum("n").cast(kind).alias("n"))


# Words in runs without spaces: a unigram lexicon, learned by expectation and maximisation.


def runs_of(df: DataFrame, text_col: str, pattern: str) -> DataFrame:
    """The distinct runs that match a pattern, and how often each occurs."""
    found = df.select(F.explode(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0))).alias("run"))
    return found.groupBy("run").agg(F.count("*").alias("times"))


def forward(run: str, cost: dict[str, float], longest: int, unknown: float) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Log-probabilities of all beginnings of a run, and the lattice's edges (from, to, log-probability)."""
    alpha, edges = [0.0] + [-math.inf] * len(run), []
    for end in range(1, len(run) + 1):
        terms = []
        for start in range(max(0, end - longest), end):
            p = cost.get(run[start:end], unknown if end - start == 1 else None)
            if p is not None:
                edges.append((start, end, p))
                terms.append(alpha[start] + p)
        top = max(terms)
        alpha[end] = top + math.log(sum(math.exp(t - top) for t in terms))
    return alpha, edges


def expected(run: str, cost: dict[str, float], longest: int, unknown: float) -> tuple[float, list[tuple[str, float]]]:
    """The log-probability of a run, and each word's expected number in it over all ways to cut it."""
    alpha, edges = forward(run, cost, longest, unknown)
    beta = [-math.inf] * len(run) + [0.0]
    for start, end, p in sorted(edges, key=lambda e: -e[1]):
        x, y = beta[start], beta[end] + p
        top = max(x, y)
        beta[start] = top + math.log(math.exp(x - top) + math.exp(y - top)) if top > -math.inf else top
    return alpha[-1], [(run[s:e], math.exp(alpha[s] + p + beta[e] - alpha[-1])) for s, e, p in edges]


def best_cut(run: str, cost: dict[str, float], longest: int, unknown: float) -> list[str]:
    """The words of the most probable way to cut a run (Viterbi)."""
    best, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        for start in range(max(0, end - longest), end):
            p = cost.get(run[start:end], unknown if end - start == 1 else None)
            if p is not None and best[start] + p > best[end]:
                best[end], back[end] = best[start] + p, start
    words, end = [], len(run)
    while end:
        words.append(run[back[end] : end])
        end = back[end]
    return words[::-1]


def learn_lexicon(
    df: DataFrame, text_col: str, pattern: str = UNSPACED, longest: int = 6, least: int = 2, limit: int = 50_000, rounds: int = 6
) -> tuple[dict[str, float], list[float]]:
    """A unigram lexicon {word: log-probability} of the runs in a column, and the log-likelihood of each round.

    Candidates are the `limit` most frequent substrings of up to `longest` characters that occur `least` times; in each round, words take
    their expected numbers over all cuts of all runs, and those that fall below one, or save less than they cost in the lexicon, go. At most `limit` words come to the driver and go to the
    tasks. A character that no word has stands alone, at a cost below that of all words. Distinct runs are worked on once."""
    runs = runs_of(df, text_col, pattern).persist()

    def substrings(batch: pa.RecordBatch) -> Iterator[tuple[tuple, float]]:
        for run, times in zip(batch.column("run").to_pylist(), batch.column("times").to_pylist(), strict=True):
            for start in range(len(run)):
                for end in range(start + 1, min(len(run), start + longest) + 1):
                    yield (run[start:end],), float(times)

    frequent = counted(runs, substrings, "word string").where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(limit).collect()
    weights, likelihoods = {r["word"]: r["n"] for r in frequent}, []
    for _ in range(rounds):
        cost, unknown = costs_of(weights)

        def expectations(batch: pa.RecordBatch, cost=cost, unknown=unknown) -> Iterator[tuple[tuple, float]]:
            for run, times in zip(batch.column("run").to_pylist(), batch.column("times").to_pylist(), strict=True):
                likelihood, found = expected(run, cost, longest, unknown)
                yield ("",), likelihood * times
                for word, n in found:
                    yield (word,), n * times

        found = counted(runs, expectations, "word string").where((F.col("n") >= 1) | (F.col("word") == "")).orderBy("word").collect()
        likelihoods.append(sum(r["n"] for r in found if r["word"] == ""))
        weights = worth_their_place({r["word"]: r["n"] for r in found if r["word"] in cost}, longest)
    runs.unpersist()
    return costs_of(weights)[0], likelihoods


def worth_their_place(weights: dict[str, float], longest: int) -> dict[str, float]:
    """The words that shorten the description of the corpus and the lexicon together: what a word saves, each time it comes, against its best cut
    into other words must be more than its own letters cost in the lexicon. Single characters stay."""
    cost, unknown = costs_of(weights)
    letter = math.log(max(2, len({c for w in weights for c in w})))
    kept = {}
    for word, n in weights.items():
        own = cost.pop(word)
        apart = sum(cost.get(part, unknown) for part in best_cut(word, cost, longest, unknown)) if len(word) > 1 else -math.inf
        cost[word] = own
        if n * (own - apart) > len(word) * letter:
            kept[word] = n
    return kept


def costs_of(weights: dict[str, float]) -> tuple[dict[str, float], float]:
    total = sum(weights.values())
    cost = {w: math.log(n / total) for w, n in weights.items() if n > 0}
    return cost, min(cost.values(), default=0.0) - math.log(10)


def segmenter(lexicon: dict[str, float], pattern: str = UNSPACED) -> Callable[[Column], Column]:
    """A function of a column that puts spaces between the words of the runs in it; other text stays. Null stays null."""
    longest, unknown = max(map(len, lexicon), default=1), min(lexicon.values(), default=0.0) - math.log(10)
    runs = re.compile(pattern)

    def spaced(value: str) -> str:
        return runs.sub(lambda m: " " + " ".join(best_cut(m[0], lexicon, longest, unknown)) + " ", value)

    @F.pandas_udf("string")
    def segment(values: pd.Series) -> pd.Series:
        return values.map(spaced, na_action="ignore")

    return lambda c: text.collapse(F.coalesce(segment(F.when(c.rlike(pattern), c)), c))


# Abbreviations, by how much more often a period follows a word than chance would have it.


def abbreviations(df: DataFrame, text_col: str, least_score: float = 0.3, least_count: int = 3) -> DataFrame:
    """Columns word (lower case, without its last period), n (with a period), others (without), score. The score is the log-likelihood
    ratio of the collocation of word and period, lower for long words and for those that stand without period, higher for those with
    periods inside. Numbers and words without letters are none."""
    # Words are counted as they stand; what is around them is cut off once for each distinct one.
    words = df.select(F.explode(text.tokens(F.lower(text_col))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    bare = F.regexp_replace("w", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", "")
    words = words.select(bare.alias("w"), "n").where("w <> ''")
    ends = F.col("w").endswith(".")
    typed = words.select(F.when(ends, F.regexp_replace("w", "[.]+$", "")).otherwise(F.col("w")).alias("word"), F.when(ends, F.col("n")).otherwise(0).alias("n"), F.when(ends, 0).otherwise(F.col("n")).alias("others"))
    typed = typed.groupBy("word").agg(F.sum("n").alias("n"), F.sum("others").alias("others"))
    whole = typed.agg(F.sum("n").alias("periods"), F.sum(F.col("n") + F.col("others")).alias("all"))
    rated = typed.where((F.col("n") >= least_count) & F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike(r"\p{N}")).crossJoin(F.broadcast(whole))
    n, count = F.col("n"), F.col("n") + F.col("others")
    chance = (F.col("periods") / F.col("all")).cast("double")

    def log_likelihood(p: Column) -> Column:
        return n * F.log(p) + (count - n) * F.log(1 - p)

    size = F.length(F.replace("word", F.lit("."), F.lit("")))
    inside = F.length("word") - size
    ratio = 2 * (log_likelihood(F.lit(0.99)) - log_likelihood(chance))
    score = ratio * F.exp(-size.cast("double")) * (inside + 1) * F.pow(size.cast("double"), -F.col("others").cast("double"))
    return rated.select("word", "n", "others", score.alias("score")).where(F.col("score") >= least_score)


# Languages, by the rank order of their most frequent character n-grams.


LETTERS = re.compile(r"[^\W\d_]+")


def grams(value: str, longest: int) -> Counter:
    """The n-grams of a text by a plain loop, which says what `gram_codes` finds at once."""
    found: Counter = Counter()
    for word in LETTERS.findall(value.lower()):
        word = f" {word} "
        for n in range(1, longest + 1):
            found.update(word[k : k + n] for k in range(len(word) - n + 1))
    found.pop(" ", None)
    return found


def coded(value: str) -> np.ndarray:
    """The code points of a text's words, lower case, a space before, between and after them."""
    words = LETTERS.findall(value.lower())
    return np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64) if words else np.zeros(0, np.uint64)


def gram_codes(codes: np.ndarray, longest: int) -> np.ndarray:
    """The n-grams (up to `longest`, three at most) of the words of `coded`, each as one number: 21 bits for a character. An n-gram has a
    space at its ends only, and is more than a space."""
    space, found = codes == 32, [codes[codes != 32]]
    if longest > 1:
        found.append((codes[:-1] << np.uint64(21) | codes[1:])[~(space[:-1] & space[1:])])
    if longest > 2:
        found.append((codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:])[~space[1:-1]])
    return np.concatenate(found)


def gram_of(code: int) -> str:
    return "".join(chr(c) for c in (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF) if c)


def code_of(gram: str) -> int:
    code = 0
    for c in gram:
        code = code << 21 | ord(c)
    return code


def learn_profiles(df: DataFrame, text_col: str, lang_col: str, size: int = 400, longest: int = 3) -> dict[str, list[str]]:
    """For each language the `size` most frequent character n-grams (of up to `longest` characters, three at most) in order (ties by the n-gram).
    Rows without text or language teach nothing. A batch's n-grams are counted as numbers, language by language."""

    def count(batch: pa.RecordBatch) -> Iterator[tuple[tuple, float]]:
        by_language: dict[str, list[str]] = {}
        for value, lang in zip(batch.column("t").to_pylist(), batch.column("l").to_pylist(), strict=True):
            by_language.setdefault(lang, []).append(value)
        for lang, values in by_language.items():
            for start in range(0, len(values), 500):
                codes, n = np.unique(gram_codes(coded(" ".join(values[start : start + 500])), longest), return_counts=True)
                for code, times in zip(codes.tolist(), n.tolist(), strict=True):
                    yield (lang, gram_of(code)), float(times)

    known = df.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    ranked = counted(known, count, "lang string, gram string").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    profiles: dict[str, list[str]] = {}
    for r in ranked.where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def rank_detector(profiles: dict[str, list[str]], longest: int = 3, lead: float = 0.03) -> Callable[[Column], Column]:
    """A detector (struct<lang, reliable>) by out-of-place distance: the sum, over the n-grams of a text in order of frequency, of how far each
    is from its place in a language's profile. Reliable where the best language leads by `lead` of the greatest distance; `un` without letters."""
    languages, size = sorted(profiles), max(map(len, profiles.values()), default=1)
    names = np.array(sorted({code_of(g) for p in profiles.values() for g in p}), np.uint64)
    places = np.full((len(names), len(languages)), size, np.int32)
    for k, lang in enumerate(languages):
        places[np.searchsorted(names, np.array([code_of(g) for g in profiles[lang]], np.uint64)), k] = np.arange(len(profiles[lang]))

    def judge(value: str) -> tuple[str, bool]:
        found, n = np.unique(gram_codes(coded(value), longest), return_counts=True)
        if not len(found) or not languages:
            return "un", False
        # Ties go in the order of the n-grams as texts: their characters from the left.
        left = np.where(found >> np.uint64(42) > 0, found, np.where(found >> np.uint64(21) > 0, found << np.uint64(21), found << np.uint64(42)))
        found = found[np.lexsort((left, -n))[:size]]
        at = np.searchsorted(names, found)
        known = at < len(names)
        known[known] = names[at[known]] == found[known]
        ids, ranks = at[known], np.flatnonzero(known)
        distance = np.full(len(languages), size * (len(found) - len(ids)), np.int64)
        apart = np.abs(places[ids] - ranks[:, None])
        distance += np.where(places[ids] == size, size, apart).sum(axis=0)
        order = np.argsort(distance, kind="stable")
        second = distance[order[1]] if len(order) > 1 else size * len(found)
        return languages[order[0]], bool(second - distance[order[0]] >= lead * size * len(found))

    @F.pandas_udf("struct<lang:string,reliable:boolean>")
    def detect(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(v or "") for v in values], columns=["lang", "reliable"])

    return detect


# Word translations, by expectation and maximisation over all word pairs of aligned rows.
#
# No word pair is shuffled or kept. Source words are dealt into parts by hash; a row sends each part its own source words of that part with all its
# target words, once. A part has all rows of its source words, and so finds their translations from the rows alone: what it needs of former rounds is,
# for each target word of a row, how likely the row made it then, which is one number however many source words the row has.

#: What rows become: distinct words of both sides with how often each comes; `weights` has a number a round for each target word, position by position.
SIDES = "row long, sources array<string>, n array<int>, words string, times array<int>, weights array<double>"
#: What a part gets: words that it knows, and those of a row's target words they are asked with (`at`: their places in the row, null: all).
DEALT = "part int, row long, sources array<string>, n array<int>, words string, at array<int>, weights array<double>"
#: What a part says of a row's target words.
SAID = "row long, at array<int>, said array<double>"
#: What a part of a table gets: entries of the table, or rows that ask for theirs; target words are codes of `names`.
PACKED = "part int, asks boolean, names binary, found binary"
#: Source words of all rows for a part of a table that rows are scored with. Word pairs, and target words of rows, that a part learns from.
PART_WORDS, PART_PAIRS, PART_TARGETS = 2_000_000, 16_000_000, 6_000_000


def listed(lists: list, kind: pa.DataType) -> pa.ListArray:
    """Lists, or nulls, as one Arrow column."""
    full = [x for x in lists if x is not None]
    offsets = pa.array(np.cumsum([0, *(0 if x is None else len(x) for x in lists)]), pa.int32())
    values = pa.array(np.concatenate(full) if full else [], kind)
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array([x is None for x in lists]) if len(full) < len(lists) else None)


def column(rows: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    found = rows.column(name)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def bounds(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins in `lists.flatten()`, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])


def numbers(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def sides(pairs: DataFrame, row: Column, src: str, trg: str, empty: bool) -> DataFrame:
    """The rows whose target has words, as `SIDES`; with `empty` each row also has the empty source word, once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = [({"": 1} if empty else {}) | (Counter(x.split(" ")) if x else {}) for x in batch.column("a").to_pylist()]
            b = [Counter(x.split(" ")) for x in batch.column("b").to_pylist()]
            words, none = pa.array([" ".join(x) for x in b], pa.string()), listed([[]] * len(b), pa.float64())
            columns = [batch.column("row"), pa.array(map(list, a), pa.list_(pa.string())), listed([[*x.values()] for x in a], pa.int32()), words, listed([[*x.values()] for x in b], pa.int32()), none]
            yield pa.RecordBatch.from_arrays(columns, ["row", "sources", "n", "words", "times", "weights"])

    plain = pairs.select(row.alias("row"), text.collapse(F.lower(src)).alias("a"), text.collapse(F.lower(trg)).alias("b"))
    return plain.where("b <> ''").mapInArrow(read, SIDES)


def dealt(rows: DataFrame, parts: int, pieces: dict[str, int], all_words: bool = True) -> DataFrame:
    """`rows` as `DEALT`: a record for each row and each part that has any of its source words. Words in `pieces` are in too many rows for one task: they are cut by
    target word into so many pieces, which go to parts of their own with their share of the row's target words. Without `all_words` only these are dealt."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            part, row, sources, n, words, at, weights = zip(*out, strict=True) if out else [[]] * 7
            columns = [pa.array(part, pa.int32()), pa.array(row, pa.int64()), pa.array(sources, pa.list_(pa.string())), listed(n, pa.int32()), pa.array(words, pa.string()), listed(at, pa.int32()), listed(weights, pa.float64())]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["part", "row", "sources", "n", "words", "at", "weights"])

        for batch in batches:
            values, begin = numbers(batch.column("weights")), bounds(batch.column("weights"))
            lists = zip(*(batch.column(c).to_pylist() for c in ("row", "sources", "n", "words")), strict=True)
            for k, (row, sources, n, words) in enumerate(lists):
                weights, by_part, targets, codes = values[begin[k] : begin[k + 1]], {}, None, None
                for s, times in zip(sources, n, strict=True):
                    if s in pieces:
                        if targets is None:
                            targets = words.split(" ")
                            codes = np.array([zlib.crc32(t.encode()) for t in targets])
                        of = codes % pieces[s]
                        for piece in np.unique(of).tolist():
                            at = np.flatnonzero(of == piece)
                            share = weights.reshape(len(targets), -1)[at].ravel()
                            out.append((zlib.crc32(f"{piece} {s}".encode()) % parts, row, [s], [times], " ".join(targets[i] for i in at), at, share))
                    elif all_words:
                        own = by_part.setdefault(zlib.crc32(s.encode()) % parts, ([], []))
                        own[0].append(s)
                        own[1].append(times)
                out.extend((part, row, *own, words, None, weights) for part, own in by_part.items())
                if len(out) > 5000:
                    yield flush()
        yield flush()

    return rows.mapInArrow(deal, DEALT)


def met(records: DataFrame, parts: int) -> DataFrame:
    """Records of a part in one task, which is that part's."""
    return records.repartitionById(parts, records["part"])


def pairs_of_part(records: pa.Table, rounds: int, sums: dict[str, list[float]], most: int) -> Iterator[tuple]:
    """The source words of a part with their translations as they are after so many `rounds`, some words after others: up to about `most` word pairs at a time, but all
    of a word. For each lot: names of the words; word, target word (as codes) and count of each distinct pair; the counts' sums by word; and of each occurrence of a
    pair its place among the record's target words, its distinct pair, and how often the record has the source word. `sums` has, round by round, those of words in pieces."""
    targets = pc.split_pattern(column(records, "words"), " ")
    begin, coded = bounds(targets), targets.flatten().dictionary_encode()
    codes, size = coded.indices.to_numpy(), len(coded.dictionary)
    weights = numbers(column(records, "weights")).reshape(len(codes), -1)
    named = column(records, "sources").flatten().dictionary_encode()
    names, word, n = named.dictionary.to_pylist(), named.indices.to_numpy(), numbers(column(records, "n"))
    record = np.repeat(np.arange(len(records)), np.diff(bounds(column(records, "sources"))))
    order = np.argsort(word, kind="stable")
    before = np.cumsum(np.bincount(word, weights=np.diff(begin)[record], minlength=len(names))) // most
    lots = np.searchsorted(before[word[order]], np.unique(before)) if len(word) else []
    for low, high in itertools.pairwise([*lots, len(order)]):
        own = order[low:high]
        first, sizes = word[own[0]], np.diff(begin)[record[own]]
        at = np.repeat(begin[record[own]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        pairs, pair = np.unique(np.repeat((word[own] - first).astype(np.int64) * size, sizes) + codes[at], return_inverse=True)
        source, times, words = pairs // size, np.repeat(n[own], sizes), names[first : word[own[-1]] + 1]
        count = np.bincount(pair).astype(float)
        for k in range(rounds + 1):
            if k:
                count = p * np.bincount(pair, weights=times * weights[at, k - 1])  # noqa: F821
            whole = np.bincount(source, weights=count)
            for i, s in enumerate(words) if sums else ():
                if k < len(sums.get(s, ())):
                    whole[i] = sums[s][k]
            p = count / whole[source]
        yield words, source, coded.dictionary, pairs % size, p, whole, at, pair, times


def parts_for(pairs: int, targets: int, most_pairs: int) -> int:
    """As few parts as can be, for what is sent grows with the parts that a row has words in: a part has `most_pairs` of the word pairs at most, and the rows
    that meet in it have `PART_TARGETS` target words at most, about. With as many parts as pairs over `PART_TARGETS` both hold."""
    most = pairs // PART_TARGETS + 1
    few = range(pairs // most_pairs + 1, most)
    return next((n for n in few if targets * (1 - (1 - 1 / n) ** (pairs / targets)) <= PART_TARGETS), max(most, pairs // most_pairs + 1))


def learn_translations(
    pairs: DataFrame, src: str, trg: str, rounds: int = 4, prune: float = 1e-3, most_words: int = 80, most_pairs: int = PART_PAIRS
) -> tuple[DataFrame, list[float]]:
    """A table (s, t, p) of the probability that word `s` is translated by `t`, and the log-likelihood after each round. Each round shares each target
    word's count among its row's source words and the empty word, and adds up; entries below `prune` go after the last round. Rows with more than `most_words` on a
    side tell little about words and are left to the score; they teach nothing here. A part has about `most_pairs` word pairs of rows; a source word that has more than a sixteenth of
    these is cut into pieces by target word, whose sums come to the driver."""
    short = (text.n_tokens(F.lower(src)) <= most_words) & (text.n_tokens(F.lower(trg)) <= most_words)
    rows = pairs_checkpoint(sides(pairs.withColumn("__row", F.monotonically_increasing_id()).where(short), F.col("__row"), src, trg, True))
    most = max(most_pairs // 16, 1)
    of_words = rows.select(F.explode("sources").alias("s"), F.size("times").cast("long").alias("n")).groupBy("s").agg(F.sum("n").alias("n"))
    sums = {r["s"]: [float(r["n"])] for r in of_words.where(F.col("n") > most).collect()}
    pieces = {s: math.ceil(n[0] / most) for s, n in sums.items()}
    each, targets = rows.agg(F.sum(F.size("sources").cast("long") * F.size("times")), F.sum(F.size("times"))).first()
    parts = parts_for(each or 0, targets or 0, most_pairs)

    def in_parts(k: int, say: Callable[[pa.Table, Iterator[tuple]], Iterator[pa.RecordBatch]], schema: str, all_words: bool = True) -> DataFrame:
        known, lot = {s: list(n) for s, n in sums.items()}, max(most // 2, 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if held := [b for b in batches if b.num_rows]:
                records = pa.Table.from_batches(held)
                yield from say(records, pairs_of_part(records, k, known, lot))

        return met(dealt(rows, parts, pieces, all_words), parts).mapInArrow(run, schema)

    def summed(_: pa.Table, lots: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for words, _, _, _, _, whole, *_ in lots:
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(whole)], ["s", "c"])

    def explained(records: pa.Table, lots: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        begin = bounds(pc.split_pattern(column(records, "words"), " "))
        made = np.zeros(begin[-1])
        for _, _, _, _, p, _, at, pair, times in lots:
            made += np.bincount(at, weights=p[pair] * times, minlength=len(made))
        yield from pa.Table.from_arrays([records.column("row"), records.column("at"), pa.ListArray.from_arrays(begin.astype(np.int32), made)], ["row", "at", "said"]).to_batches(10_000)

    def entries(_: pa.Table, lots: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for words, source, names, target, p, *_ in lots:
            kept = p >= prune
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()).take(pa.array(source[kept])), names.take(pa.array(target[kept])), pa.array(p[kept])], ["s", "t", "p"])

    likelihoods = []
    for k in range(rounds + 1):
        if k and pieces:
            for r in in_parts(k, summed, "s string, c double", all_words=False).groupBy("s").agg(F.sum("c").alias("c")).collect():
                sums[r["s"]].append(r["c"])
        if k == rounds:
            return in_parts(k, entries, "s string, t string, p double"), likelihoods
        rows = pairs_checkpoint(with_said(rows, in_parts(k, explained, SAID), weighed, f"{SIDES}, likelihood double"))
        likelihoods.append(rows.agg(F.sum("likelihood")).first()[0] or 0.0)
        rows = rows.drop("likelihood")


def with_said(rows: DataFrame, said: DataFrame, use: Callable, schema: str) -> DataFrame:
    """What `use` makes of a batch of `rows` and, for each, what the parts said of it, if any did: pairs of places (null: all) and numbers."""
    found = said.groupBy("row").agg(F.collect_list(F.struct("at", "said")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, which = batch.column("found").flatten(), bounds(batch.column("found"))
            at, numbers_of = lists.field("at"), lists.field("said")
            places, place, values, value = numbers(at), bounds(at), numbers(numbers_of), bounds(numbers_of)
            some = at.is_valid().to_pylist()
            yield use(batch, [[(places[place[i] : place[i + 1]] if some[i] else None, values[value[i] : value[i + 1]]) for i in range(a, b)] for a, b in itertools.pairwise(which)])

    return rows.join(found, "row", "left").mapInArrow(run, schema)


def weighed(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
    """The rows with one more weight for each target word: how often it comes over how likely the row made it."""
    times, begin = numbers(batch.column("times")), bounds(batch.column("times"))
    weights, start, out, likelihoods = numbers(batch.column("weights")), bounds(batch.column("weights")), [], []
    for k, said in enumerate(found):
        own = times[begin[k] : begin[k + 1]]
        made = np.zeros(len(own))
        for at, x in said:
            made[slice(None) if at is None else at] += x
        likelihoods.append(float(own @ np.log(made)))
        out.append(np.column_stack([weights[start[k] : start[k + 1]].reshape(len(own), -1), own / made]).ravel())
    columns = [batch.column(c) for c in ("row", "sources", "n", "words", "times")]
    return pa.RecordBatch.from_arrays([*columns, listed(out, pa.float64()), pa.array(likelihoods, pa.float64())], ["row", "sources", "n", "words", "times", "weights", "likelihood"])


def pairs_checkpoint(df: DataFrame) -> DataFrame:
    """`df` written to the folder the session names in spark.checkpoint.dir, so that rounds do not grow one plan."""
    context, spark = df.sparkSession.sparkContext, df.sparkSession
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            return df.persist()
        context.setCheckpointDir(folder)
    return df.checkpoint()


def adequacy(pairs: DataFrame, src: str, trg: str, table: DataFrame, name: str = "adequacy") -> DataFrame:
    """`pairs` with the mean, over the target's words, of the best probability that a source word gives it; 0 for a word that none translates, null for
    targets without words. The table is dealt into the same parts as the source words of the rows, a part for every `PART_WORDS` of these. A part holds its
    share of the table while blocks of rows stream by, and says for each row which target words it knows, and the best probability of each."""
    rows = pairs_checkpoint(pairs.withColumn("__row", F.monotonically_increasing_id()))
    asked = sides(rows, F.col("__row"), src, trg, False)
    parts = (rows.agg(F.sum(text.n_tokens(F.lower(src)))).first()[0] or 0) // PART_WORDS + 1

    def record(part: int, asks: bool, names: pa.Array, found: pa.RecordBatch) -> pa.RecordBatch:
        columns = [pa.array([part], pa.int32()), pa.array([asks]), pa.array([packed(pa.RecordBatch.from_arrays([names], ["name"]))]), pa.array([packed(found)])]
        return pa.RecordBatch.from_arrays(columns, ["part", "asks", "names", "found"])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in in_lots(batches, HELD):
            coded = column(lot, "s").dictionary_encode()
            part = parts_of(coded.dictionary, parts)[coded.indices.to_numpy()]
            order = np.lexsort((coded.indices.to_numpy(), part))
            lot, (found, low) = lot.take(pa.array(order)), np.unique(part[order], return_index=True)
            for k, (a, b) in zip(found.tolist(), itertools.pairwise([*low.tolist(), len(order)]), strict=True):
                own = lot.slice(a, b - a)
                codes, names = frequent_first(column(own, "t"))
                yield record(k, False, names, pa.RecordBatch.from_arrays([column(own, "s"), codes, column(own, "p")], ["s", "t", "p"]))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sources = pc.split_pattern(batch.column("words"), " "), batch.column("sources")
            begin, (codes, names) = bounds(words), frequent_first(words.flatten())
            named, of = sources.flatten().dictionary_encode(), np.repeat(np.arange(batch.num_rows), np.diff(bounds(sources)))
            part = parts_of(named.dictionary, parts)[named.indices.to_numpy()]
            words = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), codes)
            for k in np.unique(part).tolist():
                rows_of, n = np.unique(of[part == k], return_counts=True)
                own = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), sources.flatten().filter(pa.array(part == k)))
                yield record(k, True, names, pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows_of)), own, words.take(pa.array(rows_of))], ["row", "sources", "words"]))

    known = table.select("s", "t", "p").mapInArrow(shares, PACKED)
    table_first = met(known.unionAll(asked.mapInArrow(blocks, PACKED)), parts).sortWithinPartitions("asks")
    scores = with_said(asked.select("row", "times"), table_first.mapInArrow(answered, SAID), scored, "row long, score double")
    return rows.join(scores.select(F.col("row").alias("__row"), F.col("score").alias(name)), "__row", "left").drop("__row")


def parts_of(words: pa.Array, parts: int) -> np.ndarray:
    return np.array([zlib.crc32(s.encode()) % parts for s in words.to_pylist()], np.int64)


def frequent_first(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words as codes, low ones for words that come often, and the words by code."""
    coded = words.dictionary_encode()
    order = np.argsort(-np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)), kind="stable")
    code = np.empty(len(order), np.uint16 if len(order) <= 1 << 16 else np.uint32)
    code[order] = np.arange(len(order))
    return pa.array(code[coded.indices.to_numpy()]), coded.dictionary.take(pa.array(order))


def packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def in_lots(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches together, about `most` rows at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a part, after its share of the table, with the best probability that the part's source words give each of their target words."""
    spans, targets, share, n, ts = {}, {}, [], 0, None
    for asks, names, found in itertools.chain.from_iterable(zip(*(b.column(c) for c in ("asks", "names", "found")), strict=True) for b in batches):
        names, found = unpacked(names.as_py()).column("name").to_pylist(), unpacked(found.as_py())
        if not asks.as_py():
            coded = found.column("s").dictionary_encode()
            begin = np.flatnonzero(np.diff(coded.indices.to_numpy(), prepend=-1)) + n
            n += found.num_rows
            for s, (low, high) in zip(coded.dictionary.to_pylist(), itertools.pairwise([*begin.tolist(), n]), strict=True):
                spans.setdefault(s, []).append(slice(low, high))
            code = np.array([targets.setdefault(t, len(targets)) for t in names], np.int32)
            share.append((code[found.column("t").to_numpy()], found.column("p").to_numpy()))
            continue
        if ts is None:
            ts, ps = (np.concatenate(x) for x in zip(*share, strict=True)) if share else (np.zeros(0, np.int32), np.zeros(0))
            share, given = [], np.zeros(len(targets) + 1)
        words = found.column("words")
        codes, place = np.array([targets.get(t, len(targets)) for t in names], np.int32)[words.flatten().to_numpy()], bounds(words)
        best, named = np.zeros(len(codes)), found.column("sources").flatten().dictionary_encode()
        row, source = np.repeat(np.arange(found.num_rows), np.diff(bounds(found.column("sources")))), named.indices.to_numpy()
        order = np.argsort(source, kind="stable")
        rows = np.split(row[order], np.flatnonzero(np.diff(source[order])) + 1)
        for s, rows_of in zip(pc.unique(named.dictionary.take(pa.array(source[order]))).to_pylist(), rows, strict=True):
            if s in spans:
                for entries in spans[s]:
                    given[ts[entries]] = ps[entries]
                for k in rows_of.tolist():
                    own = slice(place[k], place[k + 1])
                    np.maximum(best[own], given[codes[own]], out=best[own])
                for entries in spans[s]:
                    given[ts[entries]] = 0
        hits = np.flatnonzero(best)
        offsets = pa.array(np.searchsorted(hits, place), pa.int32())
        at = hits - np.repeat(place[:-1], np.diff(offsets.to_numpy()))
        yield pa.RecordBatch.from_arrays([found.column("row"), pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(best[hits]))], ["row", "at", "said"])


def scored(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
    times, begin, scores = numbers(batch.column("times")), bounds(batch.column("times")), []
    for k, said in enumerate(found):
        own = times[begin[k] : begin[k + 1]]
        best = np.zeros(len(own))
        for at, x in said:
            best[at] = np.maximum(best[at], x)
        scores.append(float(own @ best / own.sum()))
    return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], ["row", "score"])
