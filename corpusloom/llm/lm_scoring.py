"""Scoring documents with a gated recurrent language model trained on the corpus.

All tokens of the training documents are counted. The most frequent words, an end, and symbols for
the others by their last letters are the model's symbols; a word outside takes its symbol's
probability times its share of that symbol's counts, so the model gives every text a
probability. The model starts as the unigram model. The training documents are dealt over the rounds
by a hash of the id, so that every one of them is learned from. In each round every task trains a
copy on its part by truncated backpropagation, hundreds of documents side by side, and Spark averages
the copies. Whole documents are then scored with the
state carried from window to window.

Texts are read once: each document is written as numbers of words within a chunk of documents, which has
each of its words once. Words are counted and looked up by chunk; the symbols that follow are written, and
the rounds learn from them and the scores are taken from them.

Only bounded data is broadcast: the model and the counts of the `lookup` most frequent words. The
counts of all other words reach the documents that have them in a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import crc32_of, cut, top
from corpusloom.llm.gru import Gru
from corpusloom.llm.words import grouped

#: Symbols for words outside the model's vocabulary.
OTHERS = 63
ALPHA = 0.1
#: Distinct words of the runs of documents that are one chunk, summed.
HELD = 300_000
CHUNK = 4096
#: Symbols of whole documents that a task gathers before it learns from them, or scores them, side by side in streams.
HELD_SYMBOLS = 1_000_000
HELD_SCORED = 4_000_000


MARKS = b".,;:!?"


def tail_of(word: bytes) -> bytes:
    return word.rstrip(MARKS)[-2:]


def of_tail(tail: bytes) -> int:
    return zlib.crc32(tail) % OTHERS


def other(word: bytes) -> int:
    return of_tail(tail_of(word))


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts (null: none), A-Z lower-cased, as numbers in a dictionary, and how many each text has."""
    texts = pc.ascii_lower(pc.ascii_trim_whitespace(pc.fill_null(pc.cast(texts, pa.string(), safe=False), "")))
    lists = pc.ascii_split_whitespace(texts)
    sizes = np.where(pc.binary_length(texts).to_numpy() > 0, pc.list_value_length(lists).to_numpy(), 0)  # an empty text has one empty word
    words = pc.cast(lists.flatten(), pa.binary())
    if (sizes == 0).any():
        words = words.filter(pc.greater(pc.binary_length(words), 0))
    return words.dictionary_encode(), sizes


def _others(words: pa.Array) -> np.ndarray:
    """The symbol for others of each word, as `other` gives it."""
    trimmed = pc.ascii_rtrim(pc.cast(words, pa.string(), safe=False), characters=MARKS.decode())
    tails = pc.binary_slice(pc.cast(trimmed, pa.binary()), -2).dictionary_encode()
    of_tails = np.array([of_tail(t) for t in tails.dictionary.to_pylist()], np.int32)
    return of_tails[tails.indices.to_numpy()] if len(words) else of_tails


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, row_key, held_out, text) with the numbers of their words in place of the text. The first
    row of each chunk has the chunk's words, their symbols for others and their counts in training rows;
    these hold for the rows after it, up to the next such row."""
    packer, held, parts, sizes, distinct, size = zstandard.ZstdCompressor(level=1), [], [], [], 0, 0

    def chunk() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        coded, lengths = pa.chunked_array(parts).unify_dictionaries(), np.concatenate(sizes)
        words = coded.chunk(0).dictionary
        codes = np.concatenate([part.indices.to_numpy() for part in coded.chunks])
        ends = np.cumsum(lengths)
        training = ~rows.column(2).to_numpy(zero_copy_only=False)
        counts = np.bincount(codes[np.repeat(training, lengths)], minlength=len(words))
        bounds, later = np.full(len(rows) + 1, len(words), np.int32), np.arange(len(rows)) > 0
        bounds[0] = 0
        columns = [
            pa.array([packer.compress(codes[end - n : end]) for end, n in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.binary()),
            *(pa.ListArray.from_arrays(bounds, x, mask=pa.array(later)) for x in (words, pa.array(_others(words), pa.int32()), pa.array(counts, pa.int64()))),
        ]
        return pa.RecordBatch.from_arrays([*rows.columns, *columns], [*rows.schema.names, "codes", "words", "others", "counts"])

    for batch in batches:
        for start, end, _ in grouped(batch):
            rows = batch.slice(start, end - start)
            part, lengths = _split(rows.column(3))
            held.append(rows.select([0, 1, 2]))
            parts.append(part)
            sizes.append(lengths)
            distinct, size = distinct + len(part.dictionary), size + len(part)
            if distinct > HELD or size > 2 * HELD_SYMBOLS:
                yield chunk()
                held, parts, sizes, distinct, size = [], [], [], 0, 0
    if held:
        yield chunk()


@dataclass
class Lexicon:
    """symbols: of the model's words. counts: of the frequent words. others: summed counts of each
    symbol for other words. documents, total, types: of the training tokens, ends included."""

    symbols: dict[bytes, int]
    counts: dict[bytes, int]
    others: np.ndarray
    documents: int
    total: int
    types: int

    @property
    def size(self) -> int:
        return len(self.symbols) + OTHERS + 1

    def weights(self) -> np.ndarray:
        words = [self.counts[w] + ALPHA for w in self.symbols]
        return np.array([*words, *self.others, self.documents + ALPHA])

    def log_total(self) -> float:
        return float(np.log10(self.total + ALPHA * (self.types + 1)))


class Reader:
    """What the words of a chunk, and after them the end, give to scores."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.first = lexicon, len(lexicon.symbols)
        self.frequent = pa.array(list(lexicon.counts), pa.binary())
        own = (lexicon.symbols.get(w, -1) for w in lexicon.counts)
        self.symbol = np.fromiter(own, np.int32, len(lexicon.counts))
        self.log_count = np.log10(np.fromiter(lexicon.counts.values(), float, len(lexicon.counts)) + ALPHA)
        self.log_others = np.log10(lexicon.others)

    def look_up(self, words: pa.Array, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether words are among the frequent, their symbols, their log counts (0: not among the frequent)
        and what they add to the score of their symbols; of the end at last."""
        at = pc.fill_null(pc.index_in(words, value_set=self.frequent.cast(words.type)), -1).to_numpy(zero_copy_only=False)
        known = at >= 0
        symbols, logs = np.full(len(at) + 1, -1, np.int32), np.zeros(len(at) + 1)
        symbols[:-1][known], logs[:-1][known] = self.symbol[at[known]], self.log_count[at[known]]
        outside = np.flatnonzero(symbols[:-1] < 0)
        extra = np.zeros(len(logs))
        extra[outside] = logs[outside] - self.log_others[others[outside]]
        symbols[outside] = self.first + others[outside]
        symbols[-1], logs[-1] = self.lexicon.size - 1, np.log10(self.lexicon.documents + ALPHA)
        return np.append(known, self.lexicon.documents > 0), symbols, logs, extra


def _read(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """Rows (id, row_key, held_out, codes, words, others) as `_code` wrote them: each row's symbols, its words that are
    not among the frequent, base scores without them, and what its score has beside the model's: the shares of words
    outside the vocabulary. The rows of a chunk are worked on together."""
    reader, log_total, unpacker = Reader(lexicon), lexicon.log_total(), zstandard.ZstdDecompressor()
    words = found = None
    for batch in batches:
        if not batch.num_rows:
            continue
        chunks = np.flatnonzero(batch.column(4).is_valid().to_numpy(zero_copy_only=False)).tolist()
        starts = sorted({0, *chunks})
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            rows = batch.slice(start, end - start)
            if rows.column(4)[0].is_valid:
                words, others = (rows.column(k)[0].values for k in (4, 5))
                found = reader.look_up(words, others.to_numpy(zero_copy_only=False))
            is_known, symbol_of, log_of, extra_of = found
            tail = np.array([len(words)], np.int32).tobytes()
            coded = [unpacker.decompress(c.as_py()) for c in rows.column(3)]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4 + 1
            own = np.frombuffer(b"".join(x for c in coded for x in (c, tail)), np.int32)
            ends = np.cumsum(sizes)
            first = ends - sizes
            known = is_known[own]
            rare = np.flatnonzero(~known & (own < len(words)))
            document = np.searchsorted(ends, rare, side="right")
            pairs, n = np.unique(document * len(words) + own[rare], return_counts=True)
            offsets = np.searchsorted(pairs, np.arange(len(coded) + 1) * len(words)).astype(np.int32)
            rare_words = words.take(pa.array(pairs % max(1, len(words))))
            yield pa.RecordBatch.from_arrays(
                [
                    *rows.columns[:3],
                    pa.array(sizes, pa.int64()),
                    pa.array(np.add.reduceat(known, first, dtype=np.int64)),
                    pa.array(np.add.reduceat(log_of[own], first) - log_total * sizes),
                    pa.array(np.add.reduceat(extra_of[own], first)),
                    packed(np.split(symbol_of[own], ends[:-1])),
                    pa.ListArray.from_arrays(offsets, rare_words),
                    pa.ListArray.from_arrays(offsets, pa.array(n, pa.int32())),
                ],
                ["id", "row_key", "held_out", "n_tokens", "n_known", "base_score", "extra", "symbols", "rare", "rare_n"],
            )


def lexicon_of(coded: DataFrame, documents: int, vocabulary: int, lookup: int) -> tuple[Lexicon, DataFrame]:
    """Counts over the training rows, so many `documents`, of `coded`: the frequent ones, about `lookup`, and the table of all."""
    found = coded.where("words is not null").select(F.explode(F.arrays_zip("words", "others", "counts")).alias("w"))
    found = found.select(F.col("w.words").alias("word"), F.col("w.others").alias("other"), F.col("w.counts").alias("n")).where("n > 0")
    counts = cut(found.groupBy("word", "other").agg(F.sum("n").alias("n")))
    frequent = top(counts, "n", "word", lookup)
    words, n = [bytes(w) for w in frequent.column("word").to_pylist()], frequent.column("n").to_pylist()
    order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
    known = {words[k]: n[k] for k in order}
    symbols = {words[k]: at for at, k in enumerate(order[: vocabulary - OTHERS - 1])}
    others = np.full(OTHERS, ALPHA)
    types = total = 0
    for r in counts.groupBy("other").agg(F.count("*").alias("types"), F.sum("n").alias("n")).collect():
        others[r["other"]] += r["n"] + ALPHA * r["types"]
        types, total = types + r["types"], total + r["n"]
    for word in symbols:
        others[other(word)] -= known[word] + ALPHA
    return Lexicon(symbols, known, np.maximum(others, ALPHA), documents, total + documents, types + (documents > 0)), counts


def packed(symbols: list[np.ndarray]) -> pa.Array:
    """Symbols of documents, as bytes: two each where that is enough, else four. A first byte tells which."""
    kinds = [np.uint16 if not len(x) or x.max() < 1 << 16 else np.int32 for x in symbols]
    return pa.array([bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes() for x, kind in zip(symbols, kinds, strict=True)], pa.binary())


def gathered(column: pa.Array, most: int = HELD_SYMBOLS) -> Iterator[list[np.ndarray]]:
    """The symbols of documents that `packed` wrote, in runs of about `most`."""
    held, size = [], 0
    for value in column:
        data = value.as_py()
        held.append(np.frombuffer(data, np.uint16 if data[0] == 2 else np.int32, offset=1).astype(np.int32))
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def portions(training: DataFrame, rounds: int = 2, share: int = 2) -> list[DataFrame]:
    """The rows, with an id, that each of the rounds learns from: 1 / `share` of all, by a hash of the
    id, another for each round. All rows are in one of them at least."""
    if share > rounds:
        raise ValueError("rows would be left out: share must not exceed rounds")
    slot = F.pmod(F.xxhash64("id", F.lit("train")), F.lit(share))
    return [training.where(slot == k % share) for k in range(rounds)]


def train(training: DataFrame, lexicon: Lexicon, hidden: int = 16, rounds: int = 2, share: int = 2) -> Gru:
    """The model after `rounds` rounds, each on its portion of `training` (id, symbols)."""
    model = Gru(lexicon.weights(), hidden)
    for portion in portions(training, rounds, share):
        shared = training.sparkSession.sparkContext.broadcast((lexicon.weights(), model))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, start = shared.value
            own, seen = Gru(known, start.hidden), 0
            own.load(start.vector())
            held, size = [], 0
            for batch in batches:
                for found in gathered(batch.column(0)):
                    held, size = held + found, size + sum(map(len, found))
                    if size >= HELD_SYMBOLS:
                        seen += own.train(held)
                        held, size = [], 0
            seen += own.train(held) if held else 0
            if seen:
                vector = own.vector().astype(np.float64)
                pieces = [vector[i : i + CHUNK] for i in range(0, len(vector), CHUNK)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(len(pieces), dtype=np.int32)),
                        pa.array(np.full(len(pieces), float(seen))),
                        pa.array(pieces, pa.list_(pa.float64())),
                    ],
                    ["piece", "weight", "part"],
                )

        parts = portion.select("symbols").mapInArrow(run, "piece int, weight double, part array<double>")
        mean = Summarizer.mean(array_to_vector("part"), F.col("weight"))
        found = parts.groupBy("piece").agg(vector_to_array(mean).alias("part")).orderBy("piece").collect()
        shared.unpersist()
        if found:
            model.load(np.concatenate([r["part"] for r in found]))
    return model


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 10,
    vocabulary: int = 2048,
    lookup: int = 100_000,
    hidden: int = 16,
    rounds: int = 2,
    share: int = 2,
) -> DataFrame:
    """Language-model scores of each row of `docs`, learned from the rows outside fold 0.

    The fold is the CRC-32 of the id as text modulo `folds` (null id: of the empty text, so fold
    0). A-Z is lower-cased; tokens are the words, runs of anything but ASCII white space, and an
    end. A null text is empty and has the end alone. Returns id_col, held_out, n_tokens, n_known
    (tokens that training has), train_tokens, base_score (log10 probability under smoothed
    unigram counts) and score (under the model). Rows with equal id and text have equal scores;
    each gets a row. Without training rows both models know nothing but the smoothing. Each task's copy
    of the model learns from its own partition, so another partitioning of `docs` gives slightly other
    scores (not base scores). An empty table gives an empty result.
    """
    held_out = crc32_of(F.col(id_col)) % folds == 0
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(id_col, text_col).alias("row_key"),
        F.col(text_col).alias("text"),
        held_out.alias("held_out"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    coded = rows.select("id", "row_key", "held_out", "text").mapInArrow(
        _code, f"id {kind}, row_key long, held_out boolean, codes binary, words array<binary>, others array<int>, counts array<long>"
    )
    coded = cut(coded)  # the order of a partition's rows is kept
    lexicon, counts = lexicon_of(coded, rows.where("not held_out").count(), vocabulary, lookup)
    context = docs.sparkSession.sparkContext
    lexicon_shared = context.broadcast(lexicon)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _read(batches, lexicon_shared.value)

    schema = f"id {kind}, row_key long, held_out boolean, n_tokens long, n_known long, base_score double"
    # The rounds, the scores and the join of the rare words use it, so it is written.
    known = cut(
        coded.select("id", "row_key", "held_out", "codes", "words", "others").mapInArrow(read, f"{schema}, extra double, symbols binary, rare array<binary>, rare_n array<int>")
    )
    model_shared = context.broadcast(train(known.where("not held_out").select("id", "symbols"), lexicon, hidden, rounds, share))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with the model's scores, without the counts of rare words."""
        model = model_shared.value
        for batch in batches:
            if batch.num_rows:
                found = np.concatenate([model.score(documents) for documents in gathered(batch.column(7), HELD_SCORED)])
                found += batch.column(6).to_numpy()
                columns = [*batch.columns[:6], pa.array(found)]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:6], "score"])

    scored = known.drop("rare", "rare_n").mapInArrow(score, f"{schema}, score double")
    words = known.select("row_key", F.explode(F.arrays_zip("rare", "rare_n")).alias("w")).select("row_key", F.col("w.rare").alias("word"), F.col("w.rare_n").alias("n"))
    log_count = F.log10(F.coalesce(F.col("c.n"), F.lit(0)) + F.lit(ALPHA))
    found = words.alias("w").join(counts.select("word", "n").alias("c"), F.col("w.word") == F.col("c.word"), "left")
    rest = found.groupBy("row_key").agg(
        F.sum(F.col("w.n") * log_count).alias("logs"), F.sum(F.when(F.col("c.n").isNotNull(), F.col("w.n"))).alias("more_known")
    )
    # Rows with equal id and text share their key, and each has added the same words.
    again = known.groupBy("row_key").agg(F.count("*").alias("copies")).where("copies > 1")
    rest = rest.join(again, "row_key", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    logs = F.coalesce(F.col("logs") / F.col("copies"), F.lit(0.0))
    more_known = F.coalesce(F.expr("more_known div copies"), F.lit(0))
    return scored.join(rest, "row_key", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + more_known).alias("n_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + logs).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
