"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams per language are gathered from all labelled texts, a row per task,
language and non-zero bucket, and summed by Spark. The matrix of log probabilities, buckets by
languages, is broadcast in blocks of languages of a bounded size; texts are scored against one block after
the other, in batches in numpy.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import crc32_of, cut
from corpusloom.llm.words import grouped

SIZES = (2, 3)
LETTER = regex.compile(r"\p{L}")
#: Texts are hashed in pieces of so many characters, which overlap by an n-gram.
PIECE = 1 << 18
#: Numbers of the matrix that are gathered at a time.
CELLS = 1 << 22


def _mix(x: np.ndarray) -> np.ndarray:
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    return x


def buckets_of(text: str, bits: int) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of the lower-cased text, in pieces."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    longest = max(SIZES)
    for start in range(0, max(1, len(points)), PIECE):
        part = points[start : start + PIECE + longest - 1]
        running = np.zeros(len(part), np.uint32)
        for n in range(1, longest + 1):
            if len(part) < n:
                break
            running = _mix(running[: len(part) - n + 1] * np.uint32(31) + part[n - 1 :])
            if n in SIZES:
                yield (running[:PIECE] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)


def grams_of(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams of the lower-cased texts, text by text, and the place of each text's first; as
    `buckets_of`, but for all texts at once."""
    points = [np.frombuffer(t.lower().encode("utf-32-le"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    chained = np.concatenate(points) if points else np.zeros(0, np.uint32)
    ends = np.repeat(np.cumsum(sizes), sizes)
    longest, running, found, owners = max(SIZES), np.zeros(len(chained), np.uint32), [], []
    owner = np.repeat(np.arange(len(texts)), sizes)
    for n in range(1, min(longest, len(chained)) + 1):
        running = _mix(running[: len(chained) - n + 1] * np.uint32(31) + chained[n - 1 :])
        if n in SIZES:
            whole = np.arange(len(running)) + n <= ends[: len(running)]
            bucket = (running + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)
            found.append(bucket[whole])
            owners.append(owner[: len(running)][whole])
    buckets, of = np.concatenate(found or [running]), np.concatenate(owners or [owner[:0]])
    order = np.argsort(of, kind="stable")
    return buckets[order], np.searchsorted(of[order], np.arange(len(texts) + 1))


def sums_of(weights: np.ndarray, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text the sum of the rows of `weights` at its buckets; as many n-grams at a time as fit in CELLS."""
    out = np.zeros((len(starts) - 1, weights.shape[1]))
    step = max(1, CELLS // max(1, weights.shape[1]))
    for at in range(0, len(buckets), step):
        rows = weights[buckets[at : at + step]]
        first = int(np.searchsorted(starts, at, side="right")) - 1
        edges = np.clip(starts[first:] - at, 0, len(rows))
        last = int(np.searchsorted(edges, len(rows)))
        filled = np.flatnonzero(np.diff(edges[: last + 1]) > 0)
        out[first + filled] += np.add.reduceat(rows, edges[filled], axis=0, dtype=float)
    return out


def _counter(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * (len(at) + 1), pa.string()),
                        pa.array(np.append(at, -1).astype(np.int32)),
                        pa.array(np.append(found[at], documents[lang])),
                    ],
                    ["lang", "bucket", "n"],
                )
            counts.clear()
            documents.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for start, _, texts in grouped(batch):
                for k, text in enumerate(texts):
                    lang = langs[start + k]
                    if lang not in counts:
                        if len(counts) >= 64:
                            yield from flush()
                        counts[lang], documents[lang] = np.zeros(1 << bits, np.int64), 0
                    documents[lang] += 1
                    for found in buckets_of(text.decode(errors="replace"), bits):
                        counts[lang] += np.bincount(found, minlength=1 << bits)
        yield from flush()

    return run


def train(labelled: DataFrame, bits: int = 15, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probability matrix (buckets by languages, the last row the priors),
    from rows (lang, text) with a lang."""
    blocks = list(train_blocks(labelled, bits, smoothing, 1 << 62))
    if not blocks:
        return [], np.zeros(((1 << bits) + 1, 0), np.float32)
    return blocks[0]


def train_blocks(
    labelled: DataFrame, bits: int = 15, smoothing: float = 0.5, max_matrix_bytes: int = 64 << 20
) -> Iterator[tuple[list[str], np.ndarray]]:
    """As `train`, in blocks of languages, by code point, whose matrices have `max_matrix_bytes` at most. Only one
    block of counts is with the driver at a time, and the list of the languages' numbers of texts."""
    counted = labelled.where("lang is not null").select("lang", "text").mapInArrow(_counter(bits), "lang string, bucket int, n long")
    totals = cut(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    texts = {r["lang"]: r["n"] for r in totals.where("bucket = -1").select("lang", "n").toLocalIterator()}
    langs, together = sorted(texts), max(1, max_matrix_bytes // (4 << bits))
    all_texts = sum(texts.values()) + smoothing * len(texts)
    for first in range(0, len(langs), together):
        own = langs[first : first + together]
        some = totals.where((F.col("bucket") >= 0) & F.col("lang").between(own[0], own[-1])).toArrow()
        counts = np.zeros((1 << bits, len(own)))
        place = {lang: k for k, lang in enumerate(own)}
        columns = np.array([place[x] for x in some.column("lang").to_pylist()], np.int64)
        counts[some.column("bucket").to_numpy(), columns] = some.column("n").to_numpy()
        grams = counts + smoothing
        priors = np.log([(texts[lang] + smoothing) / all_texts for lang in own])
        yield own, np.vstack([np.log(grams / grams.sum(axis=0)), priors]).astype(np.float32)


#: What a row has before the first block of languages.
NONE = ("cast(null as string) as lang_pred", "cast(0 as double) as best", "cast(0 as double) as spread")


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`predict_blocks` with all languages in one block."""
    return predict_blocks(docs, [(langs, matrix)] if langs else [], id_col, text_col)


def predict_blocks(
    docs: DataFrame, blocks: Iterable[tuple[list[str], np.ndarray]], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id_col, lang_pred and score of each row. A text that is null or has no letter, or any text if
    no language was learned, is `und` with score 0. The score is the posterior of the predicted
    language with the evidence tempered by the square root of the number of n-grams, which
    depend on each other. Equal posteriors go to the language first by code point. Blocks of languages are
    worked on one after the other; what a row has after one, its best language and the sum of all
    tempered posteriors, goes on to the next."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).selectExpr("id", "text", *NONE)
    turns = iter(blocks)
    block = next(turns, None)
    while block is not None:
        following = next(turns, None)
        carried = rows.schema if following is not None else rows.drop("text").schema
        rows = rows.mapInArrow(_scorer(docs, *block, following is not None), carried)
        rows = rows if following is None else cut(rows)
        block = following
    score = F.when(F.col("lang_pred").isNotNull(), 1 / F.col("spread")).otherwise(0.0)
    return rows.select(F.col("id").alias(id_col), F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), score.alias("score"))


def _scorer(docs: DataFrame, langs: list[str], matrix: np.ndarray, keep_text: bool):
    """Rows (id, text, lang_pred, best, spread), after the last block without text: the best language so far, its
    log posterior, and the sum over the languages so far of exp((log posterior - best) / sqrt(n))."""
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    bits = (len(matrix) - 1).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, names = shared.value, np.array(langs, object)
        for batch in batches:
            preds, bests, spreads = batch.column(2).to_pylist(), batch.column(3).to_numpy().copy(), batch.column(4).to_numpy().copy()
            for start, _, raws in grouped(batch):
                texts = [raw.decode(errors="replace") for raw in raws]
                some = [k for k, text in enumerate(texts) if LETTER.search(text)]
                if not some:
                    continue
                buckets, starts = grams_of([texts[k] for k in some], bits)
                totals = sums_of(weights[:-1], buckets, starts) + weights[-1]
                temper = np.sqrt(np.maximum(np.diff(starts), 1))
                place, high = totals.argmax(axis=1), totals.max(axis=1)
                spread = np.exp((totals - high[:, None]) / temper[:, None]).sum(axis=1)
                for k, at, lang, best, own, by in zip(some, start + np.array(some), names[place], high, spread, temper, strict=True):
                    if preds[at] is None:
                        preds[at], bests[at], spreads[at] = lang, best, own
                    else:
                        top = max(best, bests[at])
                        spreads[at] = spreads[at] * np.exp((bests[at] - top) / by) + own * np.exp((best - top) / by)
                        preds[at], bests[at] = (lang, best) if best > bests[at] else (preds[at], bests[at])
            columns = [batch.column(0), batch.column(1), pa.array(preds, pa.string()), pa.array(bests), pa.array(spreads)]
            found = pa.RecordBatch.from_arrays(columns, ["id", "text", "lang_pred", "best", "spread"])
            yield found if keep_text else found.select([0, 2, 3, 4])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """Predict the language of each row of `docs`, learning from the labelled rows outside fold 0.

    The fold is the CRC-32 of the id as text modulo `folds` (a null id: of the empty text, so fold
    0). Learning counts all rows of the other folds with a language and a text. Returns id_col,
    held_out, lang_pred and score; see `predict`. Rows may repeat and count so. An empty table gives
    an empty result."""
    held_out = fold_zero(id_col, folds)
    labelled = docs.where(~held_out).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found = predict_blocks(docs, train_blocks(labelled.where("text is not null")), id_col, text_col)
    return found.select(id_col, held_out.alias("held_out"), "lang_pred", "score")


def fold_zero(id_col: str, folds: int):
    return crc32_of(F.col(id_col)) % folds == 0
