"""Toxicity by compression distance.

Two zstandard dictionaries of equal length are made, from toxic and from ordinary text. Both hold the same
base, trained on ordinary windows; the toxic one also has the strings that set toxic documents apart,
where the ordinary one has as many bytes of ordinary text, so that the compressor treats both alike. A
window of a document is compressed with both. Where the toxic dictionary saves bytes, the window has
toxic strings. The savings of a document's windows are calibrated against labels by a monotone table of
rates.

Two dictionaries that zstandard's own training fills, one from each class, do worse: the training keeps
what is frequent, which is much the same in both classes, and what differs by chance in the two costs or
saves as many bytes as a toxic word. README has the figures of both forms.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import crc32_of
from corpusloom.llm.words import grouped

LEVEL = 6
#: Words of a window, and from one window to the next.
WIDTH, STRIDE = 8, 7
MARKS = b".,;:!?\"'()#*$%&|<>"


def plain_words(text: bytes) -> list[bytes]:
    """The lower-cased words of a text without the marks around them."""
    words = (w.strip(MARKS) for w in text.decode(errors="replace").lower().encode().split())
    return [w for w in words if w]


def windows_of(text: bytes) -> list[bytes]:
    """Overlapping windows of words that cover the whole text."""
    words = plain_words(text)
    last = max(1, len(words) - (WIDTH - STRIDE))
    return [b" ".join((b"", *words[k : k + WIDTH], b"")) for k in range(0, last, STRIDE)] if words else []


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    #: Upper edges of the savings' bins and the score of each bin.
    edges: np.ndarray
    scores: np.ndarray

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        def ready(content: bytes) -> zstandard.ZstdCompressor:
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_dict_id=False)

        return ready(self.ordinary), ready(self.toxic)

    def score(self, savings: float) -> float:
        return float(self.scores[np.searchsorted(self.edges, savings)])


def savings_of(text: bytes, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> float:
    """What the toxic dictionary saves over a document: the largest saving of a window, and a quarter
    of all savings."""
    found = [len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows_of(text)]
    return max(found) + sum(s for s in found if s > 0) / 4 if found else 0.0


def without_copies(texts: list[bytes]) -> list[bytes]:
    """The texts but those that share a smallest hash of four words, under one of two seeds, with an
    earlier one: copies would make any of their words look typical."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for text in texts:
        words = plain_words(text)
        shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
        sketch = {(seed, min(xxhash.xxh64_intdigest(s, seed) for s in shingles)) for seed in (1, 2)}
        if not sketch & seen:
            kept.append(text)
        seen |= sketch
    return kept


def toxic_strings(toxic: list[bytes], ordinary: list[bytes], least_share: float = 0.015, ratio: float = 10.0) -> bytes:
    """The strings, each between spaces, that are in `least_share` of the toxic documents or more (4
    at least), and there `ratio` times as often as in ordinary ones; the most frequent come last."""
    in_toxic = Counter(w for t in toxic for w in set(plain_words(t)))
    least = max(4, least_share * len(toxic))
    in_toxic = {w: n for w, n in in_toxic.items() if n >= least}
    in_ordinary = Counter(w for t in ordinary for w in in_toxic.keys() & set(plain_words(t)))
    rate = len(toxic) / max(1, len(ordinary))
    marks = [(n, w) for w, n in in_toxic.items() if n >= ratio * rate * (in_ordinary[w] + 0.5)]
    return b"".join(b" " + w + b" " for _, w in sorted(marks))


def lookalikes(marks: list[bytes], ordinary: list[bytes], near: int = 6) -> list[bytes]:
    """Words of ordinary documents that begin or end like a mark: its neighbours in order, and in order
    of the reversed words. With them in both dictionaries, only whole marks save bytes."""
    starts, ends = {m[:3] for m in marks}, {m[-3:] for m in marks}
    like: dict[bytes, None] = {}
    found = {w for t in ordinary for w in plain_words(t) if w[:3] in starts or w[-3:] in ends}.difference(marks)
    for turn in (lambda w: w, lambda w: w[::-1]):
        ordered = sorted(turn(w) for w in found)
        for m in marks:
            at = bisect.bisect(ordered, turn(m))
            like.update(dict.fromkeys(turn(w) for w in ordered[max(0, at - near) : at + near]))
    return list(like)


def train(toxic: list[bytes], ordinary: list[bytes], size: int = 32_768, base_documents: int = 2000) -> Model:
    """Dictionaries from three quarters of the documents, calibration from the rest. The samples must
    keep the proportion in which the classes occur, for the scores to be rates. The base is trained on the
    windows of `base_documents` ordinary documents; it, the toxic strings and the words that resemble
    them have `size` bytes each at most."""
    toxic, ordinary = without_copies(toxic), without_copies(ordinary)
    cut_toxic, cut_ordinary = 3 * len(toxic) // 4, 3 * len(ordinary) // 4
    windows = [w for t in ordinary[: min(cut_ordinary, base_documents)] for w in windows_of(t)]
    try:
        base = zstandard.train_dictionary(size, windows, level=3).as_bytes()
    except zstandard.ZstdError:  # too few windows to train on
        base = b"".join(windows)[-size:]
    extra = toxic_strings(toxic[:cut_toxic], ordinary[:cut_ordinary])[-size:]
    like = b"".join(b" " + w + b" " for w in lookalikes(extra.split(), ordinary[:cut_ordinary]))
    base = like[-size:] + base
    filler = (like or b"".join(windows))[: len(extra)].ljust(len(extra))
    model = Model(filler + base, extra + base, np.zeros(0), np.zeros(1))
    compressors = model.compressors()
    marked = [(savings_of(t, *compressors), 1.0) for t in toxic[cut_toxic:]]
    marked += [(savings_of(t, *compressors), 0.0) for t in ordinary[cut_ordinary:]]
    return Model(model.ordinary, model.toxic, *_calibrate(marked))


def _calibrate(marked: list[tuple[float, float]], least: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Monotone rates by pooling adjacent bins (isotonic regression), lightly smoothed."""
    if not marked:
        return np.zeros(0), np.zeros(1)
    pools: list[list[float]] = []
    for value, label in sorted(marked):
        if pools and (pools[-1][2] == value or pools[-1][1] < least):
            pools[-1][0] += label
            pools[-1][1] += 1
            pools[-1][2] = value
        else:
            pools.append([label, 1, value])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] and pools[-1][1] >= least:
            label_sum, n, edge = pools.pop()
            pools[-1] = [pools[-1][0] + label_sum, pools[-1][1] + n, edge]
    edges = np.array([p[2] for p in pools[:-1]])
    return edges, np.array([(p[0] + 0.1) / (p[1] + 1) for p in pools])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id_col, score, predicted (1 from `threshold` on) and savings of each row; null and empty
    texts save nothing."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        compressors = known.compressors()
        for batch in batches:
            found = [savings_of(text, *compressors) for _, _, texts in grouped(batch) for text in texts]
            scores = np.array([known.score(s) for s in found], float)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(scores),
                    pa.array((scores >= threshold).astype(np.int32)),
                    pa.array(np.array(found, float)),
                ],
                ["id", "score", "predicted", "savings"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, score double, predicted int, savings double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def detect(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 4,
    held_out_fold: int = 2,
    max_toxic: int = 1500,
    max_ordinary: int = 12_000,
    max_bytes: int = 48 << 20,
) -> DataFrame:
    """Score the toxicity of each row of `docs`, learning from labelled rows outside one fold.

    The fold is the CRC-32 of the id as text modulo `folds` (null id: of the empty text). The
    classifier is fitted on a bounded sample of labelled documents, in order of a hash of the id: at
    most `max_toxic` toxic and `max_ordinary` others, in the proportion in which they occur, and
    `max_bytes` of whole texts in all; a text that does not fit is passed over. Rows with a null label or text are no examples. Returns id_col,
    held_out, score (0 to 1), predicted and savings. Without toxic examples every score is 0 or near
    it. Rows may repeat; each is scored. An empty table gives an empty result.
    """
    held_out = crc32_of(F.col(id_col)) % folds == held_out_fold
    marked = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label")).where("label is not null")
    examples = (
        docs.where(~held_out & (F.octet_length(text_col) <= max_bytes))
        .select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(marked, F.col("id") == F.col("label_id"))
        .select("text", (F.col("label") == 1).alias("toxic"), F.xxhash64("id").alias("turn"))
    )
    n = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
    share = min(1.0, max_toxic / max(1, n.get(True, 0)), max_ordinary / max(1, n.get(False, 0)))
    texts: dict[bool, list[bytes]] = {True: [], False: []}
    size = 0
    for r in examples.where(F.pmod("turn", F.lit(1 << 20)) < share * (1 << 20)).orderBy("turn", "text").toLocalIterator():
        text = r["text"].encode()
        if size + len(text) <= max_bytes:  # a text that does not fit is passed over; shorter ones after it may
            size += len(text)
            texts[r["toxic"]].append(text)
    found = score(docs, train(texts[True], texts[False]), id_col, text_col)
    return found.select(id_col, held_out.alias("held_out"), "score", "predicted", "savings")
