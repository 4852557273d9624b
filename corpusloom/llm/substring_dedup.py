"""Exact substring deduplication with difference-cover anchors.

A perfect difference cover D modulo 31 has, for any two positions, a shift below 31 that brings
both onto positions in D. Two equal windows of `window` words therefore share an anchor, a run of
`window - 30` words that begins at a cover position in both documents. Only these anchors, 6 in 31
positions, are hashed and shuffled. Where an anchor occurs in more than one document, the windows
around it are extended to their full length and compared by 96-bit hashes.

Documents with the same word sequence are one class: the class is looked at once, in the
document with the smallest id, and the others lose every window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import cut
from corpusloom.llm.words import Codes, combine, grouped, rolled

PERIOD = 31
#: A perfect difference set modulo 31.
COVER = (1, 5, 11, 24, 25, 27)
#: Stands for a null id: greater than any other.
NO_ID = 2**63 - 1
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests = [], []
        for _, _, texts in grouped(batch):
            for text in texts:
                words = text.split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary())], ["id", "n_words", "digest"]
        )


def _text_key(words: list[bytes]) -> int:
    return int.from_bytes(hashlib.sha256(b" ".join(words)).digest()[:8], "big", signed=True)


def _rows_of(first: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each row, the smallest of `first` among the rows that agree with it in `keys`."""
    order = np.lexsort((first, *keys))
    new = np.concatenate(([True], np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])))
    low = np.empty_like(first)
    low[order] = first[order][new][np.cumsum(new) - 1]
    return low


def _anchors(window: int):
    """Rows (anchor, id, place, known). Where an anchor is in several documents of a batch, its rows
    are known to be shared, and only those of the smallest id go on under the anchor's name, to
    meet the other batches; the others get a name of their own. A frequent anchor so has few rows
    for each batch, however many documents have it."""
    length = window - PERIOD + 1
    at_cover = np.zeros(PERIOD, bool)
    at_cover[list(COVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            hashes, owners, at = [], [], []
            for start, _, texts in grouped(batch):
                for k, text in enumerate(texts):
                    words = text.split()
                    if len(words) < window:
                        continue
                    found = rolled(codes.of(words), length)
                    places = np.flatnonzero(at_cover[np.arange(len(found)) % PERIOD])
                    hashes.append(found[places])
                    owners.append(np.full(len(places), ids[start + k]))
                    at.append(places.astype(np.uint64))
            if not hashes:
                continue
            anchor, owner, place = np.concatenate(hashes), np.concatenate(owners), np.concatenate(at)
            low, high = _rows_of(owner, anchor), ~_rows_of(~owner, anchor)
            name = np.where(owner == low, anchor, combine(owner.view(np.uint64), place))
            yield pa.RecordBatch.from_arrays(
                [pa.array(name.view(np.int64)), pa.array(owner), pa.array(place.astype(np.int32)), pa.array(low < high)],
                ["anchor", "id", "place", "known"],
            )

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that are about to be shuffled, compressed."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [packer.compress(text) for _, _, texts in grouped(batch) for text in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "packed"])


def _windows(window: int):
    """Rows (h1, h2, id, text_key, at, gone) for the windows that contain an anchor at `places`. Where
    a window is in several documents of a batch, it is gone from all but the smallest id, and only
    the rows of that id go on under the window's hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, unpacker = Codes(), zstandard.ZstdDecompressor()
        for batch in batches:
            ids = batch.column("id").to_numpy()
            columns = []
            for start, _, texts in grouped(batch, "packed"):
                for k, text in enumerate(texts):
                    words = unpacker.decompress(text).split()
                    if len(words) < window:
                        continue
                    own = codes.of(words)
                    first = rolled(own, window)
                    places = np.asarray(batch.column("places")[start + k].as_py(), np.int64)
                    edges = np.zeros(len(first) + 1, np.int64)
                    np.add.at(edges, np.clip(places - PERIOD + 1, 0, len(first)), 1)
                    np.add.at(edges, np.clip(places + 1, 0, len(first)), -1)
                    at = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
                    second = rolled(combine(own, own), window)[at] >> np.uint64(32)
                    columns.append(
                        (first[at], second, np.full(len(at), ids[start + k]), np.full(len(at), _text_key(words)), at)
                    )
            if not columns:
                continue
            h1, h2, owner, key, at = (np.concatenate(c) for c in zip(*columns, strict=True))
            gone = owner > _rows_of(owner, h1, h2)
            h1 = np.where(gone, combine(key.view(np.uint64), at.astype(np.uint64)), h1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h1.view(np.int64)),
                    pa.array(h2.astype(np.uint32).view(np.int32)),
                    pa.array(owner),
                    pa.array(key),
                    pa.array(at.astype(np.int32)),
                    pa.array(gone),
                ],
                ["h1", "h2", "id", "text_key", "at", "gone"],
            )

    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            ids, keys = batch.column("id").to_numpy(), batch.column("text_key").to_numpy()
            rows, removed, digests, spans, kept_texts = [], [], [], [], []
            for start, _, texts in grouped(batch, "packed"):
                for k, text in enumerate(texts):
                    words = unpacker.decompress(text).split()
                    if _text_key(words) != keys[start + k]:  # another text with the same id
                        continue
                    rows.append(start + k)
                    places = np.asarray(batch.column("removed")[start + k].as_py(), np.int64)
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, places, 1)
                    np.add.at(edges, places + window, -1)
                    gone = np.cumsum(edges)[:-1] > 0
                    turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                    kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                    removed.append(int(gone.sum()))
                    spans.append([{"from": int(a), "to": int(b)} for a, b in turns.reshape(-1, 2)])
                    digests.append(hashlib.sha256(kept).hexdigest())
                    kept_texts.append(kept.decode())
            span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[rows]),
                    pa.array(keys[rows]),
                    pa.array(removed, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(spans, span),
                    pa.array(kept_texts, pa.string()),
                ],
                ["id", "text_key", "n_removed", "sha256", "spans", "kept_text"],
            )

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Remove each word that lies in a window of `window` words whose sequence also starts in a
    document with a smaller id; windows are judged on the texts as given.

    Returns a row for each input row: the id, n_words, n_removed, kept_sha256 (of the kept words,
    joined by one space), spans (removed word ranges, `to` excluded; null: nothing or everything)
    and kept_text (null where the text is unchanged or all of it went). Words are runs of anything
    but ASCII white space. Null and empty texts have no words. A null id counts as larger than any
    other; rows with equal ids don't remove each other's words. `window` must exceed 30, and the
    id must be an integer. An empty table gives an empty result.
    """
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD}")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    digests = cut(rows.mapInArrow(_digests, "id long, n_words long, digest binary"))
    owners = cut(digests.groupBy("digest").agg(F.min("id").alias("owner")))

    #: A window has at least window words and window - 1 separators.
    long_rows = rows.where(F.octet_length("text") >= 2 * window - 1)
    anchors = long_rows.mapInArrow(_anchors(window), "anchor long, id long, place int, known boolean")
    same = Window.partitionBy("anchor")
    shared = F.col("known") | (F.min("id").over(same) < F.max("id").over(same))
    places = anchors.withColumn("shared", shared).where("shared").groupBy("id").agg(F.collect_list("place").alias("places"))
    places = places.join(owners.select(F.col("owner").alias("id")).distinct(), "id", "left_semi")
    packed = long_rows.mapInArrow(_pack, "id long, packed binary")
    candidates = cut(packed.join(places, "id").select("id", "places", "packed"))

    windows = candidates.mapInArrow(_windows(window), "h1 long, h2 int, id long, text_key long, at int, gone boolean")
    gone = F.col("gone") | (F.col("id") > F.min("id").over(Window.partitionBy("h1", "h2")))
    repeats = windows.withColumn("gone", gone).where("gone")
    repeats = repeats.groupBy("id", "text_key").agg(F.array_distinct(F.collect_list("at")).alias("removed"))
    cleaned = (
        candidates.select("id", "packed")
        .join(repeats, "id")
        .select("id", "text_key", "packed", "removed")
        .mapInArrow(
            _remove(window),
            "id long, text_key long, n_removed long, sha256 string, spans array<struct<from: long, to: long>>, kept_text string",
        )
        .dropDuplicates(["id", "text_key"])
    )

    text_key = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    copy = (F.col("id") > F.col("owner")) & (F.col("n_words") >= window)
    judged = digests.withColumn("text_key", text_key).join(owners, "digest").join(cleaned, ["id", "text_key"], "left")
    whole = F.lower(F.hex("digest"))
    return judged.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA256)).otherwise(F.coalesce("sha256", whole)).alias("kept_sha256"),
        F.when(~copy, F.col("spans")).alias("spans"),
        F.when(~copy, F.col("kept_text")).alias("kept_text"),
    )

