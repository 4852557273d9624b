"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item gives windows of `window` consecutive words (an item with fewer words is one
window). A window is a set of word shingles with their offsets. Shingles are ordered by rarity,
the number of documents that contain them, counted over the whole corpus. A document contains a
window only if it contains all of its shingles, so the necessary prefix at full containment is the
rarest shingle alone: documents are joined to windows on that. A match fixes where the window would
start; it must begin and end inside the document (position and length bounds), and the words of
that window-sized part of the document must equal the window's.

The benchmark is the query set. It is taken in blocks of at most `block_bytes` of text, each sent to
the executors; the documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut
from corpusloom.llm.words import Codes, grouped, rolled

SHINGLE = 5
#: A-Z become a-z; what is neither a digit, a letter nor beyond ASCII separates words.
_CLEAN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_CLEAN).split()


@dataclass
class Windows:
    """The distinct windows of a block of items, and their shingles."""

    words: list[list[bytes]] = field(default_factory=list)
    items: list[set[str]] = field(default_factory=list)
    #: By shingle length: sorted codes of all shingles, for counting.
    shingles: dict[int, np.ndarray] = field(default_factory=dict)
    #: By shingle length: sorted codes of the rarest shingles and, for each, [(window, offset)].
    prefixes: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = field(default_factory=dict)

    @classmethod
    def of(cls, items: list[tuple[object, bytes]], window: int) -> Windows:
        out, known, codes = cls(), {}, Codes()
        for item_id, text in items:
            words = words_of(text)
            for start in range(max(1, len(words) - window + 1) if words else 0):
                part = words[start : start + window]
                at = known.setdefault(tuple(part), len(known))
                if at == len(out.words):
                    out.words.append(part)
                    out.items.append(set())
                if item_id is not None:
                    out.items[at].add(str(item_id))
        out._codes = [out._shingles(codes, w) for w in out.words]
        by_length: dict[int, list[np.ndarray]] = {}
        for w, found in zip(out.words, out._codes, strict=True):
            by_length.setdefault(min(SHINGLE, len(w)), []).append(found)
        out.shingles = {n: np.unique(np.concatenate(found)) for n, found in by_length.items()}
        return out

    @staticmethod
    def _shingles(codes: Codes, words: list[bytes]) -> np.ndarray:
        return rolled(codes.of(words), min(SHINGLE, len(words)))

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Choose each window's rarest shingle, given the document counts of `shingles`."""
        prefixes: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, (words, found) in enumerate(zip(self.words, self._codes, strict=True)):
            n = min(SHINGLE, len(words))
            at = np.searchsorted(self.shingles[n], found)
            offset = int(np.lexsort((at, counts[n][at]))[0])
            prefixes.setdefault(n, {}).setdefault(int(found[offset]), []).append((k, offset))
        for n, by_code in prefixes.items():
            ordered = sorted(by_code)
            self.prefixes[n] = np.array(ordered, np.uint64), [by_code[c] for c in ordered]
        del self._codes

    def find(self, words: list[bytes], codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, window) of each occurrence in a document."""
        for n, (wanted, entries) in self.prefixes.items():
            own = rolled(codes, n)
            if not len(own):
                continue
            at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
            for p in np.flatnonzero(wanted[at] == own).tolist():
                for k, offset in entries[at[p]]:
                    start, window = p - offset, self.words[k]
                    if start >= 0 and words[start : start + len(window)] == window:
                        yield start, k


def _counter(windows: Windows):
    """Rows (length, at, documents): in how many documents of the task a shingle occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        totals = {n: np.zeros(len(s), np.int64) for n, s in windows.shingles.items()}
        for batch in batches:
            for _, _, texts in grouped(batch):
                for text in texts:
                    own = codes.of(words_of(text))
                    for n, known in windows.shingles.items():
                        found = rolled(own, n)
                        if len(found):
                            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                            totals[n][np.unique(at[known[at] == found])] += 1
        for n, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), n, np.int32)), pa.array(at.astype(np.int64)), pa.array(counts[at])],
                ["length", "at", "documents"],
            )

    return run


def _matcher(windows: Windows, only_hits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            rows, counts, hits, items = [], [], [], []
            for start, _, texts in grouped(batch):
                for k, text in enumerate(texts):
                    words = words_of(text)
                    marked, found = np.zeros(len(words) + 1, np.int64), set()
                    for at, w in windows.find(words, codes.of(words)):
                        marked[at] += 1
                        marked[at + len(windows.words[w])] -= 1
                        found.add(w)
                    if only_hits and not found:
                        continue
                    turns = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(marked) > 0).view(np.int8)))))
                    rows.append(start + k)
                    counts.append(len(words))
                    hits.append([{"from": int(a), "to": int(b)} for a, b in turns.reshape(-1, 2)])
                    items.append(sorted(set().union(*[windows.items[w] for w in found])))
            span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take),
                    batch.column(1).take(take),
                    pa.array(counts, pa.int64()),
                    pa.array(hits, span),
                    pa.array(items, pa.list_(pa.string())),
                ],
                ["id", "row_key", "n_words", "hits", "items"],
            )

    return run


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_bytes: int = 2 << 20,
) -> DataFrame:
    """Where benchmark windows occur in documents.

    Returns a row for each row of `docs`: id_col, row_key (hash of id and text), n_words, hits
    (merged word ranges inside occurrences of windows, `to` excluded) and items (the ids, as sorted
    strings, of the items with such windows). Only A-Z is lower-cased; words are runs of digits,
    letters a-z and anything beyond ASCII. Null and empty texts have no words; an item without words
    has no window. The windows of an item with a null id hit words but name no item. Items may
    repeat or share windows. With an empty benchmark nothing is hit. Nothing is cut short: a
    benchmark larger than `block_bytes` is taken in several passes.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, row_key long, n_words long, hits array<struct<from: long, to: long>>, items array<string>"
    queries = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    size = queries.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = []
    for k in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).toLocalIterator()
        windows = Windows.of([(r["item"], r["text"].encode()) for r in block], window)
        counted = rows.select("text").mapInArrow(_counter(windows), "length int, at long, documents long")
        counts = {n: np.zeros(len(s), np.int64) for n, s in windows.shingles.items()}
        for r in counted.groupBy("length", "at").agg(F.sum("documents").alias("documents")).toLocalIterator():
            counts[r["length"]][r["at"]] = r["documents"]
        windows.order(counts)
        found.append(rows.mapInArrow(_matcher(windows, only_hits=k > 0), schema))
    result = found[0]
    if blocks > 1:
        more = found[1]
        for other in found[2:]:
            more = more.union(other)
        more = more.dropDuplicates(["row_key", "id", "hits", "items"]).groupBy("row_key").agg(
            F.flatten(F.collect_list("hits")).alias("more_hits"), F.flatten(F.collect_list("items")).alias("more_items")
        )
        hits = F.concat("hits", F.coalesce("more_hits", F.array().cast("array<struct<from: long, to: long>>")))
        items = F.concat("items", F.coalesce("more_items", F.array().cast("array<string>")))
        result = result.join(cut(more), "row_key", "left").select(
            "id", "row_key", "n_words", merged_spans(hits).alias("hits"), F.array_sort(F.array_distinct(items)).alias("items")
        )
    return result.withColumnRenamed("id", id_col)


def merged_spans(spans):
    """Sorted, disjoint ranges that cover the same places as `spans`."""
    none = F.array().cast("array<struct<from: long, to: long>>")

    def add(done, span):
        last = F.element_at(done, -1)
        longer = F.struct(last["from"].alias("from"), F.greatest(last["to"], span["to"]).alias("to"))
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))
        return F.when((F.size(done) > 0) & (span["from"] <= F.try_element_at(done, F.lit(-1))["to"]), joined).otherwise(
            F.concat(done, F.array(span))
        )

    return F.aggregate(F.array_sort(spans), none, add)


def digest(found: DataFrame) -> DataFrame:
    """The rows of `find_contamination` with n_hit, n_items, items_sha256 and contaminated."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` in which no benchmark window occurs."""
    found = digest(find_contamination(docs, benchmark, id_col, text_col, **options)).where("contaminated")
    keyed = docs.withColumn("__row_key", F.xxhash64(id_col, text_col))
    bad = cut(found.select(F.col("row_key").alias("__row_key")).distinct())
    return keyed.join(bad, "__row_key", "left_anti").select(*docs.columns)
