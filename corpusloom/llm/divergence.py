"""How far the sources of a language diverge from each other and from the language as a whole, by their terms.

Each block of documents counts its terms by language and source and deals the counts to buckets, blocks of
terms. A bucket's task adds the counts of all blocks, keeps the terms that enough documents of the language
have, and writes them down as tiles. With the totals of all tiles, each tile is spread out to a dense int64
matrix, sources by terms, of exact shares; all pairs of its rows are compared by broadcasting, in pieces of
bounded size. Partial pair matrices are summed, and each group's heap of highest terms is merged.

A share is p = 1 + floor(SCALE * (count + 1) / (N + V)), N the group's occurrences of kept terms, V their number;
the divergence of p from q is the sum of floor((p - q)^2 / q), all in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.blocks import batch_of, bounds_of, buckets_of, gather, meet, pack_all, totals_by, unpack_all
from corpusloom.llm.common import cut

SCALE = 1_000_000_000
#: Numbers in a piece of the broadcast comparison, terms in a tile.
PIECE = 1 << 20
TILE_TERMS = 1 << 16
#: What the bytes of a text are to terms: letters as they are or lower-cased, all else ASCII a gap.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTS = "bucket int, lang string, sources array<string>, terms binary, counts binary"
TILE = "bucket int, lang string, sources array<string>, n_terms long, totals array<long>, terms binary, counts binary"
FOUND = "lang string, source string, part string, item string, value long"


def terms_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts, and the number of the text that each is in."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw).translate(LETTERS), np.uint8)
    kept = data != 32
    starts = np.flatnonzero(kept & ~np.concatenate([[False], kept[:-1]])[: len(kept)])
    ends = np.cumsum([len(r) + 1 for r in raw])
    offsets = np.concatenate([(np.cumsum(kept) - kept)[starts], [kept.sum()]]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept].tobytes())])
    return terms, np.searchsorted(ends, starts, side="right")


def pack_terms(terms: list[bytes]) -> bytes:
    return zstandard.compress(b" ".join(terms), 1)


def unpack_terms(data: bytes, n: int) -> list[bytes]:
    return zstandard.decompress(data).split(b" ") if n else []


def count_block(groups: list[tuple[str, str]], texts: list[str], buckets: int) -> Iterator[tuple]:
    """Rows of COUNTS of a block: for each language and bucket its terms, in how many documents of the block each is,
    and its occurrences in each of the block's sources."""
    terms, doc = terms_of(texts)
    if not len(terms):
        return
    coded = terms.dictionary_encode()
    words, k = coded.dictionary.to_pylist(), len(coded.dictionary)
    found, times = totals_by(doc * k + coded.indices.to_numpy().astype(np.int64), np.ones(len(terms), np.int64))
    doc, term = np.divmod(found, k)
    bucket = (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, k) % np.uint64(buckets)).astype(np.int64)
    for lang in sorted({g[0] for g in groups}):
        sources = sorted({s for x, s in groups if x == lang})
        number = {s: j for j, s in enumerate(sources)}
        of_doc = np.array([number[s] if x == lang else -1 for x, s in groups])
        mine = of_doc[doc] >= 0
        at, n = totals_by(term[mine] * len(sources) + of_doc[doc[mine]], times[mine])
        there, n_docs = totals_by(term[mine], np.ones(mine.sum(), np.int64))
        order = np.argsort(bucket[there], kind="stable")
        there, n_docs = there[order], n_docs[order]
        place = np.zeros(k, np.int64)
        place[there] = np.arange(len(there))
        row, source = place[at // len(sources)], at % len(sources)
        order = np.argsort(row, kind="stable")
        row, source, n = row[order], source[order], n[order]
        bounds = bounds_of(bucket[there], buckets)
        cells = np.searchsorted(row, bounds)
        for b in np.flatnonzero(np.diff(bounds)):
            low, high, left, right = bounds[b], bounds[b + 1], cells[b], cells[b + 1]
            counts = pack_all(n_docs[low:high], np.diff(row[left:right], prepend=low), source[left:right], n[left:right])
            yield int(b), lang, sources, pack_terms([words[t] for t in there[low:high]]), counts


class Tally:
    """The terms of one language in one bucket, added up block by block."""

    def __init__(self):
        self.terms, self.sources, self.docs, self.cells, self.waiting = {}, {}, np.zeros(0, np.int64), [], 0

    def add(self, sources: list[str], terms: bytes, counts: bytes) -> None:
        n_docs, step, source, n = unpack_all(counts)
        ids = np.fromiter((self.terms.setdefault(t, len(self.terms)) for t in unpack_terms(terms, len(n_docs))), np.int64, len(n_docs))
        here = np.array([self.sources.setdefault(s, len(self.sources)) for s in sources], np.int64)
        if len(self.terms) > len(self.docs):
            self.docs = np.concatenate([self.docs, np.zeros(max(len(self.terms), 2 * len(self.docs)) - len(self.docs), np.int64)])
        self.docs[ids] += n_docs
        self.cells.append((ids[np.cumsum(step)] << 32 | here[source], n))
        self.waiting += len(n)
        if self.waiting > 4_000_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = totals_by(*(np.concatenate(x) for x in zip(*self.cells, strict=True)))
        self.cells, self.waiting = [(keys, n)], 0
        return keys, n

    def tiles(self, bucket: int, lang: str, least_docs: int) -> Iterator[tuple]:
        keys, n = self.merge()
        kept = self.docs[: len(self.terms)] >= least_docs
        names = list(self.terms)
        order = sorted(np.flatnonzero(kept).tolist(), key=names.__getitem__)
        place = np.full(len(names), -1, np.int64)
        place[order] = np.arange(len(order))
        term, source = place[keys >> 32], keys & 0xFFFFFFFF
        inside = term >= 0
        term, source, n = term[inside], source[inside], n[inside]
        by_term = np.argsort(term, kind="stable")
        term, source, n = term[by_term], source[by_term], n[by_term]
        for low in range(0, len(order), TILE_TERMS):
            some = order[low : low + TILE_TERMS]
            left, right = np.searchsorted(term, [low, low + len(some)])
            totals = np.zeros(len(self.sources), np.int64)
            np.add.at(totals, source[left:right], n[left:right])
            counts = pack_all(np.diff(term[left:right], prepend=low), source[left:right], n[left:right])
            yield bucket, lang, list(self.sources), len(some), totals.tolist(), pack_terms([names[t] for t in some]), counts


def shares(counts: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / (n + v)), exact: by two divisions, so that no product leaves 64 bits; with
    Python's numbers where totals are too large for that."""
    whole = n + v
    if whole.max(initial=0) < (1 << 63) // 32_000:
        first, rest = np.divmod((counts + 1) * 31_250, whole)
        return 1 + first * 32_000 + rest * 32_000 // whole
    return (1 + (counts + 1).astype(object) * SCALE // whole.astype(object)).astype(np.int64)


def pair_sums(p: np.ndarray) -> np.ndarray:
    """For each row i and row j of shares, the sum of floor((p_i - p_j)^2 / p_j) over the columns."""
    g, t = p.shape
    found = np.zeros((g, g), np.int64)
    wide = max(1, min(t, PIECE // max(g, 1)))
    tall = max(1, PIECE // (wide * max(g, 1)))
    for left in range(0, t, wide):
        some = p[:, left : left + wide]
        for top in range(0, g, tall):
            away = some[top : top + tall, None, :] - some[None, :, :]
            away *= away
            away //= some[None, :, :]
            found[top : top + tall] += away.sum(axis=2)
    return found


def divergences(docs: DataFrame, least_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", buckets: int | None = None) -> DataFrame:
    """Columns of the result: lang, source, part, item, value, rank. Part `pair`: the divergence of the source from
    each other source (`item`) of its language; part `term`: the `top` terms whose share in the source is above their
    share in the language, by divergence. Ranks from 1, by falling value, then by item in UTF-8 order.

    Null texts, languages and sources are empty strings. Terms are runs of letters: a to z, A to Z lower-cased, and
    all characters beyond ASCII. A language keeps the terms that `least_docs` of its documents have; without any, its
    pairs are 0. A language of one source has no pairs. Repeated rows count as often as they come; an empty table
    gives an empty result; other columns of any name are left out.
    """
    buckets = buckets or buckets_of(docs.sparkSession)
    named = docs.select(*(F.coalesce(docs[c], F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts_schema = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("sources", pa.list_(pa.string())), ("terms", pa.binary()), ("counts", pa.binary())])
    tile_schema = pa.schema([*list(counts_schema)[:3], ("n_terms", pa.int64()), ("totals", pa.list_(pa.int64())), *list(counts_schema)[3:]])
    found_schema = pa.schema([(n, pa.int64() if n == "value" else pa.string()) for n in ("lang", "source", "part", "item", "value")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, groups, texts in gather(batches):
            pairs = list(zip(groups.column(0).to_pylist(), groups.column(1).to_pylist(), strict=True))
            yield batch_of(list(count_block(pairs, texts, buckets)), counts_schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, tallies = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            for lang in sorted(tallies):
                for tile in tallies[lang].tiles(bucket, lang, least_docs):
                    yield batch_of([tile], tile_schema)
            tallies.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    yield from done()
                    bucket = row["bucket"]
                tallies.setdefault(row["lang"], Tally()).add(row["sources"], row["terms"], row["counts"])
        yield from done()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, heaps = {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                lang, groups = row["lang"], [(x["source"], x["n"]) for x in row["groups"]]
                number, g, t = {s: j for j, (s, _) in enumerate(groups)}, len(groups), row["n_terms"]
                before = pairs.setdefault(lang, ([s for s, _ in groups], np.zeros((g, g), np.int64)))
                if not t:
                    continue
                terms, (step, source, n) = unpack_terms(row["terms"], t), unpack_all(row["counts"])
                matrix = np.zeros((g, t), np.int64)
                matrix[np.array([number[s] for s in row["sources"]], np.int64)[source], np.cumsum(step)] = n
                totals = np.array([x for _, x in groups], np.int64)
                p = shares(matrix, totals[:, None], row["v"])
                before[1][:] += pair_sums(p)
                q = shares(matrix.sum(axis=0)[None, :], totals.sum(keepdims=True)[:, None], row["v"])[0]
                for j, (s, _) in enumerate(groups):
                    higher = np.flatnonzero((matrix[j] > 0) & (p[j] > q))
                    value = (p[j, higher] - q[higher]) ** 2 // q[higher]
                    best = np.argsort(-value, kind="stable")[:top]
                    heap = heaps.get((lang, s), []) + [(-int(value[x]), terms[higher[x]]) for x in best]
                    heaps[lang, s] = sorted(heap)[:top]
        rows = []
        for lang, (sources, matrix) in pairs.items():
            for i, s in enumerate(sources):
                rows += [(lang, s, "pair", o, int(matrix[i, j])) for j, o in enumerate(sources) if j != i]
                rows += [(lang, s, "term", term.decode(), -value) for value, term in heaps.get((lang, s), [])]
                if len(rows) > 50_000:
                    yield batch_of(rows, found_schema)
                    rows = []
        yield batch_of(rows, found_schema)

    tiles = cut(meet(named.mapInArrow(count, COUNTS), buckets).mapInArrow(add, TILE))
    seen = tiles.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).select("lang", "x.sources", "x.totals")
    none = named.select("lang", F.col("source").alias("sources"), F.lit(0).cast("long").alias("totals")).distinct()
    groups = seen.unionByName(none).groupBy("lang", F.col("sources").alias("source")).agg(F.sum("totals").alias("n"))
    by_lang = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups"))
    sizes = tiles.groupBy("lang").agg(F.sum("n_terms").alias("v"))
    # The totals of a language go to each bucket, so that no language's tiles meet in one task; bucket -1 is the
    # language without terms, for groups that have none.
    spread = by_lang.join(sizes, "lang", "left").select("*", F.explode(F.sequence(F.lit(-1), F.lit(buckets - 1))).alias("bucket"))
    empty = by_lang.select(F.lit(-1).alias("bucket"), "lang", *(F.lit(None).cast(t).alias(c) for c, t in (("sources", "array<string>"), ("terms", "binary"), ("counts", "binary"))), F.lit(0).cast("long").alias("n_terms"))
    joined = tiles.drop("totals").unionByName(empty).join(spread, ["lang", "bucket"])
    partial = joined.mapInArrow(compare, FOUND)
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = partial.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    highest = partial.where("part = 'term'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(w)).unionByName(highest)
