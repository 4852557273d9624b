"""SimHash near-duplicates through a vantage-point tree.

A tree over Hamming space deals the distinct fingerprints into shards. Each node has a vantage
point and a radius; what lies within the radius goes left, the rest goes right. By the triangle
inequality a point on the right can only have a partner on the left if it lies within radius +
`max_bits` of the vantage point, so the points of that boundary go to the left shard as well, and
no other branch has to be looked at. Every pair within `max_bits` so meets in a shard, where the
same splitting goes on in numpy down to small blocks that are compared in full. A shard returns a
spanning star for each of its groups, never its pairs; the stars of all shards are merged into
components by alternating star contractions on DataFrames.

The tree is grown from a bounded sample of the distinct fingerprints (`sample_size`); it only
decides where points meet. All fingerprints are dealt out and compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bounded, cut
from corpusloom.llm.words import grouped

SEED = 42
BLOCK = 512


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; without words, zero."""
    words = text.lower().split()
    if not words:
        return 0
    n = shingle_words
    shingles = zip(*[words[k:] for k in range(n)], strict=False) if len(words) >= n else [words]
    return majority(np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; without hashes, zero."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text, shingle_words) for _, _, texts in grouped(batch) for text in texts]
            prints = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints], ["id", "row_key", "fp"])

    return run


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int64)


def choose_split(points: np.ndarray, max_bits: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and radius with few points in the boundary, or None if none helps."""
    sample = points if len(points) <= 4000 else rng.choice(points, 4000, replace=False)
    best = None
    for vantage in rng.choice(sample, min(6, len(sample)), replace=False):
        share = np.cumsum(np.bincount(distances(sample, vantage), minlength=65 + max_bits)) / len(sample)
        inside, band = share[:65], share[max_bits : 65 + max_bits] - share[:65]
        least = np.minimum(inside, 1 - inside)
        cost = np.where((least >= 0.1) & (inside + band <= 0.9), (band + 0.02) / np.maximum(least, 1e-9), np.inf)
        radius = int(np.argmin(cost))
        if np.isfinite(cost[radius]) and (best is None or cost[radius] < best[0]):
            best = (cost[radius], vantage, radius)
    return best and best[1:]


def grow_tree(sample: np.ndarray, depth: int, max_bits: int, seed: int = 7) -> list[tuple]:
    """Nodes (vantage, radius, left, right); a child below zero is the leaf -child - 1."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple] = []
    leaves = 0

    def grow(points: np.ndarray, level: int) -> int:
        nonlocal leaves
        split = choose_split(points, max_bits, rng) if level < depth and len(points) >= 32 else None
        if split is None:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append(())
        d = distances(points, split[0])
        nodes[at] = (*split, grow(points[d <= split[1]], level + 1), grow(points[d > split[1]], level + 1))
        return at

    grow(sample, 0)
    return nodes


def deal(points: np.ndarray, nodes: list[tuple], max_bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, points) for each leaf that points reach, boundary points in both of a node's children."""
    stack = [(0 if nodes else -1, points)]
    while stack:
        at, some = stack.pop()
        if not len(some):
            continue
        if at < 0:
            yield -at - 1, some
            continue
        vantage, radius, left, right = nodes[at]
        d = distances(some, vantage)
        stack += [(left, some[d <= radius + max_bits]), (right, some[d > radius])]


def _hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the labels of linked points; a label is the smallest place in its group."""
    while True:
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            return labels
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def local_stars(points: np.ndarray, max_bits: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(point, centre) for all points that are linked, within these distinct points, to a smaller one."""
    points = np.sort(points)
    labels = np.arange(len(points))
    rng = np.random.default_rng(seed)
    stack = [np.arange(len(points))]
    while stack:
        some = stack.pop()
        split = choose_split(points[some], max_bits, rng) if len(some) > BLOCK else None
        if split is not None:
            d = distances(points[some], split[0])
            stack += [some[d <= split[1] + max_bits], some[d > split[1]]]
            continue
        for i in range(0, len(some), BLOCK):
            for j in range(i, len(some), BLOCK):
                x, y = some[i : i + BLOCK], some[j : j + BLOCK]
                a, b = np.nonzero(np.bitwise_count(points[x][:, None] ^ points[y][None, :]) <= max_bits)
                labels = _hook(labels, x[a], y[b])
    moved = labels != np.arange(len(points))
    return points[moved], points[labels[moved]]


def merge_stars(edges: DataFrame) -> DataFrame:
    """Components of the undirected edges (a, b): rows (a, root), for every node but the roots, with
    the smallest node of the component as root. Alternates large-star and small-star contractions,
    each an aggregation and a join, until nothing changes; the edges never leave the executors.
    """
    edges = cut(edges.where("a <> b").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b"))))
        )
        edges = cut(small.select("col.*").where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.withColumnRenamed("b", "root")
        state = now


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    max_bits: int = 2,
    shard_size: int = 20_000,
    sample_size: int = 100_000,
) -> DataFrame:
    """Fingerprints and near-duplicate components of `docs`.

    A-Z is lower-cased; words are runs of anything but ASCII white space; a text with fewer words
    than a shingle is one shingle, and one without words (null, empty, blank) has fingerprint zero,
    which links like any other. Documents are linked if their fingerprints differ in `max_bits`
    bits at most. Returns a row for each input row: id_col, row_key (hash of id and text), fp (long),
    component (a long that names it) and component_id: the smallest id in the component, nulls left
    out (null if it has no other). Equal fingerprints are compared once. An empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    prints = cut(rows.mapInArrow(_fingerprints(shingle_words), f"id {kind}, row_key long, fp long"))
    return through_tree(prints, max_bits, shard_size, sample_size).withColumnRenamed("id", id_col)


def through_tree(prints: DataFrame, max_bits: int = 2, shard_size: int = 20_000, sample_size: int = 100_000) -> DataFrame:
    """The rows `prints` (id, row_key, fp) with the component of each fingerprint and the smallest id in it."""
    classes = cut(prints.groupBy("fp").agg(F.min("id").alias("low")))

    n = classes.count()
    turned = classes.select("fp", F.xxhash64("fp", F.lit("sample")).alias("turn"))
    sample = np.sort(bounded(turned, "turn", sample_size).toPandas()["fp"].to_numpy(np.int64).view(np.uint64))
    nodes = grow_tree(sample, max(0, math.ceil(math.log2(max(n, 1) / shard_size))), max_bits)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leaf, some in deal(batch.column(0).to_numpy().view(np.uint64), nodes, max_bits):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), leaf, np.int32)), pa.array(some.view(np.int64))], ["shard", "fp"]
                )

    def search(part: pd.DataFrame) -> pd.DataFrame:
        points, centres = local_stars(part["fp"].to_numpy(np.int64).view(np.uint64), max_bits)
        return pd.DataFrame({"a": points.view(np.int64), "b": centres.view(np.int64)})

    shards = classes.select("fp").mapInArrow(route, "shard int, fp long")
    stars = merge_stars(shards.groupBy("shard").applyInPandas(search, "a long, b long"))

    members = classes.join(stars.withColumnRenamed("a", "fp"), "fp", "left")
    members = members.withColumn("component", F.coalesce("root", "fp"))
    lows = members.groupBy("component").agg(F.min("low").alias("component_id"))
    named = cut(members.join(lows, "component").select("fp", "component", "component_id"))
    return prints.join(named, "fp").select("id", "row_key", "fp", "component", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each near-duplicate group of `docs`: the one with the smallest id (null last;
    rows with equal ids: the smallest hash of id and text). Of fully equal rows, one stays. Columns
    are those of `docs`."""
    found = near_duplicates(docs, id_col, text_col, **options)
    rank = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.col("row_key"))
    first = found.groupBy("component").agg(F.min(rank).alias("first")).select(F.col("first.row_key").alias("__row_key"))
    keyed = docs.withColumn("__row_key", F.xxhash64(id_col, text_col))
    return keyed.join(cut(first), "__row_key").dropDuplicates(["__row_key"]).select(*docs.columns)
