"""Near-duplicates by the Jaccard similarity of word shingles: SimHash fingerprints through the vantage-point
tree of `simhash`, each link checked by exact similarity, then an exact candidate search for the others.

The fingerprint of a set is that of its shingles' hashes. Sets whose fingerprints the tree joins are compared
with the smallest set of their group, and those that are similar are one component from then on. Fingerprints
of sets just above the least similarity differ in more bits than a tree can be asked for, so the links that
it cannot have are looked for among sets of different components.

Two sets of similarity `least` share a shingle among the first size - ceil(least * size) + 1 of each,
in any one order of all shingles (prefix filter). Here frequent shingles come last and the others go by
their hash. Which are frequent is counted within tasks only, in bounded lists: this decides how many
candidates there are, never which links are found.

These candidates are settled in two steps. First each set is compared with the smallest set that has one of
its prefix shingles, so groups of copies become one component at a cost that grows with their number,
not with its square. Then only shingles are left whose sets are in several components. These sets are
compared, those of similar size, in blocks; equal lists of sets are looked at once.

Before texts are fetched, sets are compared by their parities: a set's hashes dealt into as many bits as
it has shingles, each bit the parity of the hashes that fell on it. Two parities differ in no more bits
than the sets in shingles, so a pair whose parities differ in too many is none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, top
from corpusloom.llm.simhash import majority, merge_stars, through_tree
from corpusloom.llm.words import Codes, grouped, rolled

#: Shingles that a task holds before it looks for frequent ones among them.
HELD = 2_000_000
#: Shingles in a block of sets that are compared.
BLOCK_SHINGLES = 1_000_000


def shingles_of(text: bytes, words: int, codes: Codes) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order; a text with fewer words is one shingle."""
    found = codes.of(text.lower().split())
    return np.unique(rolled(found, min(words, len(found)))) if len(found) else found


def name_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def prefix_size(n: int, least: float) -> int:
    return n - math.ceil(least * n - 1e-9) + 1 if n else 0


def parity(shingles: np.ndarray) -> bytes:
    """The parities of the hashes' places; as many bits as shingles, up to a power of two, 64 at least."""
    bits = max(64, 1 << (max(len(shingles), 1) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(parities: list[bytes]) -> np.ndarray:
    """The parities, one a row, all brought to the length of the shortest."""
    size = min(map(len, parities)) // 8
    out = np.empty((len(parities), size), np.uint64)
    for k, p in enumerate(parities):
        row = np.frombuffer(p, np.uint64)
        while len(row) > size:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out[k] = row
    return out


def most_apart(n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """In how many shingles sets of these sizes can differ with a similarity of `least`."""
    return (n + m) * (1 - least) / (1 + least) + 1e-6


def _names(words: int):
    """A row (row_key, set, size, parity, fp) for each text, and rows (shingle, n) for what a task finds often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, size = Codes(), [], 0
        columns = ["row_key", "set", "size", "parity", "fp", "shingle", "n"]

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            values, counts = values[often], counts[often]
            none = [pa.nulls(len(values), kind) for kind in (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays([*none, pa.array(values.view(np.int64)), pa.array(counts)], columns)

        for batch in batches:
            for start, end, texts in grouped(batch):
                found = [shingles_of(t, words, codes) for t in texts]
                names = np.array([name_of(f) for f in found], np.uint64)
                sizes = np.array([len(f) for f in found], np.int32)
                none = [pa.nulls(len(found), pa.int64())] * 2
                own = [batch.column(0).slice(start, end - start), pa.array(names.view(np.int64)), pa.array(sizes)]
                prints = pa.array(np.array([majority(f) for f in found], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([*own, pa.array(map(parity, found), pa.binary()), prints, *none], columns)
                held += found
                size += int(sizes.sum())
                if size >= HELD:
                    yield frequent()
                    size = 0
        if held:
            yield frequent()

    return run


def _prefixes(words: int, least: float, shared):
    """Rows (shingle, set) for each set's prefix; sets that a task has again are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, codes, seen = shared.value, Codes(), set()
        for batch in batches:
            for _, _, texts in grouped(batch):
                tokens, owners = [], []
                for text in texts:
                    found = shingles_of(text, words, codes)
                    name = name_of(found)
                    if name in seen:
                        continue
                    if len(seen) > HELD:
                        seen.clear()
                    seen.add(name)
                    at = np.searchsorted(often, found)
                    late = np.zeros(len(found), bool)
                    inside = at < len(often)
                    late[inside] = often[at[inside]] == found[inside]
                    tokens.append(np.concatenate((found[~late], found[late]))[: prefix_size(len(found), least)])
                    owners.append(np.full(len(tokens[-1]), name, np.uint64))
                if tokens:
                    columns = [pa.array(np.concatenate(c).view(np.int64)) for c in (tokens, owners)]
                    yield pa.RecordBatch.from_arrays(columns, ["shingle", "set"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for start, end, texts in grouped(batch):
            packed = pa.array([packer.compress(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), packed], ["row_key", "packed"])


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _promising(least: float):
    """The pairs (a, b) whose parities differ in few bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(k).to_pylist() for k in range(2, 6))
            apart = np.array([int(np.bitwise_count(np.bitwise_xor(*folded([x, y]))).sum()) for x, y in zip(a, b, strict=True)])
            kept = apart <= most_apart(np.array(n), np.array(m), least)
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return run


def promising(parities: np.ndarray, sizes: np.ndarray, labels: np.ndarray, k: int, least: float) -> np.ndarray:
    """Which of the sets after set `k`, with another label, may be similar to it by size and parity."""
    own = slice(k + 1, None)
    may = (labels[own] != labels[k]) & (np.minimum(sizes[own], sizes[k]) >= least * np.maximum(sizes[own], sizes[k]) - 1e-9)
    if may.any():
        apart = np.bitwise_count(parities[own][may] ^ parities[k]).sum(axis=1)
        may[may] = apart <= most_apart(sizes[own][may], sizes[k], least)
    return may


def near(parities: np.ndarray, sizes: np.ndarray, labels: np.ndarray, least: float) -> np.ndarray:
    """Which sets have another one, with another label, that may be similar by size and parity."""
    found = np.zeros(len(sizes), bool)
    for k in range(len(sizes) - 1):
        may = promising(parities, sizes, labels, k, least)
        found[k + 1 :] |= may
        found[k] |= may.any()
    return found


def _compare(words: int, least: float):
    """The pairs (a, b) whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, unpacker, last = Codes(), zstandard.ZstdDecompressor(), (None, None)
        for batch in batches:
            kept = []
            for k in range(batch.num_rows):
                b = batch.column(1)[k].as_py()
                if last[0] != b:
                    last = b, shingles_of(unpacker.decompress(batch.column(3)[k].as_py()), words, codes)
                a = shingles_of(unpacker.decompress(batch.column(2)[k].as_py()), words, codes)
                kept.append(similar(a, last[1], least))
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return run


def linked(sets: list[np.ndarray], least: float, labels: np.ndarray) -> np.ndarray:
    """Labels of the sets, merged (to the smaller one) where sets have a similarity of `least` or more.
    Only sets of different labels and sizes and parities that allow it are compared."""
    sizes, parities = np.array([len(x) for x in sets]), folded([parity(x) for x in sets])
    for k in range(len(sets) - 1):
        for other in k + 1 + np.flatnonzero(promising(parities, sizes, labels, k, least)):
            if labels[other] != labels[k] and similar(sets[k], sets[other], least):
                low, high = sorted((labels[k], labels[other]))
                labels[labels == high] = low
    return labels


def bundle(block_of: list[str], rows: int, together: int = 10_000) -> Column:
    """A key that puts blocks together, whole, so that about so many rows are looked at in one call."""
    return F.pmod(F.xxhash64(*block_of), F.lit(rows // together + 1)).alias("bundle")


def runs_of(part: pd.DataFrame, keys: list[str]) -> list[np.ndarray]:
    """The places of the rows of each block in `part`."""
    columns = [part[k].to_numpy() for k in keys]
    order = np.lexsort((part["set"].to_numpy(), *columns))
    new = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns]) if len(part) else np.zeros(0, bool)
    return np.split(order, np.flatnonzero(new) + 1) if len(part) else []


def components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8,
    block: int = 1000, frequent: int = 500_000, max_bits: int = 2,
) -> DataFrame:
    """(row_key, component) of each row of `docs`: rows are linked if the sets of their shingles of
    `words` words have a Jaccard similarity of `least` or more; all linked rows share a component.

    A-Z is lower-cased; words are runs of anything but ASCII white space. Texts without words are
    equal. Equal sets are compared once, by a 64-bit hash. `frequent` bounds the list of frequent
    shingles that is broadcast, `block` the sets in a block; `max_bits` is how many bits linked
    fingerprints differ in at most, which decides by which way a link is found, never whether.
    """
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    found = cut(rows.mapInArrow(_names(words), "row_key long, set long, size int, parity binary, fp long, shingle long, n long"))
    named = found.where("shingle is null").select("row_key", "set")
    counts = found.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 3")
    often = np.sort(top(counts, "n", "shingle", frequent).column("shingle").to_numpy().view(np.uint64))

    # Which sets share a shingle of their prefixes.
    shared = spark.sparkContext.broadcast(often)
    prefixes = rows.select("text").mapInArrow(_prefixes(words, least, shared), "shingle long, set long")
    lows = prefixes.groupBy("shingle").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low < high")
    lists = prefixes.join(lows.select("shingle", "low"), "shingle").distinct()
    firsts = found.where("shingle is null").groupBy("set", "size").agg(F.min("row_key").alias("row_key"), F.first("parity").alias("parity"), F.first("fp").alias("fp"))
    firsts = cut(firsts)
    lists = cut(lists.join(firsts.select("set", "size"), "set"))

    wanted = lists.select("set").distinct().join(firsts.select("set", "row_key"), "set")
    packed = rows.mapInArrow(_pack, "row_key long, packed binary").join(wanted, "row_key")
    texts = cut(packed.groupBy("set").agg(F.first("packed").alias("packed")))

    def similar_pairs(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, low) of sets, many for a `low`, that are similar, as (a, b)."""
        one = firsts.select(F.col("set").alias("a"), F.col("size").alias("n"), F.col("parity").alias("parity_a"))
        other = firsts.select(F.col("set").alias("low"), F.col("size").alias("m"), F.col("parity").alias("parity_b"))
        pairs = pairs.join(one, "a").join(other, "low")
        pairs = pairs.where(F.least("n", "m") >= F.greatest("n", "m") * F.lit(least) - F.lit(1e-9))
        pairs = cut(pairs.select("a", "low", "parity_a", "parity_b", "n", "m").mapInArrow(_promising(least), "a long, low long"))
        # A set with many others is there once for each `block` of them.
        many = pairs.groupBy("low").agg(F.expr(f"cast(count(*) div {block} as int)").alias("more"))
        ends = texts.select(F.col("set").alias("b"), F.col("packed").alias("packed_b"))
        ends = ends.join(many, F.col("b") == F.col("low")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("more")))).drop("more", "low")
        pairs = pairs.join(many, "low").select("a", F.col("low").alias("b"), F.pmod(F.xxhash64("a"), F.col("more") + 1).cast("int").alias("turn"))
        starts = texts.select(F.col("set").alias("a"), F.col("packed").alias("packed_a"))
        compared = pairs.join(starts, "a").join(ends, ["b", "turn"]).select("a", "b", "packed_a", "packed_b")
        return compared.mapInArrow(_compare(words, least), "a long, b long")

    # Each set with the smallest of those that the tree joins to it; sets that share no shingle of their prefixes have no text here, and no link.
    trees = through_tree(firsts.select(F.col("set").alias("id"), "row_key", "fp"), max_bits)
    trees = trees.where("id <> component_id").select(F.col("id").alias("a"), F.col("component_id").alias("low"))
    close = cut(similar_pairs(trees))

    # Each set with the smallest of its lists, where the tree has not made them one.
    root = close.select("a", F.col("b").alias("root"))
    pairs = lists.where("set <> low").select(F.col("set").alias("a"), "low").distinct().join(root, "a", "left")
    pairs = pairs.join(close.select(F.col("a").alias("low"), F.col("b").alias("low_root")), "low", "left")
    pairs = pairs.where(F.coalesce("root", "a") != F.coalesce("low_root", "low")).select("a", "low")
    stars = merge_stars(close.union(similar_pairs(pairs)))

    # What is left: lists, by classes of size, with sets of several components.
    labelled = lists.join(stars.withColumnRenamed("a", "set"), "set", "left").withColumn("label", F.coalesce("root", "set"))
    grade = F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log(least)) + F.lit(1e-9)).cast("int")
    labelled = labelled.withColumn("grade", F.explode(F.array(grade, grade + 1)))
    several = labelled.groupBy("shingle", "grade").agg(
        F.count("*").alias("n"),
        F.sum("size").alias("words"),
        F.bit_xor(F.xxhash64("set")).alias("sign"),
        F.min("set").alias("low"),
        F.min("label").alias("least"),
        F.max("label").alias("most"),
    )
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("words") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    several = cut(several.where("least < most").dropDuplicates(["n", "sign", "low"]).select("shingle", "grade", "n", blocks))
    placed = labelled.select("shingle", "grade", "set", "label").join(several, ["shingle", "grade"])
    placed = placed.withColumn("k", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("shingle", "grade", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"), "set", "label")
    block_of = ["shingle", "grade", "i", "j"]

    def sift(part: pd.DataFrame) -> pd.DataFrame:
        """The sets of some blocks that may have a similar one in their block."""
        kept = []
        parities, sizes, labels = part["parity"].to_numpy(), part["size"].to_numpy(np.int64), part["label"].to_numpy()
        for own in runs_of(part, block_of):
            if (labels[own] != labels[own[0]]).any():
                kept.append(own[near(folded(list(parities[own])), sizes[own], labels[own], least)])
        return part.iloc[np.concatenate(kept) if kept else []][[*block_of, "set", "label", "size"]]

    rows_left = several.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    placed = placed.join(firsts.select("set", "size", "parity"), "set").groupBy(bundle(block_of, rows_left))
    placed = cut(placed.applyInPandas(sift, "shingle long, grade int, i int, j int, set long, label long, size int"))

    def search(part: pd.DataFrame) -> pd.DataFrame:
        """The labels of some blocks' sets that are one component, as stars."""
        codes, unpacker, pairs = Codes(), zstandard.ZstdDecompressor(), []
        packed, labels = part["packed"].to_numpy(), part["label"].to_numpy()
        for own in runs_of(part, block_of):
            names, own_labels = np.unique(labels[own], return_inverse=True)
            merged = linked([shingles_of(unpacker.decompress(p), words, codes) for p in packed[own]], least, own_labels.copy())
            moved = merged != own_labels
            pairs.append(np.unique(np.stack((names[own_labels[moved]], names[merged[moved]])), axis=1))
        a, b = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        return pd.DataFrame({"a": a, "b": b})

    left = placed.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    more = placed.join(texts, "set").groupBy(bundle(block_of, max(left["n"], left["words"] // 300)))
    more = more.applyInPandas(search, "a long, b long")
    roots = merge_stars(stars.select("a", F.col("root").alias("b")).union(more))
    return named.join(roots.withColumnRenamed("a", "set"), "set", "left").select("row_key", F.coalesce("root", "set").alias("component"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component of `docs`: the one with the smallest id (null last; rows with equal
    ids: the smallest hash of id and text). Of fully equal rows, one stays. Columns are those of `docs`."""
    found = cut(components(docs, id_col, text_col, **options).distinct())
    keyed = docs.withColumn("__row_key", F.xxhash64(id_col, text_col))
    ids = keyed.select(F.col(id_col).alias("id"), F.col("__row_key").alias("row_key"))
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "row_key")
    first = ids.join(found, "row_key").groupBy("component").agg(F.min(rank).alias("first")).select(F.col("first.row_key").alias("__row_key"))
    return keyed.join(cut(first), "__row_key").dropDuplicates(["__row_key"]).select(*docs.columns)
