"""Blocks of whole documents that ask for values of keys they hold, and get them back by position.

A task gathers its documents into blocks of some megabytes of text. A block knows its distinct keys
(words, pairs of ids) and lays them out by bucket, a hash of the key: its requests are one row for each
bucket, with the keys in order. A bucket's rows of all blocks meet in one task, which answers each row with
a value for each of its keys, in the same order. Answers go back to their block, so no key or value
carries a name of its own through a shuffle, a frequent key comes once from each block however often it
occurs, and what moves is compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

#: Text bytes of a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20

REQUEST = "bucket int, block string, keys binary"
ANSWER = "block string, bucket int, found binary"


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes, so that high bytes that are alike lie together."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def pack_rows(rows: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write(rows)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def unpack_rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()


def with_text_last(docs: DataFrame, text_col: str, keep: Sequence[str]) -> DataFrame:
    """The columns `keep`, then the text under a name of its own."""
    name = "text"
    while name in keep:
        name += "_"
    return docs.select(*(docs[c] for c in keep), docs[text_col].alias(name))


def schema_of(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def buckets_of(spark: SparkSession) -> int:
    """As many buckets as the session has shuffle partitions: a cluster sets these by its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gather(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[tuple[str, pa.Table, list[str]]]:
    """Blocks of a task's documents: a name (the task's partition and a running number), all columns but the
    last, and the last one's texts, null as empty."""
    held, texts, size, n = [], [], 0, 0
    where = TaskContext.get().partitionId()
    for batch in batches:
        rest, values = batch.select(range(batch.num_columns - 1)), batch.column(batch.num_columns - 1)
        ends = np.cumsum(pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = int(np.searchsorted(ends, before + most - size, side="right"))
            if end > start or not texts:
                end = max(end, start + 1)
                held.append(rest.slice(start, end - start))
                texts += [t or "" for t in values.slice(start, end - start).to_pylist()]
                size += int(ends[end - 1] - before)
                start = end
            if start < batch.num_rows:
                yield f"{where}.{n}", pa.Table.from_batches(held), texts
                held, texts, size, n = [], [], 0, n + 1
    if texts:
        yield f"{where}.{n}", pa.Table.from_batches(held), texts


def bounds_of(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts in an ascending list of buckets, and the end."""
    return np.searchsorted(bucket, np.arange(buckets + 1))


def meet(requests: DataFrame, buckets: int, kind: str | None = None) -> DataFrame:
    """Each bucket's rows in one task, in order of bucket (and of `kind` within it)."""
    dealt = requests.repartitionById(buckets, requests["bucket"])
    return dealt.sortWithinPartitions("bucket", *([kind] if kind else []))


def bring_back(blocks: DataFrame, answers: DataFrame, settle: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`settle(rows of the block, its answers in order of bucket)` for each block, as rows of `schema`."""

    def settled(block: pa.Table, found: pa.Table) -> pa.Table:
        return settle(block, found.sort_by("bucket"))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(settled, schema)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, ... (lengths[k] of them) for each k, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of `values`."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def totals_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first)


def pack_all(*columns: np.ndarray) -> bytes:
    """Several columns of longs, one after the other."""
    parts = [pack(c.astype(np.int64)) for c in columns]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unpack_all(data: bytes) -> list[np.ndarray]:
    found, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        found.append(unpack(data[at + 8 : at + 8 + size], np.int64))
        at += 8 + size
    return found


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
