"""Word codes and rolling hashes in numpy, for tasks that read whole texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are worked on in groups of about so many bytes (one longer text is a group of its own).
GROUP_BYTES = 1 << 20
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_FINAL = np.uint64(0xD6E8FEB86659FD93)


class Codes(dict):
    """64-bit codes of words, remembered up to a bound."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of pairs; not linear, so that no arrangement of words cancels out."""
    mixed = left * _MULTIPLY + (right ^ (right >> np.uint64(31))) * _SECOND
    mixed ^= mixed >> np.uint64(32)
    mixed *= _FINAL
    mixed ^= mixed >> np.uint64(29)
    return mixed


def rolled(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of `n` codes, by doubling."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    result, done, power, length = None, 0, codes, 1
    while True:
        if n & length:
            if result is None:
                result, done = power, length
            else:
                k = len(codes) - done - length + 1
                result, done = combine(result[:k], power[done : done + k]), done + length
        if done == n:
            return result
        power = combine(power[:-length], power[length:])
        length *= 2


def binary(column: pa.Array) -> list:
    """The column's texts as UTF-8 bytes, null as None."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def grouped(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of rows (from, to, texts) of about GROUP_BYTES; null texts are empty."""
    texts = batch.column(batch.schema.get_field_index(text))
    start, size, run = 0, 0, []
    for k in range(batch.num_rows):
        value = texts[k].as_py()
        value = b"" if value is None else value.encode() if isinstance(value, str) else value
        if run and size + len(value) > GROUP_BYTES:
            yield start, k, run
            start, size, run = k, 0, []
        run.append(value)
        size += len(value)
    if run:
        yield start, batch.num_rows, run
