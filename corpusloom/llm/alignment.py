"""Alignment of two tokenizers' tokens over the bytes of a text, with corpus counts of linked id pairs.

Each byte has an owner among the tokens of A and one among those of B: token numbers repeated over their bytes.
Where the pair of owners changes, the next overlap begins; where both change at once, both tokenizers cut, and
the bytes between two cuts are a group. Tokens of one group are linked, all of A's with all of B's.

Both tokenizers work on stretches of text that begin with white space independently of what surrounds them
(`cut_bytes` takes from the vocabulary where this holds), so a block of documents encodes and aligns each
distinct stretch once, many in one call. Id pairs are counted by documents: a block asks, with the number of
its documents that hold each pair, the buckets of the pairs' A ids (see `blocks`). A bucket adds the numbers of all
blocks, knows with them the highest count of each of its A ids, and answers each block.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import (
    ANSWER, batch_of, bounds_of, bring_back, buckets_of, gather, meet, pack, pack_all, pack_rows, ragged, schema_of, sums, totals_by,
    unpack, unpack_all, unpack_rows, with_text_last,
)
from corpusloom.llm.common import cut
from corpusloom.llm.word_bpe import byte_letters

#: Bytes of stretches that are encoded in one call, links of a group that are written out one by one.
CALL_BYTES = 1 << 16
PLAIN_LINKS = 1 << 14
#: Stands before what is encoded, so that B's own space falls on it.
GUARD = b" ."
#: Characters that either tokenizer may take as white space.
SPACES = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e" + "".join(map(chr, range(0x2000, 0x200E))) + "\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
SPACE_BYTES = [c.encode() for c in SPACES]
TABLE = "block string, rest binary, counts binary, numbers binary, stretches binary, pairs array<struct<bucket:int,codes:binary,docs:binary>>"


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the bytes at which texts may be cut."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters, vocabulary = byte_letters(), self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, k in vocabulary.items():
            self.a_bytes[k] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else b""
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.cut_bytes = cut_bytes(x.decode() for k, x in enumerate(self.b_bytes) if not self.b.is_byte(k))

    def encode(self, data: bytes) -> tuple[list[int], list[int]]:
        """Ids of A and B of some text that begins with a space."""
        text = data.decode()
        return self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])


@functools.lru_cache(maxsize=2)
def tokenizers_of(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def cut_bytes(pieces: Iterator[str]) -> np.ndarray:
    """For each byte, whether a text may be cut before it where no white space precedes: ASCII white space that
    follows something else in no piece, so that no merge goes across. (A's splitter always cuts there.)"""
    pieces = list(pieces)
    free = np.zeros(256, bool)
    for c in "\t\n\x0b\x0c\r ":
        free[ord(c)] = not any(p[k] == c and p[k - 1] not in SPACES for p in pieces if c in p for k in range(1, len(p)))
    return free


def stretches_of(texts: Sequence[str], free: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The stretches of texts, a space put before each, and how many each text has; an empty text has none."""
    raw = [b" " + t.encode() if t else b"" for t in texts]
    data = np.frombuffer(joined := b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    first = free[data]
    space = np.zeros(256, bool)
    space[[ord(c) for c in SPACES if ord(c) < 0x80]] = True
    first[1:] &= ~space[data[:-1]]
    after = np.flatnonzero(first)
    after = after[(after > 0) & (data[np.maximum(after - 1, 0)] >= 0x80)]
    if len(after):
        last = [data[np.maximum(after - k, 0)] for k in (1, 2, 3)]
        for s in SPACE_BYTES:
            if len(s) > 1:
                first[after[np.logical_and.reduce([last[k] == s[-1 - k] for k in range(len(s))])]] = False
    starts = np.concatenate([[0], ends[:-1]])[np.diff(ends, prepend=0) > 0] if len(raw) else ends
    first[starts] = True
    at = np.flatnonzero(first)
    offsets = np.append(at, len(data)).astype(np.int32)
    stretches = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
    return stretches, np.diff(np.searchsorted(at, np.concatenate([[0], ends])))


def encode_stretches(stretches: list[bytes], tokenizers: Tokenizers) -> tuple[np.ndarray, ...]:
    """Of distinct stretches: the ids of A and how many each has, those of B, and whether each has tokens at all (its
    bytes are those of both tokenizers' tokens)."""
    n = len(stretches)
    a_of, b_of, valid = [()] * n, [()] * n, np.ones(n, bool)

    def told(which: list[int]) -> bool:
        """Encode some stretches in one call; False where bytes or ends do not fit."""
        data = GUARD + b"".join(stretches[k] for k in which)
        ends = np.cumsum([len(GUARD), *(len(stretches[k]) for k in which)])
        found = []
        for ids, pieces, lengths in zip(tokenizers.encode(data), (tokenizers.a_bytes, tokenizers.b_bytes), (tokenizers.a_lengths, tokenizers.b_lengths), strict=True):
            if b"".join(map(pieces.__getitem__, ids)) != data:
                return False
            reached = np.cumsum(lengths[ids])
            places = np.searchsorted(reached, ends)
            if not np.array_equal(reached[places], ends):
                return False
            found.append((ids, (places + 1).tolist()))
        for (ids, places), out in zip(found, (a_of, b_of), strict=True):
            for k, low, high in zip(which, places, places[1:], strict=False):
                out[k] = ids[low:high]
        return True

    alone, run, size = [], [], 0
    for k, s in enumerate(stretches):
        if s.endswith(tuple(SPACE_BYTES)):
            alone.append(k)
            continue
        if run and size + len(s) > CALL_BYTES:
            alone += [] if told(run) else run
            run, size = [], 0
        run.append(k)
        size += len(s)
    if run and not told(run):
        alone += run
    for k in alone:
        valid[k] = told([k])
    flat = []
    for out in (a_of, b_of):
        flat += [np.fromiter((i for x in out for i in x), np.int64), np.fromiter(map(len, out), np.int64, n)]
    return *flat, valid


class Aligned:
    """Stretches aligned by byte owners. Tokens, groups and links are numbered through all stretches."""

    def __init__(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, tokenizers: Tokenizers):
        self.a, self.n_a, self.b, self.n_b = a, n_a, b, n_b
        a_size, b_size = tokenizers.a_lengths[a], tokenizers.b_lengths[b]
        a_owner, b_owner = np.repeat(np.arange(len(a)), a_size), np.repeat(np.arange(len(b)), b_size)
        a_new, b_new = a_owner[1:] != a_owner[:-1], b_owner[1:] != b_owner[:-1]
        group = np.concatenate([[0], np.cumsum(a_new & b_new)]) if len(a) else np.zeros(0, np.int64)
        overlap = np.concatenate([[0], np.cumsum(a_new | b_new)]) if len(a) else np.zeros(0, np.int64)
        self.a_group, self.b_group = group[np.cumsum(a_size) - a_size], group[np.cumsum(b_size) - b_size]
        self.groups = int(group[-1]) + 1 if len(a) else 0
        self.a_in, self.b_in = np.bincount(self.a_group, minlength=self.groups), np.bincount(self.b_group, minlength=self.groups)
        a_last = np.cumsum(n_a)
        has = n_a > 0
        self.n_groups, self.n_overlaps = np.zeros(len(n_a), np.int64), np.zeros(len(n_a), np.int64)
        self.n_groups[has] = np.diff(self.a_group[a_last[has] - 1], prepend=-1)
        self.n_overlaps[has] = np.diff(overlap[np.cumsum(a_size)[a_last[has] - 1] - 1], prepend=-1)
        self.n_links = sums(self.a_in * self.b_in, self.n_groups)
        self.owner = np.repeat(np.arange(len(n_a)), n_a)

    def links(self, b_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The stretch, the id pair (A's id times `b_ids` plus B's) and the number of links, for each stretch's distinct pairs."""
        partners = self.b_in[self.a_group]
        large = (self.a_in * self.b_in > PLAIN_LINKS)[self.a_group]
        partners = np.where(large, 0, partners)
        first = (np.cumsum(self.b_in) - self.b_in)[self.a_group]
        keys = [np.repeat(self.owner << 32 | self.a * b_ids, partners) + self.b[ragged(first, partners)]]
        times = [np.ones(len(keys[0]), np.int64)]
        for g in np.unique(self.a_group[large]):
            low, high = np.searchsorted(self.a_group, [g, g + 1])
            a, a_times = np.unique(self.a[low:high], return_counts=True)
            b, b_times = np.unique(self.b[slice(*np.searchsorted(self.b_group, [g, g + 1]))], return_counts=True)
            keys.append((self.owner[low] << 32) + (a[:, None] * b_ids + b[None, :]).ravel())
            times.append((a_times[:, None] * b_times[None, :]).ravel())
        found, n = totals_by(np.concatenate(keys), np.concatenate(times))
        return found >> 32, found & 0xFFFFFFFF, n

    def written(self) -> pa.Array:
        """Each stretch's groups: A's ids, a bar, B's ids; commas between ids, semicolons between groups."""

        def listed(values: pa.Array, lengths: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)

        sides = [pc.binary_join(listed(pa.array(ids).cast(pa.string()), n), ",") for ids, n in ((self.a, self.a_in), (self.b, self.b_in))]
        return pc.binary_join(listed(pc.binary_join_element_wise(*sides, "|"), self.n_groups), ";")


def align(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    buckets: int | None = None,
) -> DataFrame:
    """Columns of the result: those of `keep`, `n_a`, `n_b`, `n_groups`, `n_overlaps`, `n_links`, `n_best`, `count_sum`
    (long) and `groups` (string: `a1,a2|b1;a3|b2,b3`); a row for each row of `docs`.

    A is a byte-level tokenizer of the tokenizers library and reads a space and the text; B is a sentencepiece model
    that puts a space before the text itself. Strings of special tokens are ordinary text. Texts that are null or empty, or
    whose tokens do not give back all their bytes, have zeros and no groups. A pair's count is the number of rows that hold
    it linked; `n_best` counts links whose pair has the highest count of its A id, ties included; `count_sum` adds the counts
    of all links. Repeated rows count as often as they come. An empty table gives an empty one; columns of any name besides
    those of `keep` are left out. Both paths are read on the executors.
    """
    given = with_text_last(docs, text_col, keep)
    buckets = buckets or buckets_of(docs.sparkSession)
    table_schema = pa.schema([
        ("block", pa.string()), *((c, pa.binary()) for c in ("rest", "counts", "numbers", "stretches")),
        ("pairs", pa.list_(pa.struct([("bucket", pa.int32()), ("codes", pa.binary()), ("docs", pa.binary())]))),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = tokenizers_of(a_path, b_path)
        b_ids = len(tokenizers.b_bytes)
        for where, rest, texts in gather(batches):
            stretches, counts = stretches_of(texts, tokenizers.cut_bytes)
            coded = stretches.dictionary_encode()
            numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32)
            a, n_a, b, n_b, valid = encode_stretches(coded.dictionary.to_pylist(), tokenizers)
            spoilt = sums(~valid[numbers], counts) > 0
            if spoilt.any():
                numbers = numbers[np.repeat(~spoilt, counts)]
                counts = np.where(spoilt, 0, counts)
            at, code, _ = Aligned(a, n_a, b, n_b, tokenizers).links(b_ids)
            codes, local = np.unique(code, return_inverse=True)
            first = np.searchsorted(at, np.arange(len(n_a) + 1))
            doc, stretch = np.divmod(np.unique(np.repeat(np.arange(len(texts)), counts) << 32 | numbers), 1 << 32)
            sizes = np.diff(first)[stretch]
            held = np.unique(np.repeat(doc * len(codes), sizes) + local[ragged(first[stretch], sizes)])
            n_docs = np.bincount(held % max(len(codes), 1), minlength=len(codes))
            a_hash = np.fromiter((xxhash.xxh3_64_intdigest(int(x).to_bytes(4, "little")) for x in range(len(tokenizers.a_bytes))), np.uint64)
            bucket = (a_hash % np.uint64(buckets)).astype(np.int32)[codes // b_ids]
            order = np.argsort(bucket, kind="stable")
            bounds = bounds_of(bucket[order], buckets)
            pairs = [
                {"bucket": int(k), "codes": pack(np.diff(codes[some], prepend=0).astype(np.int64)), "docs": pack(n_docs[some].astype(np.int64))}
                for k in np.flatnonzero(np.diff(bounds))
                for some in [order[bounds[k] : bounds[k + 1]]]
            ]
            yield batch_of([(where, pack_rows(rest), pack(counts.astype(np.int64)), pack(numbers), pack_all(a, n_a, b, n_b), pairs)], table_schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_ids = len(tokenizers_of(a_path, b_path).b_bytes)
        schema = pa.schema([("bucket", pa.int32()), ("codes", pa.binary()), ("docs", pa.binary())])
        bucket, held, waiting = None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if bucket is not None:
                codes, n = totals_by(*(np.concatenate(x) for x in zip(*held, strict=True)))
                first = np.flatnonzero(np.diff(codes // b_ids, prepend=-1))
                highest = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(codes))))
                yield batch_of([(bucket, pack(np.diff(codes, prepend=0)), pack_all(n, n == highest))], schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    yield from done()
                    bucket, held, waiting = row["bucket"], [], 0
                held.append((np.cumsum(unpack(row["codes"], np.int64)), unpack(row["docs"], np.int64)))
                waiting += len(held[-1][0])
                if waiting > 4_000_000:
                    held, waiting = [totals_by(*(np.concatenate(x) for x in zip(*held, strict=True)))], 0
        yield from done()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = n = best = None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                codes = np.cumsum(unpack(row["codes"], np.int64))
                if row["block"] is None:
                    known, (n, best) = codes, unpack_all(row["docs"])
                    continue
                place = np.searchsorted(known, codes)
                found.append((row["block"], row["bucket"], pack_all(n[place], best[place])))
            yield batch_of(found, pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("found", pa.binary())]))

    def settle(block: pa.Table, found: pa.Table) -> pa.Table:
        tokenizers = tokenizers_of(a_path, b_path)
        b_ids = len(tokenizers.b_bytes)
        row = block.to_pylist()[0]
        counts, numbers = unpack(row["counts"], np.int64), unpack(row["numbers"], np.uint32)
        aligned = Aligned(*unpack_all(row["stretches"]), tokenizers)
        at, code, times = aligned.links(b_ids)
        asked = sorted(row["pairs"], key=lambda x: x["bucket"])
        if [x["bucket"] for x in asked] != found.column("bucket").to_pylist():
            raise RuntimeError("a block lacks answers")
        parts = [unpack_all(x) for x in found.column("found").to_pylist()]
        codes = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unpack(x["codes"], np.int64)) for x in asked)])
        n, best = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in (0, 1))
        order = np.argsort(codes)
        place = order[np.searchsorted(codes[order], code)] if len(codes) else np.zeros(0, np.int64)
        per = np.searchsorted(at, np.arange(len(aligned.n_a) + 1))
        columns = {
            "n_a": aligned.n_a, "n_b": aligned.n_b, "n_groups": aligned.n_groups, "n_overlaps": aligned.n_overlaps, "n_links": aligned.n_links,
            "n_best": sums(times * best[place], np.diff(per)), "count_sum": sums(times * n[place], np.diff(per)),
        }
        result = unpack_rows(row["rest"])
        for name, values in columns.items():
            result = result.append_column(name, pa.array(sums(values[numbers], counts)))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        groups = pc.binary_join(pa.ListArray.from_arrays(offsets, aligned.written().take(pa.array(numbers))), ";")
        return result.append_column("groups", groups)

    table = cut(given.mapInArrow(encode, TABLE))
    requests = table.select("block", F.explode("pairs").alias("p")).select("p.bucket", "block", "p.codes", "p.docs")
    added = meet(requests.drop("block"), buckets).mapInArrow(add, "bucket int, codes binary, docs binary")
    # A bucket's sums come before its requests: a null block sorts first.
    both = added.select("bucket", F.lit(None).cast("string").alias("block"), "codes", "docs").unionByName(requests.withColumn("docs", F.lit(None).cast("binary")))
    answers = meet(both, buckets, "block").mapInArrow(answer, ANSWER)
    longs = ", ".join(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_overlaps", "n_links", "n_best", "count_sum"))
    return bring_back(table, answers, settle, f"{schema_of(given, keep)}, {longs}, groups string")
