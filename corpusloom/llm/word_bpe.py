"""BPE encoding and decoding through a table of distinct words.

Words of a BPE tokenizer are encoded independently of their surroundings, and a corpus has far fewer
distinct words than words. Spark splits the texts; each block of documents asks for the ids of its distinct
words (see `blocks`); a bucket's task has all requests for a word and encodes it once; the ids are joined
back to the texts by the words' positions. Decoding joins the ids with the pieces of the vocabulary, a table
whose size the tokenizer fixes, and puts the pieces together as the tokenizer does.

Texts are split by array operations where all their characters are Latin or common punctuation, and by the
tokenizer's own normalizer and splitter elsewhere; both give the same words.

The blocks are made twice, for the requests and for the answers, which moves the texts once only. Input that
might come in another order when it is read again (`stable=False`) is therefore written down first; a block
whose words differ from those it asked for is an error, never a wrong result.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import (
    ANSWER, REQUEST, bounds_of, bring_back, buckets_of, gather, meet, pack, pack_rows, ragged, schema_of, sums, unpack, unpack_rows,
    with_text_last,
)
from corpusloom.llm.common import cut

#: Distinct words that a task remembers; a bucket with more encodes some of them again.
REMEMBERED = 2_000_000

SPACE, LETTER, NUMBER, SYMBOL = range(4)
#: What the array splitter takes: normal forms, lower case and classes of these are settled.
OTHER_TEXT = re.compile("[^\x00-\u012f\u0131-\u017f\u2010-\u2027\u20ac]")

# The normalizer and splitter that the array splitter stands for.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTER = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


@functools.lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], SYMBOL) for c in range(0x20AD)], np.uint8)
    table[[*range(9, 14), 0x20, 0x85, 0xA0]] = SPACE
    return table


@functools.lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The letters by which byte-level tokenizers write bytes: printable bytes as themselves, the others
    moved up in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def split_latin(texts: Sequence[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of texts of the array splitter's characters, and how many each text has."""
    joined = "\n".join(texts).lower()
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = character_classes()[codes]
    kept = kind != SPACE
    before = np.concatenate([[SPACE], kind[:-1]]).astype(np.uint8) if len(kind) else kind
    starts = kept & ((kind != before) | (kind == NUMBER))
    quotes = np.flatnonzero((codes == ord("'")) & starts)
    if len(quotes):
        padded = np.concatenate([codes, np.zeros(2, np.uint32)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((one == ord("l")) & (two == ord("l")))
        for which, size in ((quotes[short], 2), (quotes[long & ~short], 3)):
            starts[which + 1] = False
            after = which[which + size < len(codes)] + size
            starts[after] = kept[after]
    width = 1 + (codes >= 0x80).astype(np.uint8) + (codes >= 0x800)
    data = np.frombuffer(joined.encode(), np.uint8)
    data = data[kept if len(data) == len(codes) else np.repeat(kept, width)]
    first = np.flatnonzero(starts)
    offsets = np.concatenate([(np.cumsum(np.where(kept, width, 0)) - width)[first], [len(data)]]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.searchsorted(first, ends) - np.searchsorted(first, np.concatenate([[0], ends[:-1]]))
    return words, counts


class Tokens:
    """What this module needs of a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        if told["model"]["type"] != "BPE" or told["post_processor"] is not None or told["decoder"] is not None:
            raise ValueError("a BPE tokenizer without post-processor and decoder is expected")
        added = told["added_tokens"]
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            raise ValueError("added tokens are expected to match as they stand")
        parts = (told["normalizer"] or {}).get("normalizers"), (told["pre_tokenizer"] or {}).get("pretokenizers")
        self.latin = parts == (NORMALIZER, SPLITTER)
        if parts[1] is None or parts[1][-1]["type"] != "ByteLevel":
            raise ValueError("a byte-level splitter is expected")
        self.added = {x["content"].encode(): x["id"] for x in added}
        self.added_pattern = re.compile("(" + "|".join(sorted((re.escape(x["content"]) for x in added), key=len, reverse=True)) + ")") if added else None
        pieces = [""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for piece, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            pieces[k] = piece
        self.pieces = pa.array(pieces, pa.string())
        self.letters = {b: c for c, b in byte_letters().items()}

    def is_latin(self, text: str) -> bool:
        if not self.latin or "<|" in text and self.added_pattern.search(text):
            return False
        return text.isascii() or OTHER_TEXT.search(text) is None

    def split(self, text: str) -> list[bytes]:
        """A text's words by the tokenizer's own parts; an added token is a word as it stands."""
        found, bytes_of = [], byte_letters()
        for k, part in enumerate(self.added_pattern.split(text) if self.added_pattern else [text]):
            if k % 2:
                found.append(part.encode())
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part)
                found += [bytes(map(bytes_of.__getitem__, w)) for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return found

    def encode(self, word: bytes) -> list[int]:
        if word in self.added:
            return [self.added[word]]
        return [t.id for t in self.tokenizer.model.tokenize("".join(map(self.letters.__getitem__, word)))]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of consecutive runs of ids: their pieces, a space between two."""
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), self.pieces.take(pa.array(ids))), " ")


@functools.lru_cache(maxsize=4)
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


def words_of_block(texts: Sequence[str], tokens: Tokens, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of a block's texts: the order in which they are taken, the number of words of each, the words as
    numbers, and the distinct words in order of their buckets, with those."""
    latin = np.fromiter(map(tokens.is_latin, texts), bool, len(texts))
    order = np.concatenate([np.flatnonzero(latin), np.flatnonzero(~latin)])
    words, counts = split_latin([texts[k] for k in np.flatnonzero(latin)])
    if not latin.all():
        others = [tokens.split(texts[k]) for k in np.flatnonzero(~latin)]
        words = pa.concat_arrays([words, pa.array([w for o in others for w in o], pa.binary())])
        counts = np.concatenate([counts, [len(o) for o in others]])
    coded = words.dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    bucket = (hashes % np.uint64(buckets)).astype(np.int32)
    ranked = np.argsort(bucket, kind="stable")
    place = np.empty(len(ranked), np.uint32)
    place[ranked] = np.arange(len(ranked), dtype=np.uint32)
    numbers = place[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint32)
    return order, counts.astype(np.int64), numbers, coded.dictionary.take(pa.array(ranked)), bucket[ranked]


def lengths_and_bytes(words: pa.Array) -> tuple[np.ndarray, bytes]:
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.uint32)
    return lengths, b"".join(words.to_pylist())


def encode_words(
    docs: DataFrame,
    tokenizer_path: str,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    stable: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Encode and decode all texts. Columns of the result: those of `keep`, `n_tokens`, `ids` (array of int),
    `decoded`; a row for each row of `docs`.

    Special tokens are not added; their strings in a text are found as the tokenizer finds them. Null and empty
    texts, and texts of white space only, have no ids and decode to the empty text. Repeated rows and null ids
    are rows like all others; other columns of any name are left out. An empty table gives an empty one.
    `stable` says that `docs` gives the same rows in the same order and partitions whenever it is read, as
    files do. `tokenizer_path` is read on the executors.
    """
    given = with_text_last(docs, text_col, keep)
    if not stable:
        given = cut(given)
    buckets = buckets or buckets_of(docs.sparkSession)

    def taken(batches: Iterator[pa.RecordBatch]):
        tokens = tokens_of(tokenizer_path)
        for where, rest, texts in gather(batches):
            order, counts, numbers, words, bucket = words_of_block(texts, tokens, buckets)
            lengths, data = lengths_and_bytes(words)
            name = f"{where}.{xxhash.xxh3_64_hexdigest(data + counts.tobytes())}"
            yield name, rest.take(pa.array(order)), counts, numbers, lengths, data, bucket

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, _, _, lengths, data, bucket in taken(batches):
            bounds, ends = bounds_of(bucket, buckets), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            rows = []
            for k in np.flatnonzero(np.diff(bounds)):
                low, high = bounds[k], bounds[k + 1]
                sizes = pack(lengths[low:high])
                rows.append((int(k), name, len(sizes).to_bytes(4, "little") + sizes + zstandard.compress(data[ends[low] : ends[high]], 1)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary()), strict=True)], ["bucket", "block", "keys"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, known = tokens_of(tokenizer_path), {}
        for batch in batches:
            found = []
            for keys in batch.column("keys").to_pylist():
                n = int.from_bytes(keys[:4], "little")
                ends = np.cumsum(unpack(keys[4 : 4 + n], np.uint32), dtype=np.int64).tolist()
                data, start, ids = zstandard.decompress(keys[4 + n :]), 0, []
                for end in ends:
                    word, start = data[start:end], end
                    if (got := known.get(word)) is None:
                        got = known[word] = tokens.encode(word)
                        if len(known) > REMEMBERED:
                            known.clear()
                    ids.append(got)
                sizes = pack(np.fromiter(map(len, ids), np.uint32, len(ids)))
                found.append(len(sizes).to_bytes(4, "little") + sizes + pack(np.array([i for x in ids for i in x], np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(found, pa.binary())], ["block", "bucket", "found"])

    def hand_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rest, counts, numbers, lengths, _, _ in taken(batches):
            row = [name], [len(lengths)], [pack_rows(rest)], [pack(counts)], [pack(numbers)]
            types = pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], ["block", "n_words", "rest", "counts", "numbers"])

    def settle(block: pa.Table, found: pa.Table) -> pa.Table:
        if block.num_rows != 1:
            raise RuntimeError("a block differs between two readings; call with stable=False")
        tokens, parts = tokens_of(tokenizer_path), found.column("found").to_pylist()
        lengths, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for part in parts:
            n = int.from_bytes(part[:4], "little")
            lengths.append(unpack(part[4 : 4 + n], np.uint32))
            ids.append(unpack(part[4 + n :], np.uint32))
        lengths, ids = np.concatenate(lengths).astype(np.int64), np.concatenate(ids)
        if len(lengths) != block.column("n_words")[0].as_py():
            raise RuntimeError("a block lacks answers; call with stable=False")
        counts, numbers = unpack(block.column("counts")[0].as_py(), np.int64), unpack(block.column("numbers")[0].as_py(), np.uint32)
        sizes = lengths[numbers]
        n_tokens = sums(sizes, counts)
        flat = ids.astype(np.int32)[ragged((np.cumsum(lengths) - lengths)[numbers], sizes)]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_tokens)]).astype(np.int32)), pa.array(flat))
        rest = unpack_rows(block.column("rest")[0].as_py())
        columns = [*rest.columns, pa.array(n_tokens), lists, tokens.decode(flat, n_tokens)]
        return pa.Table.from_arrays(columns, [*rest.column_names, "n_tokens", "ids", "decoded"])

    requests = given.mapInArrow(ask, REQUEST)
    answers = meet(requests, buckets).mapInArrow(answer, ANSWER)
    blocks = given.mapInArrow(hand_over, "block string, n_words int, rest binary, counts binary, numbers binary")
    return bring_back(blocks, answers, settle, f"{schema_of(given, keep)}, n_tokens long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """SHA-256 of the ids, written in decimal with a space between two, and of the decoded text."""
    return encoded.withColumn("ids_sha256", F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256)).withColumn(
        "decoded_sha256", F.sha2(F.col("decoded"), 256)
    )
