"""Byte-level BPE by a tree: halves are encoded on their own and joined by encoding the seam anew."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.llm.common import Memo, kept_for, map_rows, table, text_rows, texts

LEAF_BYTES = 64
LEAF_CHARS = 1 << 15
DECODE_LEAF = 1 << 16
KNOWN_PIECES = 500_000
BLOCK_CHARS = 1 << 22


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of `base64 rank` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: What classes of a pattern are among the characters below 0x80 (fixed values).
ASCII_CLASSES = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r "}


def ascii_form(pattern: str) -> re.Pattern | None:
    """The pattern for texts of ASCII characters alone, where the standard library finds the same matches sooner; None if
    it has a class that ASCII_CLASSES lacks."""
    def put(found: re.Match) -> str:
        part = found.group()
        if part == r"\S":
            return f"[^{ASCII_CLASSES[chr(92) + 's']}]"
        inside = part.startswith("[")
        for name, characters in ASCII_CLASSES.items():
            part = part.replace(name, characters if inside else f"[{characters}]")
        return part

    plain = re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\[sS]", put, pattern)
    if re.search(r"\\[a-qu-zA-Z]|&&|\[\[", plain):
        return None
    try:
        return re.compile(plain)
    except re.error:
        return None


#: The pattern whose matches follow from classes of characters, by `run_starts`.
RUNS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, NUMBER, SIGN, WHITE, END = range(5)


def character_classes() -> np.ndarray:
    """LETTER, NUMBER, SIGN or WHITE for each code point, as the regex library has them."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    out = np.full(len(every), SIGN, np.uint8)
    for kind, name in ((LETTER, "L"), (NUMBER, "N"), (WHITE, "White_Space")):
        for found in regex.finditer(rf"\p{{{name}}}+", every):
            out[found.start():found.end()] = kind
    return out


def run_starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Whether a match of RUNS begins at each character of texts that end in a line break of class END, a match of its own.

    A match begins where the class changes, but not behind a space that a run takes along, and at the last of several
    white characters before a run. An apostrophe at a match's beginning that s, t, re, ve, m, ll or d follow ends with them.
    """
    white, run = kinds == WHITE, kinds < WHITE
    out = np.ones(len(kinds), bool)
    out[1:] = (kinds[1:] != kinds[:-1]) & ~((points[:-1] == ord(" ")) & run[1:])
    out[1:-1] |= white[:-2] & white[1:-1] & run[2:]
    out[kinds == END] = True
    quotes = np.flatnonzero((points == ord("'")) & out)
    one, two = points[quotes + 1], points[np.minimum(quotes + 2, len(points) - 1)]
    r, v, l, e = map(ord, "rvle")
    by_one = np.isin(one, list(map(ord, "stmd")))
    by_two = ((one == r) | (one == v)) & (two == e) | (one == l) & (two == l)
    out[quotes[by_one | by_two] + 1] = False
    out[quotes[by_one] + 2] = True
    out[quotes[by_two] + 3] = True
    return out


class Codec:
    """Encoder and decoder for one table of ranks and one pattern. Ids are unsigned, of 32 bits, or 16 with the width H."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, width: str = "I"):
        self.ranks, self.pattern, self.width = ranks, pattern, width
        self.bytes_of = {i: b for b, i in ranks.items()}
        # \s of the regex library also differs between versions in the control separators; the Unicode property does not
        spaced = pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.find_any = regex.compile(spaced, regex.V0).findall
        self.find_ascii = found.findall if (found := ascii_form(pattern)) else self.find_any
        self.known = Memo(self.pack, size=KNOWN_PIECES)
        self.merge = tiktoken.Encoding("leaves", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    # one piece

    def pack(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode())
        try:
            return array(self.width, ids).tobytes()  # little-endian, as on all machines that Arrow runs on
        except OverflowError:
            raise ValueError(f"id {max(ids)} does not fit the codec's width") from None

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the joined bytes from the ids of both sides.

        A list of ids is the encoding of its bytes exactly when each neighbouring pair is the encoding of its own
        bytes. The window around the seam is encoded anew; once its outermost ids are those it had before, every
        pair outside is a pair of a finished side, so nothing outside can change. Until then the window grows.
        """
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            seam = self.merge(b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j])))
            left_done, right_done = i == len(left) or seam[0] == left[-i], j == len(right) or seam[-1] == right[j - 1]
            if left_done and right_done:
                return left[:-i] + seam + right[j:]
            i, j = (i if left_done else min(2 * i, len(left))), (j if right_done else min(2 * j, len(right)))

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern: leaves by the library's merge loop, longer ones from their halves.

        A token's own bytes are one id, as in the library.
        """
        whole = self.ranks.get(data)
        return self.encode_half(data) if whole is None else [whole]

    def encode_half(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.encode_half(data[:half]), self.encode_half(data[half:]))

    # a text

    def find(self, text: str) -> list[str]:
        """Matches of the pattern."""
        return self.find_ascii(text) if text.isascii() else self.find_any(text)

    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        """Matches of the pattern over the joined text from the matches over both sides.

        A match is decided by at most two characters past its end ('re, 've and 'll against a lone apostrophe), so a match
        that two others follow stands. All but the last two of the left side are kept and the rest is matched anew, until
        its last two matches are two of the right side: from there on the right side's matches stand. Should the first
        one differ from what it was, the window grows to the left as well.
        """
        if not left or not right:
            return left or right
        i, j = min(2, len(left)), min(2, len(right))
        while True:
            seam = self.find("".join(left[-i:] + right[:j]))
            left_done, right_done = i == len(left) or seam[0] == left[-i], j == len(right) or seam[-2:] == right[j - 2:j]
            if left_done and right_done:
                return left[:-i] + seam + right[j:]
            i, j = (i if left_done else min(2 * i, len(left))), (j if right_done else min(2 * j, len(right)))

    def pieces(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.find(text)
        half = len(text) // 2
        return self.join_pieces(self.pieces(text[:half]), self.pieces(text[half:]))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned integers of the codec's width."""
        return b"".join(map(self.known.__getitem__, self.pieces(text)))

    # many texts

    @cached_property
    def classes(self) -> np.ndarray:
        return character_classes()

    @cached_property
    def merge_apart(self) -> Callable[[str], np.ndarray]:
        """Ids of short matches that zero characters set apart, by one call of the library's merge loop."""
        apart = tiktoken.Encoding("apart", pat_str=r"[^\x00]+", mergeable_ranks=self.ranks, special_tokens={})
        return partial(apart.encode_to_numpy, disallowed_special=())

    @cached_property
    def bytes_in(self) -> np.ndarray:
        """Number of bytes by id."""
        out = np.zeros(max(self.bytes_of) + 1, np.int64)
        out[list(self.bytes_of)] = list(map(len, self.bytes_of.values()))
        return out

    def matches(self, block: list[str]) -> tuple[pa.LargeStringArray, np.ndarray]:
        """Matches of the pattern in all texts of a block one after the other, and how many of them each text has."""
        if self.pattern != RUNS:
            found = [self.pieces(text) for text in block]
            return pa.array(chain.from_iterable(found), pa.large_string()), np.array([len(f) for f in found], np.int64)
        whole, data = "\n".join([*block, ""]), "".join(block).encode()
        ascii_only = len(data) + len(block) == len(whole)
        points = np.frombuffer(whole.encode(), np.uint8) if ascii_only else np.frombuffer(whole.encode("utf-32-le"), "<u4")
        kinds, ends = self.classes[points], np.cumsum([len(text) + 1 for text in block]) - 1
        kinds[ends] = END
        begin = np.flatnonzero(run_starts(points, kinds))
        last = np.searchsorted(begin, ends)
        counts = np.diff(last, prepend=-1) - 1
        begin = np.delete(begin, last) - np.repeat(np.arange(len(block)), counts)  # without the line breaks
        if not ascii_only:
            begin = np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)[begin]
        offsets = np.append(begin, len(data)).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data)), counts

    def pack_all(self, pieces: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """`pack` of each match. Short ones are merged together and told apart again by their bytes; the others by the tree."""
        sizes = pc.binary_length(pieces).to_numpy()
        alone = (sizes > LEAF_BYTES) | pc.match_substring(pieces, "\0").to_numpy(zero_copy_only=False)
        bounds = np.cumsum(sizes[~alone])
        zero, none = (pa.scalar(x, pa.large_string()) for x in ("\0", ""))
        apart = pc.binary_join_element_wise(pieces.filter(pa.array(~alone)), none, zero)  # a zero character after each
        ids = self.merge_apart(str(apart.buffers()[2][:bounds[-1] + len(bounds)], "utf-8") if len(bounds) else "")
        if len(ids) and ids.max() > np.iinfo(self.width).max:
            raise ValueError(f"id {ids.max()} does not fit the codec's width")
        ids = ids.astype(self.width)
        offsets = np.append(0, (np.searchsorted(np.cumsum(self.bytes_in[ids]), bounds) + 1) * ids.itemsize)
        merged = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
        if not alone.any():
            return merged
        others = pa.array(map(self.pack, pieces.filter(pa.array(alone)).to_pylist()), pa.large_binary())
        place = np.where(alone, len(merged) + np.cumsum(alone) - 1, np.cumsum(~alone) - 1)
        return pa.concat_arrays([merged, others]).take(pa.array(place))

    def encode_block(self, block: list[str]) -> list[bytes]:
        """`encode` of each text; every distinct match is looked up and merged once a block, however often it occurs."""
        pieces, counts = self.matches(block)
        coded = pieces.dictionary_encode()
        packed = self.pack_all(coded.dictionary).take(coded.indices)
        cuts = np.frombuffer(packed.buffers()[1], np.int64)[np.append(0, np.cumsum(counts))].tolist() if len(packed) else [0] * (len(block) + 1)
        data = memoryview(packed.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:])]

    def encode_all(self, values: Iterable[str]) -> Iterator[bytes]:
        """`encode` of each text in blocks of at least BLOCK_CHARS characters, or what is left; an id that is too wide raises."""
        block, size = [], 0
        for text in values:
            block.append(text)
            size += len(text)
            if size >= BLOCK_CHARS:
                yield from self.encode_block(block)
                block, size = [], 0
        if block:
            yield from self.encode_block(block)

    def decode(self, packed: bytes) -> bytes:
        """Bytes of packed 32-bit ids: concatenation is the whole of it, so halves are decoded and joined up the tree."""
        n = len(packed) // 4
        if n <= DECODE_LEAF:
            return b"".join(map(self.bytes_of.__getitem__, struct.unpack(f"<{n}I", packed)))
        half = n // 2 * 4
        return self.decode(packed[:half]) + self.decode(packed[half:])


#: Name of the work that codecs are kept for.
CODECS = "byte_bpe"


class _Shared:
    """What a codec is made of, as a broadcast, and a digest of it by which workers keep the codec they have built."""

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str, width: str):
        value = load_ranks(ranks_path), pattern, width
        self.key = hashlib.md5(repr(value).encode(), usedforsecurity=False).hexdigest()
        self.broadcast = spark.sparkContext.broadcast(value)


def _codec(shared: _Shared) -> Codec:
    """One codec per worker process, kept while its tasks encode or decode with the same ranks, pattern and width."""
    codecs = kept_for(CODECS)
    if shared.key not in codecs:
        codecs.clear()
        codecs[shared.key] = Codec(*shared.broadcast.value)
    return codecs[shared.key]


def share_codec(spark: SparkSession, ranks_path: str, pattern: str, width: str = "I") -> _Shared:
    """Ranks go out once; a vocabulary's size does not depend on the data."""
    return _Shared(spark, ranks_path, pattern, width)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) for every row of `docs`.

    Null and empty texts give no ids; repeated rows give repeated rows; a very long text is encoded by halves in its
    task; other columns are not carried, so none can clash.
    """
    shared = share_codec(docs.sparkSession, ranks_path, pattern)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            ids = pa.array((codec.encode(t) for t in texts(batch)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return map_rows(text_rows(docs), work, "doc_id long, ids binary", CODECS)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded (binary) from the rows of `encode`; null ids decode to nothing."""
    shared = share_codec(encoded.sparkSession, ranks_path, pattern)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            out = pa.array((codec.decode(v.as_py() or b"") for v in batch.column("ids")), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), out], ["doc_id", "ids", "decoded"])

    return map_rows(encoded.select("doc_id", "ids"), work, "doc_id long, ids binary, decoded binary", CODECS)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded: `encode` and `decode` in one pass, so that ids need not leave the worker in between.

    Null and empty texts have no ids. Null ids of documents and repeated rows stay; other columns are not read, so none
    can clash. An empty table gives an empty table.
    """
    shared = share_codec(docs.sparkSession, ranks_path, pattern)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            ids = [codec.encode(t) for t in texts(batch)]
            decoded = pa.array((codec.decode(v) for v in ids), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), decoded], ["doc_id", "ids", "decoded"])

    return map_rows(text_rows(docs), work, "doc_id long, ids binary, decoded binary", CODECS)


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids of every text and of the bytes that they decode to; odd rows as in round_trip."""
    both = round_trip(docs, ranks_path, pattern)
    return both.select("doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
