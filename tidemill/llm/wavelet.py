"""Token files as wavelet matrices.

A shard is one compressed file: a stream of token ids as bit planes, highest bit
first. Plane by plane the ids are parted, stably, into those with a 0 and those
with a 1 at that bit. Rank on the planes gives the id at a place and the count
of an id before a place; select walks back up and gives the places of an id.
Decoding the whole stream undoes the partings plane by plane.

File: magic, version, bits per id, number of ids and documents; zeros per plane;
then zstd frames, each after its length: document ids, missing-id flags,
document lengths, and one per plane (bits in little-endian order).

Spark deals documents out by ranges of ``doc_id``; each task sorts its range and
writes shards of about ``SHARD_TOKENS`` ids. Files are kept as rows of a Parquet
table in the shared folder, so that any file system Spark writes to will do.

Cases: a null text counts as empty and holds the end id alone; null ids come
first; documents with equal ids are ordered by their text; an empty table gives
no shards; a document longer than a shard makes the shard longer; further
columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm.common import partitions, settled, tidied

SHARD_TOKENS = 1 << 20
END = 0
PIECES, PIECE_BYTES = 1_000_000, 24 << 20  # remembered by a worker during a job; a full store is begun anew
TEXT_AT_ONCE = 4 << 20  # bytes of texts cut into pieces together, unless one text is longer
LETTERS_AT_ONCE = 1 << 18  # characters given to the tokenizers library in a call, unless one text is longer
_MAGIC, _VERSION = b"TMWM", 1
_HEAD = struct.Struct("<4sHHQQ")


# -- succinct planes --------------------------------------------------------
@dataclass
class Plane:
    """Bits in 64-bit words, with the ones before each word."""

    words: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, packed: bytes) -> Plane:
        words = np.frombuffer(packed + bytes(-len(packed) % 8 + 8), "<u8")
        ones = np.bitwise_count(words).astype(np.int64)
        return cls(words, np.concatenate(([0], np.cumsum(ones)[:-1])))

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low).astype(np.int64)

    def select(self, value: int, k: np.ndarray, n: int) -> np.ndarray:
        """The place of the ``k``-th (from 0) bit equal to ``value``, by halving on ranks."""
        low, high = np.zeros_like(k), np.full_like(k, n)
        while np.any(high - low > 1):
            mid = (low + high) >> 1
            rank = self.rank1(mid)
            left = (rank if value else mid - rank) > k
            low, high = np.where(left, low, mid), np.where(left, mid, high)
        return low


class WaveletMatrix:
    """Ids with access, rank, count and select."""

    def __init__(self, n: int, packed: list[bytes], zeros: list[int]):
        self.n, self.packed, self.zeros, self._planes = n, packed, zeros, None

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        packed, zeros = [], []
        for b in range(bits - 1, -1, -1):
            one = ((ids >> b) & 1).astype(bool)
            packed.append(np.packbits(one, bitorder="little").tobytes())
            low = ids[~one]
            zeros.append(len(low))
            ids = np.concatenate((low, ids[one]))
        return cls(len(ids), packed, zeros)

    @property
    def planes(self) -> list[Plane]:
        if self._planes is None:
            self._planes = [Plane.of(p) for p in self.packed]
        return self._planes

    def decode(self) -> np.ndarray:
        """All ids in order."""
        bits = len(self.packed)
        ids = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            one = np.unpackbits(np.frombuffer(self.packed[level], np.uint8), count=self.n, bitorder="little").astype(bool)
            upper = np.empty_like(ids)
            upper[~one] = ids[: self.zeros[level]]
            upper[one] = ids[self.zeros[level] :] | ids.dtype.type(1 << (bits - 1 - level))
            ids = upper
        return ids

    def access(self, at) -> np.ndarray:
        """The ids at the given places."""
        at = np.array(at, np.int64, ndmin=1)
        out = np.zeros(len(at), np.uint64)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit, ones = plane.bit(at), plane.rank1(at)
            at = np.where(bit == 1, zeros + ones, at - ones)
            out = (out << np.uint64(1)) | bit
        return out.astype(np.int64)

    def _bounds(self, token: int, end: int) -> tuple[int, int]:
        low, high = np.array([0]), np.array([end])
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            a, b = plane.rank1(low), plane.rank1(high)
            one = token >> (len(self.packed) - 1 - level) & 1
            low, high = (zeros + a, zeros + b) if one else (low - a, high - b)
        return int(low[0]), int(high[0])

    def rank(self, token: int, end: int) -> int:
        """How often the token stands before ``end``."""
        low, high = self._bounds(token, end)
        return high - low

    def count(self, token: int) -> int:
        return 0 if token >> len(self.packed) else self.rank(token, self.n)

    def occurrences(self, token: int) -> np.ndarray:
        """All places of the token, in order."""
        if not self.count(token):
            return np.zeros(0, np.int64)
        low, high = self._bounds(token, self.n)
        at = np.arange(low, high)
        for level in range(len(self.packed) - 1, -1, -1):
            one = token >> (len(self.packed) - 1 - level) & 1
            at = self.planes[level].select(one, at - self.zeros[level] if one else at, self.n)
        return np.sort(at)


# -- files ------------------------------------------------------------------
def write_file(ids: np.ndarray, lengths: np.ndarray, doc_ids: list[int | None], bits: int) -> bytes:
    """One shard as bytes."""
    matrix = WaveletMatrix.build(ids, bits)
    pack = zstandard.ZstdCompressor(level=1).compress
    missing = np.array([d is None for d in doc_ids], bool)
    frames = [
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.packbits(missing, bitorder="little").tobytes(),
        lengths.astype("<u8").tobytes(),
        *matrix.packed,
    ]
    out = [_HEAD.pack(_MAGIC, _VERSION, bits, matrix.n, len(doc_ids)), np.array(matrix.zeros, "<u8").tobytes()]
    for frame in frames:
        packed = pack(frame)
        out += [struct.pack("<Q", len(packed)), packed]
    return b"".join(out)


def read_file(data: bytes) -> tuple[WaveletMatrix, np.ndarray, list[int | None]]:
    """The matrix, the document lengths and the document ids of a shard."""
    magic, version, bits, n, docs = _HEAD.unpack_from(data)
    if magic != _MAGIC or version != _VERSION:
        raise ValueError("not a token file of this version")
    at = _HEAD.size
    zeros = np.frombuffer(data, "<u8", bits, at).tolist()
    at += 8 * bits
    unpack, frames = zstandard.ZstdDecompressor().decompress, []
    for _ in range(3 + bits):
        (size,) = struct.unpack_from("<Q", data, at)
        frames.append(unpack(data[at + 8 : at + 8 + size]) if size else b"")
        at += 8 + size
    missing = np.unpackbits(np.frombuffer(frames[1], np.uint8), count=docs, bitorder="little")
    ids = [None if m else i for i, m in zip(np.frombuffer(frames[0], "<i8").tolist(), missing, strict=True)]
    return WaveletMatrix(n, frames[3:], zeros), np.frombuffer(frames[2], "<u8").astype(np.int64), ids


# -- tokens -----------------------------------------------------------------
_WHITE, _WORD = 1, 2
#: Bytes before which a piece may begin: space, line break, and ASCII punctuation but the apostrophe.
_MAY_BEGIN = np.isin(np.arange(256), [*b" \n", *(c for c in string.punctuation.encode() if c != ord("'"))])
#: What no piece of a run holds behind its first character, for the expressions of Arrow.
_NO_WHITE = r"[^\s\x0b\x1c-\x1f\x{85}\x{180e}\p{Z}]"


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """White space, and the letters and digits of old scripts, by code point; the last place is for all beyond."""
    kinds = np.zeros(0x10001, np.uint8)
    for c in map(chr, range(0x10000)):
        kind = unicodedata.category(c)[0]
        if c.isspace() or kind == "Z" or c == "\u180e":
            kinds[ord(c)] = _WHITE
        elif c < "\u0530" and kind in "LN":
            kinds[ord(c)] = _WORD
    return kinds


def _before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code point of the character that ends before each place of UTF-8 bytes."""
    one, two, three = (data.take(at - k, mode="clip").astype(np.int32) for k in (1, 2, 3))  # at the very start any will do
    far = np.where(three >= 0xE0, (three & 15) << 12 | (two & 63) << 6 | one & 63, 0x10000)
    return np.where(one < 0x80, one, np.where(two >= 0xC0, (two & 31) << 6 | one & 63, far))


def _offsets(strings: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(strings.type) else np.int32
    return np.frombuffer(strings.buffers()[1], kind)[strings.offset : strings.offset + len(strings) + 1]


def _runs(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts`` values from each of ``starts`` on, one behind the other."""
    ends = np.cumsum(counts)
    at = np.arange(ends[-1] if len(ends) else 0)
    at += np.repeat(starts - (ends - counts), counts)
    return values[at]


class Encoder:
    """Texts to the tokenizer's ids.

    A byte-level vocabulary with its own splitting pattern never joins what is
    on the two sides of the first white space behind any other character, of a
    single line break, or of punctuation (but an apostrophe) behind a letter or
    digit. Texts are cut there, all at once on their bytes, and each distinct
    piece is encoded once and remembered as ids in one array. Texts that hold
    strings of special tokens, and all texts of other vocabularies, are one
    piece each.

    New pieces go to the library many in a text: those that begin with their
    only space one behind the other, those without any behind line breaks. Its
    threads are kept off, for the tasks have the cores already.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bits = max(1, (size - 1).bit_length())
        self.dtype = np.dtype("<u2" if self.bits <= 16 else "<u4")
        self._special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._any_special = re.compile(b"|".join(re.escape(s.encode()) for s in self._special)) if self._special else None
        setup = json.loads(self.tokenizer.to_str())
        split = setup["pre_tokenizer"] or {}
        self._by_piece = (
            setup["normalizer"] is None
            and split.get("type") == "ByteLevel"
            and split["use_regex"]
            and not split["add_prefix_space"]
            and not any(c.isspace() for s in self._special for c in s)
        )
        # Ids whose token begins with a space, or a line break: in a run of pieces these begin the pieces.
        vocabulary = self.tokenizer.get_vocab(True)
        self._opens = {}
        for sep, mapped in ((" ", "\u0120"), ("\n", "\u010a")):
            self._opens[sep] = np.zeros(size, bool)
            self._opens[sep][[i for token, i in vocabulary.items() if token.startswith(mapped)]] = True
        self._job = None
        self.forget()

    def forget(self) -> None:
        """Drop the pieces remembered."""
        self._known = pa.array([], pa.string())
        self._ids, self._ends = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def work_on(self, job: str) -> None:
        """Pieces are remembered from task to task of one job."""
        if job != self._job:
            self.forget()
        self._job = job

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, by the library, some texts at a time."""
        out, some, size = [], [], 0
        for i, text in enumerate(texts):
            some.append(text)
            size += len(text)
            if size >= LETTERS_AT_ONCE or i == len(texts) - 1:
                out += [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                some, size = [], 0
        return out

    def _in_runs(self, pieces: pa.Array, sep: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces that each begin with ``sep`` and hold none besides; where a piece's begin, and their number."""
        ends, data = _offsets(pieces).tolist(), memoryview(pieces.buffers()[2])
        ids = np.concatenate(self._whole([str(data[ends[a] : ends[min(a + 512, len(pieces))]], "utf-8") for a in range(0, len(pieces), 512)]))
        starts = np.flatnonzero(self._opens[sep][ids])
        if len(starts) != len(pieces):
            raise ValueError("the vocabulary lacks a byte")
        return ids, starts, np.diff(starts, append=len(ids))

    def _learn(self, pieces: pa.Array) -> None:
        """Encode pieces and remember them, in their order, behind the others."""
        kind = np.zeros(len(pieces), np.int8)
        if self._by_piece:
            for k, shape in ((1, f"^ {_NO_WHITE}+$"), (2, f"^{_NO_WHITE}+$")):
                kind[pc.match_substring_regex(pieces, shape).to_numpy(zero_copy_only=False)] = k
            for special in self._special:
                kind[pc.match_substring(pieces, special).to_numpy(zero_copy_only=False)] = 0
        starts, counts, ids, n = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [], 0
        for k in range(3):
            at = np.flatnonzero(kind == k)
            if not len(at):
                continue
            some = pieces.take(pa.array(at))
            if k == 0:
                lists = self._whole(some.to_pylist())
                found, many = np.concatenate(lists), np.array([len(x) for x in lists])
                first = np.cumsum(many) - many
            elif k == 1:
                found, first, many = self._in_runs(some, " ")
            else:
                found, first, many = self._in_runs(pc.binary_join_element_wise(pa.scalar("\n"), some, pa.scalar("")), "\n")
                first, many = first + 1, many - 1
            starts[at], counts[at] = first + n, many
            ids.append(found)
            n += len(found)
        self._known = pa.concat_arrays([self._known, pieces])
        self._ids = np.concatenate((self._ids, _runs(np.concatenate(ids), starts, counts)))
        self._ends = np.concatenate((self._ends, self._ends[-1] + np.cumsum(counts)))

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """The place of each piece among those remembered, after new ones are learnt."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self._known), -1).to_numpy().copy()
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self._known) + len(new) > PIECES or self._known.nbytes + pieces.nbytes > PIECE_BYTES:
                self.forget()
                new = np.arange(len(pieces))
            at[new] = len(self._known) + np.arange(len(new))
            self._learn(pieces.take(pa.array(new)))
        return at

    def _begins(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the pieces begin in the bytes of texts side by side."""
        begins = np.zeros(len(data) + 1, bool)
        if self._by_piece:
            at = np.flatnonzero(_MAY_BEGIN[data])
            here, before = data[at], _kinds()[_before(data, at)]
            at = at[np.where((here == 32) | (here == 10), before != _WHITE, before == _WORD)]
            begins[at] = True
            # A line break before what is surely no white space is a piece of its own.
            behind = at[data[at] == 10] + 1
            behind = behind[behind < len(data)]
            first = data[behind]
            begins[behind[(first > 32) & (first < 127) | (first >= 0xC3) & ~np.isin(first, [0xE1, 0xE2, 0xE3])]] = True
            if self._any_special:
                found = [m.start() for m in self._any_special.finditer(data)]
                for text in np.unique(np.searchsorted(ends, found, "right")):
                    begins[ends[text - 1] : ends[text]] = False
        begins[ends] = True
        return np.flatnonzero(begins[:-1])

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text behind the other, and the number of each text's."""
        texts = texts.cast(pa.large_binary())
        ends = _offsets(texts) if len(texts) else np.zeros(1, np.int64)
        low, high = int(ends[0]), int(ends[-1])
        if low == high:
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        data, ends = texts.buffers()[2].slice(low, high - low), ends - low
        begins = self._begins(np.frombuffer(data, np.uint8), ends)
        cuts = np.append(begins, high - low)
        coded = pa.StringArray.from_buffers(len(begins), pa.py_buffer(cuts.astype(np.int32)), data).dictionary_encode()
        place = self._places(coded.dictionary)[coded.indices.to_numpy()]
        starts = self._ends[place]
        counts = self._ends[place + 1] - starts
        upto = np.concatenate(([0], np.cumsum(counts)))
        return _runs(self._ids, starts, counts), np.diff(upto[np.searchsorted(cuts, ends)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes of ``dtype``."""
        ids, counts = self.tokens(pa.array(texts, pa.string()))
        data, ends = ids.tobytes(), (np.cumsum(counts) * self.dtype.itemsize).tolist()
        return [data[a:z] for a, z in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per Python worker: the library does not give back all that a loaded tokenizer took."""
    return Encoder(path)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], pa.Array]]:
    """Ids and texts of about ``TEXT_AT_ONCE`` bytes together, unless one text is longer."""
    names, texts, size = [], [], 0
    for batch in batches:
        column = batch.column("text").cast(pa.large_binary())
        at = 0
        while at < len(column):
            ends = _offsets(column)
            to = min(max(int(np.searchsorted(ends, ends[at] + TEXT_AT_ONCE - size, "right")) - 1, at + 1), len(column))
            names += batch.column("doc_id").slice(at, to - at).to_pylist()
            texts.append(column.slice(at, to - at))
            size += int(ends[to] - ends[at])
            if size >= TEXT_AT_ONCE or to < len(column):
                yield names, pa.concat_arrays(texts)
                names, texts, size = [], [], 0
            at = to
    if names:
        yield names, pa.concat_arrays(texts)


def write_shards(docs: DataFrame, tokenizer: str, shard_tokens: int = SHARD_TOKENS, end: int = END) -> DataFrame:
    """Encode all documents and write the shard files; one row per file, read back from the shared folder.

    ``part`` and ``shard`` number the files in order of ``doc_id``;
    ``start_in_part`` counts the ids of the part's earlier files.
    """
    job = uuid.uuid4().hex

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        own = encoder(tokenizer)
        own.work_on(job)
        held, lengths, ids, n = [], [], [], 0

        def file() -> pa.RecordBatch:
            data = write_file(np.concatenate(held), np.concatenate(lengths), ids, own.bits)
            row = {"part": part, "shard": shard, "start_in_part": start, "n_tokens": n, "n_docs": len(ids), "file": data}
            return pa.RecordBatch.from_pylist([row], schema=kind)

        for names, texts in _blocks(batches):
            tokens, counts = own.tokens(texts)
            tokens, counts = np.insert(tokens, np.cumsum(counts), end), counts + 1
            upto, at = np.concatenate(([0], np.cumsum(counts))), 0
            while at < len(names):
                to = min(int(np.searchsorted(upto, upto[at] + shard_tokens - n)), len(names))
                held.append(tokens[upto[at] : upto[to]])
                lengths.append(counts[at:to])
                ids += names[at:to]
                n += int(upto[to] - upto[at])
                at = to
                if n >= shard_tokens:
                    yield file()
                    shard, start, held, lengths, ids, n = shard + 1, start + n, [], [], [], 0
        if ids:
            yield file()

    kind = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("file", pa.binary())])
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = texts.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    whole = dealt.select(F.col("doc_id").cast("long"), "text")
    return settled(whole.mapInArrow(tidied(files), "part int, shard int, start_in_part long, n_tokens long, n_docs long, file binary"))


def read_documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row per partition
    first, seen = {}, 0
    for r in totals:
        first[r.part], seen = seen, seen + r.n

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                matrix, lengths, ids = read_file(row.file)
                tokens = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths)
                begins = ends - lengths
                yield pd.DataFrame(
                    {
                        "doc_id": [None if i is None else str(i) for i in ids],
                        "start": first[row.part] + row.start_in_part + begins,
                        "n_tokens": lengths,
                        "ids_crc32": [zlib.crc32(tokens[a:b]) for a, b in zip(begins, ends, strict=True)],
                        "part": row.part,
                        "shard": row.shard,
                    }
                )

    out = shards.select("part", "shard", "start_in_part", "file").mapInPandas(
        tidied(read), "doc_id string, start long, n_tokens long, ids_crc32 long, part int, shard int"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """``part, shard, place`` of every occurrence of a token, by select on each file."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                places = read_file(row.file)[0].occurrences(token)
                yield pd.DataFrame({"part": row.part, "shard": row.shard, "place": places})

    return shards.select("part", "shard", "file").mapInPandas(find, "part int, shard int, place long")


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """``token, n`` over all files, by rank."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["file"]:
                matrix = read_file(data)[0]
                yield pd.DataFrame({"token": tokens, "n": [matrix.count(t) for t in tokens]})

    return shards.select("file").mapInPandas(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
