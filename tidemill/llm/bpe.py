"""Byte-pair encoding by a pair occurrence index, and decoding.

The distinct new words of a block of documents lie side by side as one array of
symbols with links to the next and the previous symbol. The index maps each pair
that has a rank to all places where it stands. Ranks are applied in ascending
order: the places of a rank are merged at once, and the pairs that this makes or
breaks around them are entered under their own, later, ranks. An entry whose pair
is gone by its turn is passed over. Each word is thus merged once per block,
whatever its number of occurrences.

``Bpe`` reads a tokenizer file (format of the tokenizers library, model BPE) and
asks that a pair rank behind the merges that make its two sides, as training
gives; then all words may share one ascending pass. Texts are parted at special
tokens, normalised and split into words. For texts of Latin letters and common
punctuation that is done by one expression, which the tests hold against the file's rules
character by character; any other text, and any other set of rules, goes through
the file's own normaliser and splitter.

Decoding looks ids up and joins their tokens by the file's decoder, which is a
blank between tokens where the file names none.

Words already merged are kept within a task, up to ``STORE_BYTES``; the store
goes with the task.

Cases: a null text counts as empty and has no ids; rows with one id are encoded
each for itself; very long texts and words are ordinary; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm.common import tidied

BLOCK_LETTERS = 1 << 20  # letters of new words merged together, unless one word is longer
STORE_BYTES = 48 << 20
DOCS_AT_ONCE = 2000
TEXT_AT_ONCE = 16 << 20  # characters of documents handled together, unless one document is longer
_COST = 200  # bytes of a stored word besides its letters and ids


# -- merging --------------------------------------------------------------------
@dataclass
class Merges:
    """Pairs ``left * base + right`` in sorted order with their ranks, and what each rank makes."""

    base: int
    pairs: np.ndarray
    ranks: np.ndarray
    left: np.ndarray
    right: np.ndarray
    made: np.ndarray

    @classmethod
    def of(cls, merges: list[tuple[int, int, int]], base: int) -> Merges:
        left, right, made = (np.array(c, np.int64) for c in zip(*merges, strict=True)) if merges else (np.zeros(0, np.int64),) * 3
        rank = np.arange(len(left))
        first_made = np.full(base, -1)
        first_made[made[::-1]] = rank[::-1]
        last_made = np.full(base, -1)
        last_made[made] = rank
        if (first_made != last_made).any() or (last_made[left] >= rank).any() or (last_made[right] >= rank).any():
            raise ValueError("a pair ranks before a merge that makes one of its sides")
        pairs = left * base + right
        order = np.argsort(pairs)
        return cls(base, pairs[order], rank[order], left, right, made)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        pair = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[at] == pair) & (left >= 0) & (right >= 0), self.ranks[at], -1)


class PairIndex:
    """Places of every ranked pair in an array of symbols; -1 parts words."""

    def __init__(self, merges: Merges, symbols: np.ndarray):
        self.merges = merges
        self.symbol = symbols  # -2 where merged into the one before
        n = len(symbols)
        self.next = np.arange(1, n + 1)
        self.previous = np.arange(-1, n - 1)
        self.places: list[list[np.ndarray]] = [[] for _ in merges.made]
        self._enter(np.arange(n - 1))

    def _enter(self, at: np.ndarray) -> None:
        """List the places ``at`` under the ranks of the pairs that begin there."""
        if not len(self.merges.pairs):
            return
        rank = self.merges.rank(self.symbol[at], self.symbol[self.next[at]])
        has = rank >= 0
        rank, at = rank[has], at[has]
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        rank, at = rank[order], at[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for r, a, z in zip(rank[starts].tolist(), starts, [*starts[1:], len(at)], strict=True):
            self.places[r].append(at[a:z])

    def apply(self) -> np.ndarray:
        """Merge by ascending rank; the symbols that are left."""
        symbol, nxt, previous = self.symbol, self.next, self.previous
        left, right, made = self.merges.left.tolist(), self.merges.right.tolist(), self.merges.made.tolist()
        for r, lists in enumerate(self.places):
            if not lists:
                continue
            at = np.concatenate(lists) if len(lists) > 1 else lists[0]
            self.places[r] = []
            at = at[(symbol[at] == left[r]) & (symbol[nxt[at]] == right[r])]
            if len(at) > 1 and (len(lists) > 1 or left[r] == right[r]):
                at = np.unique(at)
            if left[r] == right[r] and len(at) > 1:
                at = self._apart(at)
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            symbol[at], symbol[gone] = made[r], -2
            nxt[at], previous[after] = after, at
            before = previous[at]
            around = np.concatenate((at, before[symbol[before] != made[r]]))  # such a neighbour is listed by itself
            self._enter(around)
        return symbol[symbol != -2]

    def _apart(self, at: np.ndarray) -> np.ndarray:
        """Of pairs that overlap in a row of equal symbols, every other one from the left."""
        follows = np.concatenate(([False], self.next[at[:-1]] == at[1:]))
        run = np.flatnonzero(~follows)
        nth = np.arange(len(at)) - np.repeat(run, np.diff(np.concatenate((run, [len(at)]))))
        return at[nth % 2 == 0]


def merged(merges: Merges, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of words side by side, and the words' lengths, after all merges."""
    spaced = np.full(len(symbols) + len(lengths) + 1, -1)
    spaced[np.arange(len(symbols)) + np.repeat(np.arange(len(lengths)), lengths) + 1] = symbols
    out = PairIndex(merges, spaced).apply()
    cuts = np.flatnonzero(out == -1)
    return out[out != -1], np.diff(cuts) - 1


# -- a tokenizer's rules ----------------------------------------------------------
def byte_letters() -> list[str]:
    """The visible letter that stands for each byte: itself if printable, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, far = [], 0x100
    for b in range(256):
        out.append(chr(b if b in shown else far))
        far += b not in shown
    return out


_NEAR = "\x00-\u0239\u2010-\u2027"  # characters that no normal form changes
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_RULES = {
    "normalizer": ["NFC", ("Replace", "\\s+", " "), "Lowercase"],
    "pre_tokenizer": [("Split", _SPLIT, "Removed", True), ("ByteLevel", False)],
}


def _rules(setup: dict) -> dict:
    """The file's normaliser and splitter in short form, or what cannot be put so."""
    try:
        normal = [n["type"] if n["type"] != "Replace" else ("Replace", n["pattern"]["Regex"], n["content"]) for n in setup["normalizer"]["normalizers"]]
        split, letters = setup["pre_tokenizer"]["pretokenizers"]
        cut = (split["type"], split["pattern"]["Regex"], split["behavior"], split["invert"])
        return {"normalizer": normal, "pre_tokenizer": [cut, (letters["type"], letters["add_prefix_space"])] if not letters["use_regex"] else None}
    except (KeyError, TypeError, ValueError):
        return {}


class Bpe:
    """One tokenizer file: words of a text, ids of words, text of ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        setup = json.loads(self.tokenizer.to_str())
        model = setup["model"]
        if model["type"] != "BPE" or model["dropout"] or model["byte_fallback"] or model["ignore_merges"] or model["continuing_subword_prefix"]:
            raise ValueError("only plain byte-level BPE files are supported")
        self.special = {t["content"]: t["id"] for t in setup["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in setup["added_tokens"]):
            raise ValueError("only added tokens that stand for their exact strings are supported")
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.base = max([*ids.values(), *self.special.values()], default=0) + 1
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.merges = Merges.of([(ids[a], ids[b], ids[a + b]) for a, b in pairs], self.base)
        letters = byte_letters()
        self._inner = np.array([ids.get(c, -1) for c in letters], np.int64)
        self._final = np.array([ids.get(c + end, -1) for c in letters], np.int64)
        if (self._inner < 0).any() or (self._final < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        self._bytes = {c: b for b, c in enumerate(letters)}
        self.tokens = [""] * self.base
        for token, i in (ids | self.special).items():
            self.tokens[i] = token
        self._quick = _rules(setup) == _RULES
        self._far = re.compile(f"[^{_NEAR}]")
        # Lower case of near characters lies below U+0370, so classes reach that far.
        letters, digits = (re.escape("".join(c for c in map(chr, range(0x370)) if unicodedata.category(c)[0] == kind)) for kind in "LN")
        self._words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\\t-\\r \\x85\\xa0{letters}{digits}]+")

    # words are texts; their bytes are what is merged
    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if self._quick and not self._far.search(text):
            return self._words.findall(text.lower())
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        if self.tokenizer.pre_tokenizer is None:
            return [normal] if normal else []
        shown = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(map(self._bytes.__getitem__, w)).decode("utf-8", "surrogateescape") for w, _ in shown if w]

    def parts(self, text: str) -> list[str]:
        """A text parted at special tokens, which take every second place."""
        return self._special.split(text) if self._special else [text]

    def encode_words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each word as little-endian 32-bit numbers, merged in blocks of bounded size."""
        data = [w.encode("utf-8", "surrogateescape") for w in words]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        block = np.cumsum(lengths) // BLOCK_LETTERS
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(data)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            letters = np.frombuffer(b"".join(data[a:z]), np.uint8)
            symbols, last = self._inner[letters], np.cumsum(lengths[a:z]) - 1
            symbols[last] = self._final[letters[last]]
            ids, counts = merged(self.merges, symbols, lengths[a:z])
            packed, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            yield from map(packed.__getitem__, map(slice, [0, *ends[:-1]], ends))

    def decode(self, ids: np.ndarray) -> str:
        tokens = [self.tokens[i] for i in ids.tolist()]
        return self.tokenizer.decoder.decode(tokens) if self.tokenizer.decoder else " ".join(tokens)


@lru_cache(maxsize=1)
def load(path: str) -> Bpe:
    """One per Python worker: the library does not give back all that a loaded tokenizer took."""
    return Bpe(path)


class Encoder:
    """Texts to ids, with the words already merged; made for one task."""

    def __init__(self, bpe: Bpe):
        self.bpe, self._store, self._size = bpe, {}, 0

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of every text, in order; texts are taken in groups of bounded size."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= TEXT_AT_ONCE or len(group) >= DOCS_AT_ONCE:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        split = [[part if i % 2 else self.bpe.words(part) for i, part in enumerate(self.bpe.parts(t))] for t in texts]
        if self._size > STORE_BYTES:
            self._store, self._size = {}, 0
        store = self._store
        new = list({w for parts in split for words in parts[::2] for w in words if w not in store})
        for word, ids in zip(new, self.bpe.encode_words(new), strict=True):
            store[word] = ids
            self._size += _COST + len(word) + len(ids)
        for parts in split:
            ids = [store[w] for w in parts[0]] if len(parts) == 1 else [x for i, p in enumerate(parts) for x in self._ids(i, p)]
            yield np.frombuffer(b"".join(ids), "<u4")

    def _ids(self, i: int, part: str | list[str]) -> list[bytes]:
        return [self.bpe.special[part].to_bytes(4, "little")] if i % 2 else [self._store[w] for w in part]


# -- on documents -------------------------------------------------------------------
def _each(docs: DataFrame, path: str, schema: str, row) -> DataFrame:
    """``doc_id`` and what ``row(bpe, ids)`` gives for every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        encoder = Encoder(bpe)
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            texts = batch["text"].tolist()
            rows = [row(bpe, ids) for ids in encoder.encode(texts)]
            out = pd.DataFrame(rows, columns=names, index=batch.index)
            out.insert(0, "doc_id", batch["doc_id"])
            yield out

    kind = docs.schema["doc_id"].dataType
    named = docs.select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))  # as text, ids stay exact beside nulls
    return named.mapInPandas(tidied(run), f"doc_id string, {schema}").withColumn("doc_id", F.col("doc_id").cast(kind))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` of every document."""
    return _each(docs, path, "ids array<long>", lambda bpe, ids: (ids.astype(np.int64),))


def decoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, decoded``: every document's text after encoding and decoding."""
    return _each(docs, path, "decoded string", lambda bpe, ids: (bpe.decode(ids),))


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""

    def digest(bpe: Bpe, ids: np.ndarray) -> tuple:
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()

    return _each(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", digest)
