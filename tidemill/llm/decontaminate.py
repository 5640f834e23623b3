"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman.

Words are runs of letters and digits, lower-cased. A test item is aligned with
the words of a document; the score is the alignment's share of the best one
possible, and a document with ``THRESHOLD`` or more is a copy, verbatim or
edited, of the item. So is, whatever the item's length, a document whose
alignment is worth ``PASSAGE`` words in a row: that run itself, or a longer
passage with edits. Few words are no evidence: an alignment must be worth
``EVIDENCE`` words in a row, or the whole of an item that is shorter, and an
item of fewer than ``LEAST_WORDS`` words matches nothing.

Seeds are pairs of words, one or two words apart. An alignment of ``m`` matches
loses 1 for each word changed, put in or left out. Where two matches follow each
other after at most one such edit, both their words stand one or two words apart
in item and document. Every other step costs 2 at least, so that a score ``s``
needs ``s / 2 - 1`` such pairs, at different words of the item. Of an item's
pairs, all but that many less one must therefore hold one that the document
holds. These seeds are its rarest pairs, by the number of documents that hold
them, counted over the whole corpus (a count of none is as good as any: the
argument does not need a seed to occur). Frequent pairs are seeds of items that
have nothing else. Documents meet items by seed; then all pairs of the items met
are counted, and an item that has enough of them within a stretch of ``3 m - s``
words is aligned with the words around it. Nothing that reaches the score is
missed.

The test items are a query set against all documents: they are read in blocks of
at most ``BLOCK_WORDS`` words, each two passes over the documents, one that
counts and one that joins. A block is broadcast. Documents are never shuffled.

Cases: null and empty texts match nothing; repeated rows match alike, each on its
own row; null ids are passed through; empty tables give an empty result; further
columns of the inputs are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property, reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import tidied

EVIDENCE = 8
LEAST_WORDS = 3
BLOCK_WORDS = 1 << 20
THRESHOLD = 0.5
PASSAGE = 13
MATCH, MISMATCH, GAP = 2, -1, 1
SCHEMA = "doc_id string, item_id string, score double, first_word long, last_word long"

_WORD = (string.ascii_letters + string.digits).encode()
_TABLE = bytes(c if c >= 128 or c in _WORD.lower() else (c + 32 if c in _WORD else 32) for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score and the end of it in ``doc`` (one past its last word).

    A row of the matrix at a time; gaps along the row are a running maximum.
    """
    slope = GAP * np.arange(len(doc) + 1)
    row, best, end = np.zeros(len(doc) + 1, np.int64), 0, 0
    for word in item:
        new = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(doc == word, MATCH, MISMATCH), row[1:] - GAP, out=new[1:])
        row = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + slope) - slope, 0)
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


@dataclass
class Items:
    """A block of test items: word numbers (from 1; 0 is any other word), and the pairs with where they begin.

    Places count through all items of the block.
    Those where seed pair ``k`` begins are ``places[first[k]:first[k + 1]]``;
    other pairs have none. Without counts every pair is a seed.
    """

    ids: list[str | None]
    words: list[np.ndarray]
    number: dict[bytes, int]
    begin: np.ndarray  # each item's first place
    codes: np.ndarray  # of the pairs: sorted, distinct
    first: np.ndarray
    places: np.ndarray
    own: list[np.ndarray]  # each item's pairs, sorted
    begun: list[np.ndarray]  # each item's two pairs (or -1) that begin at each of its words

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]]) -> Items:
        number: dict[bytes, int] = {}
        words = [np.array([number.setdefault(w, len(number) + 1) for w in words_of(text)], np.int64) for _, text in rows]
        begin = np.cumsum([0, *map(len, words)])[:-1]
        pairs = [cls._pairs(own, len(number) + 1) for own in words]
        every = np.concatenate([c for c, _ in pairs])
        places = np.concatenate([at + b for (_, at), b in zip(pairs, begin, strict=True)])
        order = np.argsort(every, kind="stable")
        codes, first = np.unique(every[order], return_index=True)
        own = [np.searchsorted(codes, np.unique(c)) for c, _ in pairs]
        begun = []
        for item, (c, at) in zip(words, pairs, strict=True):
            both = np.full((len(item), 2), -1)
            near = max(len(item) - 1, 0)  # pairs one word apart come first
            both[at[:near], 0] = np.searchsorted(codes, c[:near])
            both[at[near:], 1] = np.searchsorted(codes, c[near:])
            begun.append(both)
        return cls([r[0] for r in rows], words, number, begin, codes, np.append(first, len(every)), places[order], own, begun)

    def seeded(self, counts: np.ndarray, least: np.ndarray) -> Items:
        """The same items with only their seeds in the index; ``counts`` has the documents that hold each pair."""
        counted = np.append(counts, 0)  # -1 counts nothing
        pairs, places = [], []
        for item, start, score in zip(self.begun, self.begin.tolist(), least.tolist(), strict=True):
            there = np.flatnonzero((item >= 0).any(1))
            some = max(len(there) - (-(-score // 2) - 1) + 1, 0)  # places of which an alignment must hold one
            rare = there[np.argsort(counted[item[there]].sum(1), kind="stable")][:some]
            for k in (0, 1):
                at = rare[item[rare, k] >= 0]
                pairs.append(item[at, k])
                places.append(at + start)
        none = np.zeros(0, np.int64)
        every = np.concatenate([*pairs, none])
        order = np.argsort(every, kind="stable")
        first = np.searchsorted(every[order], np.arange(len(self.codes) + 1))
        return replace(self, first=first, places=np.concatenate([*places, none])[order])

    @staticmethod
    def _pairs(own: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pairs of known words that stand one or two words apart, and where they begin."""
        codes, begins = [], []
        for apart in (1, 2):
            at = np.flatnonzero((own[:-apart] > 0) & (own[apart:] > 0))
            codes.append(own[at] * base + own[at + apart])
            begins.append(at)
        return np.concatenate(codes), np.concatenate(begins)

    def number_words(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))

    def hits(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs the document holds, and where."""
        codes, at = self._pairs(own, len(self.number) + 1)
        if not len(self.codes):
            return at[:0], at[:0]
        k = np.searchsorted(self.codes, codes)
        same = self.codes[np.minimum(k, len(self.codes) - 1)] == codes
        return k[same], at[same]

    @cached_property
    def _flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that begin at each word of the block, the items' lengths, and a mark per pair (and one for none)."""
        pairs = np.concatenate([*self.begun, np.full((0, 2), -1)])
        return pairs, np.array([len(w) for w in self.words], np.int64), np.zeros(len(self.codes) + 1, bool)

    def _held(self, items: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """At how many words of each item a pair begins that is in ``seen``."""
        pairs, lengths, mark = self._flat
        if not len(items):
            return items
        n = lengths[items]
        start = np.cumsum(n) - n
        at = np.repeat(self.begin[items] - start, n) + np.arange(n.sum())
        mark[seen] = True
        held = np.add.reduceat(mark[pairs[at]].any(1).astype(np.int64), start)
        mark[seen] = False
        return held

    def least(self, threshold: float) -> np.ndarray:
        """The score from which an alignment with each item is reported; for the shortest, one that none reaches."""
        n = np.array([len(w) for w in self.words], np.int64)
        share = np.ceil(threshold * MATCH * n - 1e-9)
        enough = np.where(n < LEAST_WORDS, MATCH * LEAST_WORDS, MATCH * np.minimum(n, EVIDENCE))
        return np.maximum(np.minimum(share, MATCH * PASSAGE), enough).astype(np.int64)

    def matches(self, own: np.ndarray, least: np.ndarray) -> list[tuple[int, float, int, int]]:
        """``(item, score, first word, last word)`` of each item the document copies: its best place."""
        found, at = self.hits(own)
        pairs = -(-least // 2) - 1
        if len(found) < pairs.min(initial=1):
            return []
        seen = np.unique(found)
        n = self.first[seen + 1] - self.first[seen]
        places = self.places[np.repeat(self.first[seen] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        met = np.unique(np.searchsorted(self.begin, places, "right") - 1)
        out = []
        for i in met[self._held(met, seen) >= pairs[met]].tolist():
            item, q, best = self.words[i], int(pairs[i]), (0, 0, 0)
            reach = 3 * len(item) - int(least[i])
            begins = np.unique(at[np.isin(found, self.own[i])])
            early, late = begins[: max(0, len(begins) - q + 1)], begins[q - 1 :]
            dense = late - early < reach
            spans = zip((late[dense] - reach).tolist(), (early[dense] + reach + 1).tolist(), strict=True)
            for a, b in _merged([(max(0, a), min(len(own), b)) for a, b in spans]):
                score, end = align(item, own[a:b])
                if score > best[0]:
                    best = (score, a, a + end)
            if best[0] >= least[i]:
                score, a, end = best
                back = align(item[::-1], own[a:end][::-1])[1]
                out.append((i, score / (MATCH * len(item)), end - back, end - 1))
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The test items, a bounded block at a time, in order of their ids."""
    rows, n = [], 0
    items = benchmark.select(F.col("item_id").cast("string"), "text").orderBy(F.col("item_id"), "text")
    for r in items.toLocalIterator():
        size = len(words_of(r.text))
        if rows and n + size > block_words:
            yield Items.of(rows)
            rows, n = [], 0
        rows.append((r.item_id, r.text))
        n += size
    if rows:
        yield Items.of(rows)


def with_seeds(docs: DataFrame, items: Items, least: np.ndarray) -> Items:
    """``items`` with their seeds: one pass over all documents counts those that hold each pair of the block."""
    held = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = held.value
        total = np.zeros(len(own.codes), np.int64)
        for batch in batches:
            for text in batch["text"]:
                total[np.unique(own.hits(own.number_words(text))[0])] += 1
        k = np.flatnonzero(total)
        yield pd.DataFrame({"k": k, "n": total[k]})

    rows = docs.select("text").mapInPandas(tidied(count), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(items.codes), np.int64)
    found = rows.toPandas()  # at most the pairs of a block
    counts[found["k"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    held.unpersist()
    return items.seeded(counts, least)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, score, first_word, last_word``: a row for each document and item it holds a copy of."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("string"), "text")
    parts = []
    for block in blocks(benchmark):
        least = block.least(threshold)
        sent = spark.sparkContext.broadcast((with_seeds(docs, block, least), least))  # at most BLOCK_WORDS words

        def find(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            items, least = sent.value
            for batch in batches:
                rows = []
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                    rows += [(doc, items.ids[i], s, a, z) for i, s, a, z in items.matches(items.number_words(text), least)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "first_word", "last_word"])

        parts.append(own.mapInPandas(tidied(find), SCHEMA))
    found = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], SCHEMA)
    return found.withColumns({"doc_id": F.col("doc_id").cast("long"), "item_id": F.col("item_id").cast("long")})


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that hold no copy of a test item, with all their columns."""

    spark, whole = docs.sparkSession, docs

    def free_of(sent):
        def free(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            items, least = sent.value
            for texts in batches:
                yield pd.Series([not items.matches(items.number_words(t), least) for t in texts], dtype="bool")

        free.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(free, "boolean")

    for block in blocks(benchmark):
        least = block.least(threshold)
        sent = spark.sparkContext.broadcast((with_seeds(whole, block, least), least))
        docs = docs.where(free_of(sent)(F.coalesce("text", F.lit(""))))
    return docs
