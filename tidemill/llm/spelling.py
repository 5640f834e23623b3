"""Spelling variants: words one edit apart, and the form each rare spelling belongs to.

Letters are hashed to ``SYMBOLS`` symbols, which turns words into reduced words.
Words one edit apart have reduced words that are equal or one edit apart, so:

1. Every word gives the neighbourhood of its reduced word: itself, each symbol
   deleted, each symbol replaced by each other one. A link shows from both its
   ends, hence each is generated from one: insertions from the longer word (where
   they are deletions), replacements from the smaller symbol.
2. Neighbours are joined with the reduced vocabulary. An edit lies in one half of
   a word and leaves the other half alone; that half's hash of original letters
   goes into the join key, so a reduced word shared by very many words is split
   by their halves and candidates stay close to the links.
3. Candidates are verified on the original strings.

Rows hold 64-bit keys made of sums of position hashes, so a neighbour costs one
addition however long the word is. Words over ``LONG`` letters travel as their
checksum and are looked up again for the candidates.

``forms`` then takes, per word, the near word that is most frequent, if it is
``RATIO`` times as frequent, and follows forms to the last by doubling jumps.

Cases: a null or empty text holds no words; a row without id has an empty id in
the checksum that decides deletions; repeated rows count again; equal counts are
decided by code points; an empty table gives no words; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import ascii_lower, settled

LETTERS = "A-Za-zÀ-ÿ"
SYMBOLS = 4  # of the reduced alphabet
MIN_LETTERS, MIN_COUNT = 7, 2
NOISE = 31  # one occurrence in so many loses a letter
RATIO = 10
LONG = 64
_SCHEMA = "key long, word string, n long"


# -- words --------------------------------------------------------------------
def runs_of_letters(text: Column) -> Column:
    """Maximal runs of at least ``MIN_LETTERS`` letters."""
    return F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{MIN_LETTERS},}}+"), 0)


def observed(doc_id: Column, run: Column) -> Column:
    """``run`` in lower case; where ``NOISE`` divides its checksum with the document's id, one letter short."""
    word = F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(ascii_lower(run))  # the same; the first is quick
    check = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (check % F.length(word)).cast("int")
    short = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(check % NOISE == 0, short).otherwise(word)


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` for the words of at least ``MIN_LETTERS`` letters that occur at least ``MIN_COUNT`` times."""
    runs = docs.select("doc_id", F.explode(runs_of_letters(F.col("text"))).alias("run"))
    words = runs.select(observed(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= MIN_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


# -- reduced words --------------------------------------------------------------
def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def symbols_of(points: np.ndarray) -> np.ndarray:
    """The symbol of each code point."""
    return _mix(points.astype(np.uint64) + np.uint64(0x51ED)) % np.uint64(SYMBOLS)


def _at(place: np.ndarray, value: np.ndarray, kind: int) -> np.ndarray:
    """A hash of a value at a place of a word; a sequence hashes to the sum."""
    return _mix(_mix(place.astype(np.uint64) + np.uint64(kind << 40)) + value)


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))


class _Words:
    """The letters of a batch of words side by side, and sums of their hashes."""

    def __init__(self, words: pa.Array):
        points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4")
        self.length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.end = np.cumsum(self.length)
        self.start = self.end - self.length
        self.word = np.repeat(np.arange(len(words)), self.length)
        self.place = np.arange(len(points)) - self.start[self.word]
        self.symbol = symbols_of(points)
        self.own = _at(self.place, self.symbol, 0)
        self.reduced = _sums(self.own)
        self.moved = _sums(_at(self.place - 1, self.symbol, 0))  # as if a symbol before were gone
        value = points.astype(np.uint64)
        self.head = _sums(_at(self.place, value, 1))
        self.tail = _sums(_at(self.length[self.word] - 1 - self.place, value, 2))  # places from the end

    def whole(self) -> np.ndarray:
        return self.reduced[self.end] - self.reduced[self.start]

    def first(self, word: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hash of the first ``n`` letters as they are."""
        return _mix((self.head[self.start[word] + n] - self.head[self.start[word]]) * np.uint64(2))

    def last(self, word: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hash of the last ``n`` letters as they are."""
        return _mix((self.tail[self.end[word]] - self.tail[self.end[word] - n]) * np.uint64(2) + np.uint64(1))

    def index_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Every word twice: its reduced word with its first half, and with its last."""
        word, half = np.arange(len(self.length)), self.length // 2
        keys = (self.first(word, half), self.last(word, self.length - half))
        return np.concatenate((word, word)), np.concatenate([_mix(self.whole() + k) for k in keys])

    def neighbour_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The one-edit neighbours of every reduced word, with the half that the edit leaves alone."""
        word, place, length = self.word, self.place, self.length[self.word]
        # Replaced: every place, by every greater symbol; the halves are those of the word.
        half = length // 2
        side = np.where(place >= half, self.first(word, half), self.last(word, length - half))
        whole = self.whole()[word]
        words, keys = [], []
        for symbol in range(1, SYMBOLS):
            less = self.symbol < np.uint64(symbol)
            value = np.full(int(less.sum()), symbol, np.uint64)
            words.append(word[less])
            keys.append(whole[less] - self.own[less] + _at(place[less], value, 0) + side[less])
        # Deleted: the halves are those of the shorter word. Of equal neighbouring symbols one is enough in each half.
        half = (length - 1) // 2
        late = place >= half
        side = np.where(late, self.first(word, half), self.last(word, length - 1 - half))
        again = np.zeros(len(word), bool)
        again[1:] = (self.symbol[1:] == self.symbol[:-1]) & (word[1:] == word[:-1]) & (late[1:] == late[:-1])
        at = np.arange(len(word))
        gone = self.reduced[at] - self.reduced[self.start[word]] + self.moved[self.end[word]] - self.moved[at + 1]
        words.append(word[~again])
        keys.append((gone + side)[~again])
        return np.concatenate(words), _mix(np.concatenate(keys))


def _keyed(words: DataFrame, neighbours: bool) -> DataFrame:
    """``key, word, n`` for the index, or for the neighbours, of ``words`` (``word, name, n``); ``name`` is what travels."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.utf8_length(batch.column("word")).to_numpy(zero_copy_only=False)
            # A long word makes many rows: batches of about 2^16 letters.
            cuts = np.flatnonzero(np.diff(np.cumsum(size) >> 16)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if z > a:
                    some = batch.slice(a, z - a)
                    held = _Words(some.column("word"))
                    word, key = held.neighbour_keys() if neighbours else held.index_keys()
                    name, n = some.column("name").take(pa.array(word)), some.column("n").take(pa.array(word))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), name, n], ["key", "word", "n"])

    return words.select("word", "name", "n").mapInArrow(emit, _SCHEMA)


def _candidates(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: pairs whose reduced words, with a half of the letters, are at most one edit apart."""
    index = _keyed(words, neighbours=False)
    other = index.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    near = _keyed(words, neighbours=True).join(other, "key")
    equal = index.join(other, "key").where(F.col("word") < F.col("other"))
    return near.unionAll(equal).drop("key")


def _verified(pairs: DataFrame) -> DataFrame:
    """Pairs exactly one edit apart, each once.

    A deletion within a run of equal letters may leave both halves alone; it counts for the first half.
    """
    pairs = pairs.where(F.levenshtein("word", "other", 1) == 1)
    return pairs.select("word", "n", "other", "other_n")


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: every pair of words (``word, n``) one edit apart, each pair once."""
    length = F.length("word")
    short = _verified(_candidates(words.where(length <= LONG).select("word", F.col("word").alias("name"), "n")))
    # Long words, and those that are one letter below the bound, under their checksums.
    long = words.where(length >= LONG).select("word", F.sha2("word", 256).alias("name"), "n")
    texts, others = long.select(F.col("name"), "word"), long.select(F.col("name").alias("other_name"), F.col("word").alias("other"))
    found = _candidates(long).distinct().withColumnsRenamed({"word": "name", "other": "other_name"}).join(texts, "name").join(others, "other_name")
    found = _verified(found).where((F.length("word") > LONG) | (F.length("other") > LONG))
    return short.unionAll(found).distinct()


# -- forms ------------------------------------------------------------------------
def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n`` of every word."""
    both = pairs.unionAll(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    # Most frequent first, then the smallest: a minimum, so that Spark combines before it shuffles.
    ends = both.select("word", "n", F.lit(1).alias("near"), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")).alias("best"))
    alone = words.select("word", "n", F.lit(0).alias("near"), F.lit(None).cast(ends.schema["best"].dataType).alias("best"))
    out = ends.unionAll(alone).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    belongs = -F.col("best.less") >= RATIO * F.col("n")
    return out.select("word", "n", "n_near", F.when(belongs, F.col("best.form")).alias("form"), F.when(belongs, -F.col("best.less")).alias("form_n"))


def roots(table: DataFrame) -> DataFrame:
    """``table`` (``word, form``) with ``root``: the end of the chain of forms that begins at the word."""
    table = settled(table)
    chain = settled(table.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        nxt = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = settled(chain.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        chain = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    own = table.where(F.col("form").isNull()).withColumn("root", F.col("word"))
    return own.unionByName(table.where(F.col("form").isNotNull()).join(chain, "word"))


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the documents."""
    words = settled(vocabulary(docs))
    return roots(forms(words, near_words(words))).select("word", "form", "root", "n", "n_near", "form_n")
