"""Set-similarity self-join on word shingles: rare-first prefix filtering.

A document is the set of its distinct ``WORDS``-word shingles, as 64-bit hashes.
Documents with equal sets are one class first. Shingles are put in one global
order, rarest first, by a count sketch of document frequencies over all
documents (any order gives the same links; a good one gives few candidates). Two
sets with similarity at the threshold must share a shingle of their prefixes, so
candidates meet on prefix shingles and pass

- the length filter: neither set is too small for the other;
- the positional filter: what follows the shingle in both is long enough;
- the suffix filter: fixed pivots cut both sets into parts, and what differs
  within the parts bounds the overlap (one pivot and sizes at first; then
  ``PARTS`` parts and whether each size is odd, which differs in a part only if
  some shingle does). A pair that is to be verified is first held against that
  once more, with more parts than shingles in the set, which costs a fraction of
  its whole sets and turns away most of those that are not similar enough.

Candidates are verified on the whole sets, each pair once. As only connected
groups are asked for, verification goes in rounds, and a pair whose documents
are already connected is not looked at again: first each class with the most
frequent head of its runs, then with the most frequent head outside its group,
then all pairs that are left. No link between
different texts is lost, and a group of many near copies costs about its size
instead of its square.

Cases: null, empty and wordless texts have the empty set and link with nothing;
a text of fewer than ``WORDS`` words is one shingle; a row without an id links
with nothing and has a null component; rows that share an id are one node (``one_of_each`` keeps one row of it); an
empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import kept_keys, partitions, settled, sorted_runs, tidied
from tidemill.llm.components import components

WORDS = 5
PERCENT = 75  # linked when 100 * intersection >= PERCENT * union
SKETCH_BITS = 20
SKETCH_BLOCKS = 64
BLOCK_BYTES = 1 << 18  # text that is hashed at a time
PARTS = 512
_PIVOT = np.uint64(1 << 63)
_PARTS = 2047


# -- shingles ---------------------------------------------------------------
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.arange(1, 257, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
#: Words are polynomials modulo a prime: modulo a power of two, words of a regular build meet whatever the base.
_PRIME = (1 << 61) - 1
_BASE = 0x1342543DE82EF951
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)
_LOW30, _LOW31, _P = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1), np.uint64(_PRIME)


def _reduced(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo the prime."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from halves of 30 and 31 bits."""
    high, low, big, small = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = low * big + high * small
    return _reduced(_reduced(high * big * np.uint64(2) + (middle >> _30)) + _reduced((middle & _LOW30) << _31) + _reduced(low * small))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, _times(out, np.uint64(pow(base, len(out), _PRIME)))))
    return out[:n]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for a block of text."""
    return _powers(_BASE, 2 * BLOCK_BYTES), _powers(pow(_BASE, -1, _PRIME), 2 * BLOCK_BYTES)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and a hash of each: a polynomial in its bytes, from running sums."""
    space = np.concatenate(([True], _SPACE[data], [True]))
    start, end = np.flatnonzero(space[:-2] & ~space[1:-1]), np.flatnonzero(~space[1:-1] & space[2:]) + 1
    n = len(data)
    up, down = _tables()
    if n > len(up):
        up, down = _powers(_BASE, n), _powers(pow(_BASE, -1, _PRIME), n)
    value = _BYTE[data]
    # Sums of the powers' low 30 and high 31 bits stay below 2**64 for texts of up to 2**24 letters in a word.
    word = np.zeros(len(start), np.uint64)
    for part, shift in ((up[:n] & _LOW30, 0), (up[:n] >> _30, 30)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * part, dtype=np.uint64)))
        word = _reduced(word + _times(_reduced(sums[end] - sums[start]), np.uint64(1 << shift)))
    return start, _mixed(_times(word, down[start]))


def _joined(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` words in a row."""
    code = np.full(max(len(words) - width + 1, 0), width, np.uint64)
    for k in range(width):
        code = _mixed(code ^ words[k : len(words) - width + 1 + k])
    return code


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text, hashing many texts at once."""
    held: list[bytes] = []
    size = 0

    def sets() -> Iterator[np.ndarray]:
        data = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
        start, words = _word_hashes(data)
        ends = np.cumsum([len(h) + 1 for h in held])
        cuts = [0, *np.searchsorted(start, ends).tolist()]
        every = _joined(words, WORDS)
        for a, z in zip(cuts, cuts[1:], strict=False):
            if z - a >= WORDS:
                yield np.unique(every[a : z - WORDS + 1])
            else:
                yield _joined(words[a:z], z - a) if z > a else np.zeros(0, np.uint64)

    for text in texts:
        own = (text or "").encode()
        if held and size + len(own) > BLOCK_BYTES:
            yield from sets()
            held, size = [], 0
        held.append(own)
        size += len(own) + 1
    if held:
        yield from sets()


def parities(own: np.ndarray) -> bytes:
    """Whether each part of a set has an odd size, as bits: a power of two above the set's size of them, ``PARTS`` at least."""
    parts = max(PARTS, 1 << len(own).bit_length())
    part = ((own >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    return np.packbits(np.bincount(part, minlength=parts) & 1, bitorder="little").tobytes()


def folded(bits: bytes, size: int = PARTS // 8) -> np.ndarray:
    """The parities of fewer, larger parts, as ``size`` bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0)


def may_link(n: int, m: int, bits: bytes, cits: bytes) -> bool:
    """Whether sets of ``n`` and ``m`` shingles with these parities can be similar enough."""
    size = min(len(bits), len(cits))
    differ = int(np.bitwise_count(folded(bits, size) ^ folded(cits, size)).sum(dtype=np.int64))
    return differ <= n + m - 2 * -(-PERCENT * (n + m) // (100 + PERCENT))


def summaries(docs: DataFrame) -> DataFrame:
    """One pass over the texts: a row per document (``doc_id, n, digest, odd, bits``), and the sketch's blocks per task (``block, counts``)."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            sets = list(shingle_sets(batch["text"]))
            if sets:
                every = np.concatenate(sets)
                sketch += np.bincount((every >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            bits = [parities(s) for s in sets]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n": [len(s) for s in sets],
                    "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                    "odd": [folded(b).tobytes() for b in bits],
                    "bits": bits,
                    "block": None,
                    "counts": None,
                }
            )
        parts = sketch.reshape(SKETCH_BLOCKS, -1)
        yield pd.DataFrame({"doc_id": None, "n": 0, "digest": None, "odd": None, "bits": None, "block": range(SKETCH_BLOCKS), "counts": [p.astype("<u4").tobytes() for p in parts]})

    own = docs.select(F.col("doc_id").cast("string"), "text")
    out = own.mapInPandas(tidied(measure), "doc_id string, n long, digest binary, odd binary, bits binary, block int, counts binary")
    return settled(out.withColumn("doc_id", F.col("doc_id").cast("long")))


def sketch_of(summary: DataFrame) -> np.ndarray:
    """The summed sketch: ``2**SKETCH_BITS`` counts, whatever the size of the corpus."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch["block"], batch["counts"], strict=True):
                total[block] = total.get(block, 0) + np.frombuffer(counts, "<u4").astype(np.int64)
        yield pd.DataFrame({"block": list(total), "counts": [np.minimum(c, 0xFFFFFFFF).astype("<u4").tobytes() for c in total.values()]})

    rows = summary.where(F.col("block").isNotNull()).select("block", "counts").repartition(8, "block")
    out = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), np.uint64)
    for r in rows.mapInPandas(add, "block int, counts binary").collect():
        out[r.block] = np.frombuffer(r.counts, "<u4")
    return out.ravel()


# -- candidates ---------------------------------------------------------------
def _pack(n: int, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Size, place and share below the pivot in one number: 26, 26 and 11 bits."""
    low = int(np.searchsorted(own, _PIVOT)) * _PARTS // n
    return (np.int64(n) << 37) | (at.astype(np.int64) << 11) | low


def _unpack(info: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return info >> 37, (info >> 11) & ((1 << 26) - 1), info & _PARTS


def passes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of packed numbers pass the length, positional and first suffix filter."""
    (n, at, low), (m, bt, mow) = _unpack(a), _unpack(b)
    need = -(-PERCENT * (n + m) // (100 + PERCENT))
    length = PERCENT * np.maximum(n, m) <= 100 * np.minimum(n, m)
    position = 1 + np.minimum(n - at - 1, m - bt - 1) >= need
    # Sizes below the pivot are known to within one part in _PARTS.
    under = np.minimum((low + 1) * n // _PARTS + 1, (mow + 1) * m // _PARTS + 1)
    over = np.minimum(n - low * n // _PARTS, m - mow * m // _PARTS)
    return length & position & (under + over >= need)


def prefixes(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """``h, doc, info``: the prefix shingles of every document."""
    held = docs.sparkSession.sparkContext.broadcast(sketch.astype(np.uint32))  # 2**SKETCH_BITS numbers

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rarity = held.value
        for batch in batches:
            for at in range(0, len(batch), 500):
                h, doc, info = [], [], []
                for d, own in zip(batch["doc_id"].iloc[at : at + 500], shingle_sets(batch["text"].iloc[at : at + 500]), strict=True):
                    n = len(own)
                    if n:
                        p = n - -(-PERCENT * n // 100) + 1
                        order = np.argsort(rarity[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[:p]
                        h.append(own[order].view(np.int64))
                        doc.append(np.full(p, int(d), np.int64))
                        info.append(_pack(n, np.arange(p), own))
                if h:
                    yield pd.DataFrame({"h": np.concatenate(h), "doc": np.concatenate(doc), "info": np.concatenate(info)})

    return docs.select("doc_id", "text").mapInPandas(tidied(emit), "h long, doc long, info long")


def shared_prefixes(prefix: DataFrame) -> DataFrame:
    """Rows of runs (equal ``h``) of two or more, each with the head of its run.

    A run is in order of the shingle's place in its set. Rare shingles come
    first, so the head has the fewest shingles of its own: of copies that were
    edited apart it is the one nearest to what they come from.
    """

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = head = None  # the last row so far and the head of its run; whether it has company shows in the next batch
        many_before = False
        for batch in batches:
            rows = batch[["h", "doc", "info"]].to_numpy()
            if held is not None:
                rows = np.concatenate((held, rows))
            if not len(rows):
                continue
            h = rows[:, 0]
            start = np.concatenate(([True], h[1:] != h[:-1]))
            heads = rows[np.maximum.accumulate(np.where(start, np.arange(len(rows)), 0))]
            if held is not None:
                heads[h == h[0]] = head
            many = ~start
            many[:-1] |= ~start[1:]
            many[0] |= many_before
            end = len(rows) - 1
            yield _with_heads(rows[:end][many[:end]], heads[:end][many[:end]])
            held, head, many_before = rows[end:], heads[end:], bool(many[end])
        if many_before:
            yield _with_heads(held, head)

    place = F.shiftright("info", 11).bitwiseAND(F.lit((1 << 26) - 1))
    ordered = prefix.repartition(partitions(prefix.sparkSession), "h").sortWithinPartitions("h", place, "info", "doc")
    return ordered.mapInPandas(tidied(link), "h long, doc long, info long, head long")


def _with_heads(rows: np.ndarray, heads: np.ndarray) -> pd.DataFrame:
    head = pd.array(heads[:, 1], dtype="Int64")
    head[(rows[:, 1] == heads[:, 1]) | ~passes(rows[:, 2], heads[:, 2])] = pd.NA
    return pd.DataFrame({"h": rows[:, 0], "doc": rows[:, 1], "info": rows[:, 2], "head": head})


def open_pairs(shared: DataFrame, groups: DataFrame, odd: DataFrame) -> DataFrame:
    """All pairs of a run that pass the filters and are not in one group yet; ``odd`` has ``doc, odd``."""
    of = groups.select(F.col("node").alias("doc"), "component")
    rows = shared.select("h", "doc", "info").join(of, "doc", "left").join(odd, "doc")
    rows = rows.select("h", "doc", "info", F.coalesce("component", "doc").alias("g"), "odd")

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in sorted_runs(batches, ["h"]):
            at, group = np.array([a for a, _ in bounds]), frame["g"].to_numpy()
            apart = np.minimum.reduceat(group, at) != np.maximum.reduceat(group, at)  # a run of one group is done
            frame = frame[np.repeat(apart, [z - a for a, z in bounds])]
            if not len(frame):
                continue
            h, doc, info, g = (frame[c].to_numpy() for c in ("h", "doc", "info", "g"))
            known = frame["odd"].notna().to_numpy()  # an id with several texts has none, and its pairs stay
            odd = np.frombuffer(b"".join(o or bytes(PARTS // 8) for o in frame["odd"]), np.uint64).reshape(len(h), -1)
            size = info >> 37
            left, step = np.arange(len(h) - 1), 1
            while len(left):  # pairs of rows that stand ``step`` apart; in a run sizes grow
                right = left + step
                near = (h[left] == h[right]) & (PERCENT * size[right] <= 100 * size[left])
                left, right = left[near], right[near]
                found = (g[left] != g[right]) & passes(info[left], info[right])
                p, q = left[found], right[found]
                both = size[p] + size[q]
                differ = np.bitwise_count(odd[p] ^ odd[q]).sum(1, dtype=np.int64)
                close = ~(known[p] & known[q]) | (differ <= both - 2 * -(-PERCENT * both // (100 + PERCENT)))
                if close.any():
                    p, q = p[close], q[close]
                    yield pd.DataFrame({"a": np.minimum(doc[p], doc[q]), "b": np.maximum(doc[p], doc[q])})
                step += 1
                left = left[left + step < len(h)]

    dealt = rows.repartition(partitions(shared.sparkSession), "h").sortWithinPartitions("h", "info", "doc")
    return dealt.mapInPandas(tidied(pair), "a long, b long").distinct()


# -- verification -------------------------------------------------------------
def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc, members`` of the documents in ``wanted`` (``doc_id``)."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc": batch["doc_id"], "members": [s.view(np.int64) for s in shingle_sets(batch["text"])]})

    return kept_keys(docs, wanted, "doc_id").select("doc_id", "text").mapInPandas(tidied(emit), "doc long, members array<long>")


def plausible(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a, b``) that their parities do not rule out; ``marks`` has ``doc, n, bits``, null where unknown."""

    def judge(n: pd.Series, m: pd.Series, bits: pd.Series, cits: pd.Series) -> pd.Series:
        rows = zip(n, m, bits, cits, strict=True)
        return pd.Series([p is None or q is None or may_link(int(a), int(b), p, q) for a, b, p, q in rows], dtype="bool")

    wanted = settled(_ends(pairs).withColumnRenamed("doc_id", "doc"))
    own = kept_keys(marks, wanted, "doc")
    for end in ("a", "b"):
        pairs = pairs.join(own.select(F.col("doc").alias(end), F.col("n").alias(f"_n{end}"), F.col("bits").alias(f"_{end}")), end)
    return pairs.where(F.pandas_udf(judge, "boolean")("_na", "_nb", "_a", "_b")).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


def verified(docs: DataFrame, candidates: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of ``candidates`` (``a, b``) whose whole sets are similar enough."""
    pairs = settled(plausible(candidates, marks))
    wanted = settled(_ends(pairs))
    sets = settled(sets_of(docs, wanted))
    left, right = (sets.select(F.col("doc").alias(k), F.col("members").alias(f"_{k}")) for k in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b")
    common: Column = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - common
    return both.where(100 * common >= PERCENT * union).select("a", "b")


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.where(F.col(b).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one group."""
    for end in ("a", "b"):
        of = groups.select(F.col("node").alias(end), F.col("component").alias(f"_g{end}"))
        pairs = pairs.join(of, end, "left").withColumn(f"_g{end}", F.coalesce(f"_g{end}", end))
    return pairs.where(F.col("_ga") != F.col("_gb")).drop("_ga", "_gb")


def similar_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    docs = docs.select("doc_id", "text")
    summary = summaries(docs)
    each = summary.where(F.col("block").isNull()).select("doc_id", "n", "digest", "odd", "bits")
    linkable = each.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = linkable.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = settled(linkable.join(classes, "digest").where(F.col("doc_id") != F.col("first")).select("doc_id", "first"))
    # An id on several rows may be a copy with one text and not with another: all its rows stay in the search.
    several = settled(linkable.groupBy("doc_id").count().where(F.col("count") > 1).select(F.col("doc_id").alias("doc")))
    spare = copies.select("doc_id").distinct().join(several, F.col("doc_id") == F.col("doc"), "left_anti")
    distinct = kept_keys(docs.where(F.col("doc_id").isNotNull()), spare, "doc_id", "left_anti")

    shared = settled(shared_prefixes(prefixes(distinct, sketch_of(summary))))
    by_head = shared.where(F.col("head").isNotNull()).groupBy("doc", "head").agg(F.count("*").alias("k"))
    best = by_head.groupBy("doc").agg(F.max_by("head", F.struct("k", "head")).alias("head"))
    once = kept_keys(linkable.withColumnRenamed("doc_id", "doc"), several, "doc", "left_anti")
    unknown = several.select("doc", F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("bits"))
    marks = once.select("doc", "n", "bits").unionAll(unknown)
    odd = once.select("doc", "odd").unionAll(unknown.select("doc", "bits"))
    links = settled(verified(docs, settled(_ordered(best, "doc", "head").distinct()), marks))
    groups = settled(components(links))
    elsewhere = _apart(by_head.select(F.col("doc").alias("a"), F.col("head").alias("b"), "k"), groups)
    second = elsewhere.groupBy("a").agg(F.max_by("b", F.struct("k", "b")).alias("b"))
    near = _ordered(second, "a", "b").distinct()
    for candidates in (lambda: near, lambda: open_pairs(shared, groups, odd)):
        pairs = settled(candidates())
        if not pairs.isEmpty():
            links = links.unionAll(settled(verified(docs, pairs, marks)))
            groups = settled(components(links))

    everything = copies.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    of_class = everything.join(groups.withColumnRenamed("node", "b"), "b", "left").select(F.col("a").alias("doc_id"), F.coalesce("component", "b").alias("component_id"))
    of_class = of_class.unionAll(groups.join(copies.select(F.col("doc_id").alias("node")), "node", "left_anti").select(F.col("node").alias("doc_id"), F.col("component").alias("component_id")))
    return each.join(of_class.distinct(), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """Documents without those that a smaller id stands for, with all their columns."""
    groups = similar_groups(docs)
    gone = settled(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    kept = kept_keys(docs, gone, "doc_id", "left_anti")
    repeated = settled(groups.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id"))
    if repeated.isEmpty():
        return kept
    # Of an id's own rows the one with the smallest text stays.
    order = F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*docs.columns))
    first = kept_keys(kept, repeated, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("_row"))
    return kept_keys(kept, repeated, "doc_id", "left_anti").unionByName(first.select("_row.*"))
