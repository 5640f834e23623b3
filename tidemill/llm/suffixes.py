"""Suffix-array dedup: bytes of strings that also start in an earlier document.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id. Sorting all suffixes would move many times the
corpus, so the suffix array is built for those that can matter:

1. Anchors. Every window of ``LENGTH`` bytes picks one ``GRAM``-byte gram in it,
   the one with the least hash. Equal windows pick equal grams, so a window can
   only repeat where its anchor's gram does. Fingerprints of the grams, packed,
   are shuffled by hash; anchors whose fingerprint stands in two documents stay
   (a false meeting costs work, never a result).
2. Suffixes. Each remaining anchor gives the stretch of text that its windows
   cover. Stretches are range-partitioned by the leading bytes of the anchor, at
   splitters sampled from the corpus, so that equal grams meet in one bucket.
   A bucket sorts its distinct stretches by their grams and then by all their
   bytes, eight at a time, refining only ties (multikey sort), and compares
   neighbours. Where stretches of one gram differ, their windows are sorted and
   compared in the same way. The smallest document of each window decides.
3. Removed runs are returned to their documents, merged, and cut out.

Texts are dealt out in chunks by a hash of the id; the three steps share that
exchange. Only packed fingerprints, stretches and runs move besides.

Cases: a null text counts as empty; texts shorter than ``LENGTH`` lose nothing;
rows with the same id are one document (equal strings in them do not count
against each other); a row without an id comes after all others and loses
nothing that only other such rows hold; an empty table gives an empty result;
further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import partitions

LENGTH = 50
GRAM = 26
SPAN = LENGTH - GRAM + 1  # grams in a window
STRETCH = LENGTH + SPAN - 1  # a gram is picked by SPAN windows at most
CHUNK_BYTES = 16 << 20  # of text, about, in a chunk
BLOCK_BYTES = 1 << 20  # text that is hashed at a time
SAMPLE_DOCS = 2000  # documents the splitters are sampled from; they decide balance alone
NO_ID = np.iinfo(np.int64).max


# -- anchors ------------------------------------------------------------------
def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


def _eight(data: np.ndarray, big: bool = False) -> np.ndarray:
    """The eight bytes from every place on, as one number."""
    view = np.ndarray((max(len(data) - 7, 0),), ">u8" if big else "<u8", data, strides=(1,))
    return view.astype(np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from every place on."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    eight = _mix(_eight(data))
    sixteen = _mix(eight[:-8] + np.uint64(3) * (eight[8:] ^ np.uint64(0x5851F42D4C957F2D)))
    far = GRAM - 16
    return _mix(sixteen[:-far] ^ (np.uint64(5) * sixteen[far:] + np.uint64(1)))


def _least(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of one text: place, gram hash, and first and last window that pick it.

    A window picks the least hash in it, the leftmost of equal ones.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, np.zeros(0, np.uint64), none, none
    grams = gram_hashes(data)
    least = _least(grams, SPAN, np.minimum)
    # Places where a window's least hash stands, each window's leftmost.
    at = np.flatnonzero(_is_least(grams, least))
    window = np.arange(len(least))
    k = np.searchsorted(at, window)  # first candidate at or after the window's start
    while True:
        wrong = grams[at[k]] != least
        if not wrong.any():
            break
        k[wrong] += 1
    starts = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1))
    ends = np.concatenate((starts[1:], [len(k)])) - 1
    place = at[k[starts]]
    return place, grams[place], window[starts], window[ends]


def _is_least(grams: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether a place holds the least hash of some window that has it."""
    padded = np.concatenate((np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)))
    return grams == _least(padded, SPAN, np.maximum)[: len(grams)]


# -- sorting --------------------------------------------------------------------
def multikey_order(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of numbers, column by column, and whether each row (in order) differs from the one before.

    After the first column only rows that still tie are sorted on.
    """
    n = len(columns)
    order = np.argsort(columns[:, 0], kind="stable")
    new = np.ones(n, bool)
    first = columns[order, 0]
    new[1:] = first[1:] != first[:-1]
    for c in range(1, columns.shape[1]):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        run = np.cumsum(new)[at]
        value = columns[order[at], c]
        inner = np.lexsort((value, run))
        order[at] = order[at][inner]
        value, run = value[inner], run[inner]
        new[at[1:]] |= (value[1:] != value[:-1]) & (run[1:] == run[:-1])
    return order, new


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian numbers, so that numbers compare as bytes do."""
    wide = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), wide), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(">u8").astype(np.uint64)


def _slices(rows: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """``length`` bytes of each row from its place ``at`` on."""
    flat = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(rows).ravel(), length)
    return flat[np.arange(len(rows)) * rows.shape[1] + at]


def removed_windows(stretch: np.ndarray, before: np.ndarray, count: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For every stretch, which of its windows also stand in a smaller document.

    ``stretch`` is (n, STRETCH) bytes with zeros behind; ``before`` the bytes in
    front of the gram; ``count`` the number of windows. Returns (n, SPAN) booleans.
    """
    gram = _keys(_slices(stretch, before, GRAM))
    shape = (before << 8 | count).astype(np.uint64)[:, None]
    order, new = multikey_order(np.concatenate((gram, shape, _keys(stretch)), 1))
    cls = np.empty(len(stretch), np.int32)
    cls[order] = np.cumsum(new) - 1
    heads = order[new]
    smallest = np.full(len(heads), NO_ID)
    np.minimum.at(smallest, cls, doc)
    # Neighbouring classes of one gram: their windows are compared one by one.
    own = gram[heads]
    same = (own[1:] == own[:-1]).all(1)
    del gram, own, order, new
    mixed = np.zeros(len(heads), bool)
    mixed[1:] |= same
    mixed[:-1] |= same
    run = np.concatenate(([0], np.cumsum(~same))).astype(np.uint64)[: len(heads)]
    gone = np.broadcast_to(smallest[cls][:, None] < doc[:, None], (len(stretch), SPAN)) & (np.arange(SPAN) < count[:, None])
    many = np.flatnonzero(mixed)
    if len(many):
        least = np.broadcast_to(smallest[:, None], (len(heads), SPAN)).copy()
        own, front, windows = stretch[heads[many]], before[heads[many]], count[heads[many]]
        # Equal windows hold their gram at the same place, so each place is compared for itself.
        for place in range(SPAN):
            at = np.flatnonzero((front >= place) & (front - place < windows))
            if len(at):
                shift = front[at] - place
                order, new = multikey_order(np.concatenate((run[many[at]][:, None], _keys(_slices(own[at], shift, LENGTH))), 1))
                group = np.empty(len(at), np.int64)
                group[order] = np.cumsum(new) - 1
                first = np.full(int(new.sum()), NO_ID)
                np.minimum.at(first, group, smallest[many[at]])
                least[many[at], shift] = first[group]
        rows = np.flatnonzero(mixed[cls])
        gone[rows] = (least[cls[rows]] < doc[rows, None]) & (np.arange(SPAN) < count[rows, None])
    return gone


# -- packing --------------------------------------------------------------------
def _planes(column: np.ndarray) -> bytes:
    """Numbers byte by byte of their width, all lowest bytes first: high bytes are mostly zeros and pack away."""
    column = np.ascontiguousarray(column)
    return np.ascontiguousarray(column.view("u1").reshape(len(column), -1).T).tobytes()


def _pack(columns: dict[str, np.ndarray], kinds: list[tuple[str, str, int]]) -> bytes:
    parts = []
    for name, kind, width in kinds:
        column = columns[name].astype(kind, copy=False)
        if name in _RISING:
            column = np.diff(column, prepend=column.dtype.type(0))
        parts.append(column.tobytes() if width > 1 else _planes(column))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(data: bytes, n: int, kinds: list[tuple[str, str, int]]) -> dict[str, np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), {}, 0
    for name, kind, width in kinds:
        size = np.dtype(kind).itemsize * width * n
        if width > 1:
            column = np.frombuffer(raw, kind, n * width, at).reshape(n, width)
        else:
            planes = np.frombuffer(raw, "u1", size, at).reshape(-1, n)
            column = np.ascontiguousarray(planes.T).view(kind).ravel()
        out[name] = np.cumsum(column, dtype=column.dtype) if name in _RISING else column
        at += size
    return out


_RISING = ("row", "at", "text")  # kept as steps; packed in their order
_PRINTS = [("print", "<u4", 1), ("high", "u1", 1), ("text", "<u4", 1), ("at", "<u4", 1)]
_STRETCHES = [("stretch", "u1", STRETCH), ("before", "u1", 1), ("count", "u1", 1), ("doc", "<i8", 1), ("row", "<u4", 1), ("window", "<u4", 1)]
_RUNS = [("row", "<u4", 1), ("window", "<u4", 1), ("flags", "<u4", 1)]
_FOUND = [("at", "<u4", 1)]


def _by_bucket(bucket: np.ndarray, columns: dict[str, np.ndarray], buckets: int, kinds: list[tuple[str, str, int]]) -> Iterator[tuple[int, int, bytes]]:
    """Bucket, number of rows and packed rows, in the order the rows came in."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        own = order[cuts[b] : cuts[b + 1]]
        if len(own):
            yield b, len(own), _pack({k: c[own] for k, c in columns.items()}, kinds)


class _Chunk:
    """The texts of a chunk in a fixed order, with their anchors."""

    def __init__(self, frame: pd.DataFrame):
        order = sorted(range(len(frame)), key=lambda i: (frame["key"].iat[i], frame["text"].iat[i]))
        self.keys = frame["key"].to_numpy()[order]
        self.ids = [frame["doc_id"].iat[i] for i in order]
        self.texts = [np.frombuffer(frame["text"].iat[i].encode(), np.uint8) for i in order]

    def anchors(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Blocks of ``row, place, hash, first window, last window``; places count within a text."""
        block, size = [], 0
        for row, data in enumerate(self.texts):
            found = anchors(data)
            if len(found[0]):
                place, gram, first, last = found
                block.append((np.full(len(place), row, np.int32), place.astype(np.int32), gram, first.astype(np.int32), last.astype(np.int32)))
                size += len(data)
            if size >= BLOCK_BYTES:
                yield tuple(np.concatenate(c) for c in zip(*block, strict=True))
                block, size = [], 0
        if block:
            yield tuple(np.concatenate(c) for c in zip(*block, strict=True))

    def all_anchors(self) -> tuple[np.ndarray, ...] | None:
        blocks = list(self.anchors())
        return tuple(np.concatenate(c) for c in zip(*blocks, strict=True)) if blocks else None


# -- the three steps --------------------------------------------------------------
def _fingerprints(chunks: DataFrame, buckets: int) -> DataFrame:
    """Step 1, map side: per chunk and bucket, packed fingerprints of the anchors' grams."""

    def emit(frame: pd.DataFrame) -> pd.DataFrame:
        found = _Chunk(frame).all_anchors()
        rows = []
        if found is not None:
            row, _, gram, _, _ = found
            number = np.arange(len(row), dtype=np.uint32)
            columns = {
                "print": (gram & np.uint64(0xFFFFFFFF)).astype("<u4"),
                "high": ((gram >> np.uint64(32)) & np.uint64(0xFF)).astype("u1"),
                "text": row.astype("<u4"),
                "at": number,
            }
            bucket = ((gram >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            rows = list(_by_bucket(bucket, columns, buckets, _PRINTS))
        return pd.DataFrame({"bucket": [r[0] for r in rows], "chunk": frame["chunk"].iat[0], "n": [r[1] for r in rows], "data": [r[2] for r in rows]})

    return chunks.groupBy("chunk").applyInPandas(emit, "bucket int, chunk int, n long, data binary")


def _repeated(prints: DataFrame) -> DataFrame:
    """Step 1, reduce side: per chunk, the anchors whose fingerprint stands in two documents."""

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(d, n, _PRINTS) for d, n in zip(frame["data"], frame["n"], strict=True)]
        chunk = np.repeat(frame["chunk"].to_numpy(), frame["n"].to_numpy())
        code = np.concatenate([p["print"].astype(np.uint64) | (p["high"].astype(np.uint64) << np.uint64(32)) for p in parts])
        doc = np.concatenate([p["text"] for p in parts]).astype(np.uint64) | (chunk.astype(np.uint64) << np.uint64(32))
        at = np.concatenate([p["at"] for p in parts])
        order = np.argsort(code, kind="stable")
        code, doc = code[order], doc[order]
        start = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
        keep = np.sort(order[np.repeat(several, np.diff(np.concatenate((start, [len(code)]))))])
        rows = list(_by_bucket(chunk[keep], {"at": at[keep]}, int(chunk.max()) + 1, _FOUND)) if len(keep) else []
        return pd.DataFrame({"chunk": [r[0] for r in rows], "n": [r[1] for r in rows], "data": [r[2] for r in rows]})

    return prints.groupBy("bucket").applyInPandas(find, "chunk int, n long, data binary")


def _stretches(chunks: DataFrame, repeated: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Step 2, map side: the stretches of repeated anchors, to the bucket of their gram's leading bytes."""

    def emit(frame: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(frame) and len(marks):
            chunk = _Chunk(frame)
            keep = np.sort(np.concatenate([_unpack(d, n, _FOUND)["at"] for d, n in zip(marks["data"], marks["n"], strict=True)]))
            row, place, _, first, last = (c[keep] for c in chunk.all_anchors())
            size = np.array([len(t) for t in chunk.texts])
            text = np.concatenate([*chunk.texts, np.zeros(STRETCH, np.uint8)])
            begin = np.concatenate(([0], np.cumsum(size)[:-1]))[row] + first
            count = last - first + 1
            stretch = np.lib.stride_tricks.sliding_window_view(text, STRETCH)[begin]
            stretch[np.arange(STRETCH) >= (count + LENGTH - 1)[:, None]] = 0
            lead = _eight(text, big=True)[begin + place - first]
            columns = {
                "stretch": stretch,
                "before": (place - first).astype("u1"),
                "count": count.astype("u1"),
                "doc": chunk.keys[row].astype("<i8"),
                "row": row.astype("<u4"),
                "window": first.astype("<u4"),
            }
            rows = list(_by_bucket(np.searchsorted(splitters, lead, side="right"), columns, len(splitters) + 1, _STRETCHES))
        name = frame["chunk"].iat[0] if len(frame) else 0
        return pd.DataFrame({"bucket": [r[0] for r in rows], "chunk": name, "n": [r[1] for r in rows], "data": [r[2] for r in rows]})

    return chunks.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInPandas(emit, "bucket int, chunk int, n long, data binary")


def _removed(stretches: DataFrame) -> DataFrame:
    """Step 2, reduce side: per chunk, the windows that go, as bits of each stretch."""

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(d, n, _STRETCHES) for d, n in zip(frame["data"], frame["n"], strict=True)]
        chunk = np.repeat(frame["chunk"].to_numpy(), frame["n"].to_numpy())
        col = {k: np.concatenate([p[k] for p in parts]) for k, _, _ in _STRETCHES}
        gone = removed_windows(col["stretch"], col["before"].astype(np.int64), col["count"].astype(np.int64), col["doc"].astype(np.int64))
        flags = gone @ (1 << np.arange(SPAN, dtype=np.int64))
        keep = np.flatnonzero(flags)
        columns = {"row": col["row"][keep], "window": col["window"][keep], "flags": flags[keep].astype("<u4")}
        rows = list(_by_bucket(chunk[keep], columns, int(chunk.max()) + 1, _RUNS)) if len(keep) else []
        return pd.DataFrame({"chunk": [r[0] for r in rows], "n": [r[1] for r in rows], "data": [r[2] for r in rows]})

    return stretches.groupBy("bucket").applyInPandas(find, "chunk int, n long, data binary")


def cut(data: np.ndarray, windows: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """A text without the bytes its ``windows`` (starts) cover, and the runs that went."""
    if not len(windows):
        return data.tobytes(), []
    windows = np.unique(windows)
    start = np.flatnonzero(np.concatenate(([True], windows[1:] > windows[:-1] + LENGTH)))
    end = np.concatenate((start[1:], [len(windows)])) - 1
    runs = list(zip(windows[start].tolist(), (windows[end] + LENGTH).tolist(), strict=True))
    gone = np.zeros(len(data), bool)
    for a, z in runs:
        gone[a:z] = True
    return data[~gone].tobytes(), runs


def _results(chunks: DataFrame, removed: DataFrame) -> DataFrame:
    """Step 3: every document without its removed runs."""

    def emit(frame: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        chunk = _Chunk(frame) if len(frame) else None
        if chunk is None:
            return pd.DataFrame(columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        parts = [_unpack(d, n, _RUNS) for d, n in zip(marks["data"], marks["n"], strict=True)]
        row = np.concatenate([p["row"] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        flags = np.concatenate([p["flags"] for p in parts]).astype(np.int64) if parts else row
        first = np.concatenate([p["window"] for p in parts]).astype(np.int64) if parts else row
        which, shift = np.nonzero((flags[:, None] >> np.arange(SPAN)) & 1)
        window, row = first[which] + shift, row[which]
        order = np.argsort(row, kind="stable")
        window, row = window[order], row[order]
        cuts = np.searchsorted(row, np.arange(len(chunk.texts) + 1))
        out = []
        for i, data in enumerate(chunk.texts):
            kept, runs = cut(data, window[cuts[i] : cuts[i + 1]])
            out.append((chunk.ids[i], len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return chunks.groupBy("chunk").cogroup(removed.groupBy("chunk")).applyInPandas(emit, schema)


def splitters_of(texts: DataFrame, buckets: int, rows: int) -> np.ndarray:
    """Bucket bounds on leading bytes: quantiles over the anchors of at most about ``SAMPLE_DOCS`` documents."""

    def leads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                data = np.frombuffer(text.encode(), np.uint8)
                place = anchors(data)[0]
                if len(place):
                    lead = _eight(data, big=True)[place[:: max(1, len(place) // 50)]]
                    yield pd.DataFrame({"lead": lead.view(np.int64)})

    share = min(1.0, SAMPLE_DOCS / max(rows, 1))
    found = texts.sample(share, seed=5).select("text").mapInPandas(leads, "lead long").toPandas()["lead"]
    lead = np.sort(found.to_numpy(np.int64).view(np.uint64))
    if not len(lead):
        return np.zeros(0, np.uint64)
    return np.unique(lead[np.linspace(0, len(lead) - 1, buckets + 1).astype(int)[1:-1]])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and the ``kept`` bytes of every document."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_chunks = max(2 * partitions(spark), -(-size["bytes"] // CHUNK_BYTES))
    buckets = max(partitions(spark), n_chunks // 2)
    splitters = splitters_of(texts, buckets, size["rows"])
    chunk = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(n_chunks)).cast("int")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID)))
    chunks = texts.select(F.col("doc_id").cast("string"), "text", key.alias("key"), chunk.alias("chunk"))
    repeated = _repeated(_fingerprints(chunks, buckets))
    removed = _removed(_stretches(chunks, repeated, splitters))  # in one plan, so that the texts are dealt out once
    return _results(chunks, removed).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
