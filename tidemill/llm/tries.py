"""Prefix trie of conversations: which beginnings are shared, and what sharing saves.

1. Every conversation becomes one key: 16 bytes of a SHA-256 per turn (role and
   text), side by side, so that a common beginning of turns is a common beginning
   of bytes. Texts are not shuffled, only their checksums and sizes. Equal
   conversations become one row for each ``SLICE`` ids, so that a conversation
   copied a billion times is a few thousand rows.
2. Keys are range-partitioned and sorted. A task takes its range in blocks of
   about ``BLOCK_TURNS`` turns. In a block, neighbours are linked by the length
   of their common beginning (LCP) and the links are taken in descending depth by
   union-find: every merge of components makes a branching node, and the
   turns between a component's last node and the merge make its chain.
3. Only nodes on the beginning of a block's first or last key may go on in
   another block. The forest of a block is contracted to these two spines: all
   else below them is final and is left as sums at the spine. A stack merges
   the spines of a task's blocks as they come; what is popped is final unless it
   lies on the task's first key.
4. The spines of all tasks, two paths a task, are merged the same way in one
   small task, and children of spine nodes learn their parent's smallest id.

A spine node is known by a chained checksum of its path. Rows of the last task
number the tasks times the turns of a conversation, whatever the input.

``shared_heads`` gives the conversations that the query asks for: the first
turns of every fifth, then each one's own.

Cases: turns are ordered by number (null first), then role, then the text's
checksum; a null role or text is empty; rows without ``conv_id`` belong to no
conversation and are left out; repeated rows are further turns; a conversation
without turns is a member of the root alone; an empty table has no root and gives
no rows; further columns are ignored. A conversation is one cell of checksums, as
a text is one cell: its turns, however many, meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import SMALL_BYTES, settled

WIDTH = 16  # bytes of a turn's checksum
SLICE_BITS = 16  # ids of one row share all but so many bits
BLOCK_TURNS = 1 << 18
FAMILY, HEADS = 5, 9
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_ROWS = (
    "final boolean, spine boolean, path binary, parent_path binary, part int, side int, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends_sha256 string"
)
NO_ENDS = hashlib.sha256(b"").hexdigest()
_ROOT = bytes(WIDTH)


# -- conversations as keys --------------------------------------------------------
def _turns(conversations: DataFrame) -> DataFrame:
    """``base, conv_id, turns``: each conversation's turns in order, as checksum and size."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        base.alias("base"),
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            F.substring(F.sha2(content.cast("binary"), 256), 1, 2 * WIDTH).alias("key"),
            F.octet_length(text).cast("long").alias("size"),
        ).alias("t"),
    )
    # Dealt by the family alone, so that a family's members meet without another shuffle.
    sized = rows.repartition(F.col("base"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size")))
    return sized.groupBy("base", "conv_id").agg(turns.alias("turns"))


def shared_heads(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` where a conversation's first turns come from the first of its family of five."""
    turns = _turns(conversations)
    own = F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, HEADS - 1))
    head = F.coalesce(F.max(own).over(Window.partitionBy("base")), F.array().cast(turns.schema["turns"].dataType))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    both = turns.select("conv_id", "turns", head.alias("head"), n.alias("n"))
    rest = F.slice("turns", F.col("n") + 1, F.size("turns") + 1)
    return both.select("conv_id", F.concat(F.slice("head", F.lit(1), F.col("n")), rest).alias("turns"))


def _keys(conversations: DataFrame) -> DataFrame:
    """``key, slice, sizes, n, low, ids``: equal conversations together, by ranges of ids."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("key")
    rows = conversations.select(key, F.shiftright("conv_id", SLICE_BITS).alias("slice"), F.transform("turns", lambda t: t["size"]).alias("sizes"), "conv_id")
    ids: Column = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    return rows.groupBy("key", "slice").agg(F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("low"), ids.alias("ids"))


# -- one block ----------------------------------------------------------------------
def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common at their beginning, by halving."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def paths(key: bytes) -> list[bytes]:
    """The checksum of every beginning of a key, from the root on."""
    out = [_ROOT]
    for at in range(0, len(key), WIDTH):
        out.append(hashlib.blake2b(out[-1] + key[at : at + WIDTH], digest_size=WIDTH).digest())
    return out


class Block:
    """Sorted distinct keys with their members: the forest of their beginnings by union-find."""

    def __init__(self, keys: list[bytes], sizes: list[np.ndarray], n: list[int], low: list[int], ends: list[str]):
        m = len(keys)
        self.sizes, self.ends = sizes, ends
        self.lcp = [0] + [common_turns(a, b) for a, b in zip(keys[:-1], keys[1:], strict=True)]
        self.first, self.last = paths(keys[0]), paths(keys[-1])
        # One component for each key to begin with; every field is that of a component's top node.
        self.root = list(range(m))
        self.top = [len(k) // WIDTH for k in keys]
        self.n, self.low, self.key = list(n), list(low), list(range(m))
        self.kids, self.leaves, self.saved = [0] * m, [0] * m, [0] * m
        self.end = list(ends)  # members that end at the top node
        self.below: list[list[int]] = [[] for _ in keys]  # rows whose parent is the top node
        self.left, self.right = [i == 0 for i in range(m)], [i == m - 1 for i in range(m)]
        self.rows: list[list] = []  # final nodes
        self.spine: list[list] = []  # nodes that may go on elsewhere

    def _find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def _lift(self, c: int, depth: int) -> None:
        """Finish a component's nodes below ``depth``, so that the next above is the node at ``depth``."""
        sizes = self.sizes[self.key[c]]
        while self.top[c] > depth:
            t = self.top[c]
            left, right = self.left[c], self.right[c]
            size = int(sizes[t - 1]) if t else 0
            if left or right:
                path = (self.first if left else self.last)[t]
                for row in self.below[c]:
                    self.rows[row][1] = path
                self.spine.append([t, path, 0 if left else 1, self.n[c], self.low[c], self.kids[c], self.leaves[c], self.saved[c], size, self.end[c]])
                self.kids[c], self.leaves[c], self.saved[c], self.below[c] = 0, 0, 0, []
            else:
                for row in self.below[c]:
                    self.rows[row][0] = self.low[c]
                self.leaves[c] += not self.kids[c]
                self.saved[c] += (self.n[c] - 1) * size
                self.rows.append([None, None, t, self.low[c], self.n[c], self.kids[c], self.leaves[c], self.saved[c], self.end[c]])
                self.kids[c], self.below[c] = 1, [len(self.rows) - 1]
            self.end[c] = NO_ENDS
            self.top[c] = t - 1

    def build(self) -> None:
        for i in sorted(range(1, len(self.lcp)), key=lambda i: -self.lcp[i]):
            depth, a, b = self.lcp[i], self._find(i - 1), self._find(i)
            self._lift(a, depth)
            self._lift(b, depth)
            self.root[b] = a
            self.n[a] += self.n[b]
            self.low[a] = min(self.low[a], self.low[b])
            self.kids[a] += self.kids[b]
            self.leaves[a] += self.leaves[b]
            self.saved[a] += self.saved[b]
            self.end[a] = self.end[b] if self.end[a] == NO_ENDS else self.end[a]
            if len(self.below[a]) < len(self.below[b]):
                self.below[a], self.below[b] = self.below[b], self.below[a]
            self.below[a] += self.below[b]
            self.below[b] = []
            self.left[a] |= self.left[b]
            self.right[a] |= self.right[b]
        self._lift(self._find(0), -1)
        self.spine.sort(key=lambda s: (s[2], s[0]))


# -- spines ---------------------------------------------------------------------------
class Spine:
    """A path from the root, merged with further paths in order; finished nodes leave it."""

    def __init__(self, first: list[bytes] | None = None):
        self.stack: list[list] = []
        self.first = first  # paths that may go on before this task's range
        self.final: list[list] = []
        self.open: list[list] = []

    def _pop(self) -> None:
        depth, path, side, n, low, kids, leaves, saved, size, end = self.stack.pop()
        above = self.stack[-1] if self.stack else None
        if self.first is not None and depth < len(self.first) and self.first[depth] == path:
            self.open.append([depth, path, 0, n, low, kids, leaves, saved, size, end, above[1] if above else None])
            return
        leaves += not kids
        saved += (n - 1) * size
        self.final.append([depth, path, above[1] if above else None, n, low, kids, leaves, saved, end])
        if above:
            above[5] += 1
            above[6] += leaves
            above[7] += saved

    def add(self, node: list) -> None:
        """The next node in preorder: one more part of the node on the path, or a new end of it."""
        depth = node[0]
        if depth < len(self.stack) and self.stack[depth][1] == node[1]:
            own = self.stack[depth]
            own[3] += node[3]
            own[4] = min(own[4], node[4])
            for i in (5, 6, 7):
                own[i] += node[i]
            own[9] = node[9] if own[9] == NO_ENDS else own[9]
            return
        while len(self.stack) > depth:
            self._pop()
        self.stack.append(list(node))

    def close(self) -> None:
        """End of a task: what is left on the path may go on behind it."""
        if self.first is None:
            while self.stack:
                self._pop()
            return
        for i, node in enumerate(self.stack):
            shared = node[0] < len(self.first) and self.first[node[0]] == node[1]
            self.open.append([node[0], node[1], 0 if shared else 1, *node[3:], self.stack[i - 1][1] if i else None])


def _frame(part: int, rows: list[list], final: list[list], spine: list[list]) -> pd.DataFrame:
    """Final nodes of blocks, final nodes of spines, and open nodes of spines as rows."""
    out = [(True, False, None, r[1], part, 0, r[3], r[2], r[0], r[4], r[5], r[6], r[7], 0, r[8]) for r in rows]
    out += [(True, True, r[1], r[2], part, 0, r[4], r[0], None, r[3], r[5], r[6], r[7], 0, r[8]) for r in final]
    out += [(False, True, r[1], r[10], part, r[2], r[4], r[0], None, r[3], r[5], r[6], r[7], r[8], r[9]) for r in spine]
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in _ROWS.split(", ")])
    return frame.astype({"parent_conv_id": "Int64"})


def _distinct(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Keys with their sizes, members, smallest id and checksum of ids, from rows sorted by key and slice."""
    key = sizes = digest = None
    n = low = 0
    for batch in batches:
        for r in batch.itertuples(index=False):
            if key is not None and r.key == key:
                digest.update(b",")
            else:
                if key is not None:
                    yield key, sizes, n, low, digest.hexdigest()
                key, sizes, digest, n, low = bytes(r.key), r.sizes, hashlib.sha256(), 0, r.low
            digest.update(r.ids.encode())
            n, low = n + r.n, min(low, r.low)
    if key is not None:
        yield key, sizes, n, low, digest.hexdigest()


def _forest(block_turns: int):
    """One task: its range block by block, as final nodes and the spines left open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, spine, held, turns = TaskContext.get().partitionId(), None, [], 0

        def block() -> pd.DataFrame:
            nonlocal spine
            forest = Block(*map(list, zip(*held, strict=True)))
            forest.build()
            spine = spine or Spine(forest.first)
            for node in forest.spine:
                spine.add(node)
            final, spine.final = spine.final, []
            return _frame(part, forest.rows, final, [])

        for item in _distinct(batches):
            held.append(item)
            turns += len(item[1]) + 1
            if turns >= block_turns:
                yield block()
                held, turns = [], 0
        if held:
            yield block()
        if spine:
            spine.close()
            yield _frame(part, [], spine.final, spine.open)

    return run


def _merge_spines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The open spines of all tasks, in order, to final nodes."""
    spine = Spine()
    for batch in batches:
        for r in batch.itertuples(index=False):
            spine.add([r.depth, bytes(r.path), 0, r.n_convs, r.conv_id, r.n_children, r.n_leaves, r.saved_tokens, r.size, r.ends_sha256])
        yield _frame(-1, [], spine.final, [])
        spine.final = []
    spine.close()
    yield _frame(-1, [], spine.final, [])


# -- the trie -------------------------------------------------------------------------
def nodes(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Every node of the trie of ``conversations`` (``conv_id, turns``)."""
    keys = _keys(conversations)
    dealt = keys.repartitionByRange("key").sortWithinPartitions("key", "slice")
    found = settled(dealt.select("key", "sizes", "n", "low", "ids").mapInPandas(_forest(block_turns), _ROWS))
    open_ = found.where(~F.col("final"))
    merged = settled(open_.repartition(1).sortWithinPartitions("part", "side", "depth").mapInPandas(_merge_spines, _ROWS))
    every = found.where("final").unionAll(merged)
    # Children of spine nodes learn the parent's id; spine nodes are few, but sent out only if their count proves it.
    spines = every.where("spine").select(F.col("path").alias("parent_path"), F.col("conv_id").alias("above"))
    small = spines.count() * 64 <= SMALL_BYTES
    named = every.join(F.broadcast(spines) if small else spines, "parent_path", "left")
    return named.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*_NODE)
