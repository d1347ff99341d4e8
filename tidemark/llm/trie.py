"""The trie of conversations that begin alike, by an LCP-aware mergesort.

A conversation is a key, 24 bytes a turn. Spark deals the keys in ranges of their order; each task sorts what it gets in runs
that carry, with every key, how many turns it shares with the one before (its LCP) and only the turns after those. A loser
tree merges the runs: two keys that share a different number of turns with the last one out are in order without a look at
them, otherwise they are compared from there on. The merged stream keeps the path to its last conversation open; when the
next one leaves a node, the node is finished and goes out. Nodes that go on into other ranges, those above the first or the last key of a
range, are few: their parts are stitched in the order of the ranges by the same open path.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, new_path
from .token_files import open_path

#: Bytes of a turn in a key: 128 bits of its role and text, and the bytes of its text.
TURN = 24
ROOT = bytes(16)
#: Bytes of keys that a task gets, about; of a run; and of the runs that it holds before it writes them to the shared folder.
RANGE_BYTES, RUN_BYTES, HELD_BYTES = 64 << 20, 8 << 20, 192 << 20


def turn_token(role: str | None, text: bytes | None) -> bytes:
    """What stands for a turn in a key. Null role or text is empty."""
    role, text = (role or "").encode(), text or b""
    return xxhash.xxh3_128_digest(len(role).to_bytes(8, "big") + role + text) + len(text).to_bytes(8, "big")


def turn_tokens(turns: DataFrame) -> DataFrame:
    """(conv_id long, turn, token): the texts are read once and stay where they are."""
    kind = turns.schema["turn"].dataType.simpleString()

    def run(batches):
        for b in batches:
            tokens = [turn_token(r.as_py(), t.as_py()) for r, t in zip(b.column("role"), b.column("text"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(tokens, pa.binary())], names=["conv_id", "turn", "token"])

    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"conv_id long, turn {kind}, token binary")


def conversation_keys(tokens: DataFrame) -> DataFrame:
    """(conv_id, key) from (conv_id, pos, token): tokens in the order of pos; a null token is no turn, but its conversation exists.

    Tokens are streamed in order, so a task holds one conversation's key, 24 bytes a turn, and no list of rows.
    """

    def run(batches):
        now, parts = None, []
        for b in batches:
            ids, keys = [], []
            for c, t in zip(b.column("conv_id").to_pylist(), b.column("token").to_pylist(), strict=True):
                if c != now:
                    if now is not None:
                        ids.append(now)
                        keys.append(b"".join(parts))
                    now, parts = c, []
                if t is not None:
                    parts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["conv_id", "key"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([b"".join(parts)], pa.binary())], names=["conv_id", "key"])

    return tokens.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "token").mapInArrow(run, "conv_id long, key binary")


def shared_turns(a: bytes, b: bytes, start: int = 0) -> int:
    """How many first turns a and b share; ``start`` of them are known."""
    n = min(len(a), len(b)) // TURN
    # doubling steps, then halving: C compares the bytes
    step, at = 1, start
    while step:
        end = min(at + step, n)
        if end > at and a[at * TURN : end * TURN] == b[at * TURN : end * TURN]:
            at, step = end, step * 2
        elif step == 1:
            return at
        else:
            step //= 2
        if at == n:
            return n
    return at


def sorted_run(pairs: list[tuple[bytes, int]]) -> Iterator[tuple[int, bytes, int]]:
    """(turns shared with the key before, the turns after those, conv_id) in the order of keys and ids."""
    before = b""
    for key, conv in sorted(pairs):
        h = shared_turns(before, key)
        yield h, key[h * TURN :], conv
        before = key


def _keys(run: Iterator[tuple[int, bytes, int]]) -> Iterator[tuple[int, bytes, int]]:
    """(LCP, whole key, conv_id) of a run."""
    key = b""
    for h, rest, conv in run:
        key = key[: h * TURN] + rest
        yield h, key, conv


def _before(a: list, b: list) -> bool:
    """Whether a comes before b; both hold [LCP with the last one out, key, conv_id]. The later one's LCP becomes that with the earlier."""
    if a[0] != b[0]:
        return a[0] > b[0]
    h = shared_turns(a[1], b[1], a[0])
    first = (a[1][h * TURN : (h + 1) * TURN], a[2]) <= (b[1][h * TURN : (h + 1) * TURN], b[2])
    (b if first else a)[0] = h
    return first


def merged(runs: list[Iterator[tuple[int, bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """(LCP with the one before, key, conv_id) of all runs in one order, by a loser tree."""
    runs = [_keys(r) for r in runs]
    n = len(runs)
    take = lambda k: list(x) if (x := next(runs[k], None)) is not None else None
    heads = [take(k) for k in range(n)]
    losers = [-1] * n

    def play(k: int, at: int) -> int:
        """k goes up from its leaf; at each node the loser stays."""
        while at:
            other = losers[at]
            if other < 0:
                losers[at] = k
                return -1
            if heads[other] is not None and (heads[k] is None or not _before(heads[k], heads[other])):
                losers[at], k = k, other
            at //= 2
        return k

    winner = -1
    for k in range(n):
        up = play(k, (k + n) // 2)
        winner = up if up >= 0 else winner
    while n and heads[winner] is not None:
        yield tuple(heads[winner])
        heads[winner] = take(winner)
        winner = play(winner, (winner + n) // 2)


@dataclass
class Node:
    """An open node: the sums of its conversations and of its finished children so far."""

    token: bytes
    id: bytes
    at: int = 0
    edge: bool = False
    conv: int | None = None
    n_convs: int = 0
    n_children: int = 0
    n_leaves: int = 0
    saved: int = 0
    #: Ids of the conversations that end here, as little-endian longs, in parts; or what is hashed of them.
    ends: list[bytes] = field(default_factory=list)
    hashed: object = None
    #: The last child that is finished and waits for this node's conv_id.
    waits: tuple | None = None

    def add(self, conv: int, n_convs: int, n_children: int, n_leaves: int, saved: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n_convs, self.n_children, self.n_leaves, self.saved = self.n_convs + n_convs, self.n_children + n_children, self.n_leaves + n_leaves, self.saved + saved

    def hash_ends(self) -> None:
        """Ids come in ascending order: what is hashed needn't be kept."""
        for ids in self.ends:
            text = b",".join(map(b"%d".__mod__, np.frombuffer(ids, "<i8").tolist()))
            if self.hashed is None:
                self.hashed = hashlib.sha256(text)
            else:
                self.hashed.update(b"," + text)
        self.ends = []


class Path:
    """The path to the last conversation. out gets finished nodes as rows, part the edges, whose sums are not complete here."""

    def __init__(self, out, part=None):
        self.open, self.out, self.part, self.pushed = [Node(b"", ROOT, edge=part is not None)], out, part, 0

    def push(self, token: bytes, edge: bool = False) -> None:
        self.pushed += 1
        self.open.append(Node(token, xxhash.xxh3_128_digest(self.open[-1].id + token), self.pushed, edge))

    def back_to(self, depth: int) -> None:
        """Nodes below the depth are finished; their sums go up, but for edges."""
        while len(self.open) > depth + 1:
            self._close(self.open.pop())

    def finish(self) -> None:
        """The last key's path goes on in other ranges, if there are any."""
        for x in self.open:
            x.edge = self.part is not None
        self.back_to(0)
        self._close(self.open.pop())

    def _close(self, x: Node) -> None:
        depth = len(self.open)
        if x.waits is not None:  # the last child learns this node's conv_id, if it is certain
            self.out(*x.waits, None if x.edge else x.conv, x.id)
        if x.edge:
            self.part(x, depth)
            return
        x.hash_ends()
        leaves = x.n_leaves if x.n_children else 1
        saved = x.saved + (x.n_convs - 1) * int.from_bytes(x.token[16:], "big")
        row = (x.id, x.conv, depth, x.n_convs, x.n_children, leaves, saved, (x.hashed or hashlib.sha256()).hexdigest())
        if not self.open:
            self.out(*row, None, None)
            return
        p = self.open[-1]
        if p.waits is not None:
            self.out(*p.waits, None, p.id)
        p.waits = row
        p.add(x.conv, x.n_convs, 1, leaves, saved)


NODES = ("id binary", "conv_id long", "depth long", "n_convs long", "n_children long", "n_leaves long", "saved_tokens long", "ends_sha256 string", "parent_conv_id long", "parent_id binary")
PARTS = ("part long", "at long", "p_depth long", "token binary", "p_conv long", "p_convs long", "p_children long", "p_leaves long", "p_saved long", "ends binary")
_KIND = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
_names = lambda columns: [c.split()[0] for c in columns]


def _batch(rows: list[tuple], columns: tuple[str, ...]) -> pa.RecordBatch:
    at = zip(*rows, strict=True) if rows else [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(x, _KIND[c.split()[1]]) for x, c in zip(at, columns, strict=True)], names=_names(columns))


def _write_run(path: str, run: Iterator[tuple[int, bytes, int]]) -> None:
    system, at = open_path(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(at) as f:
        block = []
        for x in run:
            block.append(x)
            if len(block) == 4096:
                pickle.dump(block, f)
                block = []
        pickle.dump(block, f)
        pickle.dump(None, f)


def _read_run(path: str) -> Iterator[tuple[int, bytes, int]]:
    system, at = open_path(path)
    with system.open_input_stream(at, buffer_size=1 << 16) as f:
        while (block := pickle.load(f)) is not None:
            yield from block


def _runs(batches, folder: str, run_bytes: int, held_bytes: int) -> tuple[list, list[str]]:
    """Sorted runs of what a task gets: those beyond the bound are written to the shared folder and read back in blocks."""
    runs, files, pairs, size, held = [], [], [], 0, 0

    def close():
        nonlocal pairs, size, held
        if held < held_bytes:
            runs.append(iter(list(sorted_run(pairs))))
            held += size
        else:
            files.append(f"{folder}/{TaskContext.get().taskAttemptId()}-{len(files)}")
            _write_run(files[-1], sorted_run(pairs))
            runs.append(_read_run(files[-1]))
        pairs, size = [], 0

    for b in batches:
        for key, conv in zip(b.column("key"), b.column("conv_id").to_pylist(), strict=True):
            pairs.append((key.as_py(), conv))
            size += len(pairs[-1][0]) + 128
            if size >= run_bytes:
                close()
    if pairs:
        close()
    return runs, files


def trie_nodes(keys: DataFrame, range_bytes: int = RANGE_BYTES, run_bytes: int = RUN_BYTES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """The nodes (NODES) of the trie of (conv_id, key): one row a prefix of whole turns, the root included."""
    spark = keys.sparkSession
    total = keys.agg(F.sum(F.length("key") + 128).alias("n")).first()["n"] or 0
    n = max(1, -(-total // range_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = new_path(spark, "conversation-runs")
    blank = [(None,) * len(NODES), (None,) * len(PARTS)]

    def merge(batches):
        part, rows = TaskContext.get().partitionId(), []
        runs, files = _runs(batches, folder, run_bytes, held_bytes)
        path = Path(lambda *row: rows.append(row + blank[1]), lambda x, depth: rows.append(blank[0] + (part, x.at, depth, x.token, x.conv, x.n_convs, x.n_children, x.n_leaves, x.saved, b"".join(x.ends))))
        any_yet = False
        for h, key, conv in merged(runs):
            path.back_to(h)
            for at in range(h * TURN, len(key), TURN):
                path.push(key[at : at + TURN], edge=not any_yet)
            any_yet = True
            path.open[-1].add(conv, 1, 0, 0, 0)
            path.open[-1].ends.append(conv.to_bytes(8, "little", signed=True))
            if len(rows) >= 4096:
                yield _batch(rows, NODES + PARTS)
                rows.clear()
        if any_yet:
            path.finish()
        yield _batch(rows, NODES + PARTS)
        for f in files:
            open_path(f)[0].delete_file(open_path(f)[1])

    ranges = keys.select("key", "conv_id").repartitionByRange(n, "key", "conv_id")
    made = materialize(ranges.mapInArrow(merge, ", ".join(NODES + PARTS)), "trie-ranges")

    def stitch(batches):
        rows = []
        path = Path(lambda *row: rows.append(row))
        first = True
        for b in batches:
            for _, _, depth, token, conv, n_convs, n_children, n_leaves, saved, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
                first = False
                if len(path.open) <= depth or path.open[depth].token != token:
                    path.back_to(depth - 1)
                    path.push(token)
                x = path.open[depth]
                if conv is not None:
                    x.add(conv, n_convs, n_children, n_leaves, saved)
                if ends:
                    x.ends.append(ends)
                    x.hash_ends()
            yield _batch(rows, NODES)
            rows.clear()
        if not first:
            path.finish()
        yield _batch(rows, NODES)

    edges = made.where("part IS NOT NULL").select(*_names(PARTS)).repartition(1).sortWithinPartitions("part", "at")
    stitched = materialize(edges.mapInArrow(stitch, ", ".join(NODES)), "trie-edges")
    return made.where("part IS NULL").select(*_names(NODES)).unionByName(stitched)


def prefix_trie(tokens: DataFrame, **sizes: int) -> DataFrame:
    """Nodes of the trie of conversations, from (conv_id, pos, token): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a sequence of turns with which conversations begin, the root the empty one; conv_id is the smallest of them.
    Tokens come from ``turn_tokens``: two turns are the same if 128 bits of role and text, and the text's length, are. The
    order of turns is that of pos, ties by token; a null token is no turn but makes its conversation exist; rows without a conv_id
    are left out; an empty table gives no node. saved_tokens is what sharing saves below a node, in bytes of text: each
    node's conversations but one, times its last text. ends_sha256 is the hash of the ids that end at a node, in order.

    Only keys, 24 bytes a turn, are shuffled. Ranges are cut within equal conversations too, by conv_id, so that a group of
    copies of any size is dealt over tasks. A task holds its range's runs, less the turns that neighbours share, and past a bound
    writes them to the shared folder. One conversation is one key: a task holds 24 bytes for each of its turns. The nodes above
    the ends of ranges, as many for a range as its first and last conversations have turns, are stitched by one task that holds the open path; of
    conversations that end at such a node it gets the ids, 8 bytes each, as their hash must be taken in one order.
    """
    nodes = trie_nodes(materialize(conversation_keys(tokens), "conversation-keys"), **sizes)
    nodes = materialize(nodes, "trie-nodes")
    told = "parent_id IS NULL OR parent_conv_id IS NOT NULL"
    parents = nodes.where("n_children > 0").select(F.col("id").alias("p_id"), F.col("conv_id").alias("p_conv"))
    late = nodes.where(f"NOT ({told})").join(parents, F.col("parent_id") == F.col("p_id")).withColumn("parent_conv_id", F.col("p_conv"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return nodes.where(told).select(*columns).unionByName(late.select(*columns))


def grafted(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, token): every conversation c begins with the first h turns of conversation c - c % 5 and goes on with its own
    after its first h, for h = crc32 of c in decimal, modulo 9. Turns are ordered by turn, null first, ties by content."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "token")
    turns = materialize(turn_tokens(conversations).select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "token"), "turn-tokens")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    ids = turns.select("conv_id").distinct()
    own = turns.where(F.col("pos") > h)
    heads = turns.where("pos <= 8 AND conv_id % 5 = 0").select(F.col("conv_id").alias("base"), "pos", "token")
    begun = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("of"), h.alias("h")).join(heads, (F.col("of") == F.col("base")) & (F.col("pos") <= F.col("h")))
    there = ids.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("token"))
    return own.unionByName(begun.select("conv_id", "pos", "token")).unionByName(there)
