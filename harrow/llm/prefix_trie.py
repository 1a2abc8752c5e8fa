"""The prefix trie of conversations: a node for every distinct sequence of first turns.

A conversation is the string of its turns' digests (128 bits each). The strings are sorted over the cluster; a row's
LCP is the number of turns it shares with the row before. Every node of the trie is an interval of this order, and
the intervals are those of the Cartesian tree over the LCP array: an entry's interval reaches to the nearest smaller
entries on both sides, entries of equal LCP with the same interval are one node, and the depths between a node's LCP
and its parent's are nodes with the same interval.

Blocks. Each range of the sort is a block. A stack finds the nearest smaller values within it in one streaming pass:
an entry closes the deeper nodes on the stack, each of which then has its interval and has summed members, least id,
leaves and savings from the nodes below. What has no smaller value within the block stays open: the nodes on the path of the
block's first conversation to the left, those of its last one to the right, and down to the block's minimum both
belong to one path. A block hands on these two paths and its minimum, and one more pass of the same stack
over the blocks, a few rows each, settles them: it closes what lies deeper than the next minimum and joins what does not. Children of an
open node are written at once, with a handle for the parent's id that a join fills in.

The conversations that end at a node follow each other, so that the hash of their ids is taken as they pass. Only
the ids of a run at the edge of a block go on to the second pass, which hashes them in order as they stream in.

Memory: a stack of one conversation's depth, ``PENDING`` children a node, ``RUN`` ids of a run. A conversation is one
row, of 40 bytes a turn (2 GiB hold some 50 million turns).

Defined results: turns are ordered by ``turn``, null first, and ties by their digest; null role and text are empty;
rows without an id are in no conversation; repeated rows are turns of their own; without conversations there is no
node, not even a root. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, parallelism, written

#: Children kept with an open node before they are written with its handle, ids of a run that are held, rows of a batch.
PENDING, RUN, ROWS = 4096, 1 << 16, 1 << 14
#: Hexadecimal digits of a turn's digest.
TURN = 32
NODE, CHILD, PARENT, OPEN = range(4)
FIELDS = [("kind", pa.int32()), ("block", pa.int32()), ("serial", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("seq", pa.int64()), ("data", pa.binary())]
SCHEMA = ", ".join(f"{n} {'int' if t == pa.int32() else 'bigint' if t == pa.int64() else str(t)}" for n, t in FIELDS)
NONE = hashlib.sha256(b"").hexdigest()
#: Where, among the messages of a block, those about its last conversation begin.
LAST = 1 << 40


def sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns: one row a conversation, its turns (digest, chars) in order."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).alias("chars")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def spliced(seqs: DataFrame, donor: Column, shared: Column, most: int) -> DataFrame:
    """seqs with each conversation's first turns, shared(conv_id) <= most of them, taken from the conversation
    donor(conv_id) (as many as it has) instead of its own."""
    heads = seqs.select(F.col("conv_id").alias("donor"), F.slice("turns", 1, most).alias("head"))
    rows = seqs.withColumns({"donor": donor, "shared": shared.cast("int")}).join(heads, "donor", "left")
    none = F.slice("turns", 1, 0)
    own = F.expr("slice(turns, shared + 1, greatest(size(turns), 1))")
    return rows.select("conv_id", F.concat(F.coalesce(F.expr("slice(head, 1, shared)"), none), own).alias("turns"))


class Node:
    __slots__ = ("depth", "chars", "n", "least", "saved", "leaves", "children", "ends", "sha", "left", "serial", "told", "pending", "handles")

    def __init__(self, depth: int, chars: int, left: bool = False) -> None:
        self.depth, self.chars, self.left = depth, chars, left
        self.n = self.saved = self.leaves = self.children = self.serial = 0
        self.least = self.ends = self.sha = None
        self.told = False
        self.pending: list[list] = []
        self.handles: list[tuple[int, int]] = []

    def add(self, n: int, least: int | None, saved: int, leaves: int, children: int) -> None:
        self.n, self.saved, self.leaves, self.children = self.n + n, self.saved + saved, self.leaves + leaves, self.children + children
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    def hash(self, ids: bytes) -> None:
        if self.sha is None:
            self.sha = hashlib.sha256(ids)
        else:
            self.sha.update(b"," + ids)

    def state(self) -> list:
        return [self.n, self.least, self.saved, self.leaves, self.children, self.chars, self.ends, self.serial if self.told else None]


class Stack:
    """The open nodes of a path, and the rows that closed ones have become."""

    def __init__(self, block: int) -> None:
        self.block, self.path, self.rows = block, [], []
        self.serial = 0

    def push(self, chars: int, left: bool = False) -> Node:
        node = Node(len(self.path), chars, left)
        self.serial += 1
        node.serial = self.serial
        self.path.append(node)
        return node

    def row(self, kind: int, **values) -> None:
        self.rows.append([kind, self.block, *[values.get(n) for n, _ in FIELDS[2:]]])

    def tell(self, node: Node) -> None:
        """Writes the children at hand, to be joined with the node's id."""
        for r in node.pending:
            self.rows.append([CHILD, self.block, node.serial, *r])
        node.told = node.told or bool(node.pending)
        node.pending = []

    def close(self, node: Node) -> None:
        """The node's interval has ended on both sides."""
        leaves, saved = (node.leaves if node.children else 1), node.saved + (node.n - 1) * node.chars
        ends = node.sha.hexdigest() if node.sha else node.ends or NONE
        own = [node.least, node.depth, None, node.n, node.children, leaves, saved, ends, None, None]
        for r in node.pending:
            r[2] = node.least
            self.rows.append([NODE, self.block, None, *r])
        handles = [*node.handles, *([(self.block, node.serial)] if node.told else [])]
        self.rows += [[PARENT, b, s, node.least, *[None] * 9] for b, s in handles]
        if self.path:
            up = self.path[-1]
            up.add(node.n, node.least, saved, leaves, 1)
            up.pending.append(own)
            if len(up.pending) >= PENDING and self.block >= 0:
                self.tell(up)
        else:
            self.rows.append([NODE, self.block, None, *own])

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*self.rows, strict=True), FIELDS, strict=True)], [n for n, _ in FIELDS])
        self.rows = []
        return out


def common(a: str, b: str) -> int:
    """How many turns two keys share."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * TURN] == b[: mid * TURN] else (low, mid - 1)
    return low


class Block(Stack):
    """One range of sorted conversations."""

    def __init__(self, block: int) -> None:
        super().__init__(block)
        self.first = self.key = None
        self.left: list[Node] = []
        self.least = 0
        self.ids: list[int] = []
        self.run = self.part = 0

    def spill(self) -> None:
        """The ids at hand of the run now open go on to the second pass."""
        if not self.ids:
            return
        self.part += 1
        text = ",".join(map(str, self.ids)).encode()
        if self.key != self.first:
            self.path[-1].hash(text)
        self.row(OPEN, serial=self.run, seq=self.part + (0 if self.key == self.first else LAST), data=text)
        self.ids = []

    def end_run(self) -> None:
        if self.key == self.first:
            self.spill()
        elif self.ids:
            self.path[-1].hash(",".join(map(str, self.ids)).encode())
        self.ids = []

    def add(self, conv: int, key: str, chars: list[int]) -> None:
        if key != self.key:
            if self.key is None:
                self.first, self.least = key, len(chars)
                self.push(0, True)
                for c in chars:
                    self.push(c, True)
            else:
                self.end_run()
                p = common(self.key, key)
                self.least = min(self.least, p)
                while len(self.path) > p + 1:
                    node = self.path.pop()
                    if node.left:
                        self.left.append(node)
                    else:
                        self.close(node)
                for c in chars[p:]:
                    self.push(c)
            self.run += 1
            self.key = key
        self.path[-1].add(1, conv, 0, 0, 0)
        self.ids.append(conv)
        if len(self.ids) >= RUN:
            self.spill()

    def end(self) -> None:
        """Hands on the paths of the first and the last conversation."""
        self.spill()
        both = [x for x in self.path if x.left]
        right = self.path[len(both) :]
        for node in [*self.left, *self.path]:
            self.tell(node)
        if right:
            right[-1].sha = None
        for node in right:
            node.ends = node.sha.hexdigest() if node.sha else None
        firsts = [*both, *reversed(self.left)]
        self.row(OPEN, serial=0, seq=0, data=json.dumps({"key": self.first, "nodes": [x.state() for x in firsts]}).encode())
        self.row(OPEN, serial=self.run, seq=LAST, data=json.dumps({"key": self.key, "least": self.least, "nodes": [x.state() for x in right]}).encode())


class Top(Stack):
    """The blocks one after the other."""

    def __init__(self) -> None:
        super().__init__(-1)
        self.key, self.run = None, 0

    def down_to(self, depth: int) -> None:
        while len(self.path) > depth + 1:
            self.close(self.path.pop())

    def join(self, block: int, states: list[list], start: int) -> None:
        for depth, (n, least, saved, leaves, children, chars, ends, handle) in enumerate(states, start):
            node = self.path[depth] if depth < len(self.path) else self.push(chars)
            node.add(n, least, saved, leaves, children)
            node.ends = node.ends or ends
            if handle is not None:
                node.handles.append((block, handle))

    def add(self, block: int, serial: int, seq: int, data: bytes) -> None:
        if seq == 0:
            x = json.loads(data)
            if self.key is not None:
                self.down_to(common(self.key, x["key"]))
            self.join(block, x["nodes"], 0)
        elif seq == LAST:
            x = json.loads(data)
            self.down_to(x["least"])
            self.join(block, x["nodes"], x["least"] + 1)
            self.key, self.run = x["key"], serial
        elif seq < LAST or serial == self.run:  # else a long run that ended within its block
            self.path[-1].hash(data)


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """conv_id (of the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256
    of every node. seqs: conv_id, turns (digest, chars)."""
    spark = seqs.sparkSession
    keys = written(seqs.select("conv_id", F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars")), "conversations")
    size = keys.agg(F.sum(F.length("key").cast("long") + 100).alias("n")).first()["n"] or 0
    parts = max(1, min(-(-size // (16 << 20)), 1 << 17), min(parallelism(spark), -(-size // (256 << 10))))
    dealt = keys.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").select(F.spark_partition_id().alias("block"), "conv_id", "key", "chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            if b.num_rows and state is None:
                state = Block(b.column(0)[0].as_py())
            for i in range(0, b.num_rows, 4096):
                for row in zip(*[b.column(c).slice(i, 4096).to_pylist() for c in (1, 2, 3)], strict=True):
                    state.add(*row)
                    if len(state.rows) >= ROWS:
                        yield state.batch()
        if state:
            state.end()
            yield state.batch()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Top()
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in range(4)], strict=True):
                state.add(*row)
                if len(state.rows) >= ROWS:
                    yield state.batch()
        if state.path:
            state.down_to(-1)
            yield state.batch()

    pieces = written(arrow_map(dealt, run, SCHEMA), "trie")
    opened = pieces.where(F.col("kind") == OPEN).select("block", "serial", "seq", "data")
    top = written(arrow_map(opened.repartition(1).sortWithinPartitions("block", "seq"), settle, SCHEMA), "trie-top")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = pieces.unionByName(top)
    parents = rows.where(F.col("kind") == PARENT).select("block", "serial", F.col("conv_id").alias("up"))
    told = rows.where(F.col("kind") == CHILD).join(parents, ["block", "serial"]).select(*[F.col("up").alias(n) if n == "parent_conv_id" else F.col(n) for n in names])
    return rows.where(F.col("kind") == NODE).select(*names).unionByName(told)
