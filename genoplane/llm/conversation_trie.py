"""Trie of conversation prefixes: a Cartesian tree over the LCP array of the sorted conversations.

A conversation is the sequence of 16-byte digests of its turns. The distinct sequences
are sorted; the LCP array holds how many turns each shares with the one before it. The
nodes of the trie are intervals of that order: a maximal interval whose LCP values are at
least d holds just the sequences with one prefix of d turns. All such intervals are found
by nearest smaller values, block by block in parallel: each task reads its sorted block
once with a stack, gives out the intervals that begin and end inside, and reports the few
that touch an edge of the block. These edges, with the block's record lows (its minimum
last), are merged in order of the blocks. Depths with one interval are one entry of the
stack, a node of the Cartesian tree; equal LCP values meet in it, and the depths that it
stands for are put in when it is given out.

What is gathered: a task holds the stack of one path and one sequence (16 bytes and a
length for each turn; texts are not kept); the driver holds the paths at both edges of
each block, so as many as there are partitions. Copies of a conversation are counted
before the shuffle; their ids reach the digest of a node in sorted runs, joined as a
stream. A parent's name goes to its children by a join that is salted by the child's
number, so a node with most of the children is spread.

Defined cases. Turns are ordered by turn (null first), then by digest where turns tie; a
null role or text is empty. Repeated rows are turns each. Rows with a null conversation
id belong to no conversation. A rebuilt conversation without turns is a member of the
root only. An empty table has no node.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import tidy, written

#: Bytes of a turn's digest.
DIGEST = 16
GROUP = 100
MOST_SHARED = 6
#: Ids in one run of text, and children of one salted part of a parent.
RUN_IDS = 8192
SALTED = 10_000
NO_ENDS = hashlib.sha256(b"").digest()

NODE = "uid string, conv_id long, depth long, parent_uid string, salt long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, and its turns in order as an array of (turn, digest, cp): 16 bytes of role and text, and the text's code points."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    # The role's length goes first, so no other pair of role and text gives the same bytes.
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    turn = F.struct(F.col("turn"), F.unhex(F.substring(F.sha2(both, 256), 1, 2 * DIGEST)).alias("digest"), F.length(text).alias("cp"))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, shared: Column | None = None) -> DataFrame:
    """conv_id and turns, its first h turns taken from the conversation that opens its group; ``shared`` is h."""
    own = written(turns_of(conversations), "turns")
    most = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED if shared is None else shared
    heads = own.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, MOST_SHARED).alias("opening"))
    rows = own.withColumn("h", most.cast("int")).join(heads, F.col("head") == F.col("conv_id") - F.col("conv_id") % GROUP, "left")
    opening = F.when(F.col("opening").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("opening", 1, F.col("h")))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rows.select("conv_id", F.concat(opening, rest).alias("turns"))


def sequences(conversations: DataFrame) -> DataFrame:
    """The distinct sequences: path (all digests in one binary), cps, n, the least conv_id, and the digest of all conv_ids in order."""
    joined = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    rows = conversations.select("conv_id", joined.alias("path"), F.transform("turns", lambda t: t["cp"]).alias("cps"))
    rows = written(rows.withColumn("seq", F.unhex(F.sha2("path", 256))), "paths")
    of = rows.groupBy("seq").agg(F.first("path").alias("path"), F.first("cps").alias("cps"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    return of.join(digests(rows.select("seq", "conv_id")), "seq").drop("seq")


def digests(ids: DataFrame) -> DataFrame:
    """seq and ends, the SHA-256 of its conv_ids in order: sorted runs of text first, in parallel, then one stream a sequence."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            starts = [k for k in range(len(seqs)) if k == 0 or seqs[k] != seqs[k - 1]]
            parts = [(a, min(a + RUN_IDS, end)) for at, end in zip(starts, [*starts[1:], len(seqs)], strict=True) for a in range(at, end, RUN_IDS)]
            yield pa.RecordBatch.from_pydict({"seq": pa.array([seqs[a] for a, _ in parts], pa.binary()), "first": pa.array([convs[a] for a, _ in parts], pa.int64()), "ids": [",".join(map(str, convs[a:b])) for a, b in parts]})

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            for seq, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if seq != now:
                    if sha:
                        done.append((now, sha.digest()))
                    now, sha = seq, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"seq": pa.array([d[0] for d in done], pa.binary()), "ends": pa.array([d[1] for d in done], pa.binary())})
        if sha:
            yield pa.RecordBatch.from_pydict({"seq": pa.array([now], pa.binary()), "ends": pa.array([sha.digest()], pa.binary())})

    made = ids.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(runs, "seq binary, first long, ids string")
    return made.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(stream, "seq binary, ends binary")


class Held:
    """What is known of one stack entry: depths after the entry below it up to ``deep``, all with the same members.

    n, least, leaves, saved and kids are those of the deepest of its depths, so far.
    """

    __slots__ = ("cps", "deep", "edge", "ends", "kids", "leaves", "least", "n", "names", "saved", "uid")

    def __init__(self, deep: int, cps: list[int], uid: str, edge: bool = False):
        self.deep, self.cps, self.uid, self.edge = deep, cps, uid, edge
        self.n = self.leaves = self.saved = self.kids = 0
        self.least, self.ends = None, None
        #: Entries of single blocks that this one took in: (uid, children there).
        self.names: list[tuple[str, int]] = []

    def take(self, n: int, least: int | None, leaves: int, saved: int, kids: int) -> None:
        self.n += n
        self.leaves += leaves
        self.saved += saved
        self.kids += kids
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)


class Path:
    """The stack: the intervals that are open, from the root down. Closed ones go to ``emit`` as nodes."""

    def __init__(self, emit, apart: bool = False):
        """apart: entries that touch the block's left edge are kept in ``left`` when they close, and nothing of theirs goes up."""
        self.emit, self.apart, self.left, self.made = emit, apart, [], 0
        self.name = uuid.uuid4().hex
        self.stack = [Held(0, [], self.uid(), apart)]

    def uid(self) -> str:
        self.made += 1
        return f"{self.name}-{self.made}"

    def cut(self, depth: int) -> None:
        """Closes all that is deeper than depth."""
        while (top := self.stack[-1]).deep > depth:
            above = self.stack[-2] if len(self.stack) > 1 else None
            floor = above.deep if above else -1
            if floor < depth:
                # Part of this entry stays open: the deeper depths close, the others become their parent.
                keep = depth - floor
                above = Held(depth, top.cps[:keep], self.uid(), top.edge)
                top.cps = top.cps[keep:]
                self.stack[-1:] = [above, top]
            self.stack.pop()
            self.close(top, above)

    def close(self, top: Held, above: Held | None) -> None:
        if self.apart and top.edge:
            self.left.append(top)
            return
        if not top.kids:
            top.leaves = 1
        extra = max(top.n - 1, 0)
        whole = top.saved + extra * sum(top.cps)
        self.emit(top, above, extra)
        if above:
            above.take(top.n, top.least, top.leaves, whole, 1)

    def finish(self) -> None:
        root = self.stack[0]
        self.cut(0)
        self.close(root, None)


def add(path: Path, shared: int, cps: list[int], n: int, least: int, ends: bytes, first: bool) -> None:
    """The next sequence in order, which shares so many turns with the one before."""
    path.cut(shared)
    if len(cps) > shared:
        path.stack.append(Held(len(cps), cps[shared:], path.uid(), first and path.apart))
    top = path.stack[-1]
    top.take(n, least, 0, 0, 0)
    top.ends = ends


def common(one: bytes, other: bytes) -> int:
    """How many whole digests two paths share at their start."""
    size = min(len(one), len(other)) // DIGEST
    if one[: size * DIGEST] == other[: size * DIGEST]:
        return size
    a = np.frombuffer(one, dtype="V16", count=size)
    b = np.frombuffer(other, dtype="V16", count=size)
    return int(np.argmax(a != b))


def nodes_of(top: Held, above: Held | None, extra: int) -> list[tuple]:
    """One row for each depth of a closed entry, deepest first."""
    out, saved, depth = [], top.saved, top.deep
    for k, cp in enumerate(reversed(top.cps or [0])):
        saved += extra * cp
        bottom, head = k == 0, k == len(top.cps or [0]) - 1
        parent = above.uid if head and above else None
        out.append((
            top.uid if bottom else None, top.least, depth - k, parent, above.kids // SALTED if parent else None, None if head else top.least,
            top.n, top.kids if bottom else 1, top.leaves, saved, top.ends if bottom and top.ends else NO_ENDS,
        ))
    return out


def state_of(held: Held) -> dict:
    return {name: getattr(held, name) for name in ("deep", "cps", "uid", "edge", "n", "least", "leaves", "saved", "kids", "ends")}


def from_state(state: dict) -> Held:
    held = Held(state["deep"], list(state["cps"]), state["uid"], state["edge"])
    held.n, held.least, held.leaves, held.saved, held.kids, held.ends = (state[k] for k in ("n", "least", "leaves", "saved", "kids", "ends"))
    return held


ENTRY = "struct<deep: long, cps: array<int>, uid: string, edge: boolean, n: long, least: long, leaves: long, saved: long, kids: long, ends: binary>"
EDGES = f"first binary, last binary, closed array<{ENTRY}>, open array<{ENTRY}>"
ENTRY_ARROW = pa.struct([("deep", pa.int64()), ("cps", pa.list_(pa.int32())), ("uid", pa.string()), ("edge", pa.bool_()), *((k, pa.int64()) for k in ("n", "least", "leaves", "saved", "kids")), ("ends", pa.binary())])
NODE_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 6, pa.binary()]
NODE_NAMES = [x.split()[0] for x in NODE.split(", ")]
#: Nodes that a task gives out at once.
OUT_ROWS = 4096


def scan_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes inside a sorted block, and at its end one row with its edges."""
    out: list[tuple] = []
    path = Path(lambda top, above, extra: out.extend(nodes_of(top, above, extra)), apart=True)
    first = last = None

    def given(edges: dict | None = None) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(NODE_NAMES)
        size = len(out) + bool(edges)
        node = [pa.array([*c, *[None] * bool(edges)], t) for c, t in zip(columns, NODE_TYPES, strict=True)]
        blank = [None] * len(out)
        rest = [pa.array(blank + ([edges[k]] if edges else []), t) for k, t in (("first", pa.binary()), ("last", pa.binary()), ("closed", pa.list_(ENTRY_ARROW)), ("open", pa.list_(ENTRY_ARROW)))]
        out.clear()
        assert all(len(c) == size for c in [*node, *rest])
        return pa.RecordBatch.from_arrays([*node, *rest], names=[*NODE_NAMES, "first", "last", "closed", "open"])

    for batch in batches:
        for path_, cps, n, least, ends in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            # The first sequence's true LCP is with another block: until the merge all its depths count as new.
            add(path, common(last, path_) if last is not None else 0, cps, n, least, ends, last is None)
            first, last = path_ if first is None else first, path_
            if len(out) >= OUT_ROWS:
                yield given()
    if last is not None:
        yield given({"first": first, "last": last, "closed": [state_of(h) for h in path.left], "open": [state_of(h) for h in path.stack]})


def merge_blocks(blocks: list) -> tuple[list[tuple], list[tuple]]:
    """Nodes that touch the edge of a block, and (uid, children, conv_id) of the blocks' own entries that they took in.

    blocks: (first, last, closed, open), in order. The stack goes over their edges as over sequences:
    what lies under an entry that an earlier block began is added to it, and the next block's
    LCP and record lows close what is deeper.
    """
    out, names = [], []

    def emit(top: Held, above: Held | None, extra: int) -> None:
        out.extend(nodes_of(top, above, extra))
        names.extend((uid, kids, top.least) for uid, kids in top.names)

    path, last = Path(emit), None
    for first, end, closed, open_ in blocks:
        shared = common(last, first) if last is not None else 0
        path.cut(shared)
        closed, open_ = [from_state(s) for s in closed], [from_state(s) for s in open_]
        # The first sequence's own path, from the root down.
        chain = [h for h in open_ if h.edge] + closed[::-1]
        floor = 0
        for held in chain:
            if held.deep <= shared:
                at = placed(path, held.deep)
                at.take(held.n, held.least, held.leaves, held.saved, held.kids)
                at.names.append((held.uid, held.kids))
                at.ends = held.ends or at.ends
            else:
                held.cps = held.cps[max(shared - floor, 0) :]
                path.stack.append(held)
            floor = held.deep
        lows = [h.deep for h in open_ if h.edge]
        if closed:
            path.cut(max(lows))
        path.stack.extend(h for h in open_ if not h.edge)
        last = end
    if last is not None:
        path.finish()
    return out, names


def placed(path: Path, depth: int) -> Held:
    """The open entry whose deepest depth is this one; an entry that reaches over it is parted there."""
    for k, held in enumerate(path.stack):
        if held.deep == depth:
            return held
        if held.deep > depth:
            floor = path.stack[k - 1].deep
            upper = Held(depth, held.cps[: depth - floor], path.uid(), held.edge)
            held.cps = held.cps[depth - floor :]
            path.stack.insert(k, upper)
            return upper
    raise AssertionError("no open entry reaches this depth")


@tidy
def trie(conversations: DataFrame, shared: Column | None = None, blocks: int | None = None) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``blocks`` is the number of sorted blocks; Spark's number of shuffle partitions if not given.
    """
    spark = conversations.sparkSession
    distinct = sequences(rebuilt(conversations, shared)).select("path", "cps", "n", "least", "ends")
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = distinct.repartitionByRange(blocks, "path").sortWithinPartitions("path")
    scanned = sorted_.mapInArrow(scan_block, f"{NODE}, {EDGES}").withColumn("block", F.spark_partition_id())
    scanned = written(scanned, "scanned")
    edges = scanned.filter("last IS NOT NULL").select("block", "first", "last", "closed", "open").toArrow().sort_by("block").to_pylist()
    at_edges, names = merge_blocks([(e["first"], e["last"], e["closed"], e["open"]) for e in edges])
    nodes = scanned.filter("last IS NULL").select(*NODE_NAMES).unionByName(spark.createDataFrame(at_edges, NODE))
    inner = nodes.filter("uid IS NOT NULL").select("uid", F.col("n_children").alias("kids"), F.col("conv_id").alias("name"))
    parents = inner.unionByName(spark.createDataFrame(names, "uid string, kids long, name long"))
    parents = parents.filter("kids > 0").select(F.col("uid").alias("parent_uid"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("kids") / SALTED).cast("long"))).alias("salt"), "name")
    heads = nodes.filter("parent_uid IS NOT NULL").drop("parent_conv_id").join(parents, ["parent_uid", "salt"]).withColumnRenamed("name", "parent_conv_id")
    every = nodes.filter("parent_uid IS NULL").unionByName(heads)
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.lower(F.hex("ends")).alias("ends_sha256"))
