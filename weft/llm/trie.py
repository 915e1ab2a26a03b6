"""Prefix trie of conversations by range-partition splitters.

A conversation's path is the string of its turns' digests; in the order of the paths every
prefix is one contiguous range of conversations.  The paths are range-partitioned and sorted.
A node lies in one shard whole unless it is a prefix of a boundary: of the last path of one
shard and the first of the next.  Those nodes are the skeleton, the trie of the splitters.  A
sorted list and the lengths of its neighbours' common prefixes determine its trie, so the
skeleton that is broadcast is the depth that the first and last paths of each shard share, and
the depth shared across each boundary.

Each shard walks its paths in order with a stack and finishes all its other nodes.  For a
skeleton node it gives partial aggregates, which are summed; a node's subtree in the skeleton is
a range of boundaries, so what its skeleton descendants add is a difference of prefix sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weft.llm.common import prepare, stored, words_of
from weft.operators.skew import split_lookup

#: a turn's digest: the first bytes of SHA-256 of its role and text
WIDTH = 16
#: conversations of one block share the first turns of the block's first
BLOCK = 20
#: characters of a piece of an ended-members list
PIECE = 1 << 16


# ---- conversations to paths --------------------------------------------------------------------

def turn_digest(role: Column, text: Column) -> Column:
    """Hex digest of a turn; the role's length keeps (role, text) apart."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)


def paths(conversations: DataFrame, block: int = BLOCK, heads: int = 4) -> DataFrame:
    """``conv_id, path, words``: the rebuilt conversations, one row each.

    Turns are ordered by ``turn``, null first, ties by the turn's digest; equal rows are turns
    each.  Null roles and texts are empty.  Rows without a conv_id belong to no conversation and
    are left out.  A conversation's digests (20 bytes a turn) are one row; texts are not gathered.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").isNotNull().alias("late"), F.col("turn").alias("turn"), turn_digest(role, text).alias("d"), F.size(words_of(text)).alias("w"))
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")) \
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own = stored(own.select("conv_id", F.transform("t", lambda x: F.struct(x["d"].alias("d"), x["w"].alias("w"))).alias("t")), "trie-turns")
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(block))
    first = own.where(F.pmod("conv_id", F.lit(block)) == 0).select(F.col("conv_id").alias("_base"), F.slice("t", 1, heads - 1).alias("_head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    none = F.array().cast("array<struct<d:string,w:int>>")
    both = own.join(first, base == F.col("_base"), "left")  # a block's conversations at most on a key
    turns = F.concat(F.slice(F.coalesce("_head", none), F.lit(1), h.cast("int")), F.slice("t", (h + 1).cast("int"), F.size("t")))
    both = both.select("conv_id", turns.alias("t"))
    return both.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["d"]), "")).alias("path"), F.transform("t", lambda x: x["w"]).alias("words"))


def common_depth(a: bytes, b: bytes, width: int = WIDTH) -> int:
    """Turns that two paths share from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // width
    lo, hi = 0, n // width  # the first lo turns are equal, the first hi + 1 are not
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo * width:mid * width] == b[lo * width:mid * width]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        first, last, after = ([x or b"" for x in b.column(c).to_pylist()] for c in ("first", "last", "next"))
        yield pa.RecordBatch.from_arrays([b.column("_p"), *[pa.array([common_depth(x, y) for x, y in zip(u, v)], pa.int64()) for u, v in ((first, last), (last, after))]],
                                         names=["_p", "inside", "across"])


def skeleton(rows: DataFrame) -> tuple[list[int], list[int], list[int]]:
    """The shards that hold rows, in order, the depth shared by the first and the last path of
    each, and the depth shared across each boundary: three numbers per partition, a number set
    by configuration.  The sorted ends and their common prefixes are the trie of the splitters."""
    ends = rows.groupBy("_p").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    ends = ends.withColumn("next", F.lead("first").over(W.orderBy("_p")))  # a row per partition
    found = sorted(tuple(r) for r in ends.mapInArrow(_boundaries, "_p long, inside long, across long").collect())
    return [r[0] for r in found], [r[1] for r in found], [r[2] for r in found[:-1]]


# ---- one shard ---------------------------------------------------------------------------------

class Shard:
    """The nodes of one shard, in the order of their first member: a walk over the sorted paths."""

    def __init__(self, number: int, inside: list[int], shared: list[int]):
        self.number, self.inside, self.shared = number, inside, shared
        self.left = shared[number - 1] if number else -1  # deepest node shared with the shard before
        self.right = shared[number] if number < len(shared) else -1
        self.depth, self.parent, self.low, self.members, self.words = ([] for _ in range(5))
        self.ends: dict[int, list] = {}  # node: hash and pieces of the ids that end there
        self.stack: list[int] = []  # the nodes of the last path
        self.path = None

    def add(self, conv: int, path: bytes, words: list[int]) -> None:
        new = self.path is None
        keep = 0 if new else common_depth(self.path, path) + 1
        if keep <= len(path) // WIDTH:
            del self.stack[keep:]
            for d in range(keep, len(path) // WIDTH + 1):
                self.depth.append(d)
                self.parent.append(self.stack[-1] if d else -1)
                self.words.append(words[d - 1] if d else 0)
                self.low.append(conv)
                self.members.append(0)
                self.stack.append(len(self.depth) - 1)
            if new:
                self.first = list(self.stack)
        self.path, node = path, self.stack[-1]
        self.members[node] += 1
        self.low[node] = min(self.low[node], conv)
        end = self.ends.get(node)
        if end is None:
            end = self.ends[node] = [[], 0, []]  # open ids, their characters, full pieces
        end[0].append(str(conv))
        end[1] += len(end[0][-1]) + 1
        if end[1] > PIECE:
            end[2].append(",".join(end[0]))
            end[0], end[1] = [], 0

    def first_shard(self, depth: int) -> int:
        """The shard where the node of this depth on the left boundary begins."""
        at = self.number
        while at and self.shared[at - 1] >= depth:
            at -= 1
            if self.inside[at] < depth:
                break  # on that shard's last path, not on its first
        return at

    def finish(self) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Totals of all nodes, and for skeleton nodes the shard where they begin (else -1)."""
        n = len(self.depth)
        depth, parent, words = (np.array(x, dtype=np.int64) for x in (self.depth, self.parent, self.words))
        low, members = np.array(self.low, dtype=np.int64), np.array(self.members, dtype=np.int64)
        begins = np.full(n, -1, np.int64)
        begins[[k for d, k in enumerate(self.stack) if d <= self.right]] = self.number
        for d, k in enumerate(self.first):
            if d <= self.left:
                begins[k] = self.first_shard(d)
        children, leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        local = begins < 0
        order = np.argsort(-depth, kind="stable")
        cut = np.flatnonzero(np.diff(depth[order])) + 1
        for level in np.split(order, cut):  # from the deepest up: children before parents
            mine = level[local[level]]
            leaves[mine] += children[mine] == 0
            saved[mine] += (members[mine] - 1) * words[mine]
            up = parent[level]
            if up[0] < 0:
                break
            np.minimum.at(low, up, low[level])
            np.add.at(members, up, members[level])
            np.add.at(leaves, up, leaves[level])
            np.add.at(saved, up, saved[level])
            np.add.at(children, parent[mine], 1)  # skeleton children are counted once, later
        return {"depth": depth, "parent": parent, "words": words, "low": low, "members": members, "children": children, "leaves": leaves, "saved": saved}, begins, local


NODES = ("kind int, conv_id long, depth long, begins long, parent_begins long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, words long, shard long, seq long, ends string")


def _emit(s: Shard) -> Iterator[pa.RecordBatch]:
    """Rows of a finished shard.  Kind 0: nodes that are whole; 1: nodes whose parent is in the
    skeleton; 2: partial aggregates of skeleton nodes; 3: pieces of their ended members."""
    x, begins, local = s.finish()
    n = len(begins)
    up = x["parent"]
    parent_begins = np.where(up >= 0, begins[up], -1)
    kind = np.where(~local, 2, np.where(parent_begins >= 0, 1, 0))
    ends = []
    empty = hashlib.sha256(b"").hexdigest()
    for k in range(n):
        e = s.ends.get(k)
        if not local[k]:
            ends.append(None)
        elif e is None:
            ends.append(empty)
        else:
            ends.append(hashlib.sha256(",".join([*e[2], *([",".join(e[0])] if e[0] else [])]).encode()).hexdigest())
    none = np.full(n, True)
    hide = (up < 0) | (kind != 0)
    for lo in range(0, n, 4096):
        r = slice(lo, lo + 4096)
        cols = [pa.array(kind[r].astype(np.int32)), pa.array(x["low"][r]), pa.array(x["depth"][r]), pa.array(begins[r]), pa.array(parent_begins[r]),
                pa.array(x["low"][up][r], mask=hide[r]), pa.array(x["members"][r]), pa.array(x["children"][r]), pa.array(x["leaves"][r]), pa.array(x["saved"][r]),
                pa.array(x["words"][r]), pa.array(np.full(len(up[r]), s.number)), pa.array(np.zeros(len(up[r]), np.int64), mask=none[r]), pa.array(ends[r], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in NODES.split(", ")])
    pieces = []
    for k in np.flatnonzero(~local).tolist():
        e = s.ends.get(k)
        for i, piece in enumerate([*e[2], *([",".join(e[0])] if e[0] else [])] if e else []):
            pieces.append({"kind": 3, "depth": int(x["depth"][k]), "begins": int(begins[k]), "shard": s.number, "seq": i, "ends": piece})
    if pieces:
        names = [c.split()[0] for c in NODES.split(", ")]
        types = [pa.int32()] + [pa.int64()] * 12 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([p.get(c) for p in pieces], t) for c, t in zip(names, types)], names=names)


def _shards(batches: Iterator[pa.RecordBatch], shards: list[int], inside: list[int], shared: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (_p, path, conv_id): the nodes of each shard."""
    number, now, open_ = {p: i for i, p in enumerate(shards)}, None, None
    for b in batches:
        for p, conv, path, words in zip(*(b.column(c).to_pylist() for c in ("_p", "conv_id", "path", "words"))):
            if p != open_:
                if now is not None:
                    yield from _emit(now)
                now, open_ = Shard(number[p], inside, shared), p
            now.add(conv, path or b"", words)
    if now is not None:
        yield from _emit(now)


# ---- the skeleton ------------------------------------------------------------------------------

def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (depth, begins, shard, seq): the hash of each node's ids, piece by piece."""
    key, h = None, None
    out: list[tuple] = []

    def batch():
        cols = list(zip(*out)) if out else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()))], names=["depth", "begins", "ends_sha256"])

    for b in batches:
        for d, a, piece in zip(*(b.column(c).to_pylist() for c in ("depth", "begins", "ends"))):
            if (d, a) != key:
                if key is not None:
                    out.append((*key, h.hexdigest()))
                key, h = (d, a), hashlib.sha256()
            else:
                h.update(b",")
            h.update(piece.encode())
        yield batch()
        out.clear()
    if key is not None:
        out.append((*key, h.hexdigest()))
        yield batch()


def _skeleton_nodes(rows: DataFrame) -> DataFrame:
    """Whole skeleton nodes from the shards' partial aggregates: ``begins`` and the columns of the result."""
    key = ["depth", "begins"]
    part = rows.where("kind = 2").groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.max("parent_begins").alias("parent_begins"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("local_children"),
        F.sum("n_leaves").alias("local_leaves"), F.sum("saved_tokens").alias("local_saved"), F.max("words").alias("words"), F.max("shard").alias("last"))
    part = stored(part, "trie-skeleton")
    below = part.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_begins").alias("begins")).agg(F.count("*").alias("inner"))
    node = part.join(below, key, "left").withColumn("n_children", F.col("local_children") + F.coalesce("inner", F.lit(0)))
    node = stored(node.withColumn("own_leaf", (F.col("n_children") == 0).cast("long")).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("words")), "trie-own")
    # a node's skeleton descendants begin in its own first shard, deeper, or in a later one before its last
    per = node.groupBy(F.col("begins").alias("_b")).agg(F.sum("own_leaf").alias("l"), F.sum("own_saved").alias("s"))
    run = W.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)  # a row per shard
    per = stored(per.select("_b", F.sum("l").over(run).alias("l"), F.sum("s").over(run).alias("s"), F.lead("_b").over(W.orderBy("_b")).alias("_next")), "trie-sums")
    deeper = W.partitionBy("begins").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    node = node.withColumn("in_leaf", F.sum("own_leaf").over(deeper)).withColumn("in_saved", F.sum("own_saved").over(deeper))
    last = node.agg(F.max("last")).first()[0] or 0
    # sums over the nodes that begin in a shard up to ``at``, for every shard: a row per partition
    sums = per.withColumn("_next", F.coalesce(F.col("_next"), F.lit(last + 1).cast("long")))
    sums = F.broadcast(sums.select(F.explode(F.sequence("_b", F.col("_next") - 1)).alias("_at"), "l", "s"))
    hi = sums.select((F.col("_at") + 1).alias("last"), F.col("l").alias("hi_l"), F.col("s").alias("hi_s"))
    lo = sums.select(F.col("_at").alias("begins"), F.col("l").alias("lo_l"), F.col("s").alias("lo_s"))
    node = node.join(hi, "last", "left").join(lo, "begins", "left")
    inner = F.when(F.col("last") > F.col("begins") + 1, F.lit(1)).otherwise(0)
    out = node.withColumn("n_leaves", F.col("local_leaves") + F.col("in_leaf") + inner * F.coalesce(F.col("hi_l") - F.col("lo_l"), F.lit(0))) \
        .withColumn("saved_tokens", F.col("local_saved") + F.col("in_saved") + inner * F.coalesce(F.col("hi_s") - F.col("lo_s"), F.lit(0)))
    pieces = rows.where("kind = 3").select(*key, "shard", "seq", "ends").repartition(*key).sortWithinPartitions(*key, "shard", "seq")
    ended = stored(pieces.mapInArrow(_hashes, "depth long, begins long, ends_sha256 string"), "trie-ended")
    out = out.join(ended, key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return stored(out.select(*key, "parent_begins", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "trie-inner")


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(rebuilt: DataFrame) -> DataFrame:
    """The nodes of the trie over ``conv_id, path, words``: one row per distinct prefix.

    ``conv_id`` is the smallest member, ``n_convs`` counts the conversations that start with the
    prefix, ``saved_tokens`` sums (members - 1) times words over the subtree, ``ends_sha256`` is
    over the ids that end there.  No conversations, no nodes.
    """
    prepare(rebuilt.sparkSession)
    order = ["path", "conv_id"]
    rows = stored(rebuilt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id().cast("long")), "trie-paths")
    shards, inside, shared = skeleton(rows)
    if not shards:
        return rebuilt.sparkSession.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in RESULT))
    dealt = rows.repartitionByRange(len(shards), "_p").sortWithinPartitions("_p", *order)
    nodes = stored(dealt.mapInArrow(lambda it: _shards(it, shards, inside, shared), NODES), "trie-nodes")
    whole = nodes.where("kind = 0").withColumnRenamed("ends", "ends_sha256").select(*RESULT)
    if not shared:
        return whole
    inner = _skeleton_nodes(nodes)
    open_ = nodes.where("kind = 1").withColumnRenamed("ends", "ends_sha256").select(*[c for c in RESULT if c != "parent_conv_id"], "parent_begins")
    open_ = open_.unionByName(inner.select(*[c for c in RESULT if c != "parent_conv_id"], "parent_begins"))
    open_ = open_.withColumn("_d", F.col("depth") - 1)
    above = inner.select(F.col("depth").alias("_d"), F.col("begins").alias("parent_begins"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    met = split_lookup(open_.where("depth > 0"), above, ["_d", "parent_begins"], rows_of="_n")
    root = open_.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return whole.unionByName(met.select(*RESULT)).unionByName(root.select(*RESULT))


def conversation_trie(conversations: DataFrame, block: int = BLOCK, heads: int = 4) -> DataFrame:
    return trie(paths(conversations, block, heads))
