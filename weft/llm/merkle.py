"""Merkle dataset manifest with stored SHA-256 midstates.

Every document is a leaf; the leaves of a source, in order, make a tree of fan-out 16, and the
sources' roots make another.  A parent's hash runs over the hex digests of its children, one
block of SHA-256 each, so the state before every child slot can be kept: each node of the
manifest stores, beside its digest, its parent's state just before it.  To fold a changed leaf,
the matching state is resumed with the replacement and the right siblings only; what lies left
of it is never hashed again.

The trees are built in passes.  A pass cuts each tree's nodes into groups of ``16 ** depth``
consecutive ones, whose levels one task builds on arrays; the groups' roots are the nodes of
the next pass.  A source of any size is thus spread over tasks, and a pass leaves a 4096th of
the rows.  On the way back down each group gets the path of its root: a state, the run of
siblings and a slot for every level above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weft.llm import sha256
from weft.llm.common import numbered, prepare, stored

FAN = 16
#: levels that one task builds above a node: groups of 16 ** DEPTH nodes
DEPTH = 3
#: rows that a task works on at a time, at about
ROWS = 1 << 14
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, grp long, level int, local long, digest binary, state binary, name string, doc_id long, changed binary"
PATH = "path binary, subroot binary, root binary"


# ---- leaves ----------------------------------------------------------------------------------

def _digest(columns: dict[str, Column]) -> Column:
    """SHA-256 over all fields: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns.values()]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame, changes: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``tree, doc_id, digest, changed``: the leaf of every document and, if ``changes`` gives new
    values of some fields, the leaf with them (null where it is the same)."""
    own = {c: F.col(c) for c in fields}
    digest = _digest(own)
    changed = _digest(own | changes) if changes else F.lit(None).cast("binary")
    rows = docs.select(F.col("source").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), changed.alias("changed"))
    return rows.withColumn("changed", F.when(F.col("changed") != F.col("digest"), F.col("changed")))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their tree: add the partition, and the place in the tree inside it."""
    part, last, n = TaskContext.get().partitionId(), object(), 0
    for b in batches:
        at = []
        for tree in b.column("tree").to_pylist():
            n = n + 1 if tree == last else 0
            last = tree
            at.append(n)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(at), pa.int64()), pa.array(at, pa.int64())], names=[*b.schema.names, "_p", "_at"])


def ordered(rows: DataFrame) -> DataFrame:
    """Add ``idx``, the place of a leaf in its tree (by doc_id, null first, ties by digest).

    Range partitions; a tree that goes on in the next partition continues there with the sum of
    its earlier counts.  Only a partition's first tree can: the broadcast has a row a partition.
    """
    order = ["tree", "doc_id", "digest"]
    t = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_count, "tree string, doc_id long, digest binary, changed binary, _p long, _at long")
    t = stored(t, "merkle-leaves")
    sizes = t.groupBy("_p", "tree").agg((F.max("_at") + 1).alias("n"))
    before = F.sum("n").over(W.partitionBy("tree").orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    base = sizes.select(F.col("_p").alias("_q"), F.col("tree").alias("_t"), before.alias("_base")).where("_base > 0")
    out = t.join(F.broadcast(base), (F.col("_p") == F.col("_q")) & F.col("tree").eqNullSafe(F.col("_t")), "left")
    return out.select("tree", (F.col("_at") + F.coalesce("_base", F.lit(0))).alias("idx"), "digest", F.lit(None).cast("string").alias("name"), "doc_id", "changed")


# ---- groups of rows ---------------------------------------------------------------------------

def _runs(t: pa.RecordBatch) -> np.ndarray:
    """Number of the (tree, grp) run of every row."""
    codes = pc.dictionary_encode(t.column("tree"), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    grp = t.column("grp").to_numpy()
    new = (codes[1:] != codes[:-1]) | (grp[1:] != grp[:-1])
    return np.r_[0, np.cumsum(new)] if len(grp) else np.zeros(0, np.int64)


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int = ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups, of ``least`` rows or one group at least, with the runs."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.concat_batches(held)
        g = _runs(t)
        cut = int(np.searchsorted(g, g[-1]))
        if cut:
            yield t.slice(0, cut), g[:cut]
        held, rows, least = [t.slice(cut)], rows - cut, max(ROWS, 2 * (rows - cut))
    if rows:
        t = pa.concat_batches(held)
        yield t, _runs(t)


def _words(column: pa.Array) -> np.ndarray:
    """32 bytes a row as columns (8, n); null is zero."""
    return sha256.from_bytes(b"".join(x if x is not None else bytes(32) for x in column.to_pylist()))


def _binary(x: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    return pa.array([v if k else None for v, k in zip(sha256.to_bytes(x), np.ones(x.shape[1], bool) if known is None else known)], pa.binary())


# ---- building ---------------------------------------------------------------------------------

def _build(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Nodes ``(tree, grp, idx, digest, ...)`` in order -> the nodes of their groups' levels.  The
    first group of a tree stops at a single node, the others have ``depth`` levels."""
    size = FAN ** depth
    for t, g in _whole_groups(batches):
        grp = t.column("grp").to_numpy()
        row = np.arange(t.num_rows)  # a row of the node's group
        local, digest, out = t.column("idx").to_numpy() - grp * size, _words(t.column("digest")), []
        for level in range(depth + 1):
            alone = (grp[row] == 0) & (np.bincount(g)[g] == 1) if level < depth else np.ones(len(g), bool)
            parent = np.cumsum(np.r_[0, (g[1:] != g[:-1]) | (local[1:] // FAN != local[:-1] // FAN)]) if len(g) else g
            before = np.zeros_like(digest)
            live, slot = ~alone, local % FAN
            n = int(parent[-1]) + 1 if len(parent) else 0
            state = sha256.start(n)
            block = sha256.hex_blocks(digest) if live.any() else None
            for k in range(FAN if live.any() else 0):
                at = np.flatnonzero(live & (slot == k))
                if len(at):
                    before[:, at] = state[:, parent[at]]
                    state[:, parent[at]] = sha256.compress(before[:, at], block[:, at])
            out.append((row, np.full(len(g), level), local, digest, before, live))
            if not live.any():
                break
            first = np.flatnonzero(live & (slot == 0))
            blocks = np.bincount(parent[live], minlength=n)[parent[first]]
            digest = sha256.finish(state[:, parent[first]], blocks)
            g, local, row = g[first], local[first] // FAN, row[first]
        at = pa.array(np.concatenate([o[0] for o in out]))
        leaf = np.concatenate([o[1] for o in out]) == 0
        keep = pa.array(np.where(leaf, np.r_[np.arange(t.num_rows), np.zeros(len(leaf) - t.num_rows, np.int64)], -1), mask=~leaf)
        yield pa.RecordBatch.from_arrays(
            [t.column("tree").take(at), t.column("grp").take(at), pa.array(np.concatenate([o[1] for o in out]).astype(np.int32)), pa.array(np.concatenate([o[2] for o in out])),
             _binary(np.concatenate([o[3] for o in out], axis=1)), _binary(np.concatenate([o[4] for o in out], axis=1), np.concatenate([o[5] for o in out])),
             *[t.column(c).take(keep) for c in ("name", "doc_id", "changed")]],
            names=["tree", "grp", "level", "local", "digest", "state", "name", "doc_id", "changed"])


def _passes(nodes: DataFrame, depth: int, name: str) -> list[DataFrame]:
    """The node tables of all passes over ``nodes`` (tree, idx, digest, name, doc_id, changed)."""
    out = []
    while True:
        rows = nodes.withColumn("grp", F.floor(F.col("idx") / FAN ** depth))
        rows = rows.repartition("tree", "grp").sortWithinPartitions("tree", "grp", "idx")
        out.append(stored(rows.mapInArrow(lambda it: _build(it, depth), NODE), f"merkle-{name}{len(out)}"))
        if out[-1].where("grp > 0").isEmpty():
            return out
        none = [F.lit(None).cast(k).alias(c) for c, k in (("name", "string"), ("doc_id", "long"), ("changed", "binary"))]
        nodes = out[-1].where("state is null").select("tree", F.col("grp").alias("idx"), "digest", *none)


@dataclass
class Manifest:
    """Node tables by pass, from the leaves up; ``sources`` per source tree, ``top`` over the sources.
    A node's ``state`` is that of its parent's hash before it (null: the root of its group)."""
    sources: list[DataFrame]
    top: list[DataFrame]
    depth: int

    def root(self) -> DataFrame:
        """``root``: one row, none for an empty dataset."""
        return self.top[-1].where("state is null").select(F.lower(F.hex("digest")).alias("root"))


def manifest(docs: DataFrame, changes: dict[str, Column] | None = None, depth: int = DEPTH) -> Manifest:
    """Build the manifest of ``docs (doc_id, source, lang, n_chars, text)``.

    Fields may be null; a null source is a tree of its own, the first; null ids come first in
    their source; rows that share an id are ordered by their leaf, equal rows are leaves each.
    ``changes`` keeps a second leaf per document, for ``fold``.
    """
    prepare(docs.sparkSession)
    sources = _passes(ordered(leaves(docs, changes)), depth, "sources")
    subroots = sources[-1].where("state is null").select(F.col("tree").alias("name"), "digest")
    ranked = numbered(subroots, "merkle-subroots", "name")
    top = ranked.select(F.lit("").alias("tree"), F.col("rank").alias("idx"), "digest", "name", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("changed"))
    return Manifest(sources, _passes(top, depth, "top"), depth)


# ---- folding ----------------------------------------------------------------------------------

def _entry(slot: int, state: bytes, run: list[bytes]) -> bytes:
    return bytes([slot, len(run)]) + state + b"".join(run)


def _entries(path: bytes) -> list[tuple[int, bytes, list[bytes]]]:
    out, at = [], 0
    while at < len(path):
        slot, n = path[at], path[at + 1]
        run = path[at + 34:at + 34 + 32 * n]
        out.append((slot, path[at + 2:at + 34], [run[i:i + 32] for i in range(0, 32 * n, 32)]))
        at += 34 + 32 * n
    return out


class _Groups:
    """Whole groups: a path row (level -1) and the nodes by level each."""

    def __init__(self, t: pa.RecordBatch, g: np.ndarray, depth: int):
        self.t, self.g = t, g
        self.level, self.local = t.column("level").to_numpy(), t.column("local").to_numpy()
        self.n = int(g[-1]) + 1
        at = g * (depth + 3) + self.level + 1
        self.first = np.searchsorted(at, np.arange(self.n)[:, None] * (depth + 3) + np.arange(depth + 3))  # rows of level -1, 0, ...
        head = t.take(pa.array(self.first[:, 0]))
        self.paths = [_entries(p) for p in head.column("path").to_pylist()]
        self.subroots, self.roots = (head.column(c).to_pylist() for c in ("subroot", "root"))

    def rows_of(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First row and end of a level, per group."""
        return self.first[:, level + 1], self.first[:, level + 2]


def _descend(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """The path of every lowest node of a group, up to the root of all."""
    size = FAN ** depth
    for t, g in _whole_groups(batches):
        x = _Groups(t, g, depth)
        digests, states = t.column("digest").to_pylist(), t.column("state").to_pylist()
        names, trees, grp = (t.column(c).to_pylist() for c in ("name", "tree", "grp"))
        tails = [b"".join(_entry(*e) for e in p) for p in x.paths]
        out = []
        for k in range(x.n):
            spans = [(int(a[k]), int(b[k])) for a, b in map(x.rows_of, range(depth + 1))]
            for row in range(*spans[0]):
                local, path = int(x.local[row]), []
                for a, b in spans:
                    if a == b or states[a + local] is None:
                        break
                    lo = local - local % FAN
                    path.append(_entry(local % FAN, states[a + local], digests[a + lo:min(b, a + lo + FAN)]))
                    local //= FAN
                out.append((trees[row], names[row], grp[row] * size + int(x.local[row]), b"".join(path) + tails[k], x.subroots[k] or digests[row], x.roots[k]))
        kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        cols = list(zip(*out)) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["tree", "name", "idx", "path", "subroot", "root"])


FOLDED = "doc_id long, leaf binary, subroot binary, root binary, proof_sha256 binary, folded_root binary"


def _resume(state: np.ndarray, cur: np.ndarray, block_at, right: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Parents' digests: the states go on with the replacements, then their right siblings
    (``block_at(which, k)``: blocks of the k-th ones)."""
    state = sha256.compress(state, sha256.hex_blocks(cur))
    for k in range(1, FAN):
        at = np.flatnonzero(right >= k)
        if not len(at):
            break
        state[:, at] = sha256.compress(state[:, at], block_at(at, k))
    return sha256.finish(state, total)


def _fold(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    for t, g in _whole_groups(batches):
        x = _Groups(t, g, depth)
        digest, state = _words(t.column("digest")), _words(t.column("state"))
        known = t.column("state").is_valid().to_numpy(zero_copy_only=False)
        block = sha256.hex_blocks(digest)
        hexed = [d.hex().encode() if d is not None else b"" for d in t.column("digest").to_pylist()]
        doc = np.flatnonzero(x.level == 0)
        of, local, cur = g[doc], x.local[doc], digest[:, doc].copy()
        changed = t.column("changed").take(pa.array(doc))
        at = np.flatnonzero(changed.is_valid().to_numpy(zero_copy_only=False))
        if len(at):
            cur[:, at] = _words(changed.take(pa.array(at)))
        proofs = [[] for _ in doc]
        for level in range(depth):
            a, b = (v[of] for v in x.rows_of(level))
            pos = np.where(a < b, a + local, 0)
            on = np.flatnonzero((a < b) & known[pos])
            if not len(on):
                break
            pos, lo = pos[on], (a + local - local % FAN)[on]
            hi = np.minimum(b[on], lo + FAN)
            cur[:, on] = _resume(state[:, pos], cur[:, on], lambda at, k, p=pos: block[:, p[at] + k], hi - pos - 1, hi - lo)
            for i, p, s, e in zip(on.tolist(), pos.tolist(), lo.tolist(), hi.tolist()):
                proofs[i] += hexed[s:p]
                proofs[i] += hexed[p + 1:e]
            local = local // FAN
        for j in range(max(map(len, x.paths), default=0)):
            with_j = np.array([len(p) > j for p in x.paths])
            step = [p[j] if len(p) > j else (0, bytes(32), []) for p in x.paths]
            slot, total = np.array([s for s, _, _ in step]), np.array([len(r) for _, _, r in step])
            before = sha256.from_bytes(b"".join(s for _, s, _ in step))
            runs = sha256.hex_blocks(sha256.from_bytes(b"".join(b"".join(r) + bytes(32 * (FAN - len(r))) for _, _, r in step)))
            on = np.flatnonzero(with_j[of])
            k0 = of[on]
            cur[:, on] = _resume(before[:, k0], cur[:, on], lambda at, k, q=k0: runs[:, q[at] * FAN + slot[q[at]] + k], (total - slot - 1)[k0], total[k0])
        tails = [b"".join(d.hex().encode() for s, _, r in p for i, d in enumerate(r) if i != s) for p in x.paths]
        proof = [hashlib.sha256(b"".join(p) + tails[k]).digest() for p, k in zip(proofs, of.tolist())]
        take = lambda v: pa.array([v[k] for k in of.tolist()], pa.binary())
        rows = pa.array(doc)
        yield pa.RecordBatch.from_arrays([t.column("doc_id").take(rows), t.column("digest").take(rows), take(x.subroots), take(x.roots), pa.array(proof, pa.binary()), _binary(cur)],
                                         names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])


def _with_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes of a pass and, ahead of each group, its path."""
    head = paths.withColumn("level", F.lit(-1)).withColumn("local", F.lit(0).cast("long"))
    rows = nodes.unionByName(head, allowMissingColumns=True)
    return rows.repartition("tree", "grp").sortWithinPartitions("tree", "grp", "level", "local")


def fold(m: Manifest) -> DataFrame:
    """Per leaf ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` (hex): the root
    recomputed from the changed leaf (else the leaf itself), its stored states and siblings."""
    depth, down = m.depth, "tree string, name string, idx long, " + PATH
    paths = m.top[-1].where("state is null").select("tree", "grp", F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    for k, nodes in enumerate([*reversed(m.top), *reversed(m.sources[1:])]):
        below = _with_paths(nodes, paths).mapInArrow(lambda it: _descend(it, depth), down)
        inside = k < len(m.top) - 1  # the next pass is of the same tree
        if k < len(m.top):
            below = below.withColumn("subroot", F.lit(None).cast("binary")) if inside else below.withColumn("tree", F.col("name")).withColumn("idx", F.lit(0).cast("long"))
        paths = stored(below.select("tree", F.col("idx").alias("grp"), "path", "subroot", "root"), f"merkle-paths{k}")
    out = _with_paths(m.sources[0], paths).mapInArrow(lambda it: _fold(it, depth), FOLDED)
    return out.select("doc_id", *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered(docs: DataFrame) -> dict[str, Column]:
    """Where 5 divides the crc32 of the decimal doc_id, A-Z of the text are lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return {"text": F.when(hit, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))}
