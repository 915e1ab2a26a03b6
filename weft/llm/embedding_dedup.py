"""Embedding near-dedup by sorted projection passes.

Equal vectors are one class.  In every pass the classes are ordered by the signs of random
projections read as one 64-bit number (ties by a hash of class and pass), and each is compared
with its neighbours in a window of that order.  The cosines are exact, in matrix products; the
pairs found in all passes are united into components.  Inside a component every two members are
compared once more, block by block, so the links that are counted are whole.

The keys are made of centred vectors, so a direction that all vectors share does not spoil them.
Window and number of passes follow from the row count and from all pairs that the passes so far
have found, over all rows: how often a projection parts such a pair says how many passes it needs,
and how seldom it is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import components, numbered, prepare, stored
from weft.llm.words import mix64
from weft.operators.skew import split_lookup

#: windows to choose from, in rows
WINDOWS = (256, 512, 1024)
#: rows of a block of one component
BLOCK = 2048
THRESHOLD = 0.95
#: passes before the found pairs first decide how many more it takes, and the share of pairs
#: that may stay apart in all passes
FIRST = 4
MISS = 1e-4
#: passes that are sorted in one job
TOGETHER = 16


def signs(x: np.ndarray, seed: int) -> np.ndarray:
    """64 sign bits of random projections, as signed numbers whose order is that of the bits."""
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], 64))
    bits = np.packbits(x @ planes > 0, axis=1)
    return (bits.view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _matrix(column: pa.Array) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Per vector length: the rows that have it, and their vectors."""
    widths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, ends = column.flatten().to_numpy(), np.cumsum(widths)
    out = []
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        out.append((int(width), at, flat[(ends[at] - width)[:, None] + np.arange(width)]))
    return widths, out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so no square under- or overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            rows: list = [None] * b.num_rows
            for _, at, x in _matrix(b.column("v"))[1]:
                for i, r in zip(at.tolist(), unit(x)):
                    rows[i] = r
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows, pa.list_(pa.float64())), b.column("size")], names=["id", "v", "size"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of a task's vectors, a row per length and component."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for width, _, x in _matrix(b.column("v"))[1]:
            total[width] = total.get(width, 0) + np.r_[x.sum(axis=0), len(x)]
    for width, t in total.items():
        n = np.full(width, t[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(width, width)), pa.array(np.arange(width)), pa.array(t[:-1]), pa.array(n)], names=["width", "dim", "s", "n"])


def centres(units: DataFrame) -> dict[int, np.ndarray]:
    """Mean vector per length."""
    rows = units.mapInArrow(_sums, "width long, dim long, s double, n double").groupBy("width", "dim").agg((F.sum("s") / F.sum("n")).alias("c")).collect()
    out: dict[int, np.ndarray] = {}
    for r in rows:  # a row per component of a vector
        out.setdefault(r["width"], np.zeros(r["width"]))[r["dim"]] = r["c"]
    return out


def _agreements(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs of rows of the centred ``x``: how often a random projection gives both one sign, in %."""
    rows, at = np.unique(np.r_[i, j], return_inverse=True)
    u = x[rows] / np.maximum(np.linalg.norm(x[rows], axis=1, keepdims=True), np.finfo(float).tiny)
    cosine = np.clip((u @ u.T)[at[:len(i)], at[len(i):]], -1, 1)
    return np.floor((1 - np.arccos(cosine) / np.pi) * 100)


def meeting(agreement: np.ndarray, n: int, window: int) -> np.ndarray:
    """How often a pass over ``n`` rows brings a pair into one window: if its first log2(n / window) signs agree."""
    return np.clip(agreement, 0.5, 1) ** max(0.0, math.log2(n / window))


def plan(n: int, pairs: list[tuple[float, int]], window: int | None = None) -> tuple[int, int]:
    """Window and passes for ``n`` classes.  ``pairs``: (agreement, count) of true pairs.  The
    passes are so many that a share of MISS of the pairs is left apart, at the least cost."""
    a, c = (np.array(x, dtype=np.float64) for x in zip(*pairs))
    best = None
    for w in (window,) if window else WINDOWS:
        meet = meeting(a, n, w)
        passes = 1
        while n > 2 * w and ((1 - meet) ** passes * c).sum() > MISS * c.sum():
            passes += 1 + passes // 16
        if best is None or passes * (1 + w / 512) < best[0]:
            best = (passes * (1 + w / 512), w, passes)
    return best[1:]


def _keys(batches: Iterator[pa.RecordBatch], centre: dict[int, np.ndarray], first: int, last: int) -> Iterator[pa.RecordBatch]:
    """Every row once per pass, with its place in the pass's order."""
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("id").to_numpy()
        widths, groups = _matrix(b.column("v"))
        for p in range(first, last):
            key = np.empty(len(ids), np.int64)
            for width, at, x in groups:
                key[at] = signs(x - centre[width], p * 1_000_003 + width)
            tie = mix64(ids.astype(np.uint64) * np.uint64(2 * p + 1) + np.uint64(p)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(np.full(len(ids), p, np.int32)), pa.array(widths), pa.array(key), pa.array(tie)],
                                             names=["id", "v", "pass", "width", "key", "tie"])


def _windows(rows: pa.Table, window: int, least: float, centre: dict[int, np.ndarray]) -> pa.Table:
    """Rows of consecutive ranks: every ``window`` of them against themselves and the next; edges
    that connect what is linked, and how many pairs (``n``) agree on ``a`` % of the projections.
    ``own``: the others are the next block's first."""
    rows = rows.sort_by("rank").combine_chunks()
    ids, own = rows.column("id").to_numpy(), rows.column("own").to_numpy(zero_copy_only=False).astype(bool)
    v = rows.column("v").combine_chunks()
    v = pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v
    runs, out, agreed = rows.column("pass").to_numpy(), [np.zeros((0, 2), np.int64)], np.zeros(101, np.int64)
    for width, at, x in _matrix(v)[1]:
        for lo in range(0, len(at), window):
            hi, far = min(len(at), lo + window), min(len(at), lo + 2 * window)
            if not own[at[lo]]:
                break
            i, j = near_rows(x[lo:hi], x[lo:far], least)
            i, j = i[i != j], j[i != j]
            same = runs[at[lo + i]] == runs[at[lo + j]]
            node, root = stars(i[same], j[same], far - lo)
            out.append(np.stack([ids[at[lo + node]], ids[at[lo + root]]], axis=1))
            once = same & (i < j)
            if once.any():
                agreed += np.bincount(_agreements(x[lo:far] - centre[width], i[once], j[once]).astype(np.int64), minlength=101)
    e, share = np.concatenate(out), np.flatnonzero(agreed)
    n = pa.array(np.r_[np.zeros(len(e), np.int64), agreed[share]], mask=np.r_[np.ones(len(e), bool), np.zeros(len(share), bool)])
    return pa.table({"a": pa.array(np.r_[e[:, 0], share]), "b": pa.array(np.r_[e[:, 1], share]), "n": n})


def _in_order(units: DataFrame, centre: dict, window: int, first: int, last: int, least: float) -> DataFrame:
    """Edges found by some passes, and agreements of all pairs found, see ``_windows``; sorted in
    one job: range partitions over (pass, key)."""
    keyed = units.mapInArrow(lambda it: _keys(it, centre, first, last), "id long, v array<double>, pass int, width long, key long, tie long")
    ranked = numbered(keyed, "vector-keys", "pass", "width", "key", "tie", "id").select("id", "v", "pass", "rank")
    size = window * max(1, BLOCK // window)
    block = F.floor(F.col("rank") / size)
    # the first window of a block is the halo of the one before
    places = F.when((F.col("rank") % size < window) & (block > 0), F.array(F.struct(block.alias("block"), F.lit(True).alias("own")), F.struct((block - 1).alias("block"), F.lit(False).alias("own")))) \
        .otherwise(F.array(F.struct(block.alias("block"), F.lit(True).alias("own"))))
    dealt = ranked.select("id", "v", "pass", "rank", F.inline(places))
    return stored(dealt.groupBy("block").applyInArrow(lambda t: _windows(t, window, least, centre), "a long, b long, n long"), "vector-edges")


def near_rows(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i of x, j of y) whose cosine is at least ``least``; the rows are unit vectors."""
    i, j = np.arange(len(x)), np.arange(len(y))
    between = x.mean(axis=0) - y.mean(axis=0)
    if (length := np.linalg.norm(between)) > 1e-9:
        px, py = x @ (between / length), y @ (between / length)
        reach = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
        i, j = np.flatnonzero(px <= py.max() + reach), np.flatnonzero(py >= px.min() - reach)
    # in single precision, those near the border again in double precision
    slack = 1e-4 + 1e-7 * x.shape[1]
    part = x[i].astype(np.float32) @ y[j].astype(np.float32).T
    a, b = np.nonzero(part >= least - slack)
    unsure = np.flatnonzero(part[a, b] < least + slack)
    i, j, ok = i[a], j[b], np.ones(len(a), bool)
    step = max(1, (1 << 22) // x.shape[1])
    for lo in range(0, len(unsure), step):
        u = unsure[lo:lo + step]
        ok[u] = np.einsum("nd,nd->n", x[i[u]], y[j[u]]) >= least
    return i[ok], j[ok]


def stars(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect the nodes 0..n-1 as the edges (i, j) do."""
    root = np.arange(n)
    while (root[i] != root[j]).any():
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root[root] != root).any():
            root = root[root]
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def _counts(rows: pa.Table, least: float) -> pa.Table:
    """Members of components, of one block (or several small components) or of two blocks: per
    class, the rows that it is linked with in the other block, or its own."""
    rows = rows.sort_by([("root", "ascending"), ("block", "ascending")]).combine_chunks()
    root, block, ids, sizes = (rows.column(c).to_numpy() for c in ("root", "block", "id", "size"))
    v = rows.column("v").combine_chunks()
    v = pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v
    total = np.zeros(len(ids), np.int64)
    width, groups = _matrix(v)
    for _, at, x in groups:
        cut = np.flatnonzero(np.r_[True, root[at][1:] != root[at][:-1], True])
        for lo, hi in zip(cut[:-1], cut[1:]):
            mid = lo + int(np.searchsorted(block[at[lo:hi]], block[at[hi - 1]]))
            if mid == lo:  # one block
                i, j = near_rows(x[lo:hi], x[lo:hi], least)
                i, j = lo + i[i != j], lo + j[i != j]
                total += np.bincount(at[i], sizes[at[j]], len(ids)).astype(np.int64)
            else:
                i, j = near_rows(x[lo:mid], x[mid:hi], least)
                total += (np.bincount(at[lo + i], sizes[at[mid + j]], len(ids)) + np.bincount(at[mid + j], sizes[at[lo + i]], len(ids))).astype(np.int64)
    return pa.table({"id": pa.array(ids), "others": pa.array(total)})


def link_counts(units: DataFrame, root: DataFrame, least: float) -> DataFrame:
    """``(id, others)``: rows of other classes linked with each class, exact inside components.  A
    component is cut into blocks; every two of its blocks meet in a task of their own."""
    sizes = stored(root.groupBy("root").agg(F.count("*").alias("n")), "vector-groups")
    member = units.join(root.withColumnRenamed("node", "id"), "id")
    ranked = numbered(member, "vector-members", "root", "id")
    first = stored(ranked.groupBy("root").agg(F.min("rank").alias("first"), F.count("*").alias("n")), "vector-firsts")
    member = split_lookup(ranked, first, "root", rows_of="n")
    block = F.floor((F.col("rank") - F.col("first")) / BLOCK)
    member = member.select("root", "id", "v", "size", block.alias("block"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    small = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // BLOCK))
    # components of one block share a task with others; a block of a larger one goes to its pairs
    one = member.where("blocks = 1").select("root", "id", "v", "size", "block", F.pmod(F.xxhash64("root"), F.lit(small)).alias("cell"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"))
    many = member.where("blocks > 1").withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    many = many.select("root", "id", "v", "size", "block", F.col("root").alias("cell"), F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"))
    met = one.unionByName(many).groupBy("cell", "i", "j").applyInArrow(lambda t: _counts(t, least), "id long, others long")
    return met.groupBy("id").agg(F.sum("others").alias("others"))


def edges_of_passes(units: DataFrame, least: float, window: int | None) -> DataFrame:
    """Verified pairs that connect the near classes.

    A pair is found in as many of the passes as it is likely to meet in one, so the pairs found,
    each weighed by the inverse, stand for all pairs of all rows; more passes follow until ``plan``
    asks for none.  A pair at the border counts too, also where none was found."""
    n = max(units.count(), 1)
    centre = centres(units)
    border = (1 - math.acos(least) / math.pi, 1)
    window, need = plan(n, [border], window)
    done, out, agreed = 0, None, np.zeros(101)
    while done < need:
        more = min(need - done, TOGETHER if done else FIRST)
        found = _in_order(units, centre, window, done, done + more, least)
        done += more
        for r in found.where("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("n")).collect():  # 101 rows at most
            agreed[r["a"]] += r["n"]
        a = np.flatnonzero(agreed)
        pairs = agreed[a] / (done * meeting(a / 100, n, window))
        need = plan(n, [*zip(a / 100, pairs), border], window)[1]
        e = found.where("n IS NULL").select("a", "b")
        out = e if out is None else out.unionByName(e)
    return out


def near_vectors(vectors: DataFrame, least: float = THRESHOLD, window: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors (vec_id, embedding)``.

    Null, empty and zero vectors and vectors with null or non-finite components link with
    nothing.  Equal vectors (and rows that share an id) link with each other by their class;
    a row without an id takes part as a link, and a component of such rows alone is null.
    ``window``: rows that a row is compared with per pass (default: by ``plan``).
    """
    prepare(vectors.sparkSession)
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(F.coalesce(good, F.lit(False)), F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))  # -0.0 is 0.0
    rows = rows.withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    classes = rows.where("v is not null").groupBy("v").agg(F.min(F.coalesce("vec_id", F.lit(np.iinfo(np.int64).max))).alias("first"), F.count("*").alias("size"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    units = stored(classes.select("id", "v", "size").mapInArrow(_units, "id long, v array<double>, size long"), "vector-units")
    root = stored(components(edges_of_passes(units, least, window), "vectors"), "vector-components")
    links = link_counts(units, root, least)
    named = classes.join(links, "id", "left").join(root.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = stored(named.select("v", "size", "first", "root", F.coalesce("others", F.lit(0)).alias("others")), "vector-roots")
    named = named.join(named.groupBy("root").agg(F.min("first").alias("c")), "root").select(F.col("v").alias("_v"), "size", "others", "c")
    out = rows.join(named, F.col("v") == F.col("_v"), "left")
    component = F.when(F.col("_v").isNull(), F.col("vec_id")).when(F.col("c") == np.iinfo(np.int64).max, None).otherwise(F.col("c"))
    return out.select("vec_id", F.coalesce(F.col("size") - 1 + F.col("others"), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
