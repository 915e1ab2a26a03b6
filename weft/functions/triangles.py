"""Triangles inside one cell of the vertex grid, on sorted neighbour arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: pairs (edge, neighbour) looked at in one step
STEP = 1 << 20


def _csr(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertices in order, where each one's neighbours start (and the end), the neighbours."""
    t = t.sort_by("x").combine_chunks()
    x = t.column("x").to_numpy()
    ys = t.column("ys").combine_chunks()
    if isinstance(ys, pa.ChunkedArray):
        ys = pa.concat_arrays(ys.chunks) if ys.num_chunks else pa.array([], pa.list_(pa.int64()))
    lengths = ys.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(ys) else np.zeros(0, np.int64)
    return x, np.r_[0, np.cumsum(lengths)], ys.flatten().to_numpy() if len(ys) else np.zeros(0, np.int64)


def count_cell(t: pa.Table) -> pa.Table:
    """Rows ``(near, x, ys)``: arrays of the group on the edges' lower side (near) and of the group
    on their upper side.  Every edge x -> y with y in the far group meets both arrays: each common
    neighbour z closes a triangle (x, y, z), which is counted in this cell alone."""
    near = t.column("near").to_numpy(zero_copy_only=False).astype(bool)
    x, at, out = _csr(t.filter(pa.array(near)))
    y, at2, out2 = _csr(t.filter(pa.array(~near)))
    none = pa.table({"id": pa.array([], pa.int64()), "triangles": pa.array([], pa.int64())})
    if not len(out) or not len(out2):
        return none
    # edges into the far group, by position
    source = np.repeat(np.arange(len(x)), np.diff(at))
    to = np.searchsorted(y, out)
    edge = np.flatnonzero((to < len(y)) & (y[np.minimum(to, len(y) - 1)] == out))
    a, b = source[edge], to[edge]
    # membership of (vertex, neighbour) on either side: one sorted key each
    names = np.unique(np.r_[out, out2])
    far_key = np.repeat(np.arange(len(y)), np.diff(at2)) * len(names) + np.searchsorted(names, out2)
    near_key = source * len(names) + np.searchsorted(names, out)
    ids, totals = [], []
    size_a, size_b = np.diff(at)[a], np.diff(at2)[b]
    for own, own_at, own_out, other, key, size, mine in ((a, at, out, b, far_key, size_a, size_a <= size_b), (b, at2, out2, a, near_key, size_b, size_a > size_b)):
        pick = np.flatnonzero(mine)  # the shorter array is looked up in the longer one
        ends = np.cumsum(size[pick])
        lo = 0
        while lo < len(pick):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP)))
            p, n = pick[lo:hi], size[pick[lo:hi]]
            row = np.repeat(np.arange(len(p)), n)
            z = own_out[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + own_at[own[p]][row]]
            want = other[p][row] * len(names) + np.searchsorted(names, z)
            found = np.searchsorted(key, want)
            hit = key[np.minimum(found, len(key) - 1)] == want
            each = np.bincount(row[hit], minlength=len(p))
            some = each > 0
            for v, c in ((x[a[p]][some], each[some]), (y[b[p]][some], each[some]), (z[hit], None)):
                u, where = np.unique(v, return_inverse=True)
                ids.append(u)
                totals.append(np.bincount(where, c, len(u)).astype(np.int64))
            lo = hi
    if not ids:
        return none
    u, where = np.unique(np.concatenate(ids), return_inverse=True)
    return pa.table({"id": pa.array(u, pa.int64()), "triangles": pa.array(np.bincount(where, np.concatenate(totals), len(u)).astype(np.int64))})
