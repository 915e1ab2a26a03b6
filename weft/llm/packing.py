"""Harmonic packing of token sequences.

A document's ids are cut into pieces whose lengths are reciprocals of the capacity: the
longest ``capacity // k`` that fits, again and again.  Pieces of class k go k to a bin, so
a full bin is (all but a few ids) filled and bins of a class are filled with a fixed count,
by every worker on its own.  The pieces of bins that a worker could not fill are pooled
with those of other workers, ``fan_in`` at a time, and packed by the same rule; what the last
pool leaves (less than one bin a class) is joined end to end and cut at the capacity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import prepare, stored, with_base
from weft.llm.tokens import encoder

CAPACITY = 1024
END_ID = 0
#: pieces: bin is null while the piece waits for a pool; p and bin number a sequence
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, pool long, bin long, offset long"
COLUMNS = [x.split()[0] for x in PIECES.split(", ")]
KINDS = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 3


def class_lengths(capacity: int = CAPACITY) -> list[int]:
    """``[length that fits]`` by remaining length: the longest ``capacity // k`` not above it."""
    out = [0] * (capacity + 1)
    for n in range(1, capacity + 1):
        k = -(-capacity // n)  # the smallest class whose pieces are not longer than n
        out[n] = capacity // k if capacity // k <= n else out[n - 1]
    return out


def cut(tokens: int, fits: list[int]) -> list[int]:
    """Piece lengths of a document of ``tokens`` ids."""
    capacity = len(fits) - 1
    out = [capacity] * (tokens // capacity)
    left = tokens % capacity
    while left:
        out.append(fits[left])
        left -= fits[left]
    return out


class Bins:
    """Open bins by piece length; a bin is emitted when it holds its class's count."""

    def __init__(self, capacity: int, pool: int, first: int = 0):
        self.capacity, self.pool, self.next, self.open = capacity, pool, first, {}

    def add(self, doc, start, length, doc_tokens, ids) -> list[tuple]:
        own = self.open.setdefault(length, [])
        own.append((doc, start, length, doc_tokens, ids))
        if len(own) < self.capacity // length:
            return []
        del self.open[length]
        n, self.next = self.next, self.next + 1
        return [(*x, self.pool, n, i * length) for i, x in enumerate(own)]

    def rest(self) -> list[tuple]:
        return [(*x, self.pool, None, None) for own in self.open.values() for x in own]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, KINDS)], names=COLUMNS)


def _first(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """Encode, cut and pack one partition's documents."""
    bins, tok, fits = Bins(capacity, TaskContext.get().partitionId()), encoder(vocabulary), class_lengths(capacity)
    tail = np.array([end_id], dtype="<u4").tobytes()
    for b in batches:
        out: list[tuple] = []
        for doc, ids in zip(b.column("doc_id").to_pylist(), tok.encode(b.column("text").to_pylist())):
            ids += tail
            at = 0
            for n in cut(len(ids) // 4, fits):
                out += bins.add(doc, at, n, len(ids) // 4, ids[4 * at:4 * (at + n)])
                at += n
        yield _batch(out)
    yield _batch(bins.rest())


def _pooled(rows: pa.Table, capacity: int, last: bool) -> pa.Table:
    """Pack the waiting pieces of one pool (at most ``fan_in`` workers' open bins)."""
    got = [tuple(r.values()) for r in rows.select(["doc_id", "start", "length", "doc_tokens", "ids"]).to_pylist()]
    got.sort(key=lambda x: (-x[2], x[0] is None, x[0] or 0, x[1]))
    bins, out = Bins(capacity, rows.column("pool")[0].as_py()), []
    for x in got:
        out += bins.add(*x)
    if not last:
        out += bins.rest()
    else:  # end to end, cut at the capacity
        at = 0
        for doc, start, length, doc_tokens, ids, *_ in bins.rest():
            while length:
                n = min(length, capacity - at)
                out.append((doc, start, n, doc_tokens, ids[:4 * n], bins.pool, bins.next, at))
                start, length, ids, at = start + n, length - n, ids[4 * n:], at + n
                if at == capacity:
                    bins.next, at = bins.next + 1, 0
    cols = list(zip(*out)) if out else [()] * len(COLUMNS)
    return pa.table([pa.array(c, t) for c, t in zip(cols, KINDS)], names=COLUMNS)


def _pooler(capacity: int, last: bool):
    return lambda rows: _pooled(rows, capacity, last)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, fan_in: int = 64) -> DataFrame:
    """Pieces ``doc_id, start, length, doc_tokens, ids, sequence_id, offset`` (ids: little-endian
    unsigned 32-bit).  Every document ends with ``end_id``, so a null or empty text is one id;
    repeated rows and null ids are packed like any other.  An empty table gives no piece.
    """
    prepare(docs.sparkSession)
    src = docs.select("doc_id", "text")
    levels = [stored(src.mapInArrow(lambda it: _first(it, vocabulary, end_id, capacity), PIECES), "pieces")]
    pools = (levels[0].agg(F.max("pool")).first()[0] or 0) + 1
    while True:
        waiting = levels[-1].where("bin is null").withColumn("pool", F.floor(F.col("pool") / fan_in))
        pools = -(-pools // fan_in)
        last = pools == 1
        levels.append(stored(waiting.groupBy("pool").applyInArrow(_pooler(capacity, last), PIECES), "pieces"))
        if last:
            break
    # a pool's sequences are numbered after those of all earlier pools and levels
    done = [x.where("bin is not null").withColumn("_level", F.lit(i)) for i, x in enumerate(levels)]
    pieces = done[0]
    for x in done[1:]:
        pieces = pieces.unionByName(x)
    key = F.struct("_level", "pool")
    counts = pieces.groupBy("_level", "pool").agg((F.max("bin") + 1).alias("n")).withColumn("_p", key)
    numbered = with_base(pieces.withColumn("_p", key), counts, "n", "_base")
    return numbered.select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("_base") + F.col("bin")).alias("sequence_id"), "offset")
