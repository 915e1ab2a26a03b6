"""Exact substring dedup by De Bruijn compaction.

A window of 35 words is repeated if its word sequence also starts elsewhere.  The graph is
built on k-mers of words, sparsified: of every window the k-mer with the smallest hash is an
anchor, so equal windows share an anchor and only anchors (some 7 % of the positions) are
shuffled.

* Nodes are anchor k-mers, edges the text from one anchor to the next (or to the end of the
  document).  A node whose occurrences, two or more, all have one edge in and one edge out
  does not branch.
* A join brings the nodes' verdicts back to their occurrences; consecutive occurrences of
  nodes that do not branch compact to one path.  All occurrences of its nodes have the whole
  path in common, so every window on it whose anchor lies on it is repeated.
* Windows with a repeated anchor that no path settles (at branches) are verified one by one
  at their coordinates: they are counted by a 128-bit hash of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import prepare, stored
from weft.llm.words import Anchors, Polynomial, covered, hash_words

WINDOW = 35
KMER = 8
NO_ID = np.iinfo(np.int64).max


def _split(column: pa.Array) -> tuple[list[list[bytes]], np.ndarray]:
    words = [(t or b"").split() for t in column.to_pylist()]
    return words, np.array([len(w) for w in words], dtype=np.int64)


def _hashes(words: list[list[bytes]]) -> np.ndarray:
    return hash_words([x for w in words for x in w])


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _nodes(batches: Iterator[pa.RecordBatch], n: int, k: int) -> Iterator[pa.RecordBatch]:
    """Every anchor occurrence with its edges."""
    for b in batches:
        words, lengths = _split(b.column("text"))
        h = _hashes(words)
        a = Anchors(h, lengths, n, k)
        into, out = a.edges(Polynomial(h))
        yield pa.RecordBatch.from_arrays([_i64(a.hash), _i64(into), _i64(out)], names=["node", "into", "out"])


def _places(batches: Iterator[pa.RecordBatch], n: int, k: int) -> Iterator[pa.RecordBatch]:
    """Every anchor occurrence with its coordinates."""
    for b in batches:
        words, lengths = _split(b.column("text"))
        a = Anchors(_hashes(words), lengths, n, k)
        doc = a.doc_of[a.at]
        yield pa.RecordBatch.from_arrays(
            [_i64(a.hash), *[b.column(c).take(pa.array(doc)) for c in ("doc", "key")], pa.array((a.at - a.begin[a.at]).astype(np.int32))],
            names=["node", "doc", "key", "pos"])


class _Marked:
    """A batch of documents with the verdicts of their repeated anchors."""

    def __init__(self, b: pa.RecordBatch, n: int, k: int, lanes: int):
        self.words, self.lengths = _split(b.column("text"))
        self.h = _hashes(self.words)
        self.a = a = Anchors(self.h, self.lengths, n, k)
        self.first = np.cumsum(self.lengths) - self.lengths
        at, plain = [], []
        for i, m in enumerate(b.column("marks").to_pylist()):
            if m:
                m = np.array(m, dtype=np.int64)
                at.append((m >> 1) + self.first[i])
                plain.append((m & 1).astype(bool))
        at, plain = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((at, np.int64), (plain, bool)))
        node = a.kmer[at]
        path_nodes = np.unique(node[plain])
        # runs of consecutive anchors that do not branch: one path each
        on = np.isin(a.hash, path_nodes)
        start = np.flatnonzero(on & ~(a.has_prev & np.roll(on, 1)))
        stop = np.flatnonzero(on & ~(a.has_next & np.roll(on, -1)))
        lo, hi = a.left[start], a.right[stop] - n + 1  # windows inside the path
        ok = hi > lo
        inside = covered(lo[ok], hi[ok], len(a.low))
        candidate = a.window & np.isin(a.low, np.unique(node))
        self.known = candidate & inside & np.isin(a.low, path_nodes)
        self.open = np.flatnonzero(candidate & ~self.known)
        self.poly = Polynomial(self.h, lanes) if lanes else None


def _open_windows(batches: Iterator[pa.RecordBatch], n: int, k: int) -> Iterator[pa.RecordBatch]:
    """Windows to verify: 128-bit hash and coordinates."""
    for b in batches:
        m = _Marked(b, n, k, lanes=2)
        s = m.open
        doc = m.a.doc_of[s]
        yield pa.RecordBatch.from_arrays(
            [_i64(m.poly.of(s, s + n, 0)), _i64(m.poly.of(s, s + n, 1)), *[b.column(c).take(pa.array(doc)) for c in ("doc", "key")],
             pa.array((s - m.a.begin[s]).astype(np.int32))], names=["w1", "w2", "doc", "key", "at"])


REMOVED = "doc_id long, n_words long, n_removed long, kept_text binary, removed array<struct<start:int,end:int>>"


def _removed(batches: Iterator[pa.RecordBatch], n: int, k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        marked = np.array([m is not None for m in b.column("marks").to_pylist()], dtype=bool)
        text, gone, spans = [b" ".join((t or b"").split()) for t in b.column("text").to_pylist()], np.zeros(b.num_rows, np.int64), [[]] * b.num_rows
        n_words = np.array([len(t.split()) for t in text], dtype=np.int64)
        rows = np.flatnonzero(marked)
        if len(rows):
            part = b.take(pa.array(rows))
            m = _Marked(part, n, k, lanes=0)
            starts = [np.flatnonzero(m.known)] + [np.array(p, dtype=np.int64) + m.first[i] for i, p in enumerate(part.column("at").to_pylist()) if p]
            starts = np.concatenate(starts)
            out = covered(starts, starts + n, len(m.h))
            for i, row in enumerate(rows):
                lo = m.first[i]
                o = out[lo:lo + m.lengths[i]]
                if o.any():
                    text[row] = b" ".join([w for w, x in zip(m.words[i], o.tolist()) if not x])
                    gone[row] = int(o.sum())
                    d = np.flatnonzero(np.diff(np.r_[False, o, False].astype(np.int8)))
                    spans[row] = [{"start": int(x), "end": int(y)} for x, y in zip(d[::2], d[1::2])]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n_words), pa.array(gone), pa.array(text, pa.binary()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "n_words", "n_removed", "kept_text", "removed"])


def remove_repeats(docs: DataFrame, n: int = WINDOW, k: int = KMER) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, removed`` (word spans) of every row.

    A word goes if a window of ``n`` words covers it whose sequence also starts anywhere
    else.  Windows are judged on the input.  Null and empty texts have no words; shorter
    texts no windows; a row that occurs twice repeats all its windows; null ids are allowed.
    """
    prepare(docs.sparkSession)
    src = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    one = lambda c: F.min(c) == F.max(c)
    nodes = src.select("text").mapInArrow(lambda it: _nodes(it, n, k), "node long, into long, out long") \
        .groupBy("node").agg(F.count("*").alias("c"), (one("into") & one("out")).alias("plain")).where("c >= 2").select("node", "plain")
    nodes = stored(nodes, "nodes")  # read back, the join below can split the occurrences of a frequent node
    places = src.select("doc", "key", "text").mapInArrow(lambda it: _places(it, n, k), "node long, doc long, key long, pos int")
    # a place and its verdict in one number (a text has under 2^30 words); a set, so equal rows share their places
    mark = F.col("pos") * 2 + F.col("plain").cast("int")
    marks = stored(places.join(nodes, "node").groupBy("doc", "key").agg(F.collect_set(mark).alias("marks")), "marks")
    windows = src.join(marks, ["doc", "key"]).select("doc", "key", "text", "marks") \
        .mapInArrow(lambda it: _open_windows(it, n, k), "w1 long, w2 long, doc long, key long, at int")
    windows = stored(windows, "windows")
    # stored like the nodes: a window that very many rows hold can then be split
    twice = stored(windows.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c >= 2").select("w1", "w2"), "twice")
    verified = windows.join(twice, ["w1", "w2"], "left_semi").groupBy("doc", "key").agg(F.collect_set("at").alias("at"))
    # one row per (doc, key), so that equal rows meet one stored table and their join can be split
    found = stored(marks.join(verified, ["doc", "key"], "left"), "found")
    rows = src.join(found, ["doc", "key"], "left").select("doc_id", "text", "marks", "at")
    return rows.mapInArrow(lambda it: _removed(it, n, k), REMOVED).withColumn("kept_text", F.col("kept_text").cast("string"))
