"""Line dedup through a sharded minimal perfect hash.

The distinct line hashes are split into shards.  Each shard gets a minimal perfect hash
(cascading bit arrays, as in BBHash: Limasset et al. 2017) that maps its n hashes to the
slots 0..n-1 of three arrays: a fingerprint, the number of documents that hold the line,
and the smallest of their ids.  Documents do not join lines: each batch of documents sends
its distinct line hashes, packed, to the shards, where they are probed as arrays, and gets
back the lines that go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import bind, prepare, stored

SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
#: distinct hashes a shard holds at about (its arrays are some 20 bytes each)
SHARD_KEYS = 200_000
NO_ID = np.iinfo(np.int64).max  # a null doc_id: after all others


# ---- line keys -----------------------------------------------------------------------

def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # bytes.lower changes A-Z alone


def long_enough(key: bytes, least: int = MIN_CHARS) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _hashes(keys: list[bytes]) -> np.ndarray:
    """128 bits per key as two unsigned columns: place and fingerprint."""
    raw = b"".join([xxhash.xxh3_128_digest(k) for k in keys])
    return np.frombuffer(raw, dtype=">u8").astype(np.uint64).reshape(-1, 2)


def _doc_lines(batches: Iterator[pa.RecordBatch], least: int):
    """Per batch: (doc index, line index, hashes) of all lines that have a key, and the ids."""
    for b in batches:
        ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        doc, nth, keys = [], [], []
        for i, t in enumerate(texts):
            for j, line in enumerate((t or b"").split(b"\n")):
                k = line_key(line)
                if long_enough(k, least):
                    doc.append(i)
                    nth.append(j)
                    keys.append(k)
        yield b, np.array([NO_ID if x is None else x for x in ids], dtype=np.int64), np.array(doc, dtype=np.int64), np.array(nth, dtype=np.int32), _hashes(keys)


def _held(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Distinct (hash) of a batch with the documents that hold it: count and smallest id."""
    for _, ids, doc, _, h in _doc_lines(batches, least):
        if not len(doc):
            continue
        own = ids[doc]
        order = np.lexsort((own, h[:, 1], h[:, 0]))
        h, own = h[order], own[order]
        new = np.r_[True, (h[1:] != h[:-1]).any(axis=1)]
        first = np.flatnonzero(new)
        docs = np.add.reduceat((new | np.r_[True, own[1:] != own[:-1]]).astype(np.int64), first)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[first, 0].view(np.int64), h[first, 1].view(np.int64), docs, own[first])],
                                         names=["place", "mark", "docs", "owner"])


# ---- the minimal perfect hash ----------------------------------------------------------

def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys.  Level by level, every key left sets the
    bit of its position; keys alone on their bit stay there, the others go to the next level.
    A key's slot is the number of bits set before its own (counts per 512 bits speed it up)."""

    STEP = 512

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bits, packed
        self.sizes = [len(x) * 8 for x in levels]
        self.bases, at = [], 0
        self.counts = []
        for x in levels:
            ones = np.bitwise_count(x).astype(np.int64)
            per = np.add.reduceat(ones, np.arange(0, len(ones), self.STEP // 8)) if len(ones) else np.zeros(0, np.int64)
            self.counts.append(np.r_[0, np.cumsum(per)])
            self.bases.append(at)
            at += int(ones.sum())
        self.n = at

    @classmethod
    def build(cls, place: np.ndarray, mark: np.ndarray, load: float = 2.0) -> PerfectHash:
        levels, left = [], np.arange(len(place))
        while len(left):
            size = max(64, -(-int(len(left) * load) // 64) * 64)
            at = cls._at(place[left], mark[left], len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(levels)

    @staticmethod
    def _at(place, mark, level: int, size: int) -> np.ndarray:
        return (_mix(place ^ _mix(mark, level + 1), level + 1) % np.uint64(size)).astype(np.int64)

    def slots(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Slot of each key (-1: surely not a key; a strange key may also get a slot)."""
        out, left = np.full(len(place), -1, dtype=np.int64), np.arange(len(place))
        for k, bits in enumerate(self.levels):
            if not len(left):
                break
            at = self._at(place[left], mark[left], k, self.sizes[k])
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            out[left[hit]] = self.bases[k] + self._before(k, at[hit])
            left = left[~hit]
        return out

    def _before(self, k: int, at: np.ndarray) -> np.ndarray:
        bits, block = self.levels[k], at // self.STEP
        width = self.STEP // 8
        padded = np.r_[bits, np.zeros(width, np.uint8)]
        rows = padded[(block * width)[:, None] + np.arange(width)]
        inside = at % self.STEP
        full = np.arange(width)[None, :] < (inside >> 3)[:, None]
        ones = (np.bitwise_count(rows) * full).sum(axis=1).astype(np.int64)
        last = rows[np.arange(len(at)), inside >> 3] & ((1 << (inside & 7)) - 1).astype(np.uint8)
        return self.counts[k][block] + ones + np.bitwise_count(last)

    def pack(self) -> list[bytes]:
        return [x.tobytes() for x in self.levels]

    @classmethod
    def unpack(cls, levels: list[bytes]) -> PerfectHash:
        return cls([np.frombuffer(x, dtype=np.uint8) for x in levels])


def _index_shard(rows: pd.DataFrame) -> pd.DataFrame:
    place, mark = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("place", "mark"))
    mph = PerfectHash.build(place, mark)
    slot = mph.slots(place, mark)
    arrays = []
    for values, kind in ((mark, "<u8"), (rows["docs"].to_numpy(), "<i8"), (rows["owner"].to_numpy(np.int64), "<i8")):
        a = np.zeros(mph.n, dtype=kind)
        a[slot] = values
        arrays.append(a.tobytes())
    return pd.DataFrame([[int(rows["shard"].iloc[0]), mph.pack(), *arrays]], columns=["shard", "levels", "marks", "docs", "owners"])


INDEX = "shard int, levels array<binary>, marks binary, docs binary, owners binary"


def line_index(docs: DataFrame, least: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int, DataFrame]:
    """The sharded index over all distinct line hashes, its number of shards, and the probes
    ``(shard, n)`` that each will get."""
    prepare(docs.sparkSession)
    src = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    held = src.mapInArrow(lambda it: _held(it, least), "place long, mark long, docs long, owner long")
    lines = stored(held.groupBy("place", "mark").agg(F.sum("docs").alias("docs"), F.min("owner").alias("owner")), "lines")
    shards = max(1, -(-lines.count() // shard_keys))
    sharded = lines.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
    load = stored(sharded.groupBy("shard").agg(F.sum("docs").alias("n")), "line-loads")
    return stored(sharded.groupBy("shard").applyInPandas(_index_shard, INDEX), "line-index"), shards, load


# ---- probing ---------------------------------------------------------------------------

#: probes that one task looks up at about; a shard with more (a very common line) is copied
SHARD_PROBES = 1_000_000
#: a shard is copied only if it also gets this part of all probes: so many are, at most
MOST_COPIED = 10_000


def shard_copies(load: DataFrame, shard_probes: int = SHARD_PROBES) -> dict[int, int]:
    """Copies of the shards that need more than one, each by its own load."""
    total = load.agg(F.sum("n")).first()[0] or 0
    rows = load.where(F.col("n") > max(shard_probes, total // MOST_COPIED)).collect()  # fewer than MOST_COPIED
    return {r["shard"]: -(-r["n"] // shard_probes) for r in rows}


def _probes(batches: Iterator[pa.RecordBatch], least: int, shards: int, copies: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """One row per batch and shard: the probes of the batch's lines, packed."""
    at = 0
    for b, ids, doc, nth, h in _doc_lines(batches, least):
        if not len(doc):
            continue
        keys, at = b.column("key").to_numpy(zero_copy_only=False), at + 1
        shard = (h[:, 0].view(np.int64) % shards).astype(np.int32)  # as pmod: the divisor's sign
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1]])
        parts = np.split(order, cut[1:])
        packed = [[f(p) for p in parts] for f in (
            lambda p: h[p, 0].tobytes(), lambda p: h[p, 1].tobytes(), lambda p: ids[doc[p]].tobytes(),
            lambda p: keys[doc[p]].astype("<i8").tobytes(), lambda p: nth[p].tobytes())]
        batch = xxhash.xxh3_64_intdigest(packed[0][0])
        numbers = [int(shard[p[0]]) for p in parts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int32()), pa.array([batch % copies.get(k, 1) for k in numbers], pa.int32()), *[pa.array(c, pa.binary()) for c in packed]],
            names=["shard", "copy", "place", "mark", "doc", "key", "nth"])


def _answer(probes: pa.Table, index: pa.Table) -> pa.Table:
    """Probes of a shard and its arrays -> (doc, key, nth) of the lines that go."""
    (one,) = index.to_pylist() or [None]
    joined = {c: np.frombuffer(b"".join(probes.column(c).to_pylist()), dtype=k)
              for c, k in (("place", "<u8"), ("mark", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("nth", "<i4"))}
    goes = np.zeros(len(joined["nth"]), dtype=bool)
    if one and len(goes):
        slot = PerfectHash.unpack(one["levels"]).slots(joined["place"], joined["mark"])
        marks, count, owner = (np.frombuffer(one[c], dtype=k) for c, k in (("marks", "<u8"), ("docs", "<i8"), ("owners", "<i8")))
        goes = (slot >= 0) & (marks[slot] == joined["mark"]) & (count[slot] >= 2) & (owner[slot] != joined["doc"])
    return pa.table({c: pa.array(joined[c][goes]) for c in ("doc", "key", "nth")})


def with_copies(index: DataFrame, copies: dict[int, int]) -> DataFrame:
    """A row per copy of a shard; only the shards in ``copies`` have several."""
    rows = index.sparkSession.createDataFrame(list(copies.items()), "_s int, _n int")
    many = index.join(F.broadcast(rows), F.col("shard") == F.col("_s"), "left")  # fewer than MOST_COPIED rows
    return many.withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_s", "_n")


def drops(docs: DataFrame, least: int = MIN_CHARS, shard_keys: int = SHARD_KEYS, shard_probes: int = SHARD_PROBES) -> DataFrame:
    """``doc, key, nth``: the lines that go; ``doc`` is the doc_id (null: the largest long)
    and ``key`` a hash of the text, so rows that share an id are told apart."""
    index, shards, load = line_index(docs, least, shard_keys)
    copies = shard_copies(load, shard_probes)
    src = docs.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    probes = src.mapInArrow(lambda it: _probes(it, least, shards, copies),
                            "shard int, copy int, place binary, mark binary, doc binary, key binary, nth binary")
    return probes.groupBy("shard", "copy").cogroup(with_copies(index, copies).groupBy("shard", "copy")).applyInArrow(_answer, "doc long, key long, nth int")


def dedup_lines(docs: DataFrame, least: int = MIN_CHARS, shard_keys: int = SHARD_KEYS, shard_probes: int = SHARD_PROBES, counts: bool = True) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; with ``counts`` also ``_n_lines``,
    ``_n_dropped`` (columns of the input with these names are then replaced).

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased.  A key
    of ``least`` code points or more that at least two documents hold stays only in the one
    with the smallest doc_id (null ids come last; rows with equal ids are one document).  A
    null or empty text is one empty line and stays as it is.  Other columns pass unchanged.
    """
    gone = drops(docs, least, shard_keys, shard_probes).groupBy("doc", "key").agg(F.collect_set("nth").alias("_drop"))
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("key"))
    out = rows.join(gone, ["doc", "key"], "left").select("_row", "_drop")
    lines = F.split(F.coalesce(F.col("_row.text"), F.lit("")), "\n", -1)
    left = bind(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_drop")), lambda i: F.get(x, i)), "\n"))
    text = F.when(F.col("_drop").isNull(), F.col("_row.text")).otherwise(left)
    found = [F.size(lines).cast("long").alias("_n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("_n_dropped")] if counts else []
    keep = [c for c in docs.columns if not counts or c not in ("_n_lines", "_n_dropped")]
    return out.select(*[text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in keep], *found)
