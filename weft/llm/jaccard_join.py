"""N-gram Jaccard join by T-occurrence search (DivideSkip: Li, Lu, Lu 2008).

Texts with equal shingle sets are one class.  A class of n shingles can only link with a
class that holds at least T = ceil(0.8 n) of them.  Its n inverted lists are divided: the T - 1
longest are never scanned; a class that reaches T must occur on one of the n - T + 1 short
ones.  Short lists are merged by Spark's sort-merge shuffle; the long ones are probed by
binary search when a candidate is verified.  List lengths are estimated by one fixed-size
count sketch, so very frequent shingles are long lists for everybody.

Only connected classes are asked for, so a list does not pair all its members:

1. every member of a list meets the list's most central member (its hub: the one that shares
   the largest part of its own short lists); of all hubs a class meets, the one met on the
   most short lists is verified;
2. the links found make components, and only members of one list that are still in
   different components meet: in size bands, as sizes further apart than 4 : 5 cannot link, a
   long list in blocks over many tasks.  Size, position and a parity bitmap of each set bound
   the overlap of two members; only those that may reach T leave the join and are verified.

Every pair of one list is thus verified, ruled out by a bound, or connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import components, prepare, stored
from weft.llm.words import mix64, shingle_sets

SHINGLE = 5
PERCENT = 80
#: the sketch: counters, and how they are cut into rows
CELLS, CHUNK = 1 << 20, 1 << 14
#: rows of a list that one task reads at about; longer lists are split
LIST_ROWS = 100_000
#: members of one size band of a list that meet in one task at about
BLOCK_ROWS = 4096
#: bits of a set's parity bitmap, in 64-bit words
PARITY_WORDS = 16
NO_ID = np.iinfo(np.int64).max


def _class_of(s: np.ndarray, bits: int) -> tuple[int, int]:
    """Two names of a set: its key of ``bits`` bits, and 64 more that tell sets of one key apart."""
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype="<i8")
    return int(d[0]) >> (64 - bits), int(d[1])


def parity(s: np.ndarray) -> np.ndarray:
    """Which cells hold an odd number of the set's shingles.  Where two bitmaps differ, a cell
    holds a shingle of one set alone, so the differing bits never exceed the symmetric difference."""
    cells = (s >> np.uint64(20)) % np.uint64(64 * PARITY_WORDS)
    odd = np.bincount(cells.astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _name(key: int, check: int, turns: dict[int, int]) -> int:
    """The class of a set: its key, or for the keys in ``turns`` the key xor the check turned
    left by so many bits (as ``_named`` does for columns)."""
    j = turns.get(key)
    if j is None:
        return key
    c = check & (2**64 - 1)
    x = (key & (2**64 - 1)) ^ ((c << j | c >> (64 - j)) & (2**64 - 1))
    return x - 2**64 if x >= 2**63 else x


def _named(rows: DataFrame, turns: dict[int, int]) -> DataFrame:
    """``rows`` (with ``key`` and ``check``) with their ``class``."""
    if not turns:
        return rows.withColumn("class", F.col("key"))
    small = rows.sparkSession.createDataFrame(list(turns.items()), "key long, _j int")
    turned = F.expr("shiftleft(check, _j)").bitwiseOR(F.expr("shiftrightunsigned(check, 64 - _j)"))
    return rows.join(F.broadcast(small), "key", "left").withColumn("class", F.coalesce(F.col("key").bitwiseXOR(turned), "key")).drop("_j")


def _classes(rows: DataFrame) -> tuple[dict[int, int], DataFrame]:
    """Classes ``(class, first)`` without two sets under one name, and the keys renamed for it.

    64-bit keys of n sets clash about n^2 / 2^65 times (some 300 times in 10^11 sets): those keys
    alone come to the driver.  Their sets are told apart by their checks; should a new name meet
    another one, both turn on."""
    turns: dict[int, int] = {}
    while True:
        named = _named(rows.where("n > 0"), turns)
        both = [f(c).alias(f"{c}{i}") for c in ("key", "check") for i, f in ((1, F.min), (2, F.max))]
        classes = stored(named.groupBy("class").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first"), *both), "classes")
        clash = classes.where("key1 <> key2 or check1 <> check2")
        if clash.isEmpty():
            return turns, classes.select("class", "first")
        for r in named.join(clash.select("class"), "class", "left_semi").select("key").distinct().collect():
            turns[r["key"]] = turns.get(r["key"], 0) % 63 + 1


# ---- sizes, classes and the count sketch ---------------------------------------------------

def _sizes(batches: Iterator[pa.RecordBatch], k: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, key, check, parity) per row, then this task's sketch in chunks."""
    counts = np.zeros(CELLS, np.int64)
    names = ["doc_id", "n", "key", "check", "parity", "chunk", "task", "counts"]
    bitmap = pa.list_(pa.int64())
    for b in batches:
        sets = shingle_sets(b.column("text").to_pylist(), k)
        ids = [_class_of(s, bits) for s in sets]
        if any(len(s) for s in sets):
            counts += np.bincount((np.concatenate(sets) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        m = len(sets)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([c for c, _ in ids], pa.int64()), pa.array([x for _, x in ids], pa.int64()),
             pa.array([parity(s) if len(s) else None for s in sets], bitmap), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
    m = CELLS // CHUNK
    yield pa.RecordBatch.from_arrays(
        [*[pa.nulls(m, pa.int64())] * 4, pa.nulls(m, bitmap), pa.array(range(m), pa.int32()), pa.array([TaskContext.get().partitionId()] * m, pa.int32()),
         pa.array([counts[i * CHUNK:(i + 1) * CHUNK].tobytes() for i in range(m)], pa.binary())], names=names)


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK, np.int64)
    for x in rows["counts"]:
        total += np.frombuffer(x, np.int64)
    return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "task": [rows["task"].iloc[0] // 64], "counts": [total.tobytes()]})


def _sketch(parts: DataFrame) -> np.ndarray:
    """Sum of the tasks' sketches, 64 tasks at a time; ``CELLS`` counters whatever the input."""
    add = "chunk int, task int, counts binary"
    tasks = parts.agg(F.max("task")).first()[0]
    while tasks is not None:
        parts = parts.withColumn("_g", F.floor(F.col("task") / 64)).groupBy("chunk", "_g").applyInPandas(_add, add)
        if tasks == 0 or tasks < 64:
            break
        tasks //= 64
    out = np.zeros(CELLS, np.int64)
    for r in parts.collect():
        out[r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
    return out


def _levels(counts: np.ndarray, noise: int) -> np.ndarray:
    """Counts above the sketch's noise on a coarse log scale, one byte each: the order of lists
    by length.  However full the cells are, a list that stands out of the noise is ordered by its own length."""
    return np.minimum(255, np.floor(6 * np.log2(np.maximum(0, counts - noise) + 1.0))).astype(np.uint8)


def by_length(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles, those of short lists first (ties by hash: one order for all texts)."""
    return s[np.lexsort((s, levels[(s % np.uint64(CELLS)).astype(np.int64)]))]


def least_overlap(n, percent: int = PERCENT):
    """T: shingles of a set of n that any partner holds (of a number or a column)."""
    return F.ceil(percent * n / F.lit(100)) if isinstance(n, Column) else -(-percent * n // 100)


# ---- short lists ---------------------------------------------------------------------------

def _postings(batches: Iterator[pa.RecordBatch], k: int, bits: int, percent: int, levels: np.ndarray, parts: np.ndarray, turns: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """(shingle, part, class, n, pos) for the short lists of each text; a batch's copies once."""
    for b in batches:
        sets = {}
        for s in shingle_sets(b.column("text").to_pylist(), k):
            if len(s):
                sets.setdefault(_name(*_class_of(s, bits), turns), s)
        cut = [by_length(s, levels)[:len(s) - least_overlap(len(s), percent) + 1] for s in sets.values()]
        m = np.array([len(x) for x in cut], dtype=np.int64)
        g = np.concatenate(cut) if cut else np.zeros(0, np.uint64)
        c = np.repeat(np.array(list(sets), dtype=np.int64), m)
        n = np.repeat(np.array([len(s) for s in sets.values()], dtype=np.int32), m)
        pos = (np.arange(len(g)) - np.repeat(np.cumsum(m) - m, m)).astype(np.int32)
        part = (mix64(c.view(np.uint64)) % parts[(g % np.uint64(CELLS)).astype(np.int64)].astype(np.uint64)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(part), pa.array(c), pa.array(n), pa.array(pos)],
                                         names=["shingle", "part", "class", "n", "pos"])


LISTS = "shingle long, class long, n int, pos int"


def _shared(batches: Iterator[pa.RecordBatch], parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (shingle, part, n, class), those whose list has more than one class.
    A part of a split list is passed on whole: its other classes are elsewhere."""
    tail, sent = None, False  # the open list's first row; whether it went out (others were seen)
    for b in batches:
        cols = [b.column(c).to_numpy() for c in ("shingle", "part", "class", "n", "pos")]
        if tail is not None:
            cols = [np.concatenate([t, c]) for t, c in zip(tail, cols)]
        shingle, part, cls = cols[:3]
        if not len(shingle):
            continue
        new = np.r_[True, (shingle[1:] != shingle[:-1]) | (part[1:] != part[:-1])]
        again = np.r_[False, ~new[1:] & (cls[1:] == cls[:-1])]  # copies of a class, from several tasks
        start = np.flatnonzero(new)
        several = np.maximum.reduceat((cls != cls[start][np.cumsum(new) - 1]).astype(np.int8), start) > 0
        several[0] |= sent
        out = ~again & (several[np.cumsum(new) - 1] | _is_split(shingle, parts))
        if sent:
            out[0] = False
        # the last list may go on: its first row waits for a second class
        sent = bool(several[-1])
        if not sent:
            out[start[-1]] = False
        tail = [c[start[-1]:start[-1] + 1] for c in cols]
        yield _list_rows(cols, out)
    if tail is not None and not sent:
        yield _list_rows(tail, _is_split(tail[0], parts))


def _is_split(shingle: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return parts[(shingle.view(np.uint64) % np.uint64(CELLS)).astype(np.int64)] > 1


def _list_rows(cols, out) -> pa.RecordBatch:
    shingle, _, cls, n, pos = (c[out] for c in cols)
    return pa.RecordBatch.from_arrays([pa.array(shingle, pa.int64()), pa.array(cls, pa.int64()), pa.array(n, pa.int32()), pa.array(pos, pa.int32())],
                                      names=["shingle", "class", "n", "pos"])


def may_reach(n: Column, m: Column, i: Column, j: Column, percent: int = PERCENT) -> Column:
    """Sizes and places (of the first common shingle) leave room for enough overlap: the
    intersection is at least p / (100 + p) of both sizes' sum."""
    n, m = n.cast("long"), m.cast("long")
    best = F.least(n - i, m - j)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * best >= percent * (n + m))


def may_overlap(n: Column, m: Column, x: Column, y: Column, percent: int = PERCENT) -> Column:
    """The parity bitmaps leave room for enough overlap: it is at most (n + m - differing bits) / 2."""
    n, m = n.cast("long"), m.cast("long")
    differ = sum((F.bit_count(F.get(x, F.lit(w)).bitwiseXOR(F.get(y, F.lit(w)))) for w in range(PARITY_WORDS)), F.lit(0))
    return (100 + percent) * (n + m - differ) >= 2 * percent * (n + m)


def pairs_apart(rows: DataFrame, percent: int = PERCENT, block: int = BLOCK_ROWS) -> DataFrame:
    """``(a, b)``: classes of one list and of different roots whose bounds allow a link.

    ``rows``: ``shingle, class, n, pos, root, parity``.  The smaller set of a pair (x) comes to
    its own size band and to the next one, the larger (y) to its own.  Where one side of a band
    has more than ``block`` rows, both are cut by class and meet on a grid, every pair once.
    """
    # bands a hair wider than the ratio of sizes, so that rounding moves no partner two bands off
    band = F.floor(F.ln("n") / F.ln(F.lit(100 / percent * (1 + 1e-9))))
    rows = rows.withColumn("band", band)
    sizes = rows.groupBy("shingle", "band").agg(F.count("*").alias("c")) \
        .select("shingle", "c", "band", F.explode(F.array("band", F.col("band") + 1)).alias("target")) \
        .groupBy("shingle", "target").agg(F.sum("c").alias("xs"), F.sum(F.when(F.col("band") == F.col("target"), F.col("c")).otherwise(0)).alias("ys")) \
        .where((F.greatest("xs", "ys") > block) & (F.col("ys") > 0))
    cuts = stored(sizes.select("shingle", "target", *[F.ceil(F.col(f"{s}s") / block).alias(f"{s}_cuts") for s in "xy"]), "cuts")

    def side(s: str, o: str, target: Column) -> DataFrame:
        own = rows.withColumn("target", target).drop("band").join(cuts.hint("merge"), ["shingle", "target"], "left")
        of, to = (F.coalesce(F.col(f"{c}_cuts"), F.lit(1).cast("long")) for c in (s, o))
        return own.select("shingle", "target", F.pmod("class", of).alias(f"{s}_cut"), F.explode(F.sequence(F.lit(0).cast("long"), to - 1)).alias(f"{o}_cut"),
                          *[F.col(c).alias(f"{s}_{c}") for c in ("class", "n", "pos", "root", "parity")])

    x, y = side("x", "y", F.explode(F.array("band", F.col("band") + 1))), side("y", "x", F.col("band"))
    n, m = F.col("x_n"), F.col("y_n")
    met = x.join(y, ["shingle", "target", "x_cut", "y_cut"]).where(
        ((n < m) | ((n == m) & (F.col("x_class") < F.col("y_class")))) & (F.col("x_root") != F.col("y_root"))
        & may_reach(n, m, F.col("x_pos"), F.col("y_pos"), percent) & may_overlap(n, m, F.col("x_parity"), F.col("y_parity"), percent))
    return met.select(F.least("x_class", "y_class").alias("a"), F.greatest("x_class", "y_class").alias("b")).distinct()


# ---- verification --------------------------------------------------------------------------

def _sets(batches: Iterator[pa.RecordBatch], k: int, bits: int, turns: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """(class, set), once per task: rows that share an id come to one task."""
    seen: set[int] = set()
    for b in batches:
        sets = {_name(*_class_of(s, bits), turns): s for s in shingle_sets(b.column("text").to_pylist(), k) if len(s)}
        sets = {c: s for c, s in sets.items() if c not in seen}
        seen.update(sets)
        yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([s.tobytes() for s in sets.values()], pa.binary())], names=["class", "grams"])


def overlap(short: np.ndarray, whole: np.ndarray, least: int, block: int = 64) -> int:
    """Probe the lists of ``short`` in the sorted ``whole`` by binary search, a block at a time;
    stops (with what it has) when the rest can no longer reach ``least``."""
    hits = 0
    for at in range(0, len(short), block):
        if hits + len(short) - at < least:
            break
        x = short[at:at + block]
        p = np.searchsorted(whole, x)
        hits += int((whole[np.minimum(p, len(whole) - 1)] == x).sum())
    return hits


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c, x, y = (b.column(k) for k in ("a", "b", "a_grams", "b_grams"))
        ok = []
        for s, t in zip(x, y):
            s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (s, t))
            if len(s) > len(t):
                s, t = t, s
            need = -(-percent * (len(s) + len(t)) // (100 + percent))
            inter = overlap(s, t, need)
            ok.append(100 * inter >= percent * (len(s) + len(t) - inter))
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(keep), c.filter(keep)], names=["a", "b"])


def _verify(pairs: DataFrame, classes: DataFrame, src: DataFrame, sets_of, percent: int) -> DataFrame:
    """The pairs of classes that link.  Their sets are made anew (``sets_of``) from one text each."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    first = ends.join(classes, "class").select(F.col("first").alias("_first")).distinct()
    # the candidates grow with the corpus: one plan at every size, never a broadcast of them
    texts = src.join(first.hint("merge"), F.coalesce("doc_id", F.lit(NO_ID)) == F.col("_first"), "left_semi").select("text")
    sets = stored(texts.mapInArrow(sets_of, "class long, grams binary"), "sets")
    one = pairs.join(sets.select(F.col("class").alias("a"), F.col("grams").alias("a_grams")), "a")
    both = one.join(sets.select(F.col("class").alias("b"), F.col("grams").alias("b_grams")), "b")
    return stored(both.select("a", "b", "a_grams", "b_grams").mapInArrow(lambda it: _linked(it, percent), "a long, b long"), "links")


def join_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, list_rows: int = LIST_ROWS, key_bits: int = 64, block: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable by links (null ids come last: a group
    of null ids alone has null).  Rows without a word link with nothing; repeated rows and
    copies link with each other.  Different sets whose keys (``key_bits`` bits) clash are told
    apart by 64 more bits.
    """
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    sized = stored(src.mapInArrow(lambda it: _sizes(it, k, key_bits), "doc_id long, n long, key long, check long, parity array<long>, chunk int, task int, counts binary"), "sizes")
    rows = sized.where("chunk is null").select("doc_id", "n", "key", "check", "parity")
    counts = _sketch(sized.where("chunk is not null").select("chunk", "task", "counts"))
    noise = int(np.median(counts))
    levels = _levels(counts, noise)
    parts = np.maximum(1, -(-(counts - noise) // list_rows)).astype(np.int32)
    turns, classes = _classes(rows)
    rows = _named(rows, turns).select("doc_id", "n", "class", "parity")

    share = spark.sparkContext.broadcast((levels, parts, turns))  # 5 bytes a cell, whatever the input, and the few renamed keys
    postings = src.select("text").mapInArrow(lambda it: _postings(it, k, key_bits, percent, *share.value), "shingle long, part int, class long, n int, pos int")
    lists = postings.repartition("shingle", "part").sortWithinPartitions("shingle", "part", "n", "class") \
        .mapInArrow(lambda it: _shared(it, share.value[1]), LISTS)
    lists = stored(lists, "lists")

    def sets_of(it):
        return _sets(it, k, key_bits, share.value[2])

    # a class is the more central the larger the share of its short lists that it shares
    rows_of = lists.select("shingle", "class", "n", "pos").distinct()
    central = rows_of.groupBy("class", "n").agg((F.count("*") / (F.col("n") - least_overlap(F.col("n"), percent) + 1)).alias("share"))
    member = stored(rows_of.join(central.drop("n"), "class"), "members")
    hub = member.groupBy("shingle").agg(F.max(F.struct("share", "class", "n", "pos")).alias("h")) \
        .select("shingle", F.col("h.class").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.pos").alias("hub_pos"))
    hub = stored(hub, "hubs")
    fits = may_reach(F.col("n"), F.col("hub_n"), F.col("pos"), F.col("hub_pos"), percent)
    met = member.join(hub, "shingle").where((F.col("class") != F.col("hub")) & fits).groupBy("class", "hub").agg(F.count("*").alias("times"))
    best = stored(met.groupBy("class").agg(F.max(F.struct("times", "hub")).alias("m")).select(F.col("class").alias("a"), F.col("m.hub").alias("b")), "best")
    links = _verify(best, classes, src, sets_of, percent)

    found = components(links, "comp1")
    member = stored(member.join(found.withColumnRenamed("node", "class"), "class", "left")
                    .select("shingle", "class", "n", "pos", F.coalesce("root", "class").alias("root")), "members2")
    mixed = member.groupBy("shingle").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("shingle")
    open_ = stored(member.join(mixed, "shingle", "left_semi"), "open")
    # the bitmap of a class is that of any of its rows
    ends = stored(open_.select("class").distinct(), "ends")
    bitmap = stored(rows.join(ends, "class", "left_semi").groupBy("class").agg(F.first("parity").alias("parity")), "parity")
    pairs = pairs_apart(open_.join(bitmap, "class"), percent, block)
    tried = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(_verify(pairs, classes, src, sets_of, percent))

    root = components(stored(links, "links2"), "comp2")
    named = stored(classes.select("class", "first").join(root.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")), "roots")
    smallest = named.groupBy("root").agg(F.min("first").alias("c"))
    named = named.join(smallest, "root").select("class", "c")
    # copies of one class may be a third of all rows: the join below adds no rows to a class
    out = rows.join(named.withColumnRenamed("class", "_c"), (F.col("class") == F.col("_c")) & (F.col("n") > 0), "left")
    own = F.when(F.col("c") == NO_ID, None).otherwise(F.coalesce("c", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
