"""Mix sources to target weights by pivotal dependent rounding.

Each source gets a word target.  A document's expected number of copies is its source's
target over its source's size; the whole part is taken as it is, the fractional part is
rounded by pivotal steps: two open documents meet, and word mass moves from one to the
other (the direction is random, weighted so that every expected copy count is kept) until
one of them is integral.  Mass is counted in words, so a step changes no source total.  At
most one document per group stays open; the open ones meet again, ``fan_in`` groups at a
time, up a reduction tree until one is left per source, which is rounded to the nearer
side.  A source's taken words thus differ from its target by at most half of one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weft.llm.common import numbered, salted_lookup, prepare, stored, words_of

WEIGHTS = (5.0, 2.0, 1.0)
ROUNDED = "sid long, doc_id long, size long, mass double, copies long, open boolean, bucket long"


def levels(s: DataFrame, total: float, all_w: float) -> DataFrame:
    """``ratio, rank, level`` of ranked sources: the level if all earlier ones are capped.  The
    running sums are taken inside range partitions, on top of the sums of the earlier ones."""
    s = stored(s.repartitionByRange("rank").withColumn("_p", F.spark_partition_id()), "mix-parts")
    sizes = s.groupBy("_p").agg(F.sum("cap").alias("_c"), F.sum("weight").alias("_w"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    bases = sizes.select("_p", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}0") for c in ("_c", "_w")])
    run = W.partitionBy("_p").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    cap, weight = (F.col(base) + F.coalesce(F.sum(c).over(run), F.lit(0.0)) for c, base in (("cap", "_c0"), ("weight", "_w0")))
    return s.join(F.broadcast(bases), "_p").select("ratio", "rank", ((F.lit(total) - cap) / (F.lit(all_w) - weight)).alias("level"))


def source_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size)`` -> plus ``sid`` (rank by code point, null last) and ``target``.

    Shares ``share`` of all sizes by weight; a target stops at ``most`` times its source's
    size and the excess is shared again.  That ends where target = min(cap, level * weight)
    for one level, found by sorting the sources by cap / weight: the level at which the
    k first are capped is (total - their caps) / (weight of the others).
    """
    s = numbered(sources, "mix-sources", F.col("source").asc_nulls_last()).withColumnRenamed("rank", "sid")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", pick).withColumn("cap", most * F.col("source_size"))
    s = numbered(s.withColumn("ratio", F.col("cap") / F.col("weight")), "mix-ratios", "ratio", "sid")
    t = s.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    total, all_w = share * float(t["t"] or 0), float(t["w"] or 0)
    level = levels(s, total, all_w).where("level <= ratio").agg(F.min_by("level", "rank").alias("l")).first()["l"]
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(float(level)) * F.col("weight"))
    return s.select("source", "sid", "source_size", target.cast("double").alias("target"))


def _unit(a: int, b: int, seed: int) -> float:
    """A repeatable number in [0, 1) from two ids (splitmix64 finaliser)."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    for m, s in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        x = ((x ^ (x >> s)) * m) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def pivot(rows: list[tuple[int, int, float]], carry: tuple[int, int, float] | None, seed: int):
    """Run ``(doc_id, size, mass)`` rows, 0 < mass < size, through the carried open row.
    Returns the settled ``(doc_id, size, copies)`` and the row that is left open."""
    done = []
    for doc, size, mass in rows:
        if carry is None:
            carry = (doc, size, mass)
            continue
        cd, cs, cm = carry
        up, down = min(cs - cm, mass), min(cm, size - mass)  # what the carried row can gain, lose
        move = up if _unit(cd or 0, doc or 0, seed) * (up + down) < down else -down
        pair = [(cd, cs, cm + move), (doc, size, mass - move)]
        carry = None
        for d, s, m in pair:
            eps = 1e-9 * s
            if m <= eps or m >= s - eps:
                done.append((d, s, int(m > s / 2)))
            elif carry is None:
                carry = (d, s, m)
            else:  # both open: only when rounding noise kept the mover off its border
                done.append((d, s, int(m > s / 2)))
    return done, carry


def _round_groups(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sid, bucket): settle each group; one row per group stays open."""
    key, carry = None, None
    names = ["sid", "doc_id", "size", "mass", "copies", "open", "bucket"]

    def batch(out):
        cols = list(zip(*out)) if out else [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    for b in batches:
        out: list[tuple] = []
        for sid, bucket, doc, size, mass in zip(*(b.column(c).to_pylist() for c in ("sid", "bucket", "doc_id", "size", "mass"))):
            if (sid, bucket) != key:
                if carry:
                    out.append((key[0], *carry, 0, True, key[1]))
                key, carry = (sid, bucket), None
            done, carry = pivot([(doc, size, mass)], carry, seed)
            out += [(sid, d, s, 0.0, c, False, bucket) for d, s, c in done]
        yield batch(out)
    if carry:
        yield batch([(key[0], *carry, 0, True, key[1])])


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 0, group_rows: int = 4_096, fan_in: int = 64) -> DataFrame:
    """Copies of each document in the mix: ``doc_id, source, size, source_size, target, copies, taken``.

    A null text has size 0; documents of size 0 and sources of size 0 get 0 copies; null
    doc_ids and repeated rows are documents of their own.  An empty table gives an empty
    one.  Reruns agree: the random directions are hashes of the ids that meet.
    """
    spark = docs.sparkSession
    prepare(spark)
    sized = stored(docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size")), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = stored(source_targets(sources.select("source", "source_size"), share, most)
                     .join(sources.select(F.col("source").alias("_s"), "n_docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    d = salted_lookup(sized, targets, "source").withColumn("whole", F.floor(rate + 1e-12)).withColumn("mass", (rate - F.col("whole")) * F.col("size"))
    d = d.withColumn("frac", (F.col("mass") > 1e-9 * F.col("size")) & (F.col("size") > 0))
    groups = F.ceil(F.col("n_docs") / group_rows)
    rows = d.where("frac").select("sid", F.pmod(F.xxhash64("doc_id", "size"), groups).cast("long").alias("bucket"), "doc_id", "size", "mass")
    most_groups = targets.agg(F.max(F.ceil(F.col("n_docs") / group_rows))).first()[0] or 1
    settled, level = [], 0
    while True:
        # large documents first: the row that stays open is then a small one
        g = rows.repartition("sid", "bucket").sortWithinPartitions("sid", "bucket", F.desc("size"), F.xxhash64("doc_id"), "doc_id")
        out = stored(g.mapInArrow(lambda it, s=seed * 97 + level: _round_groups(it, s), ROUNDED), f"mix-round{level}")
        settled.append(out.where("not open").select("sid", "doc_id", "size", "copies"))
        rows = out.where("open").select("sid", F.floor(F.col("bucket") / fan_in).alias("bucket"), "doc_id", "size", "mass")
        if most_groups <= 1:
            break
        most_groups, level = -(-most_groups // fan_in), level + 1
    settled.append(rows.select("sid", "doc_id", "size", (2 * F.col("mass") >= F.col("size")).cast("long").alias("copies")))
    extra = settled[0]
    for s in settled[1:]:
        extra = extra.unionByName(s)
    rounded = salted_lookup(extra.withColumn("_sid", F.col("sid")), targets.withColumnRenamed("sid", "_sid"), "_sid").drop("_sid")
    whole = F.floor(rate + 1e-12)
    rounded = rounded.withColumn("copies", F.col("copies") + whole)
    plain = d.where("not frac").select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("whole")).otherwise(0).cast("long").alias("copies"))
    both = plain.unionByName(rounded.select("doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies")))
    return both.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it (columns of ``docs``)."""
    # the user's row is one column, so no name of ours meets one of theirs
    key = F.xxhash64("doc_id", F.xxhash64("text"), "source")
    # equal rows share a key: the copies of a key are dealt to its rows in turn
    copies = mix(docs.select(key.alias("doc_id"), "text", "source"), **options)
    per = copies.groupBy("doc_id").agg(F.sum("copies").alias("_n"), F.count("*").alias("_rows")).withColumnRenamed("doc_id", "_key")
    rows = docs.select(F.struct("*").alias("_row"), key.alias("_key")).join(per, "_key")
    nth = F.row_number().over(W.partitionBy("_key").orderBy("_key"))
    rows = rows.withColumn("_i", F.when(F.col("_rows") > 1, nth).otherwise(1) - 1)
    take = F.floor(F.col("_n") / F.col("_rows")) + F.when(F.col("_i") < F.col("_n") % F.col("_rows"), 1).otherwise(0)
    rows = rows.withColumn("_take", take.cast("int")).where("_take > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_take")))).select("_row.*")
