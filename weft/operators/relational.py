"""General relational operators of the reference jobs (F1-F16), DataFrame style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.operators.skew import split_lookup
from weft.plans.iterate import cut_lineage


def key_count(df: DataFrame, key: str, name: str = "cnt") -> DataFrame:
    """``map((k, 1)).reduceByKey(_ + _)`` (F1): partial + final hash aggregate."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


#: bits of the filter in front of ``complement``, and bits of one of its rows
FILTER_BITS, ROW_BITS = 1 << 25, 1 << 15


def bit_filter(keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``(_row, _bits)``: a bit is set if a row of ``keys`` hashes to it; ``bits`` / 8 bytes at most."""
    at = F.pmod(F.xxhash64(*keys.columns), F.lit(bits))
    rows = keys.select(F.floor(at / ROW_BITS).cast("int").alias("_row"), (at % ROW_BITS).alias("_bit"))
    return rows.groupBy("_row").agg(F.expr("bitmap_construct_agg(_bit)").alias("_bits"))


def complement(a: DataFrame, b: DataFrame, on: str | list[str], bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``a`` whose key is not in ``b`` (F11); ``a``'s duplicates and rows with a null key
    are kept (an anti join, not ``EXCEPT``).

    A bit filter of ``b``'s keys, of a fixed size, is broadcast: rows it does not know stay
    without a shuffle.  The others meet the keys in an anti join that splits hub values."""
    on = on if isinstance(on, list) else [on]
    keys = cut_lineage(b.select(*on).distinct())
    at = F.pmod(F.xxhash64(*on), F.lit(bits))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor((at % ROW_BITS) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known = F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    rows = a.withColumn("_row", F.floor(at / ROW_BITS).cast("int")).join(F.broadcast(bit_filter(keys, bits)), "_row", "left")
    rows = rows.select(*a.columns, known.alias("_known"))
    maybe = split_lookup(rows.filter("_known").select(*a.columns), keys, on, "left_anti").select(*a.columns)
    return rows.filter("NOT _known").select(*a.columns).union(maybe)


def partition_filter(pairs: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """Keep the first field of pairs whose second field equals ``value`` (F16).
    The reference built the list per partition in reverse order; no order is promised."""
    return pairs.filter(F.col(second) == F.lit(value)).select(first)


def top(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """``top(n)`` by an explicit ordering (F6, F7): ``TakeOrderedAndProject``, a bounded
    per-task heap plus one merge of n rows per task."""
    return df.orderBy(*order).limit(n)


def natural_desc(df: DataFrame) -> list[Column]:
    """Natural (tuple / string) descending order over all columns, as ``RDD.top``."""
    return [F.col(c).desc_nulls_last() for c in df.columns]


def distinct_count(df: DataFrame, name: str = "cnt") -> DataFrame:
    """``distinct().count()`` as a one-row frame."""
    return df.distinct().agg(F.count(F.lit(1)).alias(name))


def page(df: DataFrame, order: list[str], skip: int, size: int) -> DataFrame:
    """``SKIP skip LIMIT size`` over a total order."""
    return df.orderBy(*order).offset(skip).limit(size)


#: rows that one task numbers; more, or pages further on, are ranked by range partitions
FIRST_ROWS = 100_000


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``rank`` (from 0) in a total order: rows are numbered inside range partitions, on
    top of the sum of the earlier partitions' counts (a row per partition, broadcast)."""
    t = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    t = t.withColumn("_p", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = t.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return t.join(F.broadcast(base), "_p").select(*df.columns, (F.col("_base") + F.col("_at")).alias("rank"))


def pages(df: DataFrame, order: list[str], n: int, size: int, first: int = 0) -> DataFrame:
    """``n`` pages of ``size`` rows over a total order, from page ``first`` on, with their ``page``
    number.  The first few rows are one bounded top-k pass; any other pages come from global
    ranks, so no task sorts more than its range."""
    if first == 0 and n * size <= FIRST_ROWS:
        rows = df.orderBy(*order).limit(n * size).withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)
    else:
        rows = numbered(df, order).filter((F.col("rank") >= first * size) & (F.col("rank") < (first + n) * size))
    return rows.select(*df.columns, F.floor(F.col("rank") / size).cast("int").alias("page"))
