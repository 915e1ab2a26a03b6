"""Sinks (K1-K3): community membership and ranked vertex tables.

The reference wrote ``(cid, CompactBuffer(members...))`` text lines through
``groupByKey``.  Here membership is written in long form, range-partitioned and
sorted on ``(community, member)``: every file holds a contiguous slice of the
ordering and the largest community is split across files instead of being gathered
into one task.  ``format='text'`` writes ``community,member`` lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERSHIP_SCHEMA = "community BIGINT, member BIGINT"


def write_membership(members: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    ordered = members.repartitionByRange("community", "member").sortWithinPartitions("community", "member")
    if fmt == "parquet":
        ordered.write.mode(mode).parquet(path)
    elif fmt == "text":
        ordered.select(F.concat_ws(",", F.col("community").cast("string"), F.col("member").cast("string"))
                       .alias("value")).write.mode(mode).text(path)
    else:
        raise ValueError(fmt)


def write_membership_by_community(members: DataFrame, path: str, buckets: int = 256, mode: str = "errorifexists") -> None:
    """Membership in folders by a hash of the community, so one community is read from one folder.
    Inside a folder the rows are range-partitioned and sorted: a giant community has many files."""
    order = ["bucket", "community", "member"]
    rows = members.select("community", "member", _bucket(F.col("community"), buckets).alias("bucket"))
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("bucket").parquet(path)


def read_community(spark: SparkSession, path: str, community: int, buckets: int = 256) -> DataFrame:
    """``(community, member)`` of one community: its folder alone is read, and of that the row groups
    that may hold it.  ``buckets`` as written."""
    rows = spark.read.schema(f"{MEMBERSHIP_SCHEMA}, bucket INT").parquet(path)
    bucket = spark.range(1).select(_bucket(F.lit(community).cast("bigint"), buckets)).first()[0]
    return rows.filter((F.col("bucket") == bucket) & (F.col("community") == community)).select("community", "member")


def _bucket(community: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(community), F.lit(buckets)).cast("int")


def read_membership(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "parquet":
        return spark.read.schema(MEMBERSHIP_SCHEMA).parquet(path)
    parts = F.split(F.col("value"), ",")
    return spark.read.text(path).select(parts[0].cast("bigint").alias("community"),
                                        parts[1].cast("bigint").alias("member"))


def write_sizes(sizes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``(community, size)`` as ``community,size`` lines, sorted by community over the files."""
    _lines(sizes.repartitionByRange("community").sortWithinPartitions("community"), "community", "size").write.mode(mode).text(path)


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, "community", "size", "bigint")


def _lines(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.concat_ws(",", F.col(a).cast("string"), F.col(b).cast("string")).alias("value"))


def _fields(spark: SparkSession, path: str, a: str, b: str, kind: str) -> DataFrame:
    parts = F.split(F.col("value"), ",")
    return spark.read.text(path).select(parts[0].cast("bigint").alias(a), parts[1].cast(kind).alias(b))


def read_ranked(spark: SparkSession, path: str, value: str, kind: str = "double") -> DataFrame:
    return _fields(spark, path, "id", value, kind)


def write_ranked(df: DataFrame, value: str, path: str, mode: str = "errorifexists") -> None:
    """``sortBy(_._2, false).saveAsTextFile``: a global descending sort (range
    partitioned, ties by id) written as ``id,value`` lines."""
    ordered = df.orderBy(F.col(value).desc(), F.col("id").asc())
    ordered.select(F.concat_ws(",", F.col("id").cast("string"), F.col(value).cast("string")).alias("value")) \
        .write.mode(mode).text(path)
