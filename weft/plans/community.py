"""Community analytics over a label assignment ``(id, label)``.

All per-community statistics are computed by one ``groupBy`` with conditional sums,
which Spark runs as a partial (map-side) plus final hash aggregate: a community
holding a third of all vertices is pre-aggregated in every map task, never gathered
into one task.  Membership stays in long form ``(community, member)``; a sink writes
it range-partitioned, so even the largest community is spread over many files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.columns import flag_if, risk_code


def with_attrs(labels: DataFrame, vertices: DataFrame) -> DataFrame:
    """Attach the original vertex attributes to the labels (inner join on id, T18):
    ``(id, community, <attrs>)``."""
    return labels.select("id", F.col("label").alias("community")).join(vertices, "id")


def members(labels: DataFrame) -> DataFrame:
    """Membership ``(community, member)`` (C1, long form of the grouped lists)."""
    return labels.select(F.col("label").alias("community"), F.col("id").alias("member"))


def sizes(labels: DataFrame) -> DataFrame:
    """``(community, size)``."""
    return labels.groupBy(F.col("label").alias("community")).agg(F.count(F.lit(1)).alias("size"))


def _rejected(end_result: str, rejected: str):
    return F.col(end_result).cast("string") == F.lit(rejected)


def _passed_overdue(end_result: str, overdue: str, passed: str):
    return (F.col(end_result).cast("string") == F.lit(passed)) & (F.col(overdue).cast("string") == F.lit("1"))


def risk_table(labelled: DataFrame, end_result: str = "end_result", overdue: str = "overdue",
               rejected: str = "1", passed: str = "0") -> DataFrame:
    """``(community, size, rejected, passed_overdue)`` from ``with_attrs`` rows, zero
    counts kept (C4, C5, C6) — one aggregation instead of three and two joins."""
    return labelled.groupBy("community").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum(flag_if(_rejected(end_result, rejected))).cast("bigint").alias("rejected"),
        F.sum(flag_if(_passed_overdue(end_result, overdue, passed))).cast("bigint").alias("passed_overdue"),
    )


def rejected_sparse(labelled: DataFrame, end_result: str = "end_result", rejected: str = "1") -> DataFrame:
    """Filter first, then count: communities without a rejected vertex are absent."""
    return (labelled.filter(_rejected(end_result, rejected)).groupBy("community")
            .agg(F.count(F.lit(1)).alias("rejected")))


def overdue_sparse(labelled: DataFrame, end_result: str = "end_result", overdue: str = "overdue",
                   passed: str = "0") -> DataFrame:
    """Passed and overdue, filter first."""
    return (labelled.filter(_passed_overdue(end_result, overdue, passed)).groupBy("community")
            .agg(F.count(F.lit(1)).alias("passed_overdue")))


def cogroup_counts(labelled: DataFrame, end_result: str = "end_result", overdue: str = "overdue",
                   rejected: str = "1", passed: str = "0") -> DataFrame:
    """``cogroup`` of sizes, sparse rejected and sparse overdue counts (C8): per community
    the values of each side as a (possibly empty) list, rendered ``v1,v2,...``.

    Each side holds at most one value per community, so the lists are bounded; the
    three sides are full-outer-joined on the community key."""
    s = sizes(labelled.select("id", F.col("community").alias("label")))
    r = rejected_sparse(labelled, end_result, rejected)
    o = overdue_sparse(labelled, end_result, overdue, passed)
    j = s.join(r, "community", "full").join(o, "community", "full")

    def lst(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return j.select("community", lst("size").alias("sizes"), lst("rejected").alias("rejected"),
                    lst("passed_overdue").alias("passed_overdue"))


def vertex_risk_codes(labelled: DataFrame, end_result: str = "end_result", overdue: str = "overdue",
                      passed: str = "0", rejected: str = "1") -> DataFrame:
    """``(id, community, code)``: 11 passed+overdue, 22 passed not overdue, 33 rejected,
    NULL otherwise (C9)."""
    return labelled.select("id", "community",
                           risk_code(end_result, overdue, passed=passed, rejected=rejected).alias("code"))
