"""Tiny hand-made graphs of the survey's golden values (public GraphX results)."""

from pyspark.sql import functions as F

from weft.model import Graph, from_edges, from_vertices_and_edges

A, B, C, D = 4262387, 4849603, 4968188, 5109594


def edges_df(spark, pairs, attr=None):
    if attr is None:
        return spark.createDataFrame([(s, d) for s, d in pairs], "src bigint, dst bigint")
    return spark.createDataFrame([(s, d, a) for (s, d), a in zip(pairs, attr)], "src bigint, dst bigint, attr int")


def g1(spark) -> Graph:
    """4 vertices with (end_result, dpd7), 4 weighted edges, default (2, 2)."""
    v = spark.createDataFrame([(D, 1, 1), (A, 1, 0), (B, 1, 1), (C, 0, 0)], "id bigint, end_result int, dpd7 int")
    e = edges_df(spark, [(D, A), (D, B), (A, B), (D, C)], [1, 2, 2, 5])
    return from_vertices_and_edges(v, e, default={"end_result": 2, "dpd7": 2})


def simple(spark, pairs) -> Graph:
    return from_edges(edges_df(spark, pairs).withColumn("attr", F.lit(1)), 1)


def as_dict(df, key="id", value=None):
    rows = df.collect()
    value = value or [c for c in df.columns if c != key][0]
    return {r[key]: r[value] for r in rows}
