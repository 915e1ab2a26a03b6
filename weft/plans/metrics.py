"""Network metrics of a graph (M1-M8) as one-row DataFrames.

Every scalar is a global aggregate; the report combines them with a union folded by
one aggregate (``one_row``), never a join of single rows.  Defects of the reference
are resolved as: density 0.0 for N < 2, sums over no rows are 0, d*(d-1) in BIGINT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.columns import fixed_decimals
from weft.model import Graph, endpoint_ids
from weft.operators.structure import degrees, in_degrees, one_row
from weft.plans.algorithms import _canonical, triangle_count
from weft.plans.iterate import cut_lineage


def _n_l(graph: Graph) -> list[DataFrame]:
    return [graph.vertices.agg(F.count(F.lit(1)).alias("num_vertices")),
            graph.edges.agg(F.count(F.lit(1)).alias("num_edges"))]


def _degree_stats(graph: Graph) -> DataFrame:
    d = degrees(graph)
    return d.agg(F.coalesce(F.sum("degree"), F.lit(0)).cast("bigint").alias("degree_sum"),
                 F.count(F.when(F.col("degree") == 1, 1)).alias("single_neighbor_nodes"),
                 F.count(F.when(F.col("degree") > 1, 1)).alias("multi_neighbor_nodes"))


def _clustering_parts(graph: Graph, mode: str = "in_degree") -> list[DataFrame]:
    tri = triangle_count(graph).agg(F.coalesce(F.sum("triangles"), F.lit(0)).cast("bigint").alias("tri_sum"))
    if mode == "in_degree":
        d = in_degrees(graph).select(F.col("in_degree").cast("bigint").alias("d"))
    elif mode == "undirected":
        e = _canonical(graph.edges)
        d = (e.select(F.explode(F.array("lo", "hi")).alias("id"))
             .groupBy("id").agg(F.count(F.lit(1)).alias("d")))
    else:
        raise ValueError(mode)
    den = d.agg(F.coalesce(F.sum(F.col("d") * (F.col("d") - 1) / 2.0), F.lit(0.0)).alias("triple_sum"))
    return [tri, den]


def _avg(num: str, den: str):
    return F.when(F.col(den) == 0, F.lit(0.0)).otherwise(F.col(num).cast("double") / F.col(den))


def _density():
    n = F.col("num_vertices").cast("double")
    return F.when(F.col("num_vertices") < 2, F.lit(0.0)).otherwise(2.0 * F.col("num_edges") / (n * (n - 1.0)))


def graph_counts(graph: Graph) -> DataFrame:
    """``(num_vertices, num_edges)`` (M1)."""
    return one_row(*_n_l(graph))


def avg_degree(graph: Graph) -> DataFrame:
    """``(avg_degree)`` = sum of degrees / N (M2)."""
    r = one_row(*_n_l(graph), _degree_stats(graph))
    return r.select(_avg("degree_sum", "num_vertices").alias("avg_degree"))


def degree_buckets(graph: Graph) -> DataFrame:
    """``(single_neighbor_nodes, multi_neighbor_nodes)``: degree == 1 and > 1 (M3, M4)."""
    return _degree_stats(graph).select("single_neighbor_nodes", "multi_neighbor_nodes")


def density(graph: Graph) -> DataFrame:
    """``(density, density_text)``: 2L / (N (N-1)) and its ``%.9f`` text (M5)."""
    r = one_row(*_n_l(graph)).select(_density().alias("density"))
    return r.select("density", fixed_decimals("density", 9).alias("density_text"))


def clustering(graph: Graph, mode: str = "in_degree") -> DataFrame:
    """``(clustering)`` = sum of per-vertex triangles / sum of d(d-1)/2 (M6, M7).

    ``mode='in_degree'`` is the reference's formula (d = in-degree; can exceed 1);
    ``mode='undirected'`` uses the simple undirected degree (textbook global
    clustering coefficient)."""
    r = one_row(*_clustering_parts(graph, mode))
    return r.select(_avg("tri_sum", "triple_sum").alias("clustering"))


def _end_stats(graph: Graph) -> DataFrame:
    """Every number of the report that comes from the edges' ends, in one pass over the edges: per
    vertex its degree and in-degree, then one row."""
    end = lambda c, n: F.struct(F.col(c).alias("id"), F.lit(n).alias("head"))
    d = graph.edges.select(F.inline(F.array(end("src", 0), end("dst", 1)))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("head").alias("d"))
    none = F.lit(0)
    return d.agg(F.count(F.lit(1)).alias("num_ends"), F.coalesce(F.sum("degree"), none).cast("bigint").alias("degree_sum"),
                 F.count(F.when(F.col("degree") == 1, 1)).alias("single_neighbor_nodes"), F.count(F.when(F.col("degree") > 1, 1)).alias("multi_neighbor_nodes"),
                 F.coalesce(F.sum(F.col("d") * (F.col("d") - 1) / 2.0), F.lit(0.0)).alias("triple_sum"))


def network_report(graph: Graph) -> DataFrame:
    """All metrics of the reference's report in one row (M8).  The edges are written once; one pass
    over them gives every number but the triangles."""
    edges = cut_lineage(graph.edges.select("src", "dst"))
    vertices = endpoint_ids(edges) if graph.endpoints_only else graph.vertices.select("id")
    g = Graph(vertices, edges, graph.endpoints_only)
    parts = [_end_stats(g), triangle_count(g).agg(F.coalesce(F.sum("triangles"), F.lit(0)).cast("bigint").alias("tri_sum"))]
    if not graph.endpoints_only:
        parts.append(graph.vertices.agg(F.count(F.lit(1)).alias("num_vertices")))
    r = one_row(*parts).withColumn("num_edges", (F.col("degree_sum") / 2).cast("bigint"))
    if graph.endpoints_only:
        r = r.withColumnRenamed("num_ends", "num_vertices")
    return r.select(
        "num_vertices", "num_edges",
        _avg("degree_sum", "num_vertices").alias("avg_degree"),
        "single_neighbor_nodes", "multi_neighbor_nodes",
        fixed_decimals(_density(), 9).alias("density_text"),
        _avg("tri_sum", "triple_sum").alias("clustering"),
    )
