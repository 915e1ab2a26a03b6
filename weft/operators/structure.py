"""Structural and property operators on a ``Graph``.

All of them are plain projections, filters, semi/anti joins and aggregations, so
Catalyst prunes columns and pushes predicates to the parquet scans underneath.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.columns import scala_string, scala_tuple
from weft.model import Graph, both_ends
from weft.operators.skew import split_lookup
from weft.plans.iterate import cut_lineage, triplets  # noqa: F401  (triplets re-exported: T5)


def counts(graph: Graph) -> DataFrame:
    """``(num_vertices, num_edges)`` in one row (T1), from two global aggregates."""
    nv = graph.vertices.agg(F.count(F.lit(1)).alias("num_vertices"))
    ne = graph.edges.agg(F.count(F.lit(1)).alias("num_edges"))
    return one_row(nv, ne)


def one_row(*single_rows: DataFrame) -> DataFrame:
    """Put one-row aggregate frames with distinct columns side by side.

    A union (missing columns NULL) folded by one global aggregate: no join, so no
    Cartesian product and no broadcast nested loop in the plan."""
    cols = [c for df in single_rows for c in df.columns]
    u = single_rows[0]
    for df in single_rows[1:]:
        u = u.unionByName(df, allowMissingColumns=True)
    return u.agg(*[F.max(c).alias(c) for c in cols])


def degrees(graph: Graph) -> DataFrame:
    """``(id, degree)``: in + out, parallel edges counted, a self-loop counts twice;
    vertices without edges are absent (T8)."""
    return both_ends(graph.edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def in_degrees(graph: Graph) -> DataFrame:
    """``(id, in_degree)``; vertices with none are absent."""
    return graph.edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))


def out_degrees(graph: Graph) -> DataFrame:
    """``(id, out_degree)``; vertices with none are absent."""
    return graph.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))


def subgraph(graph: Graph, vpred: Column | None = None, epred: Column | None = None) -> Graph:
    """Vertices passing ``vpred`` and the edges passing ``epred`` whose *both* ends
    pass (T11).  ``vpred`` sees the vertex columns, ``epred`` the edge columns."""
    v = graph.vertices if vpred is None else graph.vertices.filter(vpred)
    e = graph.edges if epred is None else graph.edges.filter(epred)
    if vpred is not None:
        ids = v.select("id")
        e = (e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
             .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return Graph(v, e.select(*graph.edges.columns))


def map_vertices(graph: Graph, **new_attrs: Column) -> Graph:
    """Replace the vertex attributes by the given expressions; structure kept."""
    return Graph(graph.vertices.select("id", *[c.alias(n) for n, c in new_attrs.items()]), graph.edges)


def init_labels(graph: Graph) -> DataFrame:
    """Vertex attribute := own id (label initialisation, T12/A10): ``(id, label)``."""
    return graph.vertices.select("id", F.col("id").alias("label"))


def reverse(graph: Graph) -> Graph:
    """Swap every edge's direction, attributes kept."""
    e = graph.edges
    swapped = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *graph.edge_attrs)
    return Graph(graph.vertices, swapped)


def mask(graph: Graph, other: Graph) -> Graph:
    """Restrict ``graph`` to the vertices and edges that are also in ``other``, keeping
    ``graph``'s attributes (T15).  Edges match on (src, dst)."""
    v = cut_lineage(graph.vertices.join(other.vertices.select("id"), "id", "left_semi"))
    e = cut_lineage(graph.edges.join(cut_lineage(other.edges.select("src", "dst").distinct()), ["src", "dst"], "left_semi"))
    for end in ("src", "dst"):  # a hub's edges are split over tasks
        e = split_lookup(e, v.select(F.col("id").alias(end)), end, "left_semi")
    return Graph(v, e.select(*graph.edges.columns))


def outer_join_vertices(graph: Graph, table: DataFrame, value: str, default, name: str | None = None) -> DataFrame:
    """Left outer join a per-vertex table ``(id, value)`` onto the vertices, missing ->
    ``default`` (T16): ``(id, name)``."""
    name = name or value
    return (graph.vertices.select("id").join(table.select("id", value), "id", "left")
            .select("id", F.coalesce(F.col(value), F.lit(default)).alias(name)))


def edge_inverse_out_degree(graph: Graph) -> DataFrame:
    """Edge weight 1 / out-degree of the source (T17): ``(src, dst, weight)``."""
    od = out_degrees(graph).withColumnRenamed("id", "src")
    return graph.edges.join(od, "src").select("src", "dst", (F.lit(1.0) / F.col("out_degree")).alias("weight"))


def triplet_strings(trip: DataFrame, src_attrs: list[str], dst_attrs: list[str], edge_attr: str) -> DataFrame:
    """Render triplets as text (T6):
    ``s1`` = ``src-<a1>-<a2>-dst-<b1>-<b2><edge>`` (attributes dash-joined, edge appended),
    ``s2`` = ``src-<attr>|<edge>|dst-<attr>`` with a tuple attribute printed ``(a,b)``."""
    def tup(cols):
        return scala_string(cols[0]) if len(cols) == 1 else scala_tuple(*cols)

    s1 = F.concat_ws("-", scala_string("src"), *[scala_string(c) for c in src_attrs], scala_string("dst"),
                     *[scala_string(c) for c in dst_attrs])
    s1 = F.concat(s1, scala_string(edge_attr))
    s2 = F.concat(scala_string("src"), F.lit("-"), tup(src_attrs), F.lit("|"), scala_string(edge_attr),
                  F.lit("|"), scala_string("dst"), F.lit("-"), tup(dst_attrs))
    return trip.select(s1.alias("s1"), s2.alias("s2"))
