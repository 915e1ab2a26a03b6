"""Property multigraph held as two DataFrames, and the graph builders.

``vertices(id BIGINT NOT NULL, <attrs>)`` and ``edges(src BIGINT, dst BIGINT, <attrs>)``.
Parallel edges and self-loops are allowed (multigraph); vertex ids are unique.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID_TYPES = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    # True when the vertex set is exactly the set of edge endpoints (``from_edges``):
    # algorithms then derive vertex ids from the (materialised) edges and skip the
    # isolated-vertex pass.
    endpoints_only: bool = False

    def __post_init__(self):
        _require(self.vertices, ["id"], "vertices")
        _require(self.edges, ["src", "dst"], "edges")

    @property
    def vertex_attrs(self) -> list[str]:
        return [c for c in self.vertices.columns if c != "id"]

    @property
    def edge_attrs(self) -> list[str]:
        return [c for c in self.edges.columns if c not in ("src", "dst")]

    def with_vertices(self, vertices: DataFrame) -> "Graph":
        return Graph(vertices, self.edges, self.endpoints_only)

    def with_edges(self, edges: DataFrame) -> "Graph":
        return Graph(self.vertices, edges)


def _require(df: DataFrame, cols: list[str], what: str) -> None:
    fields = {f.name: f.dataType for f in df.schema.fields}
    for c in cols:
        if c not in fields:
            raise ValueError(f"{what} need a column '{c}', got {df.columns}")
        if not isinstance(fields[c], ID_TYPES):
            raise TypeError(f"{what}.{c} must be an integral id column, got {fields[c].simpleString()}")


def _ids(col: str) -> Column:
    return F.col(col).cast("bigint")


def edges_from_pairs(pairs: DataFrame, src: str = "src", dst: str = "dst", attr: Column | None = None,
                     attr_name: str = "attr") -> DataFrame:
    """Row -> Edge(src.toLong, dst.toLong, attr): cast ids, attach a constant or column attribute."""
    cols = [_ids(src).alias("src"), _ids(dst).alias("dst")]
    if attr is not None:
        cols.append(attr.alias(attr_name))
    return pairs.select(*cols)


def endpoint_ids(edges: DataFrame) -> DataFrame:
    """Distinct ids seen at either end of an edge table."""
    return both_ends(edges).distinct()


def both_ends(edges: DataFrame) -> DataFrame:
    """The bag of ids at both ends, ``(id)``, in one pass over the edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id"))


def from_edges(edges: DataFrame, default: Column | object = 1, attr_name: str = "attr") -> Graph:
    """``Graph.fromEdges``: vertices are the distinct endpoints, all with the default attribute."""
    value = default if isinstance(default, Column) else F.lit(default)
    vertices = endpoint_ids(edges).select("id", value.alias(attr_name))
    return Graph(vertices, edges, endpoints_only=True)


def from_vertices_and_edges(vertices: DataFrame, edges: DataFrame, default: dict | None = None) -> Graph:
    """``Graph(vertices, edges[, default])``.

    Every given vertex is kept; endpoints missing from ``vertices`` are added with the
    ``default`` attributes (a dict column -> value), or NULL attributes when no default
    is given.  Duplicate vertex ids collapse to one row: the smallest attribute tuple,
    so the choice is deterministic.
    """
    attrs = [c for c in vertices.columns if c != "id"]
    vertices = _dedupe_vertices(vertices, attrs)
    missing = endpoint_ids(edges).join(vertices.select("id"), "id", "left_anti")
    fill = []
    for c in attrs:
        dtype = vertices.schema[c].dataType
        value = F.lit(default[c]) if default and c in default else F.lit(None)
        fill.append(value.cast(dtype).alias(c))
    return Graph(vertices.unionByName(missing.select("id", *fill)), edges)


def _dedupe_vertices(vertices: DataFrame, attrs: list[str]) -> DataFrame:
    if not attrs:
        return vertices.select("id").distinct()
    best = F.min(F.struct(*[F.col(c) for c in attrs])).alias("_a")
    return vertices.groupBy("id").agg(best).select("id", *[F.col(f"_a.{c}").alias(c) for c in attrs])


def nodes_from_both_ends(rows: DataFrame, source: str, target: str,
                         source_attrs: list[str], target_attrs: list[str], names: list[str]) -> DataFrame:
    """Vertex rows from both ends of attributed edge rows: project each end, union all, distinct."""
    def end(node, attrs):
        return F.struct(_ids(node).alias("id"), *[F.col(a).alias(n) for a, n in zip(attrs, names)])

    return rows.select(F.inline(F.array(end(source, source_attrs), end(target, target_attrs)))).distinct()
