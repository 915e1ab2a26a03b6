"""weft — property-graph analytics on Spark DataFrames."""

from weft.model import Graph, from_edges, from_vertices_and_edges

__all__ = ["Graph", "from_edges", "from_vertices_and_edges"]
