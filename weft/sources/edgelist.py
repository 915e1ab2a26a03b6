"""Text sources: lines of text (``textFile``) and whitespace edge lists (``edgeListFile``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.model import Graph, from_edges


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as ``value``."""
    return spark.read.text(path)


def text_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The lines of a text column, as ``textFile`` would read the text: split on line
    breaks, empty lines kept, no empty line after a final line break.  ``value``."""
    t = F.replace(F.replace(F.col(text_col), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    # the final line break goes before the split: a test of the lines by their place would make
    # the optimizer carry the text along and split it again for every line
    t = F.when(t.endswith("\n"), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t)
    return df.filter(F.col(text_col) != "").select(F.explode(F.split(t, "\n")).alias("value"))


def parse_edge_list(lines: DataFrame, canonical_orientation: bool = False, value_col: str = "value") -> DataFrame:
    """Edge-list lines -> ``(src, dst, attr=1)`` (S12, ``GraphLoader.edgeListFile``).

    Empty lines and lines starting with ``#`` are skipped; the line is split on runs of
    whitespace and the first two fields are the ids (extra fields ignored); a line with
    fewer than two fields fails the job.  ``canonical_orientation`` swaps each edge so
    that ``src < dst``."""
    v = F.col(value_col)
    kept = lines.filter((F.length(v) > 0) & ~v.startswith("#"))
    parts = F.split(v, r"\s+")
    checked = kept.select(F.when(F.size(parts) < 2, F.raise_error(F.concat(F.lit("Invalid line: "), v)))
                          .otherwise(parts).alias("p"))
    e = checked.select(F.col("p")[0].cast("bigint").alias("src"), F.col("p")[1].cast("bigint").alias("dst"))
    if canonical_orientation:
        e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return e.select("src", "dst", F.lit(1).alias("attr"))


def edge_list_graph(spark: SparkSession, path: str, canonical_orientation: bool = False) -> Graph:
    """Graph from edge-list files: every vertex and edge attribute is 1."""
    return from_edges(parse_edge_list(read_lines(spark, path), canonical_orientation), 1)


def render_edge_list(edges: DataFrame) -> DataFrame:
    """``"<src> <dst>"`` lines of an edge table (``value``)."""
    return edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))
