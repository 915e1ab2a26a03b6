"""One document of each group of near copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weft.llm import jaccard_join
from weft.llm.common import numbered, stored


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays, of rows that share it the
    one with the smallest text hash.  Rows that share an id but hold different texts are
    documents of their own; a row without an id comes behind all others.  The user's row is
    one column while it is worked on, so columns of any name pass unchanged."""
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_h"))
    keys = numbered(packed.select("_doc", "_h").distinct(), "near-keys", F.col("_doc").asc_nulls_last(), "_h")
    keys = keys.select(F.col("_doc").alias("_id"), F.col("_h").alias("_key"), F.col("rank").alias("_rank"))
    ranked = packed.join(keys, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_key")))
    rows = stored(ranked.select("_row", "_rank"), "near-rows")
    groups = jaccard_join.join_groups(rows.select(F.col("_rank").alias("doc_id"), F.col("_row.text").alias("text")))
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_rank")).distinct()
    nth = F.row_number().over(W.partitionBy("_rank").orderBy(F.xxhash64("_row")))
    return rows.join(first, "_rank", "left_semi").withColumn("_nth", nth).where("_nth = 1").select("_row.*")
