"""Helpers shared by the training-data operators.

Intermediate tables go to the shared folder named by ``spark.checkpoint.dir`` (see
``weft.session``): ``stored`` writes Parquet there and reads it back, which cuts the
lineage and lets a lost executor's work restart from the written table.
"""

from __future__ import annotations

import gc
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

import weft
from weft.session import scratch_path

#: a word is a run of anything but the six ASCII white-space characters
WORD = r"[^\x20\x09-\x0D]+"
#: rows per Arrow batch: texts may be long, so batches stay small
BATCH_ROWS = 256


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the re-read table."""
    spark = df.sparkSession
    # let Spark's cleaner find the shuffle files of the steps that are written already
    gc.collect()
    spark._jvm.System.gc()
    path = scratch_path(spark, name)  # removed when the process ends
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Before Python tasks: bound the Arrow batches by rows (texts of many MB may sit in one
    batch) and send this package to the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(weft.__file__).parent
        target = Path(tempfile.mkdtemp()) / "weft.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)


def bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and use it several times in ``fn`` (a let expression)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, salts: int = 64) -> DataFrame:
    """Left join ``rows`` with ``table`` (one row per ``key``, null a key of its own).

    A key that holds a third of all rows is spread over ``salts`` tasks: rows get a random
    but repeatable salt, the table's rows are repeated once per salt.
    """
    cols = [c for c in table.columns if c != key]
    right = table.select(F.col(key).alias("_k"), *cols, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"))
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col("doc_id")), F.lit(salts)).cast("int"))
    out = left.join(right, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_salt") == F.col("_s")), "left")
    return out.drop("_k", "_s", "_salt")


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """Sort globally and add ``rank`` (0-based): range partitions, rows numbered inside each,
    partition bases by a prefix sum over one count per partition."""
    ids = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    t = stored(ids, name).withColumn("_p", F.shiftright("_id", 33)).withColumn("_i", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    return with_base(t, t.groupBy("_p").agg(F.count("*").alias("n")), "n", "_base") \
        .withColumn("rank", F.col("_base") + F.col("_i")).drop("_id", "_p", "_i", "_base")


def with_base(rows: DataFrame, sizes: DataFrame, size: str, base: str) -> DataFrame:
    """Join to ``rows`` the sum of ``size`` over all earlier partitions ``_p``.  ``sizes`` has one
    row per partition, a number set by configuration, so it is sorted and broadcast whole."""
    w = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("_p", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long").alias(base))
    return rows.join(F.broadcast(bases), "_p")


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of the undirected edges ``(a, b)`` by randomised contraction.

    Each round every node picks the member of its closed neighbourhood with the smallest
    hash; edges are rewritten to the picks and deduplicated.  The number of nodes that are
    picked shrinks by a constant factor a round, whatever the order of the ids.  Returns
    ``(node, root)`` for every node of an edge.
    """
    e = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e")
    maps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))).alias("m"))
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("id"))
        m = stored(low.select("node", F.least("m", own)["id"].alias("root")), f"{name}-m")
        maps.append(m)
        x = e.join(m.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        x = x.join(m.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        e = stored(x.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{name}-e")
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1]
    for m in reversed(maps[:-1]):
        last = out.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        out = m.join(last, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    return out
