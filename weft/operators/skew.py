"""Skew-safe equi-joins and lookups.

A single key (a shared device, a hub phone) may hold a large share of all rows, on either
side.  A plain shuffle join sends every row of that key to one task.

* ``salted_join`` lays the rows of a hot key out on a grid: its left rows are split over ``lb``
  buckets, its right rows over ``rb``, each left row goes to all ``rb`` cells of its bucket and
  each right row to all ``lb`` cells of its own.  Every pair of rows meets in exactly one cell,
  so the result multiset is that of the plain join.  Cold keys have one cell.
* ``split_lookup`` joins rows with a table that has one row per key: the rows of a hot key are
  split over buckets and the table's one row is copied to each.  It does not rest on the
  optimizer's skew join, which cannot split a side that is aggregated by the join's own key.

A key is hot when one side holds more than ``threshold`` of its rows and more than that side's
rows / ``max_hot``.  Fewer than ``max_hot`` keys a side can, whatever the data, so the list is
bounded without leaving any such key out; it is the only thing broadcast.  A hot key's bucket
has ``threshold`` rows at about; a key that is not hot has at most max(threshold, rows / max_hot).

Hot keys are found by a mergeable count sketch per side: the rows are counted per hash cell of
the key, in a number of cells that is fixed by ``max_hot``, so what is shuffled does not grow with
the keys.  A hot key's cell is at least as full as the key, so none is missed; the few cells that
are full enough are then counted by key, exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DEFAULT_THRESHOLD = 200_000   # rows of one key on one side handled by one task
DEFAULT_MAX_HOT = 10_000      # bound on the broadcast hot-key list
CELLS = 8                     # cells of the sketch per key that can be hot


def _conf_int(spark: SparkSession, name: str, default: int) -> int:
    value = spark.conf.get(name, None)
    return int(value) if value is not None else default


def skew_settings(spark: SparkSession) -> tuple[int, int]:
    return (_conf_int(spark, "weft.skew.threshold", DEFAULT_THRESHOLD),
            _conf_int(spark, "weft.skew.maxHotKeys", DEFAULT_MAX_HOT))


def hot_keys(left: DataFrame, right: DataFrame | None, keys: list[str], threshold: int, max_hot: int) -> DataFrame | None:
    """``keys, _lb, _rb``: the hot keys of both sides with their bucket counts, or None.

    One job counts both sides per cell and in total; only if a cell is full enough, a second
    one counts the keys of the full cells, so both sides' rules hold exactly."""
    spark = left.sparkSession
    some = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    cell = F.pmod(F.xxhash64(*keys), F.lit(CELLS * max_hot)).alias("_c")
    one, zero = F.lit(1), F.lit(0)
    cells = left.filter(some).select(cell, one.alias("_l"), zero.alias("_r"))
    if right is not None:
        cells = cells.unionByName(right.filter(some).select(cell, zero.alias("_l"), one.alias("_r")))
    seen = Observation()
    # one side alone is counted: all its rows pass here, and a count is cheaper than two sums
    sums = [F.sum("_l").alias("_l"), F.sum("_r").alias("_r")] if right is not None else [F.count(one).alias("_l"), zero.cast("long").alias("_r")]
    cells = cells.groupBy("_c").agg(*sums).observe(seen, F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    full = cells.filter((F.col("_l") > threshold) | (F.col("_r") > threshold)).collect()  # CELLS * max_hot rows at most
    if not full:
        return None
    least = [max(threshold, -(-(seen.get[s] or 0) // max_hot)) for s in "lr"]
    full = [(r["_c"],) for r in full if r["_l"] > least[0] or r["_r"] > least[1]]
    if not full:
        return None
    pick = F.broadcast(spark.createDataFrame(full, "_c long"))  # fewer than 2 * max_hot
    rows = left.select(*keys, one.alias("_l"), zero.alias("_r"))
    if right is not None:
        rows = rows.unionByName(right.select(*keys, zero.alias("_l"), one.alias("_r")))
    counts = rows.filter(some).withColumn("_c", cell).join(pick, "_c", "left_semi") \
        .groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    found = counts.filter((F.col("_l") > least[0]) | (F.col("_r") > least[1])).collect()
    buckets = [(*r[:-2], -(-r["_l"] // threshold) if r["_l"] > least[0] else 1, -(-r["_r"] // threshold) if r["_r"] > least[1] else 1) for r in found]
    return _list(spark, left, keys, buckets)


def _list(spark: SparkSession, like: DataFrame, keys: list[str], rows: list[tuple]) -> DataFrame | None:
    if not rows:
        return None
    schema = ", ".join(f"{k} {like.schema[k].dataType.simpleString()}" for k in keys) + ", _lb long, _rb long"
    return spark.createDataFrame(rows, schema)


def salted_join(left: DataFrame, right: DataFrame, keys: str | list[str],
                condition: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
                threshold: int | None = None, max_hot: int | None = None,
                count_left: DataFrame | None = None, count_right: DataFrame | None = None) -> DataFrame:
    """Inner equi-join ``left ⋈ right`` on ``keys`` (same names on both sides) plus an
    optional residual ``condition(L, R)`` built from column getters of the two sides
    (evaluated inside the join), splitting the hot keys of both sides.

    The key columns appear once in the output, as in ``DataFrame.join(on=[...])``.

    ``count_left`` / ``count_right``: count a side's keys on this frame instead (a materialised
    table with the same key distribution, so the counting does not re-derive the side).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    t, h = skew_settings(left.sparkSession)
    hot = hot_keys(left if count_left is None else count_left, right if count_right is None else count_right,
                   keys, threshold or t, max_hot or h)
    on = list(keys)
    l, r = left, right
    if hot is not None:
        hot = F.broadcast(hot)  # fewer than 2 * max_hot rows
        l, r = _on_grid(left, hot, keys, "_lb", "_rb", "_i", "_j"), _on_grid(right, hot, keys, "_rb", "_lb", "_j", "_i")
        on += ["_i", "_j"]
    l, r = l.alias("_l"), r.alias("_r")
    cond = None
    for k in on:
        c = F.col(f"_l.{k}") == F.col(f"_r.{k}")
        cond = c if cond is None else cond & c
    if condition is not None:
        cond = cond & condition(lambda c: F.col(f"_l.{c}"), lambda c: F.col(f"_r.{c}"))
    out = [F.col(f"_l.{k}").alias(k) for k in keys]
    out += [F.col(f"_l.{c}") for c in left.columns if c not in keys]
    out += [F.col(f"_r.{c}") for c in right.columns if c not in keys]
    return l.join(r, cond, "inner").select(*out)


def _on_grid(df: DataFrame, hot: DataFrame, keys: list[str], own: str, other: str, bucket: str, cell: str) -> DataFrame:
    """Give a row its bucket (by a hash of the whole row) and copy it to the other side's cells."""
    row_hash = F.xxhash64(*[F.col(c) for c in df.columns])
    return (df.join(hot, keys, "left")
            .withColumn(bucket, F.pmod(row_hash, F.coalesce(own, F.lit(1))))
            .withColumn(cell, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1)))
            .drop(own, other))


def hot_rows(table: DataFrame, keys: list[str], rows_of: str, threshold: int, max_hot: int) -> DataFrame | None:
    """The hot keys of a table that says per key how many rows will look it up."""
    total = table.agg(F.sum(rows_of)).first()[0] or 0
    least = max(threshold, -(-total // max_hot))
    if total <= threshold:
        return None
    found = table.filter(F.col(rows_of) > least).select(*keys, rows_of).collect()  # fewer than max_hot
    return _list(table.sparkSession, table, keys, [(*r[:-1], -(-r[-1] // threshold), 1) for r in found])


def split_lookup(rows: DataFrame, table: DataFrame, keys: str | list[str], how: str = "inner", rows_of: str | None = None,
                 hot: DataFrame | None = None, known: bool = False, threshold: int | None = None, max_hot: int | None = None) -> DataFrame:
    """Join ``rows`` with ``table``, which has one row per key (``how``: inner, left, left_semi or
    left_anti; a null key matches nothing).  The rows of a hot key are split over tasks.

    Hot keys come from the column ``rows_of`` of the table (how many rows have the key), from
    ``hot`` (``keys, _lb``, or None with ``known``: there is none), or from a pass over ``rows``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    t, h = skew_settings(rows.sparkSession)
    t, h = threshold or t, max_hot or h
    if hot is None and not known:
        hot = hot_rows(table, keys, rows_of, t, h) if rows_of else hot_keys(rows, None, keys, t, h)
    null = F.expr(" OR ".join(f"{k} IS NULL" for k in keys))
    # the partition's number is part of the hash: equal rows spread too, and a task that runs
    # again gives each of its rows the same bucket
    spread = F.xxhash64(*[F.col(c) for c in rows.columns], F.spark_partition_id())
    nullable = how in ("left", "left_anti") and any(rows.schema[k].nullable for k in keys)
    if hot is None and not nullable:
        return rows.join(table, keys, how)
    if hot is None:
        left, right = rows.withColumn("_lb", F.lit(1).cast("long")), table.withColumn("_i", F.lit(0).cast("long"))
    else:
        hot = F.broadcast(hot.select(*keys, "_lb"))  # fewer than max_hot rows
        left, right = rows.join(hot, keys, "left"), table.join(hot, keys, "left")
        right = right.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_lb", F.lit(1).cast("long")) - 1))).drop("_lb")
    # rows without a key match nothing: they are dealt out as well
    buckets = F.when(null, F.lit(1 << 20).cast("long")).otherwise(F.coalesce("_lb", F.lit(1).cast("long")))
    left = left.withColumn("_i", F.when(null | (F.col("_lb") > 1), F.pmod(spread, buckets)).otherwise(F.lit(0).cast("long"))).drop("_lb")
    return left.join(right, [*keys, "_i"], how).drop("_i")
