"""Bulk-synchronous building blocks: message aggregation, Pregel, lineage cuts.

GraphX ships no Python API, so every superstep is a DataFrame round:
values are joined onto a static adjacency table (persisted once, partitioned by the
neighbour id) and messages are combined with a partial (map-side) aggregation.

Hub vertices: a vertex whose id sits in a large share of the adjacency rows would put
all of them in one join task.  ``Adjacency`` finds such hubs once (a bounded broadcast
table, see ``weft.operators.skew``), splits their adjacency rows into buckets and
replicates only the hub's *value row* once per bucket in every round.

Lineage: a driver loop grows the logical plan by one round per iteration.  The rounds
write their (small) vertex values with a reliable ``DataFrame.checkpoint()`` into the shared
``spark.checkpoint.dir``: this truncates the plan, makes the loop restartable after executor
loss, and gives every round the same plan, so its code is generated and compiled once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weft.model import Graph, endpoint_ids
from weft.operators.skew import hot_keys, skew_settings
from weft.session import ensure_checkpoint_dir, scratch_path

DEFAULT_CHECKPOINT_EVERY = 5


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the shared checkpoint folder and return the re-read frame."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table into the shared folder: its readers prune columns and rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``cut_lineage`` with aggregates of the written rows, taken by the write itself."""
    seen = Observation()
    cut = cut_lineage(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]))
    return cut, {n: seen.get.get(n) for n in metrics}


def materialise(graph: Graph, edge_cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Checkpoint a graph's edges (``src, dst`` + ``edge_cols``) and vertex ids once,
    before a loop, so no round re-derives them from the source tables.  For
    ``from_edges`` graphs the ids come from the materialised edges."""
    edges = cut_lineage(graph.edges.select("src", "dst", *(edge_cols or [])))
    if graph.endpoints_only:
        ids = cut_lineage(endpoint_ids(edges))
    else:
        ids = cut_lineage(graph.vertices.select("id"))
    return ids, edges


class Adjacency:
    """Directed adjacency ``(me, nbr)``: row (me, nbr) means *me* receives the value of *nbr*.

    ``direction``: ``"both"`` (undirected, each edge gives both rows; a self-loop gives
    two rows for its vertex), ``"out"`` (src receives from dst) or ``"in"`` (dst
    receives from src).  Parallel edges are kept, so they count as often as they occur.
    """

    def __init__(self, edges: DataFrame, direction: str = "both", extra: list[str] | None = None,
                 multiplicity: str = "bag", with_direction: bool = False):
        """``multiplicity``: ``"bag"`` keeps one row per edge; ``"count"`` pre-aggregates
        parallel rows into ``(me, nbr, mult)`` (for senders whose messages add up);
        ``"set"`` keeps distinct ``(me, nbr)`` (for idempotent merges such as min).
        ``with_direction``: a column ``forward`` tells rows along an edge from those against."""
        extra = list(extra or [])
        fwd = F.struct(F.col("dst").alias("me"), F.col("src").alias("nbr"), F.lit(True).alias("forward"))    # dst hears src
        back = F.struct(F.col("src").alias("me"), F.col("dst").alias("nbr"), F.lit(False).alias("forward"))  # src hears dst
        ways = {"both": [fwd, back], "in": [fwd], "out": [back]}[direction]
        adj = edges.select(*extra, F.inline(F.array(*ways)))
        adj = adj.select("me", "nbr", *extra, "forward") if with_direction else adj.select("me", "nbr", *extra)
        if with_direction:
            extra = extra + ["forward"]
        if multiplicity == "count":
            adj = adj.groupBy("me", "nbr", *extra).agg(F.count(F.lit(1)).alias("mult"))
            extra = extra + ["mult"]
        elif multiplicity == "set":
            adj = adj.distinct()
        elif multiplicity != "bag":
            raise ValueError(multiplicity)
        spark = edges.sparkSession
        threshold, max_hot = skew_settings(spark)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        adj = cut_lineage(adj)
        # a bounded list (see ``hot_keys``): resolved once, every round broadcasts it
        hot = hot_keys(adj, None, ["nbr"], threshold, max_hot)
        self.salted = hot is not None
        self.hot = F.broadcast(hot.select(F.col("nbr").alias("_hid"), F.col("_lb").alias("_salts"))) if self.salted else None
        if self.salted:
            row_hash = F.xxhash64(F.col("me"), F.col("nbr"))
            adj = (adj.join(self.hot, F.col("nbr") == F.col("_hid"), "left")
                   .withColumn("_b", F.when(F.col("_salts").isNull(), F.lit(0))
                               .otherwise(F.pmod(row_hash, F.col("_salts"))).cast("int"))
                   .drop("_hid", "_salts"))
            self.keys = ["nbr", "_b"]
        else:
            self.keys = ["nbr"]
        # persisted (not checkpointed) after the repartition: the cached relation keeps
        # its hash partitioning, so each round shuffles only the value side of the
        # join; its lineage is the short path back to the checkpoint above
        self.adj = adj.repartition(n, *self.keys).persist(StorageLevel.MEMORY_AND_DISK)
        self.adj.count()   # fill the cache now: only a materialised cache reports its partitioning
        self.extra = extra

    def gather(self, values: DataFrame, cols: list[str]) -> DataFrame:
        """For each adjacency row, the neighbour's ``cols`` from ``values(id, cols...)``:
        returns ``(me, nbr, <extra edge cols>, <cols>)``."""
        v = values.select(F.col("id").alias("nbr"), *cols)
        if not self.salted:
            return self.adj.join(v, "nbr")
        v = (v.join(self.hot, F.col("nbr") == F.col("_hid"), "left")
             .withColumn("_b", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
             .drop("_hid", "_salts"))
        return self.adj.join(v, ["nbr", "_b"]).drop("_b")

    def votes(self, labels: DataFrame) -> DataFrame:
        """``(id, label, votes)``: the neighbours' labels, counted as often as they are adjacent."""
        return self.gather(labels, ["label"]).select(F.col("me").alias("id"), "label", F.col("mult").alias("votes"))

    def receivers(self) -> DataFrame:
        return self.adj.select(F.col("me").alias("id")).distinct()

    def release(self) -> None:
        self.adj.unpersist()


class Hop:
    """One hop of a path that every round walks again: static rows that stay partitioned by the
    hop's ``keys``, so a round shuffles the moving values alone.

    Keys that are hot on either side (``senders``: a frame with the key distribution of the
    values) are laid out on a grid of buckets, as in ``weft.operators.skew.salted_join``: the
    static rows once, at the start, the values in every round.
    """

    def __init__(self, static: DataFrame, keys: list[str], senders: DataFrame | None = None):
        spark = static.sparkSession
        self.keys, self.parts = keys, int(spark.conf.get("spark.sql.shuffle.partitions"))
        threshold, max_hot = skew_settings(spark)
        hot = hot_keys(static, senders, keys, threshold, max_hot)
        self.hot = None if hot is None else F.broadcast(hot)  # fewer than 2 * max_hot rows
        self.on = list(keys)
        if hot is not None:
            self.on += ["_i", "_j"]
            row = F.xxhash64(*[F.col(c) for c in static.columns])
            static = static.join(self.hot, keys, "left").withColumn("_i", F.pmod(row, F.coalesce("_lb", F.lit(1)))) \
                .withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_rb", F.lit(1)) - 1))).drop("_lb", "_rb")
        self.static = static.repartition(self.parts, *self.on).sortWithinPartitions(*self.on).persist(StorageLevel.MEMORY_AND_DISK)
        self.static.count()  # only a filled cache reports its partitioning

    def summed(self, rows: DataFrame, by: str, value: str | None = None) -> DataFrame:
        """``rows`` added up per key and ``by`` (without ``value``: counted, as ``n``), before they
        meet the hop.  Without hot keys they are
        dealt out by the key first and added up there: the hop then needs no other shuffle."""
        rows = rows if self.hot is not None else rows.repartition(self.parts, *self.keys)
        return rows.groupBy(*self.keys, by).agg(F.sum(value).alias(value) if value else F.count("*").alias("n"))

    def meet(self, values: DataFrame) -> DataFrame:
        """Inner join of the static rows with ``values`` (with the hop's keys)."""
        if self.hot is not None:
            row = F.xxhash64(*[F.col(c) for c in values.columns])
            values = values.join(self.hot, self.keys, "left").withColumn("_j", F.pmod(row, F.coalesce("_rb", F.lit(1)))) \
                .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_lb", F.lit(1)) - 1))).drop("_lb", "_rb")
        # one plan at every size: the static side lies sorted, neither side is sent to every task
        return self.static.join(values.hint("merge"), self.on).drop("_i", "_j")

    def release(self) -> None:
        self.static.unpersist()


def aggregate_messages(graph: Graph, to_src: Column | None, to_dst: Column | None,
                       agg: Callable[[Column], Column], msg_name: str = "msg", by: str | None = None) -> DataFrame:
    """One round of messages over the triplets (A4): ``(id, <msg_name>)``.

    ``to_src``/``to_dst`` are Column expressions over the triplet columns
    ``src, dst, <edge attrs>, src_<attr>, dst_<attr>``; ``None`` sends nothing that way.
    ``by``: keep one result per different message, ``(id, <by>, <msg_name>)`` (a vote count
    per label).  Vertices without messages are absent (as in GraphX)."""
    sent = [F.struct(F.col(end).alias("id"), m.alias("_m")) for end, m in (("src", to_src), ("dst", to_dst)) if m is not None]
    if not sent:
        raise ValueError("no message direction given")
    msgs = triplets(graph).select(F.inline(F.array(*sent)))
    keys = ["id"] if by is None else ["id", F.col("_m").alias(by)]
    return msgs.groupBy(*keys).agg(agg(F.col("_m")).alias(msg_name))


def triplets(graph: Graph) -> DataFrame:
    """``src, dst, <edge attrs>, src_<attr>..., dst_<attr>...`` (edge joined with both ends)."""
    attrs = graph.vertex_attrs
    sv = graph.vertices.select(F.col("id").alias("src"), *[F.col(a).alias(f"src_{a}") for a in attrs])
    dv = graph.vertices.select(F.col("id").alias("dst"), *[F.col(a).alias(f"dst_{a}") for a in attrs])
    return graph.edges.join(sv, "src").join(dv, "dst").select(
        "src", "dst", *graph.edge_attrs, *[f"src_{a}" for a in attrs], *[f"dst_{a}" for a in attrs])


class Layered:
    """Vertex rows ``(id, <names>)`` as a base and thin layers of the rows that changed since.

    A superstep writes the changed rows alone.  The base stays partitioned by ``id``, so what a
    superstep receives is all that is shuffled to meet it.  When the layers hold as many rows as
    the base, they are merged into a new one; that is paid for by the rows written since.  More
    than ``most`` layers become one.
    """

    def __init__(self, rows: DataFrame, names: list[str], most: int = 6):
        self.names, self.most = names, most
        self.parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.base = None
        self._rebase(rows)

    def _rebase(self, rows: DataFrame) -> None:
        old, self.layers, self.thin = self.base, [], 0
        written, seen = cut_observed(rows.select("id", *self.names), n=F.count(F.lit(1)))
        self.base, self.n = written.repartition(self.parts, "id").persist(StorageLevel.MEMORY_AND_DISK), seen["n"]
        self.base.count()  # only a filled cache reports its partitioning
        if old is not None:
            old.unpersist()

    def _over(self) -> DataFrame | None:
        """The newest row of every vertex that any layer holds: ``(id, _new)``."""
        if not self.layers:
            return None
        each = [df.select("id", F.struct(*self.names).alias("_new"), F.lit(i).alias("_layer")) for i, df in enumerate(self.layers)]
        rows = each[0]
        for x in each[1:]:
            rows = rows.unionByName(x)
        return rows.groupBy("id").agg(F.max_by("_new", "_layer").alias("_new")) if len(each) > 1 else rows.drop("_layer")

    def latest(self, received: DataFrame | None = None) -> DataFrame:
        """The rows as they are now; with ``received`` (one row per id) those it holds, and its columns."""
        rows, over = self.base if received is None else self.base.join(received, "id"), self._over()
        if over is None:
            return rows
        now = [F.when(F.col("_new").isNull(), F.col(n)).otherwise(F.col(f"_new.{n}")).alias(n) for n in self.names]
        others = [] if received is None else [c for c in received.columns if c != "id"]
        return rows.join(over, "id", "left").select("id", *now, *others)

    def add(self, changed: DataFrame) -> DataFrame | None:
        """Write the rows that changed and return them; None if there are none."""
        layer, seen = cut_observed(changed, n=F.count(F.lit(1)))
        if not seen["n"]:
            return None
        self.layers.append(layer)
        self.thin += seen["n"]
        if self.thin >= self.n:
            self._rebase(self.latest())
        elif len(self.layers) > self.most:
            self.layers = [cut_lineage(self._over().select("id", "_new.*"))]
        return layer

    def release(self) -> None:
        self.base.unpersist()


def pregel(graph: Graph, values: dict[str, Column], merge: dict[str, Column], update: dict[str, Column],
           to_dst: Column | None = None, to_src: Column | None = None, steps: int | None = None,
           max_iter: int | None = None, only_active: bool = False, reads_receiver: bool = False,
           checkpoint_every: int = DEFAULT_CHECKPOINT_EVERY) -> DataFrame:
    """A vertex program (A3): ``(id, <values>)`` after the last superstep.

    * ``values``: start value of each value column, over the vertex row;
    * ``to_dst`` / ``to_src``: the message along / against an edge, over ``sender_<value>``,
      the edge attributes and, with ``reads_receiver``, ``receiver_<value>``; null is no message;
    * ``merge``: aggregates over ``msg``, any (sum, count, min, a struct, ...);
    * ``update``: new values, over the old ones and the merged columns, of the vertices that
      received a message; the others keep theirs.

    ``only_active``: from the second superstep on, only vertices whose values changed in the
    last one send, and a superstep writes only the rows that it changes (``Layered``).  With ``steps`` the program runs that many supersteps (it stops early when
    no value changes: nothing could change later).  Without, it runs until no value changes;
    if ``max_iter`` supersteps do not reach that, it raises.
    """
    names = list(values)
    sides = [d for d, m in (("in", to_dst), ("out", to_src)) if m is not None]
    if not sides:
        raise ValueError("no message direction given")
    _, edges = materialise(graph, graph.edge_attrs)
    adj = Adjacency(edges, sides[0] if len(sides) == 1 else "both", extra=graph.edge_attrs, with_direction=True)
    if len(sides) == 2:
        message = F.when(F.col("forward"), to_dst).otherwise(to_src)
    else:
        message = to_dst if to_dst is not None else to_src
    start = graph.vertices.select("id", *[c.alias(n) for n, c in values.items()])

    def received(senders: DataFrame, receivers: Callable[[], DataFrame]) -> DataFrame:
        got = adj.gather(senders.select("id", *[F.col(n).alias(f"sender_{n}") for n in names]), [f"sender_{n}" for n in names])
        if reads_receiver:
            got = got.join(receivers().select(F.col("id").alias("me"), *[F.col(n).alias(f"receiver_{n}") for n in names]), "me")
        return got.select(F.col("me").alias("id"), message.alias("msg")).filter("msg IS NOT NULL") \
            .groupBy("id").agg(*[c.alias(n) for n, c in merge.items()], F.lit(True).alias("_got"))

    new = {n: F.when(F.col("_got"), update[n]).otherwise(F.col(n)) if n in update else F.col(n) for n in names}
    changed = F.lit(False)
    for n in names:
        if n in update:
            changed = changed | ~new[n].eqNullSafe(F.col(n))
    moved = [*[new[n].alias(n) for n in names], changed.alias("_changed")]
    state = None
    try:
        done = 0
        if only_active:
            state = Layered(start, names)
            senders = state.base
            while steps is None or done < steps:
                if max_iter is not None and done >= max_iter and steps is None:
                    raise RuntimeError(f"no fixpoint after {max_iter} supersteps")
                senders = state.add(state.latest(received(senders, state.latest)).select("id", *moved).filter("_changed").drop("_changed"))
                done += 1
                if senders is None:
                    break
            return cut_lineage(state.latest())
        cur = cut_lineage(start)
        while steps is None or done < steps:
            if max_iter is not None and done >= max_iter and steps is None:
                raise RuntimeError(f"no fixpoint after {max_iter} supersteps")
            nxt = cur.join(received(cur, lambda: cur), "id", "left").select("id", *moved)  # noqa: B023 (used at once)
            done += 1
            last = steps is not None and done == steps
            test = steps is None or done % checkpoint_every == 0
            cur = cut_lineage(nxt) if test or last else nxt
            if test and not last and cur.filter("_changed").isEmpty():
                break
        return cur.select("id", *names)
    finally:
        adj.release()
        if state is not None:
            state.release()
