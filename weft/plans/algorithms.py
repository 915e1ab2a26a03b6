"""Iterative graph algorithms as DataFrame programs.

* ``label_propagation`` — synchronous LPA with the exact update rule of the reference.
* ``connected_components`` — alternating large-star / small-star (Kiveris et al.,
  "Connected Components in MapReduce and Beyond", SoCC 2014): O(log^2 n) rounds
  independent of the graph diameter; component id = smallest vertex id.
* ``pagerank`` / ``pagerank_until`` — GraphX's static and delta (tolerance) PageRank,
  ranks rescaled to sum to the number of vertices.
* ``triangle_count`` — triangles through each vertex of the simple undirected graph,
  counted once per triangle by orienting edges from lower to higher (degree, id)
  (Suri & Vassilvitskii, "Counting Triangles and the Curse of the Last Reducer",
  WWW 2011): a vertex's out-degree is at most sqrt(2m).  Sorted neighbour arrays are met
  per edge on a grid of vertex groups, so no pairs of neighbours are shuffled.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.model import Graph
from weft.functions import triangles
from weft.operators.skew import hot_keys, skew_settings, split_lookup
from weft.plans.iterate import DEFAULT_CHECKPOINT_EVERY, Adjacency, Hop, cut_lineage, cut_observed, materialise


# ---------------------------------------------------------------------------------------
# label propagation

def best_label(votes: DataFrame, id_col: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per vertex, the label with most votes; ties go to the smallest label.

    One aggregation of ``min((-votes, label))``: it has a map-side partial step, so a
    hub vertex's candidate labels are reduced in every map task before the shuffle.
    ``keep``: columns that are set in one row per vertex and pass through."""
    best = F.min(F.struct(F.negative("votes").alias("nv"), F.col("label").alias("label"))).alias("_best")
    return votes.groupBy(id_col).agg(best, *[F.max(c).alias(c) for c in keep]).select(id_col, F.col("_best.label").alias("label"), *keep)


def label_propagation(graph: Graph, max_steps: int, checkpoint_every: int = DEFAULT_CHECKPOINT_EVERY) -> DataFrame:
    """Synchronous label propagation for exactly ``max_steps`` supersteps: ``(id, label)``.

    Label := own id; each edge gives one vote to each end for the other end's label
    (edge attributes ignored, parallel edges vote repeatedly, a self-loop votes twice for
    its own vertex); a vertex takes the most voted label, the smallest on ties;
    isolated vertices keep their id.  There is no convergence test, as in the
    reference (bipartite parts oscillate); a fixpoint stops the loop early because it
    cannot change the result."""
    if max_steps <= 0:
        raise ValueError(f"Maximum of steps must be greater than 0, but got {max_steps}")
    # parallel edges and self-loops pre-aggregated: one adjacency row per (me, nbr)
    # with its multiplicity, votes are summed multiplicities.  The adjacency is the
    # only materialised input; its receivers are the non-isolated vertices.
    adj = Adjacency(graph.edges.select("src", "dst"), "both", multiplicity="count")
    try:
        active = adj.receivers()
        labels = propagate(active, adj.votes, max_steps, checkpoint_every, hubs=adj.salted)
        if graph.endpoints_only:
            return labels
        isolated = graph.vertices.select("id").join(active, "id", "left_anti")
        return labels.union(isolated.select("id", F.col("id").alias("label")))
    finally:
        adj.release()


def propagate(ids: DataFrame, votes_of, max_steps: int, checkpoint_every: int = DEFAULT_CHECKPOINT_EVERY, hubs: bool = True) -> DataFrame:
    """The supersteps: ``votes_of(labels)`` gives ``(id, label, votes)`` rows for every id.

    Every step's labels are written: they are small beside the votes, a lost executor costs one
    step, and all steps have one plan, whose generated code is compiled once.  Every
    ``checkpoint_every`` steps the rows written also carry each vertex's last label (as a row
    without votes, which never wins), so the fixpoint test reads them alone.  Without ``hubs``
    the votes are dealt out by their receiver, which is the only time that they are shuffled; a
    hub's votes are added up per label over all tasks first."""
    def dealt(rows: DataFrame) -> DataFrame:
        return rows if hubs else rows.repartition("id")

    labels = ids.select("id", F.col("id").alias("label"))
    for step in range(1, max_steps + 1):
        votes = votes_of(labels)
        if step % checkpoint_every or step == max_steps:
            labels = cut_lineage(best_label(dealt(votes).groupBy("id", "label").agg(F.sum("votes").alias("votes"))))
            continue
        none = F.lit(None).cast("bigint").alias("last")
        rows = votes.select("id", "label", F.col("votes").cast("bigint").alias("votes"), none).union(
            labels.select("id", "label", F.lit(0).cast("bigint").alias("votes"), F.col("label").alias("last")))
        summed = dealt(rows).groupBy("id", "label").agg(F.sum("votes").alias("votes"), F.max("last").alias("last"))
        done = cut_lineage(best_label(summed, keep=("last",)))
        labels = done.select("id", "label")
        if done.filter("label <> last").isEmpty():
            break
    return labels


#: owners of a phone up to which its calls may well be written as pairs of applications: 64 a call at most
FEW_OWNERS = 8


def call_graph_labels(phones: DataFrame, calls: DataFrame, max_steps: int,
                      checkpoint_every: int = DEFAULT_CHECKPOINT_EVERY, few: int = 0) -> DataFrame:
    """Label propagation over the application call graph without the pairs of its hub phones: ``(id, label)``.

    ``phones (app, k1, k2)`` is who owns which phone, ``calls (a1, a2, b1, b2)`` the calls in
    both orientations (a phone's call to itself once).  The graph's edges are the owners of a
    times the owners of b for every call.  Between phones of at most ``few`` owners the edges are
    formed once and counted per pair of applications (``few * few`` a call at most): one join a
    round.  The other calls, all of them without ``few``, never become pairs (``CallHops``).  The
    pairs are symmetric, so counting both directions would just double every vote.
    """
    if max_steps <= 0:
        raise ValueError(f"Maximum of steps must be greater than 0, but got {max_steps}")
    few_calls, hub_calls, few_owned = _calls_by_owners(phones, calls, few) if few else (None, calls, None)
    hops = None if hub_calls is None else CallHops(phones, hub_calls)
    adj = None if few_calls is None else Adjacency(_owner_pairs(few_owned, few_calls), "both", multiplicity="count")
    ways = [way for way in (adj, hops) if way is not None]

    def votes_of(labels: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, [way.votes(labels) for way in ways])

    try:
        ids = ways[0].receivers() if len(ways) == 1 else adj.receivers().union(hops.receivers()).distinct()
        return propagate(ids, votes_of, max_steps, checkpoint_every, hubs=hops is not None or adj.salted)
    finally:
        for way in ways:
            way.release()


def _calls_by_owners(phones: DataFrame, calls: DataFrame, few: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The calls between phones of at most ``few`` owners, the others (None if there are none) and
    the rows of those phones.  Phones of very many owners or calls are split over tasks."""
    hubs = cut_lineage(phones.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("owners")).filter(F.col("owners") > few))
    if hubs.isEmpty():
        return calls, None, phones
    a, b = (hubs.select(F.col("k1").alias(f"{end}1"), F.col("k2").alias(f"{end}2")) for end in "ab")
    names = ["a1", "a2", "b1", "b2"]
    rest = split_lookup(calls, a, ["a1", "a2"], "left_anti").select(*names)
    hub_calls = split_lookup(calls, a, ["a1", "a2"], "left_semi").select(*names).union(
        split_lookup(rest, b, ["b1", "b2"], "left_semi").select(*names))
    return split_lookup(rest, b, ["b1", "b2"], "left_anti"), hub_calls, split_lookup(phones, hubs, ["k1", "k2"], "left_anti", rows_of="owners")


def _owner_pairs(phones: DataFrame, calls: DataFrame) -> DataFrame:
    """The edges ``(src, dst)`` of the call graph, each in one of its two directions."""
    once = calls.filter("a1 < b1 OR (a1 = b1 AND a2 <= b2)")
    near = phones.select(F.col("app").alias("src"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    far = phones.select(F.col("app").alias("dst"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    # a phone that calls itself joins two owners; one ownership used twice is no edge
    return once.join(near, ["a1", "a2"]).join(far, ["b1", "b2"]).filter("NOT (a1 = b1 AND a2 = b2) OR src < dst").select("src", "dst")


class CallHops:
    """The votes of calls whose pairs of applications are never formed.

    Votes factor along the path from owner to owner: labels are counted per phone, the counts move
    over the calls and are added up by the owners.  The three hops stay partitioned by their keys
    and split hub phones; a round reads the labels once.  An application that reaches itself
    through one ownership used twice (a phone calling itself) is no edge: that vote is taken back.
    """

    def __init__(self, phones: DataFrame, calls: DataFrame):
        calls = cut_lineage(calls.select("a1", "a2", "b1", "b2"))
        loop = calls.filter("a1 = b1 AND a2 = b2").select(F.col("a1").alias("k1"), F.col("a2").alias("k2"))
        self.loops = None if loop.isEmpty() else cut_lineage(
            phones.join(loop, ["k1", "k2"], "left_semi").groupBy(F.col("app").alias("id")).agg(F.count("*").alias("own")))
        heard = calls.select(F.col("b1").alias("k1"), F.col("b2").alias("k2"))
        if self.loops is not None:  # a phone that only calls itself and has one owner makes no edge
            owners = cut_lineage(phones.groupBy(F.col("k1").alias("a1"), F.col("k2").alias("a2")).agg(F.count("*").alias("owners")))
            heard = calls.join(owners, ["a1", "a2"]).filter("NOT (a1 = b1 AND a2 = b2) OR owners > 1").select(F.col("b1").alias("k1"), F.col("b2").alias("k2"))
        # phones without a call move nothing
        phones = cut_lineage(split_lookup(phones, heard.distinct(), ["k1", "k2"], "left_semi").select("app", "k1", "k2"))
        self.owned = Hop(phones, ["app"])
        self.near = Hop(calls, ["a1", "a2"], phones.select(F.col("k1").alias("a1"), F.col("k2").alias("a2")))
        self.far = Hop(phones, ["k1", "k2"], heard)

    def receivers(self) -> DataFrame:
        return self.owned.static.select(F.col("app").alias("id")).distinct()

    def votes(self, labels: DataFrame) -> DataFrame:
        """``(id, label, votes)`` of one round."""
        out = self.owned.meet(labels.withColumnRenamed("id", "app")).select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), "label")
        out = self.near.meet(self.near.summed(out, "label")).select(F.col("b1").alias("k1"), F.col("b2").alias("k2"), "label", "n")
        out = self.far.meet(self.far.summed(out, "label", "n")).select("app", "label", F.col("n").alias("votes"))
        if self.loops is not None:
            back = labels.join(self.loops, "id").select(F.col("id").alias("app"), "label", F.negative("own").alias("votes"))
            out = out.unionByName(back)
        return self.owned.summed(out, "label", "votes").filter("votes > 0").withColumnRenamed("app", "id")

    def release(self) -> None:
        for hop in (self.owned, self.near, self.far):
            hop.release()


# ---------------------------------------------------------------------------------------
# connected components

def _canonical(edges: DataFrame) -> DataFrame:
    """Undirected simple edge set ``(lo, hi)``, lo < hi, self-loops and duplicates dropped."""
    return (edges.filter(F.col("src") != F.col("dst"))
            .select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct())


def _both(e: DataFrame) -> DataFrame:
    return e.select(F.inline(F.array(F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")),
                                     F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")))))


def _star_hubs(e: DataFrame, rows: int) -> DataFrame | None:
    """The nodes with so many edges that their star is split over tasks.  After a large-star a
    node has no more smaller neighbours than before, so the list serves both stars of a round."""
    threshold, max_hot = skew_settings(e.sparkSession)
    if 2 * rows <= threshold:
        return None
    return hot_keys(e.select(F.explode(F.array("lo", "hi")).alias("u")), None, ["u"], threshold, max_hot)


def _large_star_rows(e: DataFrame, hubs: DataFrame | None) -> DataFrame:
    n = _both(e)
    m = n.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return split_lookup(n.filter(F.col("v") > F.col("u")), m, "u", hot=hubs, known=True)


def _large_star(e: DataFrame, hubs: DataFrame | None) -> DataFrame:
    return _large_star_rows(e, hubs).select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()


def _small_star(e: DataFrame, hubs: DataFrame | None) -> DataFrame:
    n = _both(e).filter(F.col("v") < F.col("u"))
    m = n.groupBy("u").agg(F.min("v").alias("m"))
    to_min = split_lookup(n, m, "u", hot=hubs, known=True).filter(F.col("v") != F.col("m")).select(F.col("m").alias("lo"), F.col("v").alias("hi"))
    own = m.select(F.col("m").alias("lo"), F.col("u").alias("hi"))
    return to_min.union(own).distinct()


def connected_components(graph: Graph, max_rounds: int = 1000) -> DataFrame:
    """``(id, component)``: component = smallest vertex id reachable ignoring direction.

    A star's centre may own most edges: its edges are split over tasks and its one row of the
    minima is copied to them."""
    ids, edges = materialise(graph)
    e = cut_lineage(_canonical(edges))
    seen = _signature(e)
    for _ in range(max_rounds):
        hubs = _star_hubs(e, seen[0])
        e = cut_lineage(_small_star(_large_star(e, hubs), hubs))
        now = _signature(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not converge")
    comp = e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(
        e.select(F.col("lo").alias("id"), F.col("lo").alias("component"))).distinct()
    # vertices without an edge to another vertex (isolated, or only self-loops)
    rest = ids.join(comp, "id", "left_anti")
    return comp.union(rest.select("id", F.col("id").alias("component")))


def _signature(e: DataFrame) -> tuple:
    """Row count and two hash folds of an edge set: equal sets have equal signatures, and a
    round that changes the set goes unnoticed with probability 2^-128 at most."""
    folds = [F.bit_xor(F.xxhash64(F.lit(seed), "lo", "hi")) for seed in (1, 2)]
    return tuple(e.agg(F.count("*"), *folds).first())


# ---------------------------------------------------------------------------------------
# PageRank

def _with_out_degree(verts: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, deg)`` of every vertex, written once: the loops carry the degree with the rank, so
    no edge row is ever joined with it."""
    deg = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    return cut_lineage(verts.join(deg, "id", "left").select("id", F.coalesce("deg", F.lit(0)).cast("bigint").alias("deg")))


def _shares(adj: Adjacency, state: DataFrame, value: str) -> DataFrame:
    """What each vertex receives over its in-edges, ``(id, c)``: value / out-degree of the other
    end, once per parallel edge."""
    share = state.filter("deg > 0").select("id", (F.col(value) / F.col("deg")).alias("share"))
    return adj.gather(share, ["share"]).select(F.col("me").alias("id"), (F.col("share") * F.col("mult")).alias("c"))


def _normalise(ranks: DataFrame) -> DataFrame:
    row = ranks.agg(F.sum("rank").alias("s"), F.count(F.lit(1)).alias("n")).first()
    if row is None or not row["n"]:
        return ranks
    return ranks.select("id", (F.col("rank") * F.lit(float(row["n"]) / row["s"])).alias("rank"))


def pagerank(graph: Graph, num_iter: int, reset: float = 0.15) -> DataFrame:
    """Static PageRank, ``num_iter`` rounds (A7): start 1.0;
    rank' = reset + (1 - reset) * sum over in-edges of rank(src) / outdeg(src);
    finally rescaled so the ranks sum to the number of vertices."""
    verts, edges = materialise(graph)
    verts = _with_out_degree(verts, edges)
    adj = Adjacency(edges, "in", multiplicity="count")
    try:
        ranks = verts.select("id", F.lit(1.0).alias("rank"), "deg")
        zero = verts.select("id", F.lit(0.0).alias("c"), "deg")
        for _ in range(num_iter):
            got = _shares(adj, ranks, "rank").withColumn("deg", F.lit(None).cast("bigint"))
            ranks = cut_lineage(got.union(zero).groupBy("id").agg((F.lit(reset) + F.lit(1.0 - reset) * F.sum("c")).alias("rank"), F.max("deg").alias("deg")))
        return _normalise(ranks)
    finally:
        adj.release()


def pagerank_until(graph: Graph, tol: float, reset: float = 0.15, max_iter: int | None = None) -> DataFrame:
    """Delta PageRank until every change is at most ``tol`` (A6), GraphX's Pregel form:
    each vertex starts with rank = delta = reset; a vertex whose last delta exceeds
    ``tol`` and that received something in the previous round sends delta * w along its
    out-edges; receivers add (1 - reset) * sum to their rank.  Rescaled to sum N.
    Deltas shrink by (1 - reset) a round, so it ends; a ``max_iter`` that is hit raises.

    A round is one job: its write also counts the vertices that will send in the next one."""
    verts, edges = materialise(graph)
    verts = _with_out_degree(verts, edges)
    adj = Adjacency(edges, "in", multiplicity="count")
    sends = F.col("active") & (F.col("delta") > F.lit(tol))
    try:
        state = verts.select("id", "deg", F.lit(reset).alias("rank"), F.lit(reset).alias("delta"),
                             F.lit(True).alias("active"))
        for i in count(1):
            if max_iter is not None and i > max_iter:
                raise RuntimeError(f"PageRank did not reach the tolerance in {max_iter} rounds")
            msgs = _shares(adj, state.filter(sends), "delta").groupBy("id").agg(F.sum("c").alias("m"))
            state, seen = cut_observed(
                state.join(msgs, "id", "left")
                .select("id", "deg",
                        (F.col("rank") + F.coalesce(F.lit(1.0 - reset) * F.col("m"), F.lit(0.0))).alias("rank"),
                        F.when(F.col("m").isNull(), F.col("delta")).otherwise(F.lit(1.0 - reset) * F.col("m")).alias("delta"),
                        F.col("m").isNotNull().alias("active")), senders=F.count_if(sends))
            if not seen["senders"]:
                return _normalise(state.select("id", "rank"))
    finally:
        adj.release()


# ---------------------------------------------------------------------------------------
# triangles

#: neighbour entries that one task holds at about, on each side
CELL_ENTRIES = 4_000_000


def oriented(e: DataFrame, rows: int) -> DataFrame:
    """Each canonical edge as ``(x, y)`` from the lower to the higher (degree, id): no vertex has
    more than sqrt(2m) edges out.  Hubs' edges are split over tasks when degrees are looked up."""
    deg = cut_lineage(e.select(F.explode(F.array("lo", "hi")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d")))
    threshold, max_hot = skew_settings(e.sparkSession)
    hubs = None
    if rows > threshold:
        least = max(threshold, -(-rows // max_hot))  # fewer than 2 * max_hot vertices have more edges
        found = deg.filter(F.col("d") > least).collect()
        hubs = e.sparkSession.createDataFrame([(r["id"], -(-r["d"] // threshold)) for r in found], "id long, _lb long") if found else None

    def degree_of(rows: DataFrame, end: str, name: str) -> DataFrame:
        return split_lookup(rows, deg.select(F.col("id").alias(end), F.col("d").alias(name)), end, hot=None if hubs is None else hubs.withColumnRenamed("id", end), known=True)

    ranked = degree_of(degree_of(e, "lo", "dl"), "hi", "dh")
    lo_first = (F.col("dl") < F.col("dh")) | ((F.col("dl") == F.col("dh")) & (F.col("lo") < F.col("hi")))
    return ranked.select(F.when(lo_first, F.col("lo")).otherwise(F.col("hi")).alias("x"), F.when(lo_first, F.col("hi")).otherwise(F.col("lo")).alias("y"))


def triangle_count(graph: Graph) -> DataFrame:
    """``(id, triangles)`` for every vertex: triangles through it in the graph with
    self-loops, parallel edges and directions removed; 0 for the others.

    The out-neighbours of a vertex are one sorted array.  Vertices are hashed to ``side``
    groups; cell (i, j) of a grid gets the arrays of group i and of group j and meets them for
    every edge from i to j.  An array goes to ``2 * side`` cells, so the shuffle grows with the
    edges, not with the pairs of neighbours, and a cell holds a bounded part of the graph."""
    ids, edges = materialise(graph)
    e = cut_lineage(_canonical(edges))
    m = e.count()
    side = max(math.isqrt(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1) + 1, -(-2 * m // CELL_ENTRIES))
    arrays = cut_lineage(oriented(e, m).groupBy("x").agg(F.sort_array(F.collect_list("y")).alias("ys")))  # sqrt(2m) a row at most
    group = F.pmod(F.xxhash64("x"), F.lit(side)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    cells = arrays.select(group.alias("i"), every.alias("j"), F.lit(True).alias("near"), "x", "ys") \
        .unionByName(arrays.select(every.alias("i"), group.alias("j"), F.lit(False).alias("near"), "x", "ys"))
    counts = cells.groupBy("i", "j").applyInArrow(triangles.count_cell, "id long, triangles long").groupBy("id").agg(F.sum("triangles").alias("triangles"))
    return ids.join(counts, "id", "left").select("id", F.coalesce(F.col("triangles"), F.lit(0).cast("bigint")).alias("triangles"))
