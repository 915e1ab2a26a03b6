"""Property tests on random small multigraphs, against brute-force Python models."""

from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from tests.graphs import as_dict, simple
from weft.model import Graph
from weft.operators import structure as st
from weft.operators.skew import salted_join
from weft.plans import algorithms as alg

edge_lists = st_.lists(st_.tuples(st_.integers(0, 9), st_.integers(0, 9)), min_size=1, max_size=25)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def brute_lpa(edges, steps):
    ids = {x for e in edges for x in e}
    label = {v: v for v in ids}
    for _ in range(steps):
        votes = defaultdict(Counter)
        for s, d in edges:
            votes[s][label[d]] += 1
            votes[d][label[s]] += 1
        label = {v: min(votes[v].items(), key=lambda kv: (-kv[1], kv[0]))[0] for v in ids}
    return label


def brute_cc(edges):
    ids = {x for e in edges for x in e}
    parent = {v: v for v in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for s, d in edges:
        a, b = find(s), find(d)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in ids}


def brute_triangles(edges):
    und = {(min(s, d), max(s, d)) for s, d in edges if s != d}
    nb = defaultdict(set)
    for a, b in und:
        nb[a].add(b)
        nb[b].add(a)
    ids = {x for e in edges for x in e}
    out = {v: 0 for v in ids}
    for a, b in und:
        for c in nb[a] & nb[b]:
            if c > b:
                for v in (a, b, c):
                    out[v] += 1
    return out


def brute_pagerank(edges, iters, reset=0.15):
    ids = {x for e in edges for x in e}
    outdeg = Counter(s for s, _ in edges)
    rank = {v: 1.0 for v in ids}
    for _ in range(iters):
        contrib = defaultdict(float)
        for s, d in edges:
            contrib[d] += rank[s] / outdeg[s]
        rank = {v: reset + (1 - reset) * contrib[v] for v in ids}
    total = sum(rank.values())
    return {v: r * len(ids) / total for v, r in rank.items()}


@SETTINGS
@given(edge_lists)
def test_algorithms_match_brute_force(spark, edges):
    g = simple(spark, edges)
    assert as_dict(alg.label_propagation(g, 3)) == brute_lpa(edges, 3)
    assert as_dict(alg.connected_components(g)) == brute_cc(edges)
    assert as_dict(alg.triangle_count(g)) == brute_triangles(edges)
    pr = as_dict(alg.pagerank(g, 4))
    for v, r in brute_pagerank(edges, 4).items():
        assert pr[v] == pytest.approx(r, rel=1e-9)


@SETTINGS
@given(edge_lists)
def test_structural_invariants(spark, edges):
    g = simple(spark, edges)
    deg = as_dict(st.degrees(g))
    assert sum(deg.values()) == 2 * len(edges)
    assert sum(as_dict(alg.triangle_count(g)).values()) % 3 == 0
    rr = st.reverse(st.reverse(g)).edges
    assert sorted(map(tuple, rr.collect())) == sorted(map(tuple, g.edges.collect()))
    m = st.mask(g, g)
    assert sorted(map(tuple, m.edges.collect())) == sorted(map(tuple, g.edges.collect()))
    cc = as_dict(alg.connected_components(g))
    assert all(c <= v for v, c in cc.items())
    labels = as_dict(alg.label_propagation(g, 4))
    assert set(labels.values()) <= set(labels)
    assert all(cc[v] == cc[l] for v, l in labels.items())          # labels stay inside a component
    pr = as_dict(alg.pagerank(g, 3))
    assert sum(pr.values()) == pytest.approx(len(pr))


def test_partition_count_does_not_change_results(spark):
    edges = [(i, (i * 7 + 3) % 40) for i in range(40)] + [(i, i + 1) for i in range(0, 39, 3)]
    g = simple(spark, edges)
    base = as_dict(alg.label_propagation(g, 5))
    g2 = Graph(g.vertices.repartition(5), g.edges.repartition(7), g.endpoints_only)
    assert as_dict(alg.label_propagation(g2, 5)) == base


def test_salted_join_equals_plain_join(spark):
    rows = [(k % 3 if i % 4 else 0, i) for i, k in enumerate(range(400))]   # key 0 is hot
    left = spark.createDataFrame(rows, "k int, a int")
    right = spark.createDataFrame([(k, j) for k in range(3) for j in range(5)], "k int, b int")
    plain = sorted(map(tuple, left.join(right, "k").select("k", "a", "b").collect()))
    salted = salted_join(left, right, "k", threshold=20, max_hot=200).select("k", "a", "b")
    assert sorted(map(tuple, salted.collect())) == plain
    cond = salted_join(left, right, "k", condition=lambda L, R: L("a") > R("b") * 50, threshold=20)
    assert sorted(map(tuple, cond.select("k", "a", "b").collect())) == [r for r in plain if r[1] > r[2] * 50]


@pytest.mark.parametrize("side", ["left", "right", "both"])
def test_hub_of_either_side_is_split(spark, side):
    """No task makes more than twice the mean of the output rows, wherever the hub is."""
    n = {"left": (40_000, 10), "right": (10, 40_000), "both": (2_000, 2_000)}[side]
    left, right = (spark.range(m).select((F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(7) if m > 100 else F.lit(7)).cast("long").alias("k"),
                                         F.col("id").alias(c)) for m, c in zip(n, "ab"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_join(left, right, "k", threshold=100, max_hot=10_000)
        per = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(per) == left.join(right, "k").count()
        assert max(per) <= 2 * sum(per) / 8
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_list_is_bounded_and_drops_no_hub(spark):
    from weft.operators.skew import hot_keys
    df = spark.range(10_000).select((F.col("id") % 100).alias("k"))
    assert hot_keys(df, df, ["k"], 10, 5) is None          # 100 keys of 100 rows: none above a fifth
    hub = df.union(spark.range(9_000).select(F.lit(3).cast("long").alias("k")))
    assert [r["k"] for r in hot_keys(df, hub, ["k"], 10, 5).collect()] == [3]
    assert hot_keys(df, None, ["k"], 10, 1_000).count() == 100


@pytest.mark.parametrize("max_hot", [20, 1000])
def test_rule_of_each_side_holds_exactly(spark, max_hot):
    """Many large keys on the left that pass no rule push no hub of the right side off the list."""
    from weft.operators.skew import hot_keys
    left = spark.range(100 * 4_000).select((F.col("id") % 100).alias("k"))
    right = spark.range(2_000).select(F.lit(777).cast("long").alias("k"))
    got = {r["k"]: (r["_lb"], r["_rb"]) for r in hot_keys(left, right, ["k"], 1_000, max_hot).collect()}
    assert got.pop(777) == (1, 2)
    assert got == ({} if max_hot == 20 else {k: (4, 1) for k in range(100)})


def test_sketch_misses_no_heavy_key(spark):
    """Keys just above the rule among many small ones that share their cells; nulls are no key."""
    from weft.operators.skew import hot_keys
    heavy = spark.range(40 * 60).select((F.col("id") % 40).alias("k"))
    small = spark.range(1_000, 60_000).select("id").union(spark.range(5_000).select(F.lit(None).cast("long")))
    got = hot_keys(heavy.union(small).repartition(7), None, ["k"], 59, 1_100).collect()
    assert sorted(map(tuple, got)) == [(k, 2, 1) for k in range(40)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_lookup_equals_plain_join(spark, how):
    from weft.operators.skew import split_lookup
    key = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 5 == 0, None).otherwise(F.col("id"))
    rows = spark.range(10_000).select(key.alias("k"), (F.col("id") % 3).alias("z"))
    table = spark.range(1, 10_000, 3).select(F.col("id").alias("k"), (F.col("id") + 1).alias("w"))
    want = sorted(map(repr, rows.join(table, ["k"], how).collect()))
    counted = table.join(rows.groupBy("k").agg(F.count("*").alias("n")), "k", "left").na.fill(0, ["n"])
    assert sorted(map(repr, split_lookup(rows, table, "k", how, threshold=100).collect())) == want
    assert sorted(map(repr, split_lookup(rows, counted, "k", how, rows_of="n", threshold=100).drop("n").collect())) == want
    assert sorted(map(repr, split_lookup(rows, table, "k", how, known=True).collect())) == want
    assert split_lookup(rows, table.limit(0), "k", how, threshold=100).count() == (0 if how in ("inner", "left_semi") else 10_000)


def test_lookup_of_a_hub_is_split(spark):
    """Half the rows have one key, all of them equal: no task has more than twice the mean."""
    from weft.operators.skew import split_lookup
    rows = spark.range(80_000).select(F.when(F.col("id") % 2 == 0, F.lit(-1).cast("long")).otherwise(F.col("id")).alias("k"))
    table = rows.distinct().withColumn("w", F.lit(1))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = split_lookup(rows, table, "k", threshold=500)
        per = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(per) == 80_000 and max(per) <= 2 * sum(per) / 8
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_call_graph_labels_equal_those_of_the_pairs(spark):
    """Self-calls, several phones an application, phones without calls."""
    import random
    r = random.Random(4)
    phones = sorted({(a, p, 0) for a in range(25) for p in r.sample(range(14), r.randrange(0, 3))})
    calls = sorted({(p, q) for p, q in ((r.randrange(14), r.randrange(14)) for _ in range(12)) if p <= q} | {(13, 13)})
    both = [(p, 0, q, 0) for p, q in calls] + [(q, 0, p, 0) for p, q in calls if p != q]
    pairs = [(s, t) for p, _, q, _ in both for s, x, _ in phones if x == p for t, y, _ in phones if y == q if not (s == t and p == q)]
    ph = spark.createDataFrame(phones, "app long, k1 long, k2 long")
    ca = spark.createDataFrame(both, "a1 long, a2 long, b1 long, b2 long")
    for steps in (1, 2, 6):
        assert as_dict(alg.call_graph_labels(ph, ca, steps)) == brute_lpa(pairs, steps)


@pytest.mark.parametrize("few", [1, 2, 3, 8])
def test_call_graph_labels_with_pairs_of_few_owners(spark, few):
    """Phones on both sides of the bound, self-calls, hubs split over tasks, two phones that call each other twice."""
    import random
    r = random.Random(few)
    phones = sorted({(a, p, 0) for a in range(30) for p in r.sample(range(14), r.randrange(0, 3))} | {(a, 0, 0) for a in range(6)})
    calls = sorted({(p, q) for p, q in ((r.randrange(14), r.randrange(14)) for _ in range(14)) if p <= q} | {(13, 13), (0, 0), (0, 1)}) + [(2, 3), (2, 3)]
    both = [(p, 0, q, 0) for p, q in calls] + [(q, 0, p, 0) for p, q in calls if p != q]
    pairs = [(s, t) for p, _, q, _ in both for s, x, _ in phones if x == p for t, y, _ in phones if y == q if not (s == t and p == q)]
    ph = spark.createDataFrame([*phones, (40, None, 0)], "app long, k1 long, k2 long")
    ca = spark.createDataFrame([*both, (None, 0, None, 0)], "a1 long, a2 long, b1 long, b2 long")
    spark.conf.set("weft.skew.threshold", "4")
    try:
        assert as_dict(alg.call_graph_labels(ph, ca, 5, few=few)) == brute_lpa(pairs, 5)
    finally:
        spark.conf.unset("weft.skew.threshold")


def test_hub_vertex_lpa_with_forced_salting(spark):
    spark.conf.set("weft.skew.threshold", "3")
    try:
        edges = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(1, 29, 2)]
        g = simple(spark, edges)
        assert as_dict(alg.label_propagation(g, 4)) == brute_lpa(edges, 4)
        pr = as_dict(alg.pagerank(g, 3))
        for v, r in brute_pagerank(edges, 3).items():
            assert pr[v] == pytest.approx(r, rel=1e-9)
        assert as_dict(alg.triangle_count(g)) == brute_triangles(edges)
    finally:
        spark.conf.unset("weft.skew.threshold")
