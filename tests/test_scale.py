"""Operators whose plans must hold when one key owns most rows: balance of tasks, and results."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.graphs import as_dict, simple
from tests.test_properties import brute_cc, brute_triangles
from weft.functions import triangles
from weft.operators import relational as rel
from weft.operators import structure as st
from weft.plans import algorithms as alg
from weft.plans.iterate import Hop, cut_lineage, cut_observed
from weft.sinks import read_community, write_membership_by_community


@pytest.fixture
def plain_joins(spark):
    """No broadcasts and no run-time splitting: what balances the tasks is the operator."""
    keep = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "weft.skew.threshold": "500"}
    for k, v in keep.items():
        spark.conf.set(k, v)
    yield
    for k in keep:
        spark.conf.unset(k)


def per_task(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def test_star_of_one_centre_is_split(spark, plain_joins):
    e = cut_lineage(spark.range(1, 40_000).select(F.lit(0).cast("long").alias("lo"), F.col("id").alias("hi")))
    hubs = alg._star_hubs(e, 39_999)
    assert [tuple(r) for r in hubs.select("u", "_lb").collect()] == [(0, 80)]
    n = per_task(alg._large_star_rows(e, hubs))
    assert sum(n) == 39_999 and max(n) <= 2 * sum(n) / 8
    got = alg.connected_components(simple(spark, [(0, i) for i in range(1, 2_000)] + [(5_000, 5_001)]))
    assert Counter(got.select("component").collect()) == Counter({(0,): 2_000, (5_000,): 2})


def test_mask_of_a_star(spark, plain_joins):
    g = simple(spark, [(0, i) for i in range(1, 3_000)] + [(i, 0) for i in range(1, 3_000)])
    half = st.subgraph(g, vpred=F.col("id") % 2 == 0)
    m = st.mask(g, half)
    assert m.edges.count() == 2 * 1_499 and m.vertices.count() == 1_500
    spark.conf.set("weft.skew.threshold", "50")
    assert max(per_task(st.mask(g, g).edges)) <= 2 * g.edges.count() / 8


def test_components_and_triangles_with_hubs(spark):
    spark.conf.set("weft.skew.threshold", "10")
    try:
        r = np.random.default_rng(3)
        edges = [(0, i) for i in range(1, 60)] + [tuple(map(int, x)) for x in r.integers(0, 70, (150, 2))] + [(100, 101), (101, 102), (102, 100), (100, 101)]
        g = simple(spark, edges)
        assert as_dict(alg.connected_components(g)) == brute_cc(edges)
        assert as_dict(alg.triangle_count(g)) == brute_triangles(edges)
    finally:
        spark.conf.unset("weft.skew.threshold")


@pytest.mark.parametrize("step", [3, 1 << 20])
def test_triangles_on_a_grid(spark, monkeypatch, step):
    """A dense graph over many cells; the work of a cell in small steps."""
    monkeypatch.setattr(alg, "CELL_ENTRIES", 400)
    monkeypatch.setattr(triangles, "STEP", step)
    r = np.random.default_rng(step)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 60, (900, 2))]
    assert as_dict(alg.triangle_count(simple(spark, edges))) == brute_triangles(edges)


def test_triangle_shuffle_grows_with_the_edges(spark, sf_small):
    from tests.test_plans import plan_text
    from weft.catalog import QUERIES
    text = plan_text(QUERIES["triangle_count"](spark, sf_small)).split("Initial Plan")[-1]
    assert "FlatMapGroupsInArrow" in text and "y1" not in text  # no pairs of neighbours


def test_hop_equals_plain_join(spark):
    static = spark.range(3_000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), F.col("id").alias("a"))
    values = spark.range(500).select((F.col("id") % 5 * (F.col("id") % 3)).alias("k"), (F.col("id") % 4).alias("label"), F.lit(1).alias("n"))
    want = None
    for threshold in ("1000000", "50"):
        spark.conf.set("weft.skew.threshold", threshold)
        try:
            hop = Hop(static, ["k"], values)
            assert (hop.hot is None) == (threshold == "1000000")
            got = hop.meet(hop.summed(values, "label", "n")).groupBy("k", "label").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
            rows = sorted(map(tuple, got.collect()))
            hop.release()
        finally:
            spark.conf.unset("weft.skew.threshold")
        assert want is None or rows == want
        want = rows
    plain = static.join(values.groupBy("k", "label").agg(F.sum("n").alias("n")), "k").groupBy("k", "label").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
    assert want == sorted(map(tuple, plain.collect()))


def test_a_round_reads_the_labels_once(spark, sf_small, monkeypatch):
    from tests.test_plans import round_plan
    from weft.catalog import S
    from weft.operators.match import undirected_calls
    src = S(spark, sf_small)
    phones, calls = src.phones_of_apps("HasPhone"), undirected_calls(src)
    plans = round_plan(monkeypatch, alg, lambda: alg.call_graph_labels(phones, calls, 3))
    rounds = [p for p in plans if "votes" in p]
    assert len(rounds) == 3
    for text in rounds[1:]:
        assert text.count("SortMergeJoin") == 3 and "BroadcastExchange" not in text
        assert text.count("ExistingRDD[id") == 1


@pytest.mark.parametrize("bits", [1 << 15, 1 << 25])
def test_complement_with_a_hub_value(spark, bits):
    value = F.when(F.col("id") % 2 == 0, F.lit("hub")).when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 5_000).cast("string"))
    a = spark.range(20_000).select(value.alias("value"), (F.col("id") % 3).alias("x"))
    for b in (spark.range(0, 5_000, 3).select(F.col("id").cast("string").alias("value")).union(spark.createDataFrame([("hub",), (None,)], "value string")),
              spark.createDataFrame([("1",)], "value string"), spark.createDataFrame([], "value string")):
        want = Counter(map(tuple, a.join(b.distinct(), "value", "left_anti").select("value", "x").collect()))
        spark.conf.set("weft.skew.threshold", "100")
        try:
            assert Counter(map(tuple, rel.complement(a, b, "value", bits).select("value", "x").collect())) == want
        finally:
            spark.conf.unset("weft.skew.threshold")


def test_complement_shuffles_only_what_the_filter_knows(spark, plain_joins):
    a = spark.range(50_000).select(F.lit(7).cast("long").alias("k"))
    b = spark.range(10).select(F.col("id").alias("k"))
    assert rel.complement(a, b, "k").count() == 0 and rel.complement(a, b.filter("k <> 7"), "k").count() == 50_000
    n = per_task(rel.complement(a.union(spark.range(20, 40)), b.filter("k <> 7"), "k"))
    assert sum(n) == 50_020


def test_deep_pages(spark):
    df = spark.range(1_000).select((F.col("id") * 37 % 1_000).alias("id")).repartition(5)
    for first, n in ((0, 2), (7, 3), (98, 5), (200, 1)):
        got = sorted((r["page"], r["id"]) for r in rel.pages(df, ["id"], n, 10, first).collect())
        assert got == [(i // 10, i) for i in range(min(1_000, first * 10), min(1_000, (first + n) * 10))]
    assert rel.pages(df.limit(0), ["id"], 1, 10, 3).count() == 0


def test_one_community_is_read_from_its_folder(spark, tmp_path):
    from tests.test_plans import plan_text
    members = spark.range(5_000).select((F.col("id") % 50).alias("community"), F.col("id").alias("member"))
    path = str(tmp_path / "m")
    write_membership_by_community(members, path, buckets=16)
    one = read_community(spark, path, 7, buckets=16)
    assert sorted(r["member"] for r in one.collect()) == list(range(7, 5_000, 50))
    text = plan_text(one)
    assert "PartitionFilters: [isnotnull(bucket" in text and "PushedFilters: [IsNotNull(community), EqualTo(community,7)]" in text

    assert one.select(F.input_file_name().alias("f")).distinct().count() <= 2 and read_community(spark, path, 999, buckets=16).count() == 0


def test_written_rows_are_observed(spark):
    cut, seen = cut_observed(spark.range(10), n=F.count("*"), big=F.count_if(F.col("id") > 6))
    assert seen == {"n": 10, "big": 3} and cut.count() == 10


@pytest.mark.parametrize("receiver", [False, True])
def test_a_superstep_writes_the_changed_rows_alone(spark, monkeypatch, receiver):
    """Hops from one end of a path, beside many vertices that are done after one superstep."""
    from weft.plans import iterate
    written = []

    def counted(df, **metrics):
        cut, seen = cut_observed(df, **metrics)
        written.append(seen["n"])
        return cut, seen

    monkeypatch.setattr(iterate, "cut_observed", counted)
    path, pairs = list(range(12)), [(1_000 + 2 * i, 1_001 + 2 * i) for i in range(300)]
    g = simple(spark, [*zip(path, path[1:]), *pairs])
    far = F.col("sender_far") + 1
    if receiver:  # nothing is sent to a vertex that is nearer already
        far = F.when(F.coalesce(F.col("receiver_far") > far, F.lit(True)), far)
    got = as_dict(iterate.pregel(g, {"far": F.when((F.col("id") == 0) | (F.col("id") >= 1_000) & (F.col("id") % 2 == 0), F.lit(0)).cast("bigint")},
                                 {"near": F.min("msg")}, {"far": F.least("far", "near")}, to_dst=far, only_active=True, reads_receiver=receiver))
    assert got == {**{i: i for i in path}, **{a: 0 for a, _ in pairs}, **{b: 1 for _, b in pairs}}
    assert written == [612, 301, *[1] * 10, 0]


def test_layers_merge_and_the_newest_row_counts(spark):
    from weft.plans.iterate import Layered
    rows = Layered(spark.createDataFrame([(i, 0, "a") for i in range(40)], "id long, v int, s string"), ["v", "s"], most=2)
    want = {i: (0, "a") for i in range(40)}
    for step in range(1, 16):
        ids = [(7 * step + d) % 40 for d in range(5)]
        change = {i: (step, None if i % 2 else f"s{step}") for i in ids}
        rows.add(spark.createDataFrame([(i, *x) for i, x in change.items()], "id long, v int, s string"))
        want |= change
        assert len(rows.layers) <= 2 and rows.thin < rows.n == 40
        assert {r["id"]: (r["v"], r["s"]) for r in rows.latest().collect()} == want
    few = rows.latest(spark.createDataFrame([(3, 9), (99, 9)], "id long, m int")).collect()
    assert [(r["id"], r["v"], r["s"], r["m"]) for r in few] == [(3, *want[3], 9)]
    assert rows.add(spark.createDataFrame([], "id long, v int, s string")) is None
    rows.release()


def test_lines_are_split_once_per_text(spark):
    """The split is not run again for every line, and the lines are those of ``textFile``."""
    import re
    from tests.test_plans import plan_text
    from weft.sources.edgelist import text_lines
    texts = ["a\nb", "a\n", "a\n\n", "\n", "", None, "a\r\nb\rc\n\rd\r\n", "\r", "é\r\r\n", "x\n y ", "\\n|"]
    want = Counter()
    for t in texts:
        parts = [] if t is None else re.split(r"\r\n|\r|\n", t)
        want.update(parts[:-1] if parts and not parts[-1] else parts)
    df = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    assert Counter(r["value"] for r in text_lines(df).collect()) == want
    above = plan_text(text_lines(df)).split("Generate")[0]
    assert "split(" not in above


def test_links_of_a_graph_are_found_once(spark, sf_small):
    from tests.test_plans import plan_text
    from weft.catalog import S, link_graph
    g = link_graph(S(spark, sf_small), "link_device")
    assert "Join" not in plan_text(g.vertices) and "Join" not in plan_text(g.edges)


def test_rows_are_dealt_out_before_they_become_a_row_per_family(spark, sf_small, plain_joins):
    from tests.test_plans import plan_text
    from weft.catalog import ALL_TYPES, S
    src = S(spark, sf_small)
    rows = src.owns_with_person(ALL_TYPES)
    assert plan_text(rows).count("hashpartitioning(") == 2  # lineitem rows, applications
    text = plan_text(src.owned_by_persons(ALL_TYPES))
    assert text.index("Generate") < text.index("Join")
    want = Counter(map(tuple, rows.collect()))
    plain = src.owns(ALL_TYPES).join(src.has_id_card(), "app").count()
    assert sum(want.values()) == plain and max(want.values()) == 1
    spark.conf.set("weft.skew.threshold", "3")  # every large order is a hub
    spark.conf.set("weft.skew.maxHotKeys", "1000000")
    try:
        assert Counter(map(tuple, src.owns_with_person(ALL_TYPES).collect())) == want
    finally:
        spark.conf.unset("weft.skew.maxHotKeys")


@pytest.mark.parametrize("threshold", ["1000000", "20"])
def test_only_nodes_of_several_persons_are_met(spark, threshold):
    from weft.operators import match
    from weft.sources.tables import PropertyGraphSource
    rows = [(p, t, 4, 1, 1) for p in range(60) for t in ("HasHomeAddress", "HasApplyAddress")]  # a hub
    rows += [(p, "HasHomeAddress", 4, 2, p) for p in range(50)] * 2 + [(7, "HasHomeAddress", 4, 3, 0), (8, "HasApplyAddress", 4, 3, 0), (None, "HasHomeAddress", 4, 2, 5), (9, "HasHomeAddress", 4, None, 0), (10, "HasHomeAddress", 4, None, 0)]
    src = PropertyGraphSource(spark, "")
    src._memo[("rows", match.ADDRESS_TYPES)] = spark.createDataFrame(rows, "person long, rel_type string, fam int, k1 long, k2 long")
    spark.conf.set("weft.skew.threshold", threshold)
    try:
        kept = match.met_rows(src, match.ADDRESS_TYPES).collect()
        assert Counter((r["k1"], r["k2"]) for r in kept) == {(1, 1): 120, (3, 0): 2}
        pairs = Counter(map(tuple, match.links(src, "link_address").collect()))
    finally:
        spark.conf.unset("weft.skew.threshold")
    assert pairs == Counter({(a, b): 1 for a in range(60) for b in range(a)})


@pytest.mark.parametrize("second", [False, True])
def test_nodes_of_several_applications_are_found_before_the_id_cards(spark, second):
    """pagerank_20, lpa_25: every lineitem row met its order, most of them to be left out afterwards."""
    import datetime as dt

    from weft.operators import match
    from weft.sources.tables import PropertyGraphSource
    day = dt.datetime(2024, 1, 1)
    orders = [(a, a // 2) for a in range(40)] + [(None, 1), (None, 2), (50, None)] + ([(7, 90)] if second else [])
    items = [(a, a % 9, day + dt.timedelta(days=a % 2), f) for a in range(45) for f in "NRA"] * 2
    items += [(6, 100, day, "N"), (7, 101, day, "N"), (10, 102, day, "N"), (11, 102, day, "N"), (None, 3, day, "N"), (50, 3, day, "N"), (4, None, day, "N"), (5, None, day, "N"), (8, 3, None, "N")]
    src = PropertyGraphSource(spark, "")
    src._memo["orders"] = spark.createDataFrame([(*o, "F", "2-HIGH", day) for o in orders], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp_ntz")
    src._memo["lineitem"] = spark.createDataFrame([(a, p, 1, 1.0, f, d) for a, p, d, f in items], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz")
    for name, flags in (("link_device", ("NRA", "NRA")), ("link_phone_emergency", ("N", "R"))):
        got = Counter(map(tuple, match.links(src, name).collect()))
        node = (lambda p, d: (p, d)) if name == "link_device" else (lambda p, d: (p, d and (d.year, d.month)))
        held = [{(c, node(p, d)) for a, p, d, f in items if f in some for o, c in orders if None not in (a, c, p, d) and a == o} for some in flags]
        want = {(a, b) for a, x in held[0] for b, y in held[1] if x == y and (a > b if name == "link_device" else a != b)}
        assert got == Counter(want)
        assert any(k[0] == "rows" for k in src._memo) == second


def test_votes_are_shuffled_once_a_round(spark, sf_small, monkeypatch):
    """lpa_25: the votes went out by vertex and label and then, added up, by vertex."""
    from tests.test_plans import round_plan
    from weft.catalog import S, link_graph
    plans = round_plan(monkeypatch, alg, lambda: alg.label_propagation(link_graph(S(spark, sf_small), "link_device"), 3))
    rounds = [p for p in plans if "votes" in p]
    assert len(rounds) == 3 and all(p.count("hashpartitioning(id#") == 1 for p in rounds[1:])


def test_rows_go_to_their_node_once(spark, sf_small, monkeypatch):
    """pagerank_tol, sink_roundtrip, community_members: rows were shuffled to count their nodes, and again to meet them."""
    from tests.test_plans import round_plan
    from weft.catalog import S
    from weft.operators import match
    for name in ("link_device", "link_phone_emergency"):
        plans = round_plan(monkeypatch, match, lambda: match.links(S(spark, sf_small), name))
        assert sum(len(re.findall(r"hashpartitioning\([^)]*k1#", p.split("Initial Plan")[-1])) for p in plans) == 1


@pytest.mark.parametrize("threshold", ["1000000", "4"])
def test_nodes_without_both_sides_of_a_rule_are_left(spark, threshold, monkeypatch):
    """pagerank_tol: nodes of several persons were kept though none held them the other way."""
    from weft.operators import match
    from weft.sources.tables import PropertyGraphSource
    held = {(1, 1): "NR", (2, 2): "N", (3, 3): "R", (4, 4): "NR"}  # node -> the ways in which its 12 (the last: 2) persons hold it
    rows = [(p, "HasPhone" if way == "N" else "HasEmergencyPhone", 5, *node) for node, ways in held.items() for p in range(2 if node == (4, 4) else 12) for way in ways]
    src = PropertyGraphSource(spark, "")
    src._memo[("rows", ("HasEmergencyPhone", "HasPhone"))] = spark.createDataFrame(rows, "person long, rel_type string, fam int, k1 long, k2 long")
    kept, plain = [], match.met_rows
    monkeypatch.setattr(match, "met_rows", lambda *a: kept.append(plain(*a)) or kept[-1])
    spark.conf.set("weft.skew.threshold", threshold)
    try:
        pairs = Counter(map(tuple, match.links(src, "link_phone_emergency").collect()))
    finally:
        spark.conf.unset("weft.skew.threshold")
    assert Counter((r["fam"], r["rel_type"], r["k1"]) for r in kept[0].collect()) == {(5, t, k): n for t in ("HasPhone", "HasEmergencyPhone") for k, n in ((1, 12), (4, 2))}
    assert pairs == Counter({(a, b): 1 for a in range(12) for b in range(12) if a != b})
