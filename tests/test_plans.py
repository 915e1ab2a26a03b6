"""Plan shape: no Cartesian products, no nested-loop joins, no Python evaluation;
filters and column pruning reach the parquet scans."""

import pytest

from weft.catalog import QUERIES, S, link_graph
from weft.plans.iterate import Adjacency, cut_lineage

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")
NON_ITERATIVE = [k for k in QUERIES if not any(
    k.startswith(p) for p in ("lpa_", "pregel", "pagerank", "connected", "cc_", "mask_cc", "community",
                              "vertex_risk", "top_triplets", "sink_", "triangle", "network_report",
                              "clustering", "social_net", "link_", "edges_", "graph_", "degree", "in_",
                              "out_", "triplet", "subgraph", "map_", "reverse", "outer_", "edge_", "density",
                              "avg_"))]


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(NON_ITERATIVE))
def test_no_forbidden_operators(spark, sf_small, key):
    text = plan_text(QUERIES[key](spark, sf_small))
    for op in FORBIDDEN:
        assert op not in text, (key, op)


@pytest.mark.parametrize("key", ["link_device", "social_net_11", "degrees", "triplets", "network_report",
                                 "triangle_count", "community_risk"])
def test_graph_queries_have_no_forbidden_operators(spark, sf_small, key):
    text = plan_text(QUERIES[key](spark, sf_small))
    for op in FORBIDDEN:
        assert op not in text, (key, op)


def test_scan_is_pruned(spark, sf_small):
    src = S(spark, sf_small)
    rows = src.owns(("HasDeviceAddress",), distinct=False).join(src.has_id_card(), "app")
    text = plan_text(rows)
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_shipdate:timestamp_ntz>" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_param_filter_is_pushed_down(spark, sf_small):
    text = plan_text(QUERIES["param_filter"](spark, sf_small))
    assert "PushedFilters: [IsNotNull(o_orderkey), LessThanOrEqual(o_orderkey,30)]" in text


def test_message_round_shuffles_only_the_value_side(spark, sf_small):
    g = link_graph(S(spark, sf_small), "link_device")
    adj = Adjacency(g.edges.select("src", "dst"), "both")
    try:
        labels = cut_lineage(g.vertices.select("id", g.vertices["id"].alias("label")))
        text = plan_text(adj.gather(labels, ["label"]))
        # the persisted adjacency keeps its partitioning: one exchange (value side) only
        assert text.count("ENSURE_REQUIREMENTS") <= 1
        for op in FORBIDDEN:
            assert op not in text
    finally:
        adj.release()


def round_plan(monkeypatch, module, run):
    """The plans of the frames that a loop writes, as they are before each write."""
    seen = []
    keep = module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df: (seen.append(plan_text(df)), keep(df))[1])
    run()
    return seen


def test_call_graph_rounds_join_no_owners_with_owners(spark, sf_small, monkeypatch):
    from weft.operators.match import undirected_calls
    from weft.plans import algorithms as alg
    src = S(spark, sf_small)
    phones, calls = src.phones_of_apps("HasPhone"), undirected_calls(src)
    plans = round_plan(monkeypatch, alg, lambda: alg.call_graph_labels(phones, calls, 2, checkpoint_every=1))
    rounds = [p for p in plans if "votes" in p]
    assert len(rounds) == 2
    for text in rounds:
        for op in FORBIDDEN:
            assert op not in text
        # votes are summed per phone before they move on and before the owners read them
        assert text.count("partial_count(1)") + text.count("partial_sum(n") >= 2


def test_call_graph_round_is_one_join_between_phones_of_few_owners(spark, sf_small, monkeypatch):
    """community_risk: its rounds walked three hops over every phone and call."""
    from weft.plans import algorithms as alg
    plans = round_plan(monkeypatch, alg, lambda: QUERIES["community_risk"](spark, sf_small))
    rounds = [p for p in plans if "votes" in p]
    assert rounds
    for text in rounds[1:]:
        assert len([x for x in text.splitlines() if "Join" in x]) == 1
        # beside the votes, which go to their receiver once, only the labels are shuffled
        assert text.count("ENSURE_REQUIREMENTS") <= 1 and text.count("Exchange hashpartitioning(id#") == 1


def test_label_round_reads_its_last_labels_without_a_join(spark, sf_small, monkeypatch):
    from weft.plans import algorithms as alg
    g = link_graph(S(spark, sf_small), "link_device")
    plans = round_plan(monkeypatch, alg, lambda: alg.label_propagation(g, 3, checkpoint_every=1))
    assert plans and all(len([x for x in p.split("Initial Plan")[-1].splitlines() if "Join" in x]) <= 1 for p in plans)


def test_endpoint_union_scans_no_more_than_the_call_graph(spark, sf_small):
    bag, ends = (plan_text(QUERIES[k](spark, sf_small)).split("Initial Plan")[-1] for k in ("call_graph", "endpoint_union"))
    assert ends.count("Scan") <= bag.count("Scan") and ends.count("Join") <= bag.count("Join")
    assert plan_text(QUERIES["triplet_sources"](spark, sf_small)).split("Initial Plan")[-1].count("Join") <= bag.count("Join")
