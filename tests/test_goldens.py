"""Golden values: GraphX results on tiny graphs (survey Appendix A)."""

import pytest
from pyspark.sql import functions as F

from tests.graphs import A, B, C, D, as_dict, edges_df, g1, simple
from weft.model import Graph, from_edges, from_vertices_and_edges
from weft.operators import structure as st
from weft.plans import algorithms as alg
from weft.plans import metrics as met
from weft.sources.edgelist import parse_edge_list


def test_degrees(spark):
    g = g1(spark)
    assert as_dict(st.degrees(g)) == {A: 2, B: 2, C: 1, D: 3}
    assert as_dict(st.in_degrees(g)) == {A: 1, B: 2, C: 1}
    assert as_dict(st.out_degrees(g)) == {A: 1, D: 3}


def test_filters(spark):
    g = g1(spark)
    assert g.vertices.filter(F.col("dpd7") == 1).count() == 2
    assert g.edges.filter(F.col("src") > F.col("dst")).count() == 3
    assert g.edges.filter(F.col("src") < F.col("dst")).count() == 1


def test_subgraph_components_mask(spark):
    g = g1(spark)
    sub = st.subgraph(g, vpred=F.col("dpd7") != 1)
    assert sorted(r.id for r in sub.vertices.collect()) == [A, C]
    assert sub.edges.count() == 0
    cc = alg.connected_components(g)
    assert set(as_dict(cc).values()) == {A}
    masked = st.mask(Graph(cc, g.edges), sub)
    assert as_dict(masked.vertices) == {A: A, C: A}


def test_triangles_and_clustering(spark):
    g = g1(spark)
    assert as_dict(alg.triangle_count(g)) == {A: 1, B: 1, C: 0, D: 1}
    assert met.clustering(g).first()["clustering"] == pytest.approx(3.0)


def test_pagerank_tolerance(spark):
    g = g1(spark)
    pr = as_dict(alg.pagerank_until(g, 0.001))
    expected = {A: 0.864076308, B: 1.598541170, C: 0.864076308, D: 0.673306214}
    for k, v in expected.items():
        assert pr[k] == pytest.approx(v, abs=1e-8)


def test_pagerank_three_disjoint_edges(spark):
    g = simple(spark, [(1, 2), (3, 4), (5, 6)])
    pr = as_dict(alg.pagerank_until(g, 0.001))
    assert len(pr) == 6
    for k, v in pr.items():
        assert v == pytest.approx(0.701754386 if k % 2 else 1.298245614, abs=1e-8)


def test_outer_join_and_reverse(spark):
    g = g1(spark)
    od = st.outer_join_vertices(g, st.out_degrees(g), "out_degree", 0)
    assert as_dict(od) == {A: 1, B: 0, C: 0, D: 3}
    rev = {(r.src, r.dst, r.attr) for r in st.reverse(g).edges.collect()}
    assert rev == {(A, D, 1), (B, D, 2), (B, A, 2), (C, D, 5)}


def lpa(spark, pairs, steps):
    return as_dict(alg.label_propagation(simple(spark, pairs), steps))


def test_lpa_single_edge_oscillates(spark):
    assert lpa(spark, [(1, 2)], 1) == {1: 2, 2: 1}
    assert lpa(spark, [(1, 2)], 2) == {1: 1, 2: 2}
    assert lpa(spark, [(1, 2)], 10) == {1: 1, 2: 2}
    assert lpa(spark, [(1, 2)], 25) == {1: 2, 2: 1}


CLIQUES = [(2, 1), (3, 1), (3, 2), (4, 3), (5, 4), (6, 4), (6, 5)]


def test_lpa_two_cliques(spark):
    assert lpa(spark, CLIQUES, 1) == {1: 2, 2: 1, 3: 1, 4: 3, 5: 4, 6: 4}
    assert lpa(spark, CLIQUES, 2) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 3, 6: 3}
    for steps in (3, 5, 10):
        assert lpa(spark, CLIQUES, steps) == {1: 1, 2: 1, 3: 1, 4: 3, 5: 3, 6: 3}


def test_two_cliques_clustering(spark):
    g = simple(spark, CLIQUES)
    assert sum(as_dict(alg.triangle_count(g)).values()) == 6
    assert met.clustering(g).first()["clustering"] == pytest.approx(3.0)


MULTI = [(1, 2), (1, 2), (2, 1), (3, 3), (1, 3), (2, 3)]


def test_multigraph(spark):
    g = simple(spark, MULTI)
    assert as_dict(st.degrees(g)) == {1: 4, 2: 4, 3: 4}
    assert as_dict(st.in_degrees(g)) == {1: 1, 2: 2, 3: 3}
    assert as_dict(alg.triangle_count(g)) == {1: 1, 2: 1, 3: 1}
    assert lpa(spark, MULTI, 1) == {1: 2, 2: 1, 3: 3}
    assert lpa(spark, MULTI, 2) == {1: 1, 2: 2, 3: 3}
    assert lpa(spark, MULTI, 3) == {1: 2, 2: 1, 3: 3}


def test_missing_vertex_has_null_attribute(spark):
    v = spark.createDataFrame([(1, "a")], "id bigint, name string")
    g = from_vertices_and_edges(v, edges_df(spark, [(1, 2)]))
    assert as_dict(g.vertices) == {1: "a", 2: None}


def test_edge_list_parsing(spark):
    lines = spark.createDataFrame([("# c",), ("1 2",), ("3\t1",), ("",), ("4 3 9.5",)], "value string")
    edges = {(r.src, r.dst, r.attr) for r in parse_edge_list(lines, canonical_orientation=True).collect()}
    assert edges == {(1, 2, 1), (1, 3, 1), (3, 4, 1)}
    plain = {(r.src, r.dst) for r in parse_edge_list(lines).collect()}
    assert plain == {(1, 2), (3, 1), (4, 3)}


def test_malformed_edge_line_fails(spark):
    lines = spark.createDataFrame([("1 2",), ("7",)], "value string")
    with pytest.raises(Exception):
        parse_edge_list(lines).collect()


def test_lpa_requires_positive_steps(spark):
    with pytest.raises(ValueError, match="Maximum of steps must be greater than 0, but got 0"):
        alg.label_propagation(simple(spark, [(1, 2)]), 0)


def test_empty_graph_metrics(spark):
    g = from_edges(spark.createDataFrame([], "src bigint, dst bigint, attr int"), 1)
    r = met.network_report(g).first()
    assert r["num_vertices"] == 0 and r["num_edges"] == 0
    assert r["avg_degree"] == 0.0 and r["clustering"] == 0.0
    assert r["density_text"] == "0.000000000"


def test_single_vertex_self_loop(spark):
    g = simple(spark, [(7, 7)])
    assert as_dict(st.degrees(g)) == {7: 2}
    assert as_dict(alg.label_propagation(g, 3)) == {7: 7}
    assert as_dict(alg.triangle_count(g)) == {7: 0}
    assert as_dict(alg.connected_components(g)) == {7: 7}
    assert met.density(g).first()["density"] == 0.0


def test_aggregate_messages_and_pregel(spark):
    from weft.plans.iterate import aggregate_messages, pregel
    g = g1(spark)
    # sum of the source's dpd7 over in-edges, and max neighbour id over both directions
    s = as_dict(aggregate_messages(g, None, F.col("src_dpd7"), F.sum))
    assert s == {A: 1, B: 1 + 0, C: 1}
    mx = as_dict(aggregate_messages(g, F.col("dst"), F.col("src"), F.max))
    assert mx == {A: D, B: D, C: D, D: C}
    # min label to a fixpoint along both directions = connected components
    low = dict(values={"label": F.col("id")}, merge={"m": F.min("msg")}, update={"label": F.least("label", "m")},
               to_dst=F.col("sender_label"), to_src=F.col("sender_label"))
    for active in (False, True):
        assert set(as_dict(pregel(g, **low, only_active=active)).values()) == {A}
    with pytest.raises(RuntimeError):
        pregel(g, **low, max_iter=1)
    # receiver values, null messages and a sum: every vertex adds up its smaller neighbours, once
    n = pregel(g, {"n": F.lit(0).cast("bigint")}, {"s": F.sum("msg")}, {"n": F.col("n") + F.col("s")},
               to_dst=F.when(F.col("sender_n") <= F.col("receiver_n"), 1), steps=1, reads_receiver=True)
    indegree = {r["dst"]: r["n"] for r in g.edges.groupBy("dst").agg(F.count("*").alias("n")).collect()}
    assert {k: v for k, v in as_dict(n).items() if v} == indegree


def test_pagerank_cap_raises(spark):
    with pytest.raises(RuntimeError):
        alg.pagerank_until(g1(spark), 1e-6, max_iter=1)


def test_sinks_roundtrip(spark, tmp_path):
    from weft.sinks import read_membership, write_membership, write_ranked
    m = spark.createDataFrame([(1, 1), (1, 2), (5, 5), (1, 3)], "community bigint, member bigint")
    for fmt in ("parquet", "text"):
        path = str(tmp_path / fmt)
        write_membership(m, path, fmt=fmt)
        assert sorted(map(tuple, read_membership(spark, path, fmt).collect())) == [(1, 1), (1, 2), (1, 3), (5, 5)]
    ranks = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, 1.5)], "id bigint, rank double")
    write_ranked(ranks, "rank", str(tmp_path / "ranked"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "ranked")).collect()]
    assert sorted(lines) == ["1,0.5", "2,1.5", "3,1.5"]


def test_edge_list_file(spark, tmp_path):
    from weft.sources.edgelist import edge_list_graph
    p = tmp_path / "edges.txt"
    p.write_text("1 2\n3 4\n5 6\n")
    g = edge_list_graph(spark, str(p))
    assert g.vertices.count() == 6 and g.edges.count() == 3


def test_call_graph_leaves_out_an_ownership_used_twice(spark):
    """A phone that calls itself pairs its owners with each other, none with itself."""
    from weft.operators.match import call_graph

    class Source:
        def phones_of_apps(self, rel):
            return spark.createDataFrame([(1, 5, 0), (2, 5, 0), (1, 6, 0)], "app bigint, k1 bigint, k2 bigint")

        def calls(self):
            return spark.createDataFrame([(5, 0, 5, 0, 1), (5, 0, 6, 0, 2)],
                                         "src_k1 bigint, src_k2 bigint, dst_k1 bigint, dst_k2 bigint, call_cnt bigint")

    got = sorted(tuple(r) for r in call_graph(Source()).collect())
    assert got == sorted([(1, 2, 1), (2, 1, 1), (1, 1, 2), (1, 1, 2), (2, 1, 2), (1, 2, 2)])
