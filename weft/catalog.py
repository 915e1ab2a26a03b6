"""Every operator of the reference as a named query over the driver tables.

``QUERIES[key](spark, sf_dir) -> DataFrame`` and ``SQL[key]`` (DuckDB oracle).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import oracle as Q
from weft.functions.columns import overdue_flag, scala_string
from weft.model import Graph, edges_from_pairs, from_edges, from_vertices_and_edges, nodes_from_both_ends
from weft.operators import relational as rel
from weft.operators import structure as st
from weft.operators.match import APP_ATTRS, call_graph, component_edges, links, undirected_calls
from weft.plans import algorithms as alg
from weft.plans import community as com
from weft.plans import metrics as met
from weft.plans.iterate import aggregate_messages, cut_lineage, pregel
from weft.session import scratch_path
from weft.sinks import (read_community, read_membership, read_ranked, read_sizes, write_membership, write_membership_by_community,
                        write_ranked, write_sizes)
from weft.sources.edgelist import edge_list_graph, parse_edge_list, read_lines, render_edge_list, text_lines
from weft.sources.tables import FAMILY_CODE, FAMILY_OF, PropertyGraphSource, render_key, source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------------------
# graphs used by several keys (FIXTURES §4)

def link_graph(src: PropertyGraphSource, name: str) -> Graph:
    """``Graph.fromEdges(Edge(from, to, 1), 1)`` over one link pattern; the links are found once,
    for edges and vertices."""
    return from_edges(edges_from_pairs(cut_lineage(links(src, name)), attr=F.lit(1)), 1)


def person_graph(src: PropertyGraphSource) -> Graph:
    """Customers (nation, segment) with the link_phone_emergency edges, default (2, '2')."""
    e = edges_from_pairs(links(src, "link_phone_emergency"), attr=F.lit(1))
    return from_vertices_and_edges(src.persons(), e, default={"nation": 2, "segment": "2"})


def flag_rows(src: PropertyGraphSource) -> DataFrame:
    return call_graph(src, flags=True).select(
        "source", "target", "weight", "end_result1", F.col("overdue1"), "end_result2", F.col("overdue2"))


def flag_nodes(src: PropertyGraphSource) -> DataFrame:
    return nodes_from_both_ends(flag_rows(src), "source", "target", ["end_result1", "overdue1"],
                                ["end_result2", "overdue2"], ["end_result", "overdue"])


def flag_graph(src: PropertyGraphSource) -> Graph:
    """``Graph(nodes, edges)`` of the application call graph: nodes from both ends
    (id, end_result, overdue) — one row per id, the attributes being functions of the
    application — and weighted edges with the weight kept as text."""
    e = call_graph(src).select(F.col("source").alias("src"), F.col("target").alias("dst"),
                               F.col("weight").cast("string").alias("attr"))
    return Graph(flag_nodes(src), e)


def app_flags(src: PropertyGraphSource) -> DataFrame:
    """``(id, end_result, overdue)`` of every application."""
    return src.applications().select(F.col("app").alias("id"), "end_result",
                                     overdue_flag(*APP_ATTRS[1:]).alias("overdue"))


def labelled_flags(src: PropertyGraphSource, steps: int = 10) -> DataFrame:
    """LPA over the application call graph, labels joined to the node attributes.

    Phones of few owners give pairs of applications; the pairs of the others are never formed: votes
    move from owners to phones, over the calls and to the owners at the other end.  Every node is an endpoint of a call edge and
    its attributes are functions of its application, so they are attached afterwards by one
    join on the application key."""
    return com.with_attrs(alg.call_graph_labels(src.phones_of_apps("HasPhone"), undirected_calls(src), steps, few=alg.FEW_OWNERS), app_flags(src))


def S(spark, d):
    return source(spark, d)


# ---------------------------------------------------------------------------------------
# sources S1-S12

ALL_TYPES = tuple(FAMILY_OF)


@register("graph_tables", Q.with_base(body="SELECT o.rel_type, o.app, h.person, o.attr_key "
                                          "FROM owns o JOIN has_id_card h ON o.app = h.app"))
def graph_tables(spark, d):
    return S(spark, d).owns_with_person(ALL_TYPES)


@register("node_ids", Q.with_base(body="SELECT app AS id FROM applications"))
def node_ids(spark, d):
    return S(spark, d).applications().select(F.col("app").alias("id"))


MAX_ID = 30


@register("param_filter", Q.with_base(body=f"SELECT app AS id FROM applications WHERE app <= {MAX_ID}"))
def param_filter(spark, d, max_id: int = MAX_ID):
    """``where id(n) <= {maxId}`` with a bound parameter: named SQL argument over a DataFrame."""
    apps = S(spark, d).applications()
    return spark.sql("SELECT app AS id FROM {apps} WHERE app <= :maxId", args={"maxId": max_id}, apps=apps)


PAGES, PAGE_SIZE = 4, 25


@register("paged_nodes", Q.with_base(body=f"""
SELECT id, CAST((rn - 1) // {PAGE_SIZE} AS INTEGER) AS page FROM (
  SELECT app AS id, row_number() OVER (ORDER BY app) AS rn FROM applications) r
WHERE rn <= {PAGES * PAGE_SIZE}"""))
def paged_nodes(spark, d):
    ids = S(spark, d).applications().select(F.col("app").alias("id"))
    return rel.pages(ids, ["id"], PAGES, PAGE_SIZE)


@register("pattern_scan", Q.with_base(body="SELECT app AS source, person AS target FROM has_id_card"))
def pattern_scan(spark, d):
    return S(spark, d).has_id_card().select(F.col("app").alias("source"), F.col("person").alias("target"))


@register("label_count", Q.with_base(body="SELECT count(*) AS cnt FROM applications"))
def label_count(spark, d):
    return S(spark, d).applications().agg(F.count(F.lit(1)).alias("cnt"))


@register("rels_graph", Q.with_base(body="SELECT app AS source, attr_key AS target, 'HasPhone' AS value FROM ph"))
def rels_graph(spark, d):
    return (S(spark, d).phones_of_apps("HasPhone")
            .select(F.col("app").alias("source"), render_key(F.lit(FAMILY_CODE["phone"])).alias("target"),
                    F.lit("HasPhone").alias("value")))


@register("pattern_graph_props", Q.with_base(body="""
SELECT p.app AS source, a.end_result AS source_attr, p.attr_key AS target, p.attr_key AS target_attr,
       strftime(a.created, '%Y-%m-%d') AS edge_attr
FROM ph p JOIN applications a ON a.app = p.app"""))
def pattern_graph_props(spark, d):
    src = S(spark, d)
    apps = src.applications().select("app", "end_result", "created")
    phones = src.phones_of_apps("HasPhone").withColumn("attr_key", render_key(F.lit(FAMILY_CODE["phone"])))
    return (phones.join(apps, "app")
            .select(F.col("app").alias("source"), F.col("end_result").alias("source_attr"),
                    F.col("attr_key").alias("target"), F.col("attr_key").alias("target_attr"),
                    F.date_format("created", "yyyy-MM-dd").alias("edge_attr")))


DOC_LINES = r"""
doc_lines AS (
  SELECT lang, value FROM (
    SELECT lang, unnest(parts) AS value, generate_subscripts(parts, 1) AS pos, len(parts) AS n
    FROM (SELECT lang, string_split_regex(text, '\r\n|\r|\n') AS parts FROM documents) s) u
  WHERE NOT (pos = n AND value = ''))"""


@register("line_count", Q.with_base(DOC_LINES, body="SELECT value AS line, count(*) AS cnt FROM doc_lines GROUP BY value"))
def line_count(spark, d):
    lines = text_lines(S(spark, d).table("documents"))
    return rel.key_count(lines, "value").withColumnRenamed("value", "line")


EDGE_LIST_SQL = "SELECT src, dst, 1 AS attr FROM ({}) l"


@register("edge_list_load", Q.with_base(body=EDGE_LIST_SQL.format(Q.link_sql("link_phone_emergency"))))
def edge_list_load(spark, d):
    lines = render_edge_list(links(S(spark, d), "link_phone_emergency"))
    return parse_edge_list(lines, canonical_orientation=False)


@register("edge_list_canonical", Q.with_base(
    body=f"SELECT least(src, dst) AS src, greatest(src, dst) AS dst, 1 AS attr FROM ({Q.link_sql('link_phone_emergency')}) l"))
def edge_list_canonical(spark, d):
    lines = render_edge_list(links(S(spark, d), "link_phone_emergency"))
    return parse_edge_list(lines, canonical_orientation=True)


def _written_lines(spark, lines):
    """Write text lines to the shared scratch folder and return the folder."""
    path = scratch_path(spark, "lines")
    lines.select("value").write.text(path)
    return path


@register("text_file_lines", Q.with_base(DOC_LINES, body="SELECT value FROM doc_lines"))
def text_file_lines(spark, d):
    """Lines of text files (``textFile``): the documents' lines, written and read as files."""
    return read_lines(spark, _written_lines(spark, text_lines(S(spark, d).table("documents"))))


@register("edge_list_file", Q.with_base(body=f"SELECT src, dst, 1 AS attr FROM ({Q.link_sql('link_phone_emergency')}) l"))
def edge_list_file(spark, d):
    """``edgeListFile``: a graph from files of ``src dst`` lines."""
    path = _written_lines(spark, render_edge_list(links(S(spark, d), "link_phone_emergency")))
    return edge_list_graph(spark, path).edges


FAR_PAGE = 30


@register("paged_nodes_deep", Q.with_base(body=f"""
SELECT id, CAST((rn - 1) // {PAGE_SIZE} AS INTEGER) AS page FROM (
  SELECT app AS id, row_number() OVER (ORDER BY app) AS rn FROM applications) r
WHERE rn > {FAR_PAGE * PAGE_SIZE} AND rn <= {(FAR_PAGE + PAGES) * PAGE_SIZE}"""))
def paged_nodes_deep(spark, d):
    ids = S(spark, d).applications().select(F.col("app").alias("id"))
    return rel.pages(ids, ["id"], PAGES, PAGE_SIZE, first=FAR_PAGE)


# ---------------------------------------------------------------------------------------
# sinks K1-K3

@register("sink_roundtrip", Q.with_base(*Q.link_graph("link_device"), *Q.lpa_ctes(25),
                                        body="SELECT label AS community, id AS member FROM labels", recursive=True))
def sink_roundtrip(spark, d):
    labels = alg.label_propagation(link_graph(S(spark, d), "link_device"), 25)
    path = scratch_path(spark, "communities")
    write_membership(com.members(labels), path)
    return read_membership(spark, path)


@register("sink_community", Q.with_base(*Q.link_graph("link_device"), *Q.lpa_ctes(25), body="""
SELECT label AS community, id AS member FROM labels WHERE label = (SELECT min(label) FROM labels)""", recursive=True))
def sink_community(spark, d):
    """The community of the smallest label, read from its folder alone."""
    members = com.members(alg.label_propagation(link_graph(S(spark, d), "link_device"), 25))
    path = scratch_path(spark, "by-community")
    write_membership_by_community(members, path)
    return read_community(spark, path, members.agg(F.min("community")).first()[0])


@register("sink_sizes", Q.with_base(*Q.link_graph("link_device"), *Q.lpa_ctes(25),
                                    body="SELECT label AS community, count(*) AS size FROM labels GROUP BY label", recursive=True))
def sink_sizes(spark, d):
    labels = alg.label_propagation(link_graph(S(spark, d), "link_device"), 25)
    path = scratch_path(spark, "sizes")
    write_sizes(com.sizes(labels), path)
    return read_sizes(spark, path)


@register("sink_ranked", Q.with_base(*Q.link_graph("link_phone"), *Q.triangle_ctes(), body="SELECT id, triangles FROM tc"))
def sink_ranked(spark, d):
    path = scratch_path(spark, "ranked")
    write_ranked(alg.triangle_count(link_graph(S(spark, d), "link_phone")), "triangles", path)
    return read_ranked(spark, path, "triangles", "bigint")


# ---------------------------------------------------------------------------------------
# pattern matching R1-R22

for _name in ["link_device", "link_ip", "link_company", "link_address", "link_phone", "link_emergency",
              "link_phone_emergency", "link_phone_contact", "link_phone_call", "link_emergency_contact",
              "link_emergency_call", "link_call_emergency_fwd", "link_call_phone_fwd", "link_contact_emergency",
              "link_device_both", "social_net_11", "social_net_6", "social_net_7"]:
    register(_name, Q.with_base(body=Q.link_sql(_name)))(
        (lambda n: lambda spark, d: links(S(spark, d), n))(_name))


@register("call_graph", Q.with_base(body=Q.CALL_GRAPH))
def q_call_graph(spark, d):
    return call_graph(S(spark, d))


@register("call_graph_flags", Q.with_base(body=Q.CALL_GRAPH_FLAGS))
def q_call_graph_flags(spark, d):
    return flag_rows(S(spark, d))


@register("call_graph_wide", Q.with_base(body=Q.CALL_GRAPH_WIDE))
def q_call_graph_wide(spark, d):
    wide = call_graph(S(spark, d), attrs=APP_ATTRS)
    return wide.select("source", "target", "weight", *[f"{a}1" for a in APP_ATTRS], *[f"{a}2" for a in APP_ATTRS])


@register("edge_struct_attr", Q.with_base(body=f"""
SELECT source AS src, target AS dst,
  '(' || concat_ws(',', coalesce(CAST(weight AS VARCHAR), 'null'), coalesce(end_result2, 'null'),
     coalesce(dpd72, 'null'), coalesce(dpd152, 'null'), coalesce(dpd302, 'null'), coalesce(dpd902, 'null')) || ')' AS attr
FROM ({Q.CALL_GRAPH_WIDE}) w"""))
def edge_struct_attr(spark, d):
    """Edges whose attribute is the 6-tuple (weight, target's end_result, dpd7, dpd15,
    dpd30, dpd90), printed as the tuple prints; vertex default 3."""
    wide = call_graph(S(spark, d), attrs=APP_ATTRS)
    tup = F.struct(F.col("weight"), *[F.col(f"{a}2").alias(a) for a in APP_ATTRS])
    g = from_edges(edges_from_pairs(wide, "source", "target", attr=tup), 3)
    fields = ["weight"] + APP_ATTRS
    text = F.concat(F.lit("("), F.concat_ws(",", *[scala_string(F.col(f"attr.{f}")) for f in fields]), F.lit(")"))
    return g.edges.select("src", "dst", text.alias("attr"))


# ---------------------------------------------------------------------------------------
# graph construction G1-G7

@register("edges_const_attr", Q.with_base(body=f"SELECT src, dst, 1 AS attr FROM ({Q.link_sql('link_device')}) l"))
def edges_const_attr(spark, d):
    return link_graph(S(spark, d), "link_device").edges


@register("edges_weighted", Q.with_base(body=f"SELECT source AS src, target AS dst, CAST(weight AS VARCHAR) AS attr FROM ({Q.CALL_GRAPH}) c"))
def edges_weighted(spark, d):
    return flag_graph(S(spark, d)).edges


@register("graph_from_edges", Q.with_base(*Q.link_graph("link_device"), body="SELECT id, 1 AS attr FROM V"))
def graph_from_edges(spark, d):
    return link_graph(S(spark, d), "link_device").vertices


@register("graph_with_default", Q.with_base(*Q.PERSON_GRAPH, body="SELECT id, nation, segment FROM V"))
def graph_with_default(spark, d):
    return person_graph(S(spark, d)).vertices


@register("graph_no_default", Q.with_base(*Q.FLAG_GRAPH, body="""
SELECT V.id, N.end_result, N.overdue FROM V LEFT JOIN N ON N.id = V.id"""))
def graph_no_default(spark, d):
    src = S(spark, d)
    g = flag_graph(src)
    return from_vertices_and_edges(g.vertices, g.edges).vertices


BUILDING = """
E AS (SELECT src, dst, 1 AS attr FROM ({link}) l),
K AS (SELECT id, nation, segment FROM persons WHERE segment = 'BUILDING'),
M AS (SELECT src AS id FROM E UNION SELECT dst FROM E)"""


def building_vertices(src: PropertyGraphSource):
    """The customers of one segment: most ends of the links are not among them."""
    return src.persons().filter(F.col("segment") == "BUILDING")


@register("graph_default_filled", Q.with_base(BUILDING.format(link=Q.link_sql("link_phone_emergency")), body="""
SELECT id, nation, segment FROM K UNION ALL SELECT id, 2, '2' FROM M WHERE id NOT IN (SELECT id FROM K)"""))
def graph_default_filled(spark, d):
    """``Graph(v, e, default)`` where the default is filled in for most vertices."""
    src = S(spark, d)
    e = edges_from_pairs(links(src, "link_phone_emergency"), attr=F.lit(1))
    return from_vertices_and_edges(building_vertices(src), e, default={"nation": 2, "segment": "2"}).vertices


@register("graph_null_filled", Q.with_base(BUILDING.format(link=Q.link_sql("link_phone_emergency")), body="""
SELECT id, nation, segment FROM K UNION ALL SELECT id, NULL, NULL FROM M WHERE id NOT IN (SELECT id FROM K)"""))
def graph_null_filled(spark, d):
    """``Graph(v, e)``: the missing vertices have null attributes."""
    src = S(spark, d)
    e = edges_from_pairs(links(src, "link_phone_emergency"), attr=F.lit(1))
    return from_vertices_and_edges(building_vertices(src), e).vertices


@register("nodes_from_both_ends", Q.with_base(body=Q.FLAG_NODES))
def q_nodes_from_both_ends(spark, d):
    return flag_nodes(S(spark, d))


# ---------------------------------------------------------------------------------------
# structural operators T1-T18 (person graph)

@register("graph_counts", Q.with_base(*Q.PERSON_GRAPH, body="""
SELECT (SELECT count(*) FROM V) AS num_vertices, (SELECT count(*) FROM E) AS num_edges"""))
def graph_counts(spark, d):
    return st.counts(person_graph(S(spark, d)))


@register("vertex_filter_count", Q.with_base(*Q.PERSON_GRAPH, body="SELECT count(*) AS cnt FROM V WHERE segment = 'BUILDING'"))
def vertex_filter_count(spark, d):
    v = person_graph(S(spark, d)).vertices
    return v.filter(F.col("segment") == "BUILDING").agg(F.count(F.lit(1)).alias("cnt"))


@register("edge_filter_desc", Q.with_base(*Q.PERSON_GRAPH, body="SELECT src, dst, attr FROM E WHERE src > dst"))
def edge_filter_desc(spark, d):
    return person_graph(S(spark, d)).edges.filter(F.col("src") > F.col("dst"))


@register("edge_filter_asc", Q.with_base(*Q.PERSON_GRAPH, body="SELECT src, dst, attr FROM E WHERE src < dst"))
def edge_filter_asc(spark, d):
    return person_graph(S(spark, d)).edges.filter(F.col("src") < F.col("dst"))


TRIPLETS_SQL = """
SELECT E.src, E.dst, E.attr, s.nation AS src_nation, s.segment AS src_segment,
       t.nation AS dst_nation, t.segment AS dst_segment
FROM E JOIN V s ON s.id = E.src JOIN V t ON t.id = E.dst"""


@register("triplets", Q.with_base(*Q.PERSON_GRAPH, body=TRIPLETS_SQL))
def q_triplets(spark, d):
    return st.triplets(person_graph(S(spark, d)))


@register("triplet_strings", Q.with_base(*Q.PERSON_GRAPH, body=f"""
SELECT src || '-' || src_nation || '-' || src_segment || '-' || dst || '-' || dst_nation || '-' || dst_segment || attr AS s1,
       src || '-(' || src_nation || ',' || src_segment || ')|' || attr || '|' || dst || '-(' || dst_nation || ',' || dst_segment || ')' AS s2
FROM ({TRIPLETS_SQL}) t"""))
def triplet_strings(spark, d):
    trip = st.triplets(person_graph(S(spark, d)))
    return st.triplet_strings(trip, ["src_nation", "src_segment"], ["dst_nation", "dst_segment"], "attr")


@register("triplet_sources", Q.with_base(body=f"SELECT source AS src FROM ({Q.CALL_GRAPH}) c"))
def triplet_sources(spark, d):
    """Louvain stub: call graph edges (attr 11, default 79), label := id, triplet sources."""
    cg = call_graph(S(spark, d))
    g = from_edges(edges_from_pairs(cg, "source", "target", attr=F.lit(11)), 79)
    # each edge has both its ends as vertices, so the triplets' sources are the edges'
    return g.edges.select("src")


@register("degrees", Q.with_base(*Q.PERSON_GRAPH, body="""
SELECT id, count(*) AS degree FROM (SELECT src AS id FROM E UNION ALL SELECT dst FROM E) x GROUP BY id"""))
def q_degrees(spark, d):
    return st.degrees(person_graph(S(spark, d)))


@register("in_degrees", Q.with_base(*Q.PERSON_GRAPH, body="SELECT dst AS id, count(*) AS in_degree FROM E GROUP BY dst"))
def q_in_degrees(spark, d):
    return st.in_degrees(person_graph(S(spark, d)))


@register("out_degrees", Q.with_base(*Q.PERSON_GRAPH, body="SELECT src AS id, count(*) AS out_degree FROM E GROUP BY src"))
def q_out_degrees(spark, d):
    return st.out_degrees(person_graph(S(spark, d)))


SUB_V = "SELECT id, nation, segment FROM V WHERE segment <> 'BUILDING'"


def person_subgraph(src) -> Graph:
    return st.subgraph(person_graph(src), vpred=F.col("segment") != "BUILDING")


@register("subgraph", Q.with_base(*Q.PERSON_GRAPH, body=f"""
SELECT src, dst, attr FROM E WHERE src IN (SELECT id FROM ({SUB_V}) a) AND dst IN (SELECT id FROM ({SUB_V}) b)"""))
def q_subgraph(spark, d):
    return person_subgraph(S(spark, d)).edges


@register("subgraph_vertices", Q.with_base(*Q.PERSON_GRAPH, body=SUB_V))
def q_subgraph_vertices(spark, d):
    return person_subgraph(S(spark, d)).vertices


@register("map_vertices", Q.with_base(*Q.PERSON_GRAPH, body="""
SELECT id, nation || '-1' AS a1, segment || '-2' AS a2 FROM V"""))
def q_map_vertices(spark, d):
    g = st.map_vertices(person_graph(S(spark, d)),
                        a1=F.concat(scala_string("nation"), F.lit("-1")),
                        a2=F.concat(scala_string("segment"), F.lit("-2")))
    return g.vertices


@register("init_labels", Q.with_base(body=f"""
SELECT id, id AS label FROM (SELECT source AS id FROM ({Q.CALL_GRAPH}) a UNION SELECT target FROM ({Q.CALL_GRAPH}) b) v"""))
def q_init_labels(spark, d):
    cg = call_graph(S(spark, d))
    return st.init_labels(from_edges(edges_from_pairs(cg, "source", "target", attr=F.lit(11)), 79))


@register("reverse_edges", Q.with_base(*Q.PERSON_GRAPH, body="SELECT dst AS src, src AS dst, attr FROM E"))
def reverse_edges(spark, d):
    return st.reverse(person_graph(S(spark, d))).edges


@register("mask_cc", Q.with_base(*Q.PERSON_GRAPH, *Q.cc_ctes(), body=f"""
SELECT cc.id, cc.component FROM cc WHERE cc.id IN (SELECT id FROM ({SUB_V}) s)""", recursive=True))
def mask_cc(spark, d):
    src = S(spark, d)
    g = person_graph(src)
    same = Graph(g.vertices, component_edges(src, "link_phone_emergency"))
    cc = Graph(alg.connected_components(same), g.edges)
    return st.mask(cc, person_subgraph(src)).vertices


@register("mask_edges", Q.with_base(*Q.PERSON_GRAPH, body=f"""
SELECT src, dst, attr FROM E WHERE src < dst AND src IN (SELECT id FROM ({SUB_V}) s) AND dst IN (SELECT id FROM ({SUB_V}) t)"""))
def mask_edges(spark, d):
    """The edges of a graph that are also in a subgraph by vertices and edges, with the graph's attributes."""
    g = person_graph(S(spark, d))
    sub = st.subgraph(g, vpred=F.col("segment") != "BUILDING", epred=F.col("src") < F.col("dst"))
    return st.mask(g, sub.with_edges(sub.edges.select("src", "dst"))).edges


@register("outer_join_outdeg", Q.with_base(*Q.PERSON_GRAPH, body="""
SELECT V.id, coalesce(o.n, 0) AS out_degree FROM V LEFT JOIN (SELECT src, count(*) AS n FROM E GROUP BY src) o ON o.src = V.id"""))
def outer_join_outdeg(spark, d):
    g = person_graph(S(spark, d))
    return st.outer_join_vertices(g, st.out_degrees(g), "out_degree", 0)


@register("edge_inv_outdeg", Q.with_base(*Q.PERSON_GRAPH, body="""
SELECT E.src, E.dst, CAST(1.0 AS DOUBLE) / o.n AS weight FROM E JOIN (SELECT src, count(*) AS n FROM E GROUP BY src) o ON o.src = E.src"""))
def edge_inv_outdeg(spark, d):
    return st.edge_inverse_out_degree(person_graph(S(spark, d)))


FLAG_LPA = [*Q.FLAG_GRAPH, *Q.lpa_ctes(10),
            "LN AS (SELECT l.id, l.label AS community, N.end_result, N.overdue FROM labels l JOIN N ON N.id = l.id)"]


@register("community_with_attrs", Q.with_base(*FLAG_LPA, body="SELECT id, community, end_result, overdue FROM LN",
                                              recursive=True))
def community_with_attrs(spark, d):
    return labelled_flags(S(spark, d)).select("id", "community", "end_result", "overdue")


# ---------------------------------------------------------------------------------------
# iterative algorithms A1-A10 (link_device / link_phone / link_phone_emergency)

for _steps in (2, 10, 25, 40):
    register(f"lpa_{_steps}", Q.with_base(*Q.link_graph("link_device"), *Q.lpa_ctes(_steps),
                                          body="SELECT id, label FROM labels", recursive=True))(
        (lambda n: lambda spark, d: alg.label_propagation(link_graph(S(spark, d), "link_device"), n))(_steps))


@register("pregel_min_label", Q.with_base(*Q.link_graph("link_device"), *Q.cc_ctes(),
                                          body="SELECT id, component AS label FROM cc", recursive=True))
def pregel_min_label(spark, d):
    g = link_graph(S(spark, d), "link_device")
    return pregel(g, {"label": F.col("id")}, {"low": F.min("msg")}, {"label": F.least("label", "low")},
                  to_dst=F.col("sender_label"), to_src=F.col("sender_label"), only_active=True)


@register("pregel_max_attr", Q.with_base(*Q.link_graph("link_device"), """
reach(id, val) AS (SELECT id, id FROM V UNION SELECT E.dst, reach.val FROM reach JOIN E ON E.src = reach.id)""",
                                         body="SELECT id, max(val) AS value FROM reach GROUP BY id", recursive=True))
def pregel_max_attr(spark, d):
    g = link_graph(S(spark, d), "link_device")
    return pregel(g, {"value": F.col("id")}, {"high": F.max("msg")}, {"value": F.greatest("value", "high")},
                  to_dst=F.col("sender_value"), only_active=True)


# every 50th person is a start; an edge is 1 to 4 long; no shortest way is longer than the
# bound that ends the SQL recursion (the Spark side has none)
FAR = 400


@register("pregel_weighted_distance", Q.with_base(*Q.link_graph("link_device"), f"""
W AS (SELECT src AS a, dst AS b, 1 + (src + dst) % 4 AS w FROM E UNION SELECT dst, src, 1 + (src + dst) % 4 FROM E),
reach(id, d) AS (SELECT id, 0::BIGINT FROM V WHERE id % 50 = 0 UNION SELECT W.b, reach.d + W.w FROM reach JOIN W ON W.a = reach.id WHERE reach.d + W.w <= {FAR})""",
                                                  body="SELECT id, min(d) AS distance FROM V LEFT JOIN reach USING (id) GROUP BY id", recursive=True))
def pregel_weighted_distance(spark, d):
    """Shortest weighted distance to the nearest start, null where none is reachable."""
    pairs = cut_lineage(links(S(spark, d), "link_device"))
    g = from_edges(edges_from_pairs(pairs, attr=1 + (F.col("src") + F.col("dst")) % 4, attr_name="w"), 1)
    far = F.col("sender_distance") + F.col("w")
    return pregel(g, {"distance": F.when(F.col("id") % 50 == 0, F.lit(0)).cast("bigint")}, {"near": F.min("msg")},
                  {"distance": F.least("distance", "near")}, to_dst=far, to_src=far, only_active=True)


@register("pregel_sum", Q.with_base(*Q.link_graph("link_device"), """
S0 AS (SELECT id, 1::HUGEINT AS v, 0::HUGEINT AS n FROM V),
M1 AS (SELECT dst AS id, sum(v) AS m, count(*) AS c FROM E JOIN S0 ON id = src GROUP BY dst),
S1 AS (SELECT id, coalesce(m, v) AS v, n + coalesce(c, 0) AS n FROM S0 LEFT JOIN M1 USING (id)),
M2 AS (SELECT dst AS id, sum(v) AS m, count(*) AS c FROM E JOIN S1 ON id = src GROUP BY dst),
S2 AS (SELECT id, coalesce(m, v) AS v, n + coalesce(c, 0) AS n FROM S1 LEFT JOIN M2 USING (id)),
M3 AS (SELECT dst AS id, sum(v) AS m, count(*) AS c FROM E JOIN S2 ON id = src GROUP BY dst)""",
                                     body="SELECT id, coalesce(m, v)::BIGINT AS walks, (n + coalesce(c, 0))::BIGINT AS heard FROM S2 LEFT JOIN M3 USING (id)"))
def pregel_sum(spark, d):
    """Three supersteps of sums: two value columns, a merge that is not idempotent."""
    g = link_graph(S(spark, d), "link_device")
    return pregel(g, {"walks": F.lit(1).cast("bigint"), "heard": F.lit(0).cast("bigint")},
                  {"m": F.sum("msg"), "c": F.count("msg")}, {"walks": F.col("m"), "heard": F.col("heard") + F.col("c")},
                  to_dst=F.col("sender_walks"), steps=3)


@register("neighbor_label_votes", Q.with_base(*Q.link_graph("link_device"), body="""
SELECT id, label, count(*) AS votes FROM (SELECT src AS id, dst AS label FROM E UNION ALL SELECT dst, src FROM E) m
GROUP BY id, label"""))
def neighbor_label_votes(spark, d):
    g = link_graph(S(spark, d), "link_device")
    g = g.with_vertices(st.init_labels(g))
    return aggregate_messages(g, to_src=F.col("dst_label"), to_dst=F.col("src_label"), agg=F.count, msg_name="votes", by="label")


@register("connected_components", Q.with_base(*Q.link_graph("link_device"), *Q.cc_ctes(),
                                              body="SELECT id, component FROM cc", recursive=True))
def q_connected_components(spark, d):
    return alg.connected_components(from_edges(component_edges(S(spark, d), "link_device"), 1))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("rank", 6).alias("rank"))


@register("pagerank_tol", Q.with_base(*Q.link_graph("link_phone_emergency"), *Q.pagerank_tol_ctes(0.001, 150),
                                      body="SELECT id, round(rank, 6) AS rank FROM ranks", recursive=True))
def pagerank_tol(spark, d):
    return _rounded(alg.pagerank_until(link_graph(S(spark, d), "link_phone_emergency"), 0.001))


for _iters in (5, 20):
    register(f"pagerank_{_iters}", Q.with_base(*Q.link_graph("link_phone_emergency"), *Q.pagerank_ctes(_iters),
                                               body="SELECT id, round(rank, 6) AS rank FROM ranks", recursive=True))(
        (lambda n: lambda spark, d: _rounded(alg.pagerank(link_graph(S(spark, d), "link_phone_emergency"), n)))(_iters))


@register("triangle_count", Q.with_base(*Q.link_graph("link_phone"), *Q.triangle_ctes(),
                                        body="SELECT id, triangles FROM tc"))
def q_triangle_count(spark, d):
    return alg.triangle_count(link_graph(S(spark, d), "link_phone"))


# ---------------------------------------------------------------------------------------
# metrics M1-M8 (link_phone)

DEG = "DEG AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM E UNION ALL SELECT dst FROM E) x GROUP BY id)"
CLUST = ("SELECT CASE WHEN den = 0 THEN 0.0 ELSE num / den END AS clustering FROM "
         "(SELECT (SELECT coalesce(sum(triangles), 0) FROM tc) AS num, "
         "(SELECT coalesce(sum(n * (n - 1) / 2.0), 0.0) FROM (SELECT dst, count(*) AS n FROM E GROUP BY dst) i) AS den) q")


@register("avg_degree", Q.with_base(*Q.link_graph("link_phone"), DEG, body="""
SELECT CASE WHEN (SELECT count(*) FROM V) = 0 THEN 0.0
            ELSE CAST((SELECT coalesce(sum(degree), 0) FROM DEG) AS DOUBLE) / (SELECT count(*) FROM V) END AS avg_degree"""))
def avg_degree(spark, d):
    return met.avg_degree(link_graph(S(spark, d), "link_phone"))


@register("degree_buckets", Q.with_base(*Q.link_graph("link_phone"), DEG, body="""
SELECT count(*) FILTER (WHERE degree = 1) AS single_neighbor_nodes,
       count(*) FILTER (WHERE degree > 1) AS multi_neighbor_nodes FROM DEG"""))
def degree_buckets(spark, d):
    return met.degree_buckets(link_graph(S(spark, d), "link_phone"))


DENSITY = ("CASE WHEN nv < 2 THEN 0.0 ELSE 2.0 * ne / (CAST(nv AS DOUBLE) * (nv - 1.0)) END")


@register("density", Q.with_base(*Q.link_graph("link_phone"), body=f"""
SELECT {DENSITY} AS density, printf('%.9f', {DENSITY}) AS density_text
FROM (SELECT (SELECT count(*) FROM V) AS nv, (SELECT count(*) FROM E) AS ne) c"""))
def density(spark, d):
    return met.density(link_graph(S(spark, d), "link_phone"))


@register("clustering_in_degree", Q.with_base(*Q.link_graph("link_phone"), *Q.triangle_ctes(), body=CLUST))
def clustering_in_degree(spark, d):
    return met.clustering(link_graph(S(spark, d), "link_phone"))


@register("network_report", Q.with_base(*Q.link_graph("link_phone"), DEG, *Q.triangle_ctes(), body=f"""
SELECT nv AS num_vertices, ne AS num_edges,
       CASE WHEN nv = 0 THEN 0.0 ELSE CAST(dsum AS DOUBLE) / nv END AS avg_degree,
       single_neighbor_nodes, multi_neighbor_nodes,
       printf('%.9f', {DENSITY}) AS density_text,
       (SELECT clustering FROM ({CLUST}) cl) AS clustering
FROM (SELECT (SELECT count(*) FROM V) AS nv, (SELECT count(*) FROM E) AS ne,
             (SELECT coalesce(sum(degree), 0) FROM DEG) AS dsum,
             (SELECT count(*) FROM DEG WHERE degree = 1) AS single_neighbor_nodes,
             (SELECT count(*) FROM DEG WHERE degree > 1) AS multi_neighbor_nodes) c"""))
def network_report(spark, d):
    return met.network_report(link_graph(S(spark, d), "link_phone"))


# ---------------------------------------------------------------------------------------
# community analytics C1-C9

DEVICE_LPA25 = [*Q.link_graph("link_device"), *Q.lpa_ctes(25)]


def device_communities(spark, d) -> DataFrame:
    return alg.label_propagation(link_graph(S(spark, d), "link_device"), 25)


@register("community_members", Q.with_base(*DEVICE_LPA25, body="SELECT label AS community, id AS member FROM labels",
                                           recursive=True))
def community_members(spark, d):
    return com.members(device_communities(spark, d))


@register("community_sizes", Q.with_base(*DEVICE_LPA25, body="SELECT label AS community, count(*) AS size FROM labels GROUP BY label",
                                         recursive=True))
def community_sizes(spark, d):
    return com.sizes(device_communities(spark, d))


RISK = """
SELECT community, count(*) AS size,
       CAST(sum(CASE WHEN end_result = '1' THEN 1 ELSE 0 END) AS BIGINT) AS rejected,
       CAST(sum(CASE WHEN end_result = '0' AND CAST(overdue AS VARCHAR) = '1' THEN 1 ELSE 0 END) AS BIGINT) AS passed_overdue
FROM LN GROUP BY community"""


@register("community_risk", Q.with_base(*FLAG_LPA, body=RISK, recursive=True))
def community_risk(spark, d):
    return com.risk_table(labelled_flags(S(spark, d)))


@register("community_rejected", Q.with_base(*FLAG_LPA, body=f"SELECT community, rejected FROM ({RISK}) r", recursive=True))
def community_rejected(spark, d):
    return com.risk_table(labelled_flags(S(spark, d))).select("community", "rejected")


@register("community_overdue", Q.with_base(*FLAG_LPA, body=f"SELECT community, passed_overdue FROM ({RISK}) r",
                                           recursive=True))
def community_overdue(spark, d):
    return com.risk_table(labelled_flags(S(spark, d))).select("community", "passed_overdue")


REJ_SPARSE = "SELECT community, count(*) AS rejected FROM LN WHERE end_result = '1' GROUP BY community"
OD_SPARSE = ("SELECT community, count(*) AS passed_overdue FROM LN "
             "WHERE end_result = '0' AND CAST(overdue AS VARCHAR) = '1' GROUP BY community")


@register("community_rejected_sparse", Q.with_base(*FLAG_LPA, body=REJ_SPARSE, recursive=True))
def community_rejected_sparse(spark, d):
    return com.rejected_sparse(labelled_flags(S(spark, d)))


@register("community_overdue_sparse", Q.with_base(*FLAG_LPA, body=OD_SPARSE, recursive=True))
def community_overdue_sparse(spark, d):
    return com.overdue_sparse(labelled_flags(S(spark, d)))


@register("community_cogroup", Q.with_base(*FLAG_LPA, body=f"""
SELECT coalesce(s.community, r.community, o.community) AS community,
       coalesce(CAST(s.size AS VARCHAR), '') AS sizes,
       coalesce(CAST(r.rejected AS VARCHAR), '') AS rejected,
       coalesce(CAST(o.passed_overdue AS VARCHAR), '') AS passed_overdue
FROM (SELECT community, count(*) AS size FROM LN GROUP BY community) s
FULL OUTER JOIN ({REJ_SPARSE}) r ON r.community = s.community
FULL OUTER JOIN ({OD_SPARSE}) o ON o.community = coalesce(s.community, r.community)""", recursive=True))
def community_cogroup(spark, d):
    return com.cogroup_counts(labelled_flags(S(spark, d)))


@register("vertex_risk_code", Q.with_base(*FLAG_LPA, body="""
SELECT id, community,
  CASE WHEN end_result = '0' AND CAST(overdue AS VARCHAR) = '1' THEN 11
       WHEN end_result = '0' THEN 22
       WHEN end_result = '1' THEN 33 END AS code
FROM LN""", recursive=True))
def vertex_risk_code(spark, d):
    return com.vertex_risk_codes(labelled_flags(S(spark, d)))


# ---------------------------------------------------------------------------------------
# general relational operators F1-F16

@register("distinct_nodes", Q.with_base(body=f"SELECT count(*) AS cnt FROM ({Q.FLAG_NODES}) n"))
def distinct_nodes(spark, d):
    rows = flag_rows(S(spark, d))
    both = rows.select(F.col("source").alias("id"), F.col("end_result1").alias("end_result"),
                       F.col("overdue1").alias("overdue")).union(
        rows.select("target", "end_result2", "overdue2"))
    return rel.distinct_count(both)


@register("top_triplets", Q.with_base(*DEVICE_LPA25, body="""
SELECT E.src || '-' || a.label || '|' || E.attr || '|' || E.dst || '-' || b.label AS s
FROM (SELECT src, dst, 1 AS attr FROM E) E JOIN labels a ON a.id = E.src JOIN labels b ON b.id = E.dst
ORDER BY s DESC LIMIT 40""", recursive=True))
def top_triplets(spark, d):
    src = S(spark, d)
    g = link_graph(src, "link_device")
    lg = g.with_vertices(alg.label_propagation(g, 25))
    trip = st.triplets(lg)
    s = F.concat(scala_string("src"), F.lit("-"), scala_string("src_label"), F.lit("|"), scala_string("attr"),
                 F.lit("|"), scala_string("dst"), F.lit("-"), scala_string("dst_label"))
    strings = trip.select(s.alias("s"))
    return rel.top(strings, 40, rel.natural_desc(strings))


@register("top_nodes", Q.with_base(body=f"""
SELECT id, end_result, overdue FROM ({Q.FLAG_NODES}) n ORDER BY id DESC, end_result DESC, overdue DESC LIMIT 100"""))
def top_nodes(spark, d):
    nodes = flag_nodes(S(spark, d))
    return rel.top(nodes, 100, rel.natural_desc(nodes))


@register("pagerank_top", Q.with_base(*Q.link_graph("link_phone_emergency"), *Q.pagerank_ctes(20), body="""
SELECT id, round(rank, 6) AS rank FROM ranks ORDER BY round(rank, 6) DESC, id ASC LIMIT 5""", recursive=True))
def pagerank_top(spark, d):
    pr = _rounded(alg.pagerank(link_graph(S(spark, d), "link_phone_emergency"), 20))
    return rel.top(pr, 5, [F.col("rank").desc(), F.col("id").asc()])


@register("cc_top", Q.with_base(*Q.link_graph("link_device"), *Q.cc_ctes(), body="""
SELECT id, component FROM cc ORDER BY component DESC, id ASC LIMIT 5""", recursive=True))
def cc_top(spark, d):
    cc = alg.connected_components(from_edges(component_edges(S(spark, d), "link_device"), 1))
    return rel.top(cc, 5, [F.col("component").desc(), F.col("id").asc()])


@register("triangle_top", Q.with_base(*Q.link_graph("link_phone"), *Q.triangle_ctes(), body="""
SELECT id, triangles FROM tc ORDER BY triangles DESC, id ASC LIMIT 5"""))
def triangle_top(spark, d):
    tc = alg.triangle_count(link_graph(S(spark, d), "link_phone"))
    return rel.top(tc, 5, [F.col("triangles").desc(), F.col("id").asc()])


EDGE_LIMIT = 40


@register("edge_limit", Q.with_base(body=f"""
SELECT src, dst, 1 AS attr FROM ({Q.link_sql('link_device')}) l ORDER BY src, dst LIMIT {EDGE_LIMIT}"""))
def edge_limit(spark, d):
    e = link_graph(S(spark, d), "link_device").edges
    return rel.top(e, EDGE_LIMIT, [F.col("src").asc(), F.col("dst").asc()])


@register("endpoint_union", Q.with_base(body=f"""
SELECT source AS id FROM ({Q.CALL_GRAPH}) a UNION ALL SELECT target FROM ({Q.CALL_GRAPH}) b"""))
def endpoint_union(spark, d):
    return call_graph(S(spark, d)).select(F.explode(F.array("source", "target")).alias("id"))


@register("complement", Q.with_base(DOC_LINES, body="""
SELECT value FROM doc_lines WHERE value NOT IN (SELECT value FROM doc_lines WHERE lang = 'en')"""))
def complement(spark, d):
    docs = S(spark, d).table("documents")
    all_lines = text_lines(docs)
    en_lines = text_lines(docs.filter(F.col("lang") == "en"))
    return rel.complement(all_lines, en_lines, "value")


@register("partition_filter", Q.with_base(body="SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING'"))
def partition_filter(spark, d):
    pairs = S(spark, d).table("customer").select("c_name", "c_mktsegment")
    return rel.partition_filter(pairs, "c_name", "c_mktsegment", "BUILDING")

