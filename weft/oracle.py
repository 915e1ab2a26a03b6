"""Independent ANSI-SQL (DuckDB) formulations of every catalog query.

Each statement reads only the driver's tables (pre-registered views) and re-derives
the property graph with plain SQL, so it shares no code path with the Spark side.
Iterative algorithms use recursive CTEs.
"""

from __future__ import annotations

BASE = """
applications AS (
  SELECT o_orderkey AS app, o_custkey AS person,
    CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '0' WHEN 'P' THEN '2' END AS end_result,
    CASE WHEN o_orderpriority = '1-URGENT' THEN '1' ELSE '0' END AS dpd7,
    CASE WHEN o_orderpriority = '2-HIGH' THEN '1' ELSE '0' END AS dpd15,
    '0' AS dpd30,
    CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE '0' END AS dpd90,
    o_orderdate AS created
  FROM orders),
owns AS (
  SELECT DISTINCT rel_type, app, attr_key FROM (
    SELECT 'HasDeviceAddress' AS rel_type, l_orderkey AS app,
           'dev|' || l_partkey || '|' || strftime(l_shipdate, '%Y-%m-%d') AS attr_key FROM lineitem
    UNION ALL SELECT 'HasIP', l_orderkey, 'ip|' || l_partkey || '|' || l_suppkey FROM lineitem
    UNION ALL SELECT 'HasCompanyName', l_orderkey, 'co|' || l_suppkey || '|' || strftime(l_shipdate, '%Y-%m-%d') FROM lineitem
    UNION ALL SELECT CASE l_returnflag WHEN 'N' THEN 'HasHomeAddress' WHEN 'R' THEN 'HasApplyAddress'
                                       WHEN 'A' THEN 'HasCompanyAddress' END,
                     l_orderkey, 'addr|' || l_partkey || '|' || CAST(trunc(l_quantity) AS INTEGER) FROM lineitem
    UNION ALL SELECT CASE l_returnflag WHEN 'N' THEN 'HasPhone' WHEN 'R' THEN 'HasEmergencyPhone'
                                       WHEN 'A' THEN 'HasContact' END,
                     l_orderkey, 'ph|' || l_partkey || '|' || strftime(l_shipdate, '%Y-%m') FROM lineitem
  ) t WHERE rel_type IS NOT NULL),
has_id_card AS (SELECT app, person FROM applications),
pa AS (SELECT DISTINCT h.person, o.rel_type, o.attr_key FROM owns o JOIN has_id_card h ON o.app = h.app),
ph AS (SELECT app, attr_key FROM owns WHERE rel_type = 'HasPhone'),
calls AS (
  SELECT a.attr_key AS src, b.attr_key AS dst, count(*) AS call_cnt
  FROM ph a JOIN ph b ON a.app = b.app AND a.attr_key < b.attr_key
  GROUP BY a.attr_key, b.attr_key),
uc AS (SELECT src AS a, dst AS b, call_cnt AS weight FROM calls
       UNION ALL SELECT dst, src, call_cnt FROM calls WHERE src <> dst),
persons AS (SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment FROM customer)
"""


# One statement per pattern, written out: nothing here comes from the code under test.
LINKS = {
    "link_device": """SELECT a.person AS src, b.person AS dst FROM pa a JOIN pa b ON a.attr_key = b.attr_key
      WHERE a.rel_type = 'HasDeviceAddress' AND b.rel_type = 'HasDeviceAddress' AND a.person > b.person""",
    "link_ip": """SELECT a.person AS src, b.person AS dst FROM pa a JOIN pa b ON a.attr_key = b.attr_key
      WHERE a.rel_type = 'HasIP' AND b.rel_type = 'HasIP' AND a.person > b.person""",
    "link_company": """SELECT a.person AS src, b.person AS dst FROM pa a JOIN pa b ON a.attr_key = b.attr_key
      WHERE a.rel_type = 'HasCompanyName' AND b.rel_type = 'HasCompanyName' AND a.person > b.person""",
    "link_address": """SELECT a.person AS src, b.person AS dst FROM pa a JOIN pa b ON a.attr_key = b.attr_key
      WHERE a.rel_type IN ('HasHomeAddress', 'HasApplyAddress', 'HasCompanyAddress') AND b.rel_type IN ('HasHomeAddress', 'HasApplyAddress', 'HasCompanyAddress') AND a.person > b.person""",
    "link_phone": """SELECT a.person AS src, b.person AS dst FROM pa a JOIN pa b ON a.attr_key = b.attr_key
      WHERE a.rel_type = 'HasPhone' AND b.rel_type = 'HasPhone' AND a.person > b.person""",
    "link_emergency": """SELECT a.person AS src, b.person AS dst FROM pa a JOIN pa b ON a.attr_key = b.attr_key
      WHERE a.rel_type = 'HasEmergencyPhone' AND b.rel_type = 'HasEmergencyPhone' AND a.person > b.person""",
    "link_phone_emergency": """SELECT a.person AS src, b.person AS dst FROM pa a JOIN pa b ON a.attr_key = b.attr_key
      WHERE a.rel_type = 'HasPhone' AND b.rel_type = 'HasEmergencyPhone' AND a.person <> b.person""",
    "link_phone_contact": """SELECT a.person AS src, b.person AS dst FROM pa a JOIN pa b ON a.attr_key = b.attr_key
      WHERE a.rel_type = 'HasPhone' AND b.rel_type = 'HasContact' AND a.person <> b.person""",
    "link_phone_call": """SELECT a.person AS src, b.person AS dst FROM pa a JOIN calls c ON c.dst = a.attr_key JOIN pa b ON b.attr_key = c.src
      WHERE a.rel_type = 'HasPhone' AND b.rel_type = 'HasPhone' AND a.person <> b.person""",
    "link_emergency_contact": """SELECT a.person AS src, b.person AS dst FROM pa a JOIN pa b ON a.attr_key = b.attr_key
      WHERE a.rel_type = 'HasEmergencyPhone' AND b.rel_type = 'HasContact' AND a.person <> b.person""",
    "link_emergency_call": """SELECT a.person AS src, b.person AS dst FROM pa a JOIN calls c ON c.dst = a.attr_key JOIN pa b ON b.attr_key = c.src
      WHERE a.rel_type = 'HasEmergencyPhone' AND b.rel_type = 'HasPhone' AND a.person <> b.person""",
    "link_call_emergency_fwd": """SELECT a.person AS src, b.person AS dst FROM pa a JOIN calls c ON c.src = a.attr_key JOIN pa b ON b.attr_key = c.dst
      WHERE a.rel_type = 'HasPhone' AND b.rel_type = 'HasEmergencyPhone' AND a.person <> b.person""",
    "link_call_phone_fwd": """SELECT a.person AS src, b.person AS dst FROM pa a JOIN calls c ON c.src = a.attr_key JOIN pa b ON b.attr_key = c.dst
      WHERE a.rel_type = 'HasPhone' AND b.rel_type = 'HasPhone' AND a.person <> b.person""",
    "link_contact_emergency": """SELECT a.person AS src, b.person AS dst FROM pa a JOIN pa b ON a.attr_key = b.attr_key
      WHERE a.rel_type = 'HasContact' AND b.rel_type = 'HasEmergencyPhone' AND a.person <> b.person""",
    "link_device_both": """SELECT a.person AS src, b.person AS dst FROM pa a JOIN pa b ON a.attr_key = b.attr_key
      WHERE a.rel_type = 'HasDeviceAddress' AND b.rel_type = 'HasDeviceAddress' AND a.person <> b.person""",
    "link_phone_both": """SELECT a.person AS src, b.person AS dst FROM pa a JOIN pa b ON a.attr_key = b.attr_key
      WHERE a.rel_type = 'HasPhone' AND b.rel_type = 'HasPhone' AND a.person <> b.person""",
    "link_emergency_both": """SELECT a.person AS src, b.person AS dst FROM pa a JOIN pa b ON a.attr_key = b.attr_key
      WHERE a.rel_type = 'HasEmergencyPhone' AND b.rel_type = 'HasEmergencyPhone' AND a.person <> b.person""",
}
SOCIAL = {
    "social_net_11": ["link_device", "link_ip", "link_company", "link_address", "link_phone", "link_emergency", "link_phone_emergency",
                      "link_phone_contact", "link_phone_call", "link_emergency_contact", "link_emergency_call"],
    "social_net_6": ["link_device", "link_ip", "link_address", "link_phone", "link_emergency", "link_phone_emergency"],
    "social_net_7": ["link_phone_both", "link_emergency_both", "link_phone_emergency", "link_contact_emergency",
                     "link_call_emergency_fwd", "link_phone_contact", "link_call_phone_fwd"],
}


def link_sql(name: str) -> str:
    """Distinct ``(src, dst)`` of one pattern or union, as a sub-select."""
    if name in SOCIAL:
        return " UNION ".join(f"({LINKS[m]})" for m in SOCIAL[name])
    return f"SELECT DISTINCT src, dst FROM ({LINKS[name]}) x"


CALL_GRAPH = """
SELECT p1.app AS source, p2.app AS target, uc.weight
FROM ph p1 JOIN uc ON uc.a = p1.attr_key JOIN ph p2 ON p2.attr_key = uc.b
WHERE NOT (p1.app = p2.app AND uc.a = uc.b)
"""

OVERDUE = ("CASE WHEN ({p}.dpd7 = '1' OR {p}.dpd15 = '1' OR {p}.dpd30 = '1' OR {p}.dpd90 = '1') "
           "THEN 1 ELSE 0 END")

CALL_GRAPH_FLAGS = f"""
SELECT cg.source, cg.target, cg.weight,
       a1.end_result AS end_result1, {OVERDUE.format(p='a1')} AS overdue1,
       a2.end_result AS end_result2, {OVERDUE.format(p='a2')} AS overdue2
FROM ({CALL_GRAPH}) cg JOIN applications a1 ON a1.app = cg.source JOIN applications a2 ON a2.app = cg.target
"""

CALL_GRAPH_WIDE = f"""
SELECT cg.source, cg.target, cg.weight,
       a1.end_result AS end_result1, a1.dpd7 AS dpd71, a1.dpd15 AS dpd151, a1.dpd30 AS dpd301, a1.dpd90 AS dpd901,
       a2.end_result AS end_result2, a2.dpd7 AS dpd72, a2.dpd15 AS dpd152, a2.dpd30 AS dpd302, a2.dpd90 AS dpd902
FROM ({CALL_GRAPH}) cg JOIN applications a1 ON a1.app = cg.source JOIN applications a2 ON a2.app = cg.target
"""

FLAG_NODES = f"""
SELECT DISTINCT id, end_result, overdue FROM (
  SELECT source AS id, end_result1 AS end_result, overdue1 AS overdue FROM ({CALL_GRAPH_FLAGS}) f
  UNION ALL SELECT target, end_result2, overdue2 FROM ({CALL_GRAPH_FLAGS}) g) n
"""


def with_base(*ctes: str, body: str, recursive: bool = False) -> str:
    parts = [BASE.strip()] + [c.strip() for c in ctes]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + body


# -- graph algorithms over named CTEs E(src, dst) and V(id) ---------------------------------

def lpa_ctes(steps: int) -> list[str]:
    return [
        "adj AS (SELECT src AS me, dst AS nbr FROM E UNION ALL SELECT dst AS me, src AS nbr FROM E)",
        f"""lp(it, id, label) AS (
  SELECT 0, me, me FROM (SELECT DISTINCT me FROM adj) s
  UNION ALL
  SELECT it + 1, id, label FROM (
    SELECT it, id, label, row_number() OVER (PARTITION BY id ORDER BY votes DESC, label ASC) AS rn FROM (
      SELECT l.it, a.me AS id, l.label, count(*) AS votes FROM lp l JOIN adj a ON a.nbr = l.id
      WHERE l.it < {steps} GROUP BY l.it, a.me, l.label) v) r
  WHERE rn = 1)""",
        f"""labels AS (SELECT id, label FROM lp WHERE it = {steps}
  UNION ALL SELECT id, id FROM V WHERE id NOT IN (SELECT me FROM adj))""",
    ]


def cc_ctes() -> list[str]:
    return [
        "ue AS (SELECT src AS a, dst AS b FROM E WHERE src <> dst UNION SELECT dst, src FROM E WHERE src <> dst)",
        "reach(id, comp) AS (SELECT id, id FROM V UNION SELECT ue.b, reach.comp FROM reach JOIN ue ON ue.a = reach.id)",
        "cc AS (SELECT id, min(comp) AS component FROM reach GROUP BY id)",
    ]


def pagerank_ctes(iters: int) -> list[str]:
    return [
        "od AS (SELECT src, count(*) AS deg FROM E GROUP BY src)",
        """w0 AS (SELECT e.src, e.dst, CAST(count(*) AS DOUBLE) / any_value(od.deg) AS w
         FROM E e JOIN od ON od.src = e.src GROUP BY e.src, e.dst
         UNION ALL SELECT id, id, 0.0 FROM V)""",
        f"""pr(it, id, rank) AS (
  SELECT 0, id, CAST(1.0 AS DOUBLE) FROM V
  UNION ALL
  SELECT p.it + 1, w0.dst, 0.15 + 0.85 * sum(p.rank * w0.w) FROM pr p JOIN w0 ON w0.src = p.id
  WHERE p.it < {iters} GROUP BY p.it, w0.dst)""",
        f"""ranks AS (SELECT id, rank * (SELECT count(*) FROM V) / (SELECT sum(rank) FROM pr WHERE it = {iters}) AS rank
         FROM pr WHERE it = {iters})""",
    ]


def pagerank_tol_ctes(tol: float, rounds: int) -> list[str]:
    """Delta PageRank run for ``rounds`` rounds, more than it takes: at the fixpoint no vertex
    sends, so further rounds change nothing (``open`` counts the senders that are left)."""
    return [
        "od AS (SELECT src, count(*) AS deg FROM E GROUP BY src)",
        """w0 AS (SELECT e.src, e.dst, CAST(count(*) AS DOUBLE) / any_value(od.deg) AS w
         FROM E e JOIN od ON od.src = e.src GROUP BY e.src, e.dst
         UNION ALL SELECT id, id, NULL FROM V)""",
        f"""pt(it, id, rank, delta, active) AS (
  SELECT 0, id, CAST(0.15 AS DOUBLE), CAST(0.15 AS DOUBLE), true FROM V
  UNION ALL
  SELECT it + 1, id, max(keep_rank) + 0.85 * coalesce(sum(m), 0), coalesce(0.85 * sum(m), max(keep_delta)), count(m) > 0 FROM (
    SELECT p.it, w0.dst AS id, CASE WHEN w0.w IS NULL THEN p.rank END AS keep_rank, CASE WHEN w0.w IS NULL THEN p.delta END AS keep_delta,
           CASE WHEN p.active AND p.delta > {tol} THEN p.delta * w0.w END AS m
    FROM pt p JOIN w0 ON w0.src = p.id WHERE p.it < {rounds}) x GROUP BY it, id)""",
        f"open_left AS (SELECT count(*) AS n FROM pt WHERE it = {rounds} AND active AND delta > {tol})",
        f"""ranks AS (SELECT id, rank * (SELECT count(*) FROM V) / (SELECT sum(rank) FROM pt WHERE it = {rounds}) AS rank
         FROM pt WHERE it = {rounds} AND (SELECT n FROM open_left) = 0)""",
    ]


def triangle_ctes() -> list[str]:
    return [
        "ce AS (SELECT DISTINCT least(src, dst) AS lo, greatest(src, dst) AS hi FROM E WHERE src <> dst)",
        """tri AS (SELECT a.lo AS x, a.hi AS y, b.hi AS z FROM ce a JOIN ce b ON a.lo = b.lo AND a.hi < b.hi
         JOIN ce c ON c.lo = a.hi AND c.hi = b.hi)""",
        """tc AS (SELECT V.id, CAST(coalesce(t.n, 0) AS BIGINT) AS triangles FROM V LEFT JOIN (
           SELECT id, count(*) AS n FROM (SELECT x AS id FROM tri UNION ALL SELECT y FROM tri
                                          UNION ALL SELECT z FROM tri) c GROUP BY id) t ON t.id = V.id)""",
    ]


def link_graph(name: str) -> list[str]:
    return [f"E AS ({link_sql(name)})", "V AS (SELECT src AS id FROM E UNION SELECT dst FROM E)"]


PERSON_GRAPH = [
    f"E AS (SELECT src, dst, 1 AS attr FROM ({link_sql('link_phone_emergency')}) l)",
    """V AS (SELECT id, nation, segment FROM persons
         UNION ALL SELECT id, 2, '2' FROM (SELECT src AS id FROM E UNION SELECT dst FROM E) m
         WHERE id NOT IN (SELECT id FROM persons))""",
]

FLAG_GRAPH = [
    f"N AS ({FLAG_NODES})",
    f"E AS (SELECT source AS src, target AS dst, CAST(weight AS VARCHAR) AS attr FROM ({CALL_GRAPH}) cg)",
    "V AS (SELECT id FROM N UNION SELECT src FROM E UNION SELECT dst FROM E)",
]
