"""Graph pattern matching over the relationship tables, as DataFrame joins.

No query text is parsed: each pattern of the reference is an instance of a few path
shapes, expressed as options of the builders below.

* ``shared_attribute_links`` — person <- app -[A]-> attribute <-[B]- app -> person,
  for any number of (A, B, id predicate) *rules at once*: one skew-salted self-join on
  the attribute key serves a whole union of such patterns (the attribute keys of the
  different node kinds never collide, so the rules only decide which type pairs and
  which id predicate are kept, inside the join).
* ``call_links`` — person <- app -[A]-> phone <-HasCall- phone <-[B]- app -> person
  (``direction='in'``) or with the call edge pointing forward (``direction='out'``).
* ``call_graph`` — application -HasPhone-> phone -HasCall- phone <-HasPhone- application
  with the call edge undirected, as a bag (no distinct), optionally carrying the
  applications' attributes.

Relationship uniqueness within one match (openCypher) never removes a row of a link pattern:
two relationships of one path can only coincide when the two applications coincide, which the
person inequality excludes.  The call graph has no such inequality: when a phone calls itself,
an application would be paired with itself through one ownership used twice, and that row is
left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.columns import overdue_flag
from weft.operators.skew import hot_keys, salted_join, skew_settings
from weft.plans.iterate import cut_lineage, written
from weft.sources.tables import ADDRESS_TYPES, FAMILY_CODE, FAMILY_OF, KEY_COLS, PropertyGraphSource

DEV, IP, CO = ("HasDeviceAddress",), ("HasIP",), ("HasCompanyName",)
PHONE, EMERG, CONTACT = ("HasPhone",), ("HasEmergencyPhone",), ("HasContact",)


@dataclass(frozen=True)
class LinkRule:
    """(P1) <- app -[left types]-> node <-[right types]- app -> (P2) where id(P1) <op> id(P2)."""
    left: tuple[str, ...]
    right: tuple[str, ...]
    op: str = ">"          # ">" keeps one orientation, "<>" keeps both


@dataclass(frozen=True)
class CallRule:
    """(P1) <- app -[left]-> phone <-HasCall- phone <-[right]- app -> (P2) for ``in``;
    (P1) <- app -[left]-> phone -HasCall-> phone <-[right]- app -> (P2) for ``out``."""
    left: str
    right: str
    direction: str = "in"
    op: str = "<>"


# R1-R8, R10, R14, R18 and R5/R6 with both orientations (used by the 7-way union)
LINK_RULES = {
    "link_device": LinkRule(DEV, DEV, ">"),
    "link_ip": LinkRule(IP, IP, ">"),
    "link_company": LinkRule(CO, CO, ">"),
    "link_address": LinkRule(ADDRESS_TYPES, ADDRESS_TYPES, ">"),
    "link_phone": LinkRule(PHONE, PHONE, ">"),
    "link_emergency": LinkRule(EMERG, EMERG, ">"),
    "link_phone_emergency": LinkRule(PHONE, EMERG, "<>"),
    "link_phone_contact": LinkRule(PHONE, CONTACT, "<>"),
    "link_emergency_contact": LinkRule(EMERG, CONTACT, "<>"),
    "link_contact_emergency": LinkRule(CONTACT, EMERG, "<>"),
    "link_device_both": LinkRule(DEV, DEV, "<>"),
    "link_phone_both": LinkRule(PHONE, PHONE, "<>"),
    "link_emergency_both": LinkRule(EMERG, EMERG, "<>"),
}

# R9, R11, R12, R13
CALL_RULES = {
    "link_phone_call": CallRule("HasPhone", "HasPhone", "in"),
    "link_emergency_call": CallRule("HasEmergencyPhone", "HasPhone", "in"),
    "link_call_emergency_fwd": CallRule("HasPhone", "HasEmergencyPhone", "out"),
    "link_call_phone_fwd": CallRule("HasPhone", "HasPhone", "out"),
}

# Unions (set semantics) of the patterns above
UNIONS = {
    "social_net_11": ["link_device", "link_ip", "link_company", "link_address", "link_phone", "link_emergency",
                      "link_phone_emergency", "link_phone_contact", "link_phone_call", "link_emergency_contact",
                      "link_emergency_call"],
    "social_net_6": ["link_device", "link_ip", "link_address", "link_phone", "link_emergency",
                     "link_phone_emergency"],
    "social_net_7": ["link_phone_both", "link_emergency_both", "link_phone_emergency", "link_contact_emergency",
                     "link_call_emergency_fwd", "link_phone_contact", "link_call_phone_fwd"],
}


def _compare(op: str, a: Column, b: Column) -> Column:
    if op == ">":
        return a > b
    if op == "<>":
        return a != b
    raise ValueError(f"unsupported id predicate {op!r}")


def _superset(src: PropertyGraphSource, kind: str, rel_types: tuple[str, ...]) -> DataFrame | None:
    """A memoised table of at least the given types, reduced to them."""
    for key, df in src._memo.items():
        if key[0] == kind and set(rel_types) <= set(key[1]):
            return df.filter(F.col("rel_type").isin(*rel_types)) if set(rel_types) != set(key[1]) else df
    return None


def person_rows(src: PropertyGraphSource, rel_types) -> DataFrame:
    """``(person, rel_type, fam, k1, k2)``: attribute nodes reached by a person through one of
    the given relationship types, as generated (a bag).  Written once; queries over a union of
    patterns share one copy."""
    rel_types = tuple(sorted(set(rel_types)))
    rows = _superset(src, "rows", rel_types)
    if rows is None:
        rows = src._memo[("rows", rel_types)] = written(src.owned_by_persons(rel_types), "person-rows")
    return rows


def person_rel_attr(src: PropertyGraphSource, rel_types) -> DataFrame:
    """``person_rows`` as a set, written once to the shared checkpoint folder (exact: two
    different persons always mean two different applications, so person-level sets lose no
    match)."""
    rel_types = tuple(sorted(set(rel_types)))
    pra = _superset(src, "pra", rel_types)
    if pra is None:
        rows = _superset(src, "rows", rel_types)
        rows = src.owned_by_persons(rel_types) if rows is None else rows
        pra = src._memo[("pra", rel_types)] = cut_lineage(rows.distinct())
    return pra


def met_rows(src: PropertyGraphSource, rel_types, rules: list[LinkRule] | None = None) -> DataFrame:
    """``(person, rel_type, fam, k1, k2)`` as a set, of the nodes that two persons or more hold (with
    ``rules``: through both sides of one of them): no other node links anybody.

    Of one family, the nodes that two applications hold are found first, and their rows alone meet
    the id cards; a node of one person may then be left, which links nobody either.  Where an
    application has several persons, or a lineitem row gives a row per family, the persons come first.

    Rows are shuffled once, to their node, as fixed-width numbers, and judged there in one sort.
    The hub nodes' rows are left where they are: a row per hub says whether it links."""
    rel_types = tuple(sorted(set(rel_types)))
    families = {FAMILY_OF[t] for t in rel_types}
    if len(families) == 1 and _superset(src, "rows", rel_types) is None and src.one_person_each():
        rows, holder = src.owns(rel_types, distinct=False), "app"
    else:
        rows, holder = person_rows(src, rel_types), "person"
    bit = {t: 1 << i for i, t in enumerate(rel_types)}
    keys = KEY_COLS if len(families) > 1 else [c for c in KEY_COLS if c != "fam"]
    names = [holder, "_type", *keys]
    rows = rows.withColumn("_type", _mapped("rel_type", bit)).filter(" AND ".join(f"{k} IS NOT NULL" for k in keys)).select(*names)
    seen = {"_low": F.min(holder), "_high": F.max(holder)}
    links_some = F.col("_low") < F.col("_high")
    if rules and any(set(r.left) != set(r.right) for r in rules):
        seen["_types"] = F.bit_or("_type")
        has = lambda types: F.col("_types").bitwiseAND(F.lit(sum(bit[t] for t in set(types)))) != 0
        links_some = links_some & reduce(lambda a, b: a | b, [has(r.left) & has(r.right) for r in rules])

    def of_linking_nodes(rows: DataFrame) -> DataFrame:
        node = Window.partitionBy(*keys)
        return rows.select(*names, *[c.over(node).alias(n) for n, c in seen.items()]).filter(links_some).select(*names)

    hot = hot_keys(rows, None, keys, *skew_settings(src.spark))
    if hot is None:
        met = of_linking_nodes(rows)
    else:
        hot = F.broadcast(hot.select(*keys))  # fewer than max_hot rows
        hubs = rows.join(hot, keys, "left_semi")
        linking = F.broadcast(hubs.groupBy(*keys).agg(*[c.alias(n) for n, c in seen.items()]).filter(links_some).select(*keys))
        met = of_linking_nodes(rows.join(hot, keys, "left_anti")).unionByName(hubs.join(linking, keys, "left_semi").select(*names))
    if holder == "app":
        met = met.join(src.has_id_card(), "app")
    met = cut_lineage(met.select("person", "_type", *keys).distinct())
    fam = F.col("fam") if len(families) > 1 else F.lit(FAMILY_CODE[min(families)])
    return met.select("person", _mapped("_type", {b: t for t, b in bit.items()}).alias("rel_type"), fam.alias("fam"), "k1", "k2")


def _mapped(col: str, values: dict) -> Column:
    """The value for each of the given ones of a column, as a CASE."""
    return reduce(lambda c, kv: c.when(F.col(col) == kv[0], kv[1]), values.items(), F)


def shared_attribute_links(src: PropertyGraphSource, rules: list[LinkRule], distinct: bool = True) -> DataFrame:
    """Person pairs ``(src, dst)`` linked by a shared attribute node under any of ``rules``."""
    types = sorted({t for r in rules for t in r.left + r.right})
    pra = met_rows(src, types, rules)

    def side(name: str, of) -> tuple[DataFrame, DataFrame]:
        # one row per rule that the row's type can serve on this side: rows of types that
        # no rule puts together never meet
        numbers = reduce(lambda a, b: F.concat(a, b), [
            F.when(F.col("rel_type").isin(*of(r)), F.array(F.lit(i))).otherwise(F.array().cast("array<int>")) for i, r in enumerate(rules)])
        rows = pra.select(F.col("person").alias(name), F.explode(numbers).alias("rule"), *KEY_COLS)
        # rows of a set stay one if no rule takes several types; hot keys are counted without the shuffle
        return (rows.distinct() if any(len(of(r)) > 1 for r in rules) else rows), rows

    def keep(L, R):
        ordered = [i for i, r in enumerate(rules) if r.op == ">"]
        differ = [i for i, r in enumerate(rules) if r.op == "<>"]
        if not differ:
            return L("src") > R("dst")
        return (L("src") > R("dst")) | (L("rule").isin(*differ) & (L("src") != R("dst"))) if ordered else L("src") != R("dst")

    for r in rules:
        _compare(r.op, F.lit(1), F.lit(1))  # an unknown predicate raises here
    (left, all_left), (right, all_right) = side("src", lambda r: r.left), side("dst", lambda r: r.right)
    pairs = salted_join(left, right, ["rule", *KEY_COLS], condition=keep, count_left=all_left, count_right=all_right)
    out = pairs.select("src", "dst")
    return out.distinct() if distinct else out


def component_edges(src: PropertyGraphSource, name: str) -> DataFrame:
    """Edges ``(src, dst)`` with the vertices and connected components of a shared-attribute
    pattern, but one per person and attribute instead of one per pair of persons.

    All persons that meet on an attribute node (some through a left type, some through a right
    one, two at least) are connected there, so a star from the smallest of them will do."""
    rule = LINK_RULES[name]
    pra = person_rel_attr(src, sorted(set(rule.left + rule.right)))
    low = pra.groupBy(*KEY_COLS).agg(
        F.min("person").alias("src"), F.max("person").alias("_high"),
        F.bool_or(F.col("rel_type").isin(*rule.left)).alias("_l"), F.bool_or(F.col("rel_type").isin(*rule.right)).alias("_r"))
    low = cut_lineage(low.filter("_l AND _r AND src < _high").select(*KEY_COLS, "src"))
    held = pra.select(F.col("person").alias("dst"), *KEY_COLS)
    return salted_join(held, low, KEY_COLS, condition=lambda L, R: L("dst") != R("src")).select("src", "dst").distinct()


def call_links(src: PropertyGraphSource, rule: CallRule, distinct: bool = True) -> DataFrame:
    """Person pairs ``(src, dst)`` tied through a directed phone call."""
    pra = person_rel_attr(src, sorted({rule.left, rule.right}))
    calls = src.calls()
    near, far = ("dst", "src") if rule.direction == "in" else ("src", "dst")
    memo = ("hop", rule.left, rule.direction)
    if memo not in src._memo:
        left = pra.filter(F.col("rel_type") == rule.left).select(F.col("person").alias("src"), "k1", "k2")
        # person -> own phone -> the phone at the other end of the call: a set before the next
        # hop, written once (its keys are counted, and several patterns start with it)
        step = calls.select(F.col(f"{near}_k1").alias("k1"), F.col(f"{near}_k2").alias("k2"),
                            F.col(f"{far}_k1").alias("o1"), F.col(f"{far}_k2").alias("o2"))
        src._memo[memo] = cut_lineage(salted_join(left, step, ["k1", "k2"])
                                      .select("src", F.col("o1").alias("k1"), F.col("o2").alias("k2")).distinct())
    hop = src._memo[memo]
    right = pra.filter(F.col("rel_type") == rule.right).select(F.col("person").alias("dst"), "k1", "k2")
    pairs = salted_join(right, hop, ["k1", "k2"], condition=lambda L, R: _compare(rule.op, R("src"), L("dst")))
    out = pairs.select("src", "dst")
    return out.distinct() if distinct else out


def links(src: PropertyGraphSource, name: str) -> DataFrame:
    """One named link pattern (``link_*``) or union (``social_net_*``) as distinct ``(src, dst)``."""
    if name in UNIONS:
        members = UNIONS[name]
        types = set()
        for m in members:
            r = LINK_RULES.get(m) or CALL_RULES[m]
            types |= set(r.left if isinstance(r, LinkRule) else (r.left,))
            types |= set(r.right if isinstance(r, LinkRule) else (r.right,))
        person_rows(src, types)              # one written input for every branch
        calls = [CALL_RULES[m] for m in members if m in CALL_RULES]
        if calls:
            person_rel_attr(src, {t for r in calls for t in (r.left, r.right)})
        attr_rules = [LINK_RULES[m] for m in members if m in LINK_RULES]
        parts = []
        if attr_rules:
            parts.append(shared_attribute_links(src, attr_rules, distinct=False))
        parts += [call_links(src, CALL_RULES[m], distinct=False) for m in members if m in CALL_RULES]
        return reduce(DataFrame.union, parts).distinct()
    if name in LINK_RULES:
        return shared_attribute_links(src, [LINK_RULES[name]])
    if name in CALL_RULES:
        return call_links(src, CALL_RULES[name])
    raise KeyError(name)


# ---------------------------------------------------------------------------------------
# application call graph

APP_ATTRS = ["end_result", "dpd7", "dpd15", "dpd30", "dpd90"]


def undirected_calls(src: PropertyGraphSource) -> DataFrame:
    """Both orientations of every call edge ``(a1, a2, b1, b2, weight)`` (phone a to
    phone b); a self-loop only once."""
    here = F.struct(F.col("src_k1").alias("a1"), F.col("src_k2").alias("a2"), F.col("dst_k1").alias("b1"),
                    F.col("dst_k2").alias("b2"), F.col("call_cnt").alias("weight"))
    there = F.struct(F.col("dst_k1").alias("a1"), F.col("dst_k2").alias("a2"), F.col("src_k1").alias("b1"),
                     F.col("src_k2").alias("b2"), F.col("call_cnt").alias("weight"))
    loop = (F.col("src_k1") == F.col("dst_k1")) & (F.col("src_k2") == F.col("dst_k2"))
    return src.calls().select(F.inline(F.when(loop, F.array(here)).otherwise(F.array(here, there))))


def call_graph(src: PropertyGraphSource, attrs: list[str] | None = None, flags: bool = False) -> DataFrame:
    """Bag of ``(source, target, weight[, attrs of both ends])`` application pairs whose
    phones are connected by a call (either direction).

    ``attrs``: application columns to carry, suffixed ``1`` for the source and ``2`` for
    the target; ``flags``: carry ``end_result`` and the overdue flag instead.
    Attributes are attached to the (smaller) phone-ownership table *before* the two
    path joins, so the bag result itself is never shuffled for them."""
    phones = owned = src.phones_of_apps("HasPhone")
    if flags or attrs:
        apps = src.applications()
        extra = []
        if flags:
            extra = [F.col("end_result"), overdue_flag(*APP_ATTRS[1:]).alias("overdue")]
        else:
            extra = [F.col(a) for a in attrs]
        phones = phones.join(apps.select(F.col("app"), *extra), "app")
    names = [c for c in phones.columns if c not in ("app", "k1", "k2")]
    near = phones.select(F.col("app").alias("source"), F.col("k1").alias("a1"), F.col("k2").alias("a2"),
                         *[F.col(n).alias(f"{n}1") for n in names])
    far = phones.select(F.col("app").alias("target"), F.col("k1").alias("b1"), F.col("k2").alias("b2"),
                        *[F.col(n).alias(f"{n}2") for n in names])
    # both hops split hot phones of either side; the keys are counted on materialised tables
    calls = src.calls()
    ends = calls.select(F.inline(F.array(F.struct(F.col("src_k1").alias("a1"), F.col("src_k2").alias("a2")),
                                         F.struct(F.col("dst_k1").alias("a1"), F.col("dst_k2").alias("a2")))))
    step = salted_join(undirected_calls(src), near, ["a1", "a2"], count_left=ends,
                       count_right=owned.select(F.col("k1").alias("a1"), F.col("k2").alias("a2")))
    bag = salted_join(far, step, ["b1", "b2"], condition=lambda L, R: ~(
        (L("target") == R("source")) & (R("a1") == L("b1")) & (R("a2") == L("b2"))),
        count_left=owned.select(F.col("k1").alias("b1"), F.col("k2").alias("b2")))
    out = ["source", "target", "weight"] + [f"{n}1" for n in names] + [f"{n}2" for n in names]
    return bag.select(*out)
