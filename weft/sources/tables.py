"""The property graph as ordinary tables, derived from the driver's parquet tables.

Graph elements (the mapping is fixed by the test fixtures):

* person (``id_card``)           = ``customer.c_custkey``
* application (``real_income_no``) = ``orders.o_orderkey``; ``HasIdCard`` = order -> customer
* attribute nodes (device, ip, company, address, phone) = string keys built from
  ``lineitem`` columns, one relationship per (type, application, key)
* ``HasCall`` = phone -> phone, between two phones of one application

Every relationship table is a *set* of ``(rel_type, app, fam, k1, k2)`` rows because
``lineitem`` has no key.  Only the relationship families a query asks for are
generated, in one pass over ``lineitem`` (a single ``inline`` generator, no union of
scans), and the scan reads only the columns those families use.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.skew import hot_keys, salted_join, skew_settings
from weft.plans.iterate import cut_lineage

# Fixed values of the mapping (must equal the fixture definition).
# o_orderstatus -> end_result: F rejected "1", O passed "0", P "2".
STATUS_TO_END_RESULT = {"F": "1", "O": "0", "P": "2"}
# l_returnflag -> relationship type for the address and the phone families.
ADDRESS_TYPE_BY_FLAG = {"N": "HasHomeAddress", "R": "HasApplyAddress", "A": "HasCompanyAddress"}
PHONE_TYPE_BY_FLAG = {"N": "HasPhone", "R": "HasEmergencyPhone", "A": "HasContact"}
ADDRESS_TYPES = ("HasHomeAddress", "HasApplyAddress", "HasCompanyAddress")

FAMILY_OF = {
    "HasDeviceAddress": "device",
    "HasIP": "ip",
    "HasCompanyName": "company",
    **{t: "address" for t in ADDRESS_TYPE_BY_FLAG.values()},
    **{t: "phone" for t in PHONE_TYPE_BY_FLAG.values()},
}

FLAG_OF = {t: flag for m in (ADDRESS_TYPE_BY_FLAG, PHONE_TYPE_BY_FLAG) for flag, t in m.items()}

#: what the relationships are built from
LINEITEM_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table.  ``weft.scan.partitions`` (unset by default) deals the rows of
    every scan out to that many partitions: the local session of tests and bench sets it,
    whose files have one row group each."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    spread = spark.conf.get("weft.scan.partitions", None)
    return df.repartition(int(spread)) if spread else df


def _by_flag(mapping: dict[str, str]) -> Column:
    expr = None
    for flag, value in mapping.items():
        expr = (F.when(F.col("l_returnflag") == flag, value) if expr is None
                else expr.when(F.col("l_returnflag") == flag, value))
    return expr


# Attribute nodes are identified by an exact numeric key ``(fam, k1, k2)``: the
# family code and the two numbers the node is built from (a day is counted from
# 1970-01-01, a month as year * 12 + month - 1).  Joins and shuffles then move three
# fixed-width numbers instead of text; the text form (``dev|<partkey>|<yyyy-MM-dd>``
# and so on) is rendered only where a result shows it (``render_key``).
FAMILY_CODE = {"device": 1, "ip": 2, "company": 3, "address": 4, "phone": 5}
KEY_COLS = ["fam", "k1", "k2"]


def _epoch_day(c: str) -> Column:
    return F.unix_date(F.to_date(F.col(c))).cast("bigint")


def _epoch_month(c: str) -> Column:
    return (F.year(F.col(c)) * 12 + F.month(F.col(c)) - 1).cast("bigint")


def _family_struct(family: str) -> Column:
    day = _epoch_day("l_shipdate")
    if family == "device":
        rel, k1, k2 = F.lit("HasDeviceAddress"), F.col("l_partkey"), day
    elif family == "ip":
        rel, k1, k2 = F.lit("HasIP"), F.col("l_partkey"), F.col("l_suppkey")
    elif family == "company":
        rel, k1, k2 = F.lit("HasCompanyName"), F.col("l_suppkey"), day
    elif family == "address":
        rel, k1, k2 = _by_flag(ADDRESS_TYPE_BY_FLAG), F.col("l_partkey"), F.col("l_quantity").cast("int").cast("bigint")
    elif family == "phone":
        rel, k1, k2 = _by_flag(PHONE_TYPE_BY_FLAG), F.col("l_partkey"), _epoch_month("l_shipdate")
    else:
        raise ValueError(f"unknown relationship family {family!r}")
    return F.struct(rel.alias("rel_type"), F.lit(FAMILY_CODE[family]).alias("fam"),
                    k1.cast("bigint").alias("k1"), k2.alias("k2"))


def _relationships(rows: DataFrame, rel_types, owner: Column) -> DataFrame:
    """``(<owner>, rel_type, fam, k1, k2)`` of ``lineitem`` rows, a row per family asked for."""
    families = sorted({FAMILY_OF[t] for t in rel_types})
    return rows.select(owner, F.inline(F.array(*[_family_struct(f) for f in families]))).filter(F.col("rel_type").isin(*rel_types))


def render_key(fam: str | Column = "fam", k1: str | Column = "k1", k2: str | Column = "k2") -> Column:
    """Text form of an attribute node key, e.g. ``dev|<partkey>|<yyyy-MM-dd>``."""
    f, a, b = (F.col(c) if isinstance(c, str) else c for c in (fam, k1, k2))
    day = F.date_from_unix_date(b.cast("int")).cast("string")
    month = F.concat(F.floor(b / 12).cast("string"), F.lit("-"),
                     F.lpad((F.pmod(b, F.lit(12)) + 1).cast("string"), 2, "0"))

    def key(prefix, tail):
        return F.concat(F.lit(prefix + "|"), a.cast("string"), F.lit("|"), tail)

    return (F.when(f == 1, key("dev", day)).when(f == 2, key("ip", b.cast("string")))
            .when(f == 3, key("co", day)).when(f == 4, key("addr", b.cast("string")))
            .when(f == 5, key("ph", month)))


@dataclass
class PropertyGraphSource:
    """Lazily built relationship tables over one set of driver tables.

    DataFrames are memoised per instance so that one query which uses a table several
    times (unions of patterns) refers to the same plan subtree and Spark can reuse
    its exchanges.
    """

    spark: SparkSession
    sf_dir: str
    _memo: dict = field(default_factory=dict, repr=False)

    def table(self, name: str) -> DataFrame:
        if name not in self._memo:
            self._memo[name] = read_table(self.spark, self.sf_dir, name)
        return self._memo[name]

    # -- nodes -------------------------------------------------------------
    def applications(self) -> DataFrame:
        """``applications(app, person, end_result, dpd7, dpd15, dpd30, dpd90, created)``."""
        if "applications" not in self._memo:
            o = self.table("orders")
            prio = F.col("o_orderpriority")
            status = None
            for k, v in STATUS_TO_END_RESULT.items():
                status = F.when(F.col("o_orderstatus") == k, v) if status is None else status.when(
                    F.col("o_orderstatus") == k, v)
            self._memo["applications"] = o.select(
                F.col("o_orderkey").alias("app"),
                F.col("o_custkey").alias("person"),
                status.alias("end_result"),
                F.when(prio == "1-URGENT", "1").otherwise("0").alias("dpd7"),
                F.when(prio == "2-HIGH", "1").otherwise("0").alias("dpd15"),
                F.lit("0").alias("dpd30"),
                F.when(prio == "5-LOW", F.lit(None).cast("string")).otherwise("0").alias("dpd90"),
                F.col("o_orderdate").alias("created"),
            )
        return self._memo["applications"]

    def has_id_card(self) -> DataFrame:
        """``HasIdCard``: ``(app, person)``, exactly one per application."""
        return self.applications().select("app", "person")

    def persons(self) -> DataFrame:
        """Person vertices with customer attributes ``(id, nation, segment)``."""
        c = self.table("customer")
        return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"),
                        F.col("c_mktsegment").alias("segment"))

    def one_person_each(self) -> bool:
        """Whether no application has two persons."""
        if "one_person_each" not in self._memo:
            persons = self.has_id_card().filter("app IS NOT NULL").groupBy("app").agg(F.min("person").alias("_low"), F.max("person").alias("_high"))
            self._memo["one_person_each"] = persons.filter("_low < _high").count() == 0
        return self._memo["one_person_each"]

    # -- relationships -----------------------------------------------------
    def _flagged(self, rel_types) -> DataFrame:
        """The ``lineitem`` rows that can give one of the types."""
        li = self.table("lineitem")
        if all(t in FLAG_OF for t in rel_types):
            li = li.filter(F.col("l_returnflag").isin(*sorted({FLAG_OF[t] for t in rel_types})))
        return li

    def owns(self, rel_types, distinct: bool = True) -> DataFrame:
        """``(rel_type, app, fam, k1, k2)`` rows of the given relationship types, as a set
        (``distinct=False``: as generated, for consumers that deduplicate later)."""
        rel_types = tuple(sorted(set(rel_types)))
        memo_key = ("owns", rel_types, distinct)
        if memo_key not in self._memo:
            rows = _relationships(self._flagged(rel_types), rel_types, F.col("l_orderkey").alias("app")).select("rel_type", "app", *KEY_COLS)
            self._memo[memo_key] = rows.distinct() if distinct else rows
        return self._memo[memo_key]

    def owned_by_persons(self, rel_types) -> DataFrame:
        """``(person, rel_type, fam, k1, k2)`` as generated, a bag.  A ``lineitem`` row meets its
        application while it is one row, not one per family."""
        rel_types = tuple(sorted(set(rel_types)))
        held = self._flagged(rel_types).join(self.has_id_card(), F.col("l_orderkey") == F.col("app"))
        return _relationships(held, rel_types, F.col("person")).select("person", "rel_type", *KEY_COLS)

    def phones_of_apps(self, rel_type: str = "HasPhone") -> DataFrame:
        """``(app, k1, k2)`` phones of applications for one phone relationship type.

        Read by several joins and their hot-key passes, so it is materialised once
        (reliable checkpoint in the shared folder) per source."""
        memo_key = ("phones", rel_type)
        if memo_key not in self._memo:
            rows = self.owns((rel_type,)).filter(F.col("rel_type") == rel_type).select("app", "k1", "k2")
            self._memo[memo_key] = cut_lineage(rows)
        return self._memo[memo_key]

    def calls(self) -> DataFrame:
        """``HasCall(src_k1, src_k2, dst_k1, dst_k2, call_cnt)`` between phone nodes: two
        phones of one application call each other, from the one whose text key is
        smaller; ``call_cnt`` = number of distinct applications holding both (each
        ``(app, k1, k2)`` occurs once, since ``owns`` is a set)."""
        if "calls" not in self._memo:
            p = self.phones_of_apps("HasPhone").withColumn("text", render_key(F.lit(FAMILY_CODE["phone"])))
            a = p.select("app", F.col("k1").alias("src_k1"), F.col("k2").alias("src_k2"), F.col("text").alias("t1"))
            b = p.select("app", F.col("k1").alias("dst_k1"), F.col("k2").alias("dst_k2"), F.col("text").alias("t2"))
            # an application holding very many phones is split across tasks
            pairs = salted_join(a, b, "app", condition=lambda L, R: L("t1") < R("t2"))
            self._memo["calls"] = cut_lineage(pairs.groupBy("src_k1", "src_k2", "dst_k1", "dst_k2")
                                              .agg(F.count(F.lit(1)).cast("bigint").alias("call_cnt")))
        return self._memo["calls"]

    def owns_with_person(self, rel_types) -> DataFrame:
        """``(rel_type, app, person, attr_key)``: the relationship rows with the id card and
        the text key of the attribute node.

        Without a hot application the ``lineitem`` rows are dealt out by application before they
        become a row per family: neither the set nor the join shuffles those rows."""
        li = self.table("lineitem").select(*LINEITEM_COLS).filter("l_orderkey IS NOT NULL")
        if hot_keys(li, None, ["l_orderkey"], *skew_settings(self.spark)) is None:
            li = li.repartition("l_orderkey")
        rows = _relationships(li, sorted(set(rel_types)), F.col("l_orderkey").alias("app")).distinct()
        return rows.join(self.has_id_card(), "app").select("rel_type", "app", "person", render_key().alias("attr_key"))


def source(spark: SparkSession, sf_dir: str) -> PropertyGraphSource:
    return PropertyGraphSource(spark, sf_dir)
