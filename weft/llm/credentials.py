"""Secret scans with multipart linking (DataFrame functions only).

Three base patterns are reported as they stand.  Three weak patterns (an account name, an
opaque token, an endpoint) are reported only where complementary parts occur together: the
parts are interval-joined within a scope of characters of the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weft.llm.common import stored

# fixed values: kinds in order, their patterns and least lengths (of group 2 for assign)
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
IDENT = r"""(?i:access_?key_?id|client_?id|account|username|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]+"""
OPAQUE = r"[A-Za-z0-9+/_-]+"
ENDPOINT = r"""(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!&=%+-]+"""
KINDS = ["assign", "access", "hex", "ident", "opaque", "endpoint"]
#: rough tests that are cheap on texts without any match
MAY_MATCH = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}",
    "ident": r"(?i:access_?key_?id|client_?id|account|username|login)[\"']?\x20*[:=]", "opaque": r"[A-Za-z0-9+/_-]{20}", "endpoint": r"://",
}
#: parts of one credential start within this many characters of each other
SCOPE = 200


def _good(kind: str, x: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(x, ASSIGN, 2)) >= 12
    if kind == "opaque":  # long, with a digit, a capital and a small letter
        return (F.length(x) >= 20) & x.rlike("[0-9]") & x.rlike("[A-Z]") & x.rlike("[a-z]")
    least = {"access": 18, "hex": 16}.get(kind)
    return F.length(x) >= least if least else F.lit(True)


def _runs(kind: str, text: Column) -> Column:
    """``[(gap, length, ok)]`` of the matches in order: characters since the last match's end."""
    pattern = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "ident": IDENT, "opaque": OPAQUE, "endpoint": ENDPOINT}[kind]
    if kind in ("hex", "opaque"):  # runs are maximal, so the short ones can be left out of the match
        pattern = pattern[:-1] + ("{16,}" if kind == "hex" else "{20,}")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    runs = F.transform(F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g")),
                       lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), _good(kind, x["m"]).alias("ok")))
    none = F.array().cast("array<struct<gap:int,len:int,ok:boolean>>")
    return F.when(text.rlike(MAY_MATCH[kind]), runs).otherwise(none)


def _near(left: DataFrame, right: DataFrame, scope: int) -> DataFrame:
    """Keys of ``left`` rows that start within ``scope`` of a ``right`` row: an interval join on
    (row, bin).  A bin of ``scope`` characters holds few parts, so no text makes many pairs."""
    bins = F.explode(F.array(*[F.floor(F.col("start") / scope) + d for d in (-1, 0, 1)]))
    a = left.withColumn("bin", F.floor(F.col("start") / scope))
    b = right.select(F.col("rid").alias("_rid"), F.col("start").alias("_start"), bins.alias("_bin"))
    on = (F.col("rid") == F.col("_rid")) & (F.col("bin") == F.col("_bin")) & (F.abs(F.col("start") - F.col("_start")) <= scope)
    # the parts grow with the corpus: one plan at every size, never a broadcast of them
    return a.join(b.hint("merge"), on, "left_semi").drop("bin")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base, linked``: spans ``(start, ord, kind, end)`` in code
    points, end exclusive, sorted by start, then kind as listed in ``KINDS``.

    ``linked`` has the weak parts that are reported: an account name near a secret (assign,
    hex or opaque), an opaque token near an identifier (access or account name), and an
    endpoint near both.  Weak parts inside or across a base span are not reported again.
    Null and empty texts have no spans; repeated rows are scanned each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = stored(docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), *[_runs(k, text).alias(f"r_{k}") for k in KINDS]), "runs")
    def with_kind(i: int, k: str) -> Column:
        return F.transform(f"r_{k}", lambda x, j: F.struct(F.lit(i).alias("ord"), j.alias("j"), x["gap"].alias("gap"), x["len"].alias("len"), x["ok"].alias("ok")))

    each = F.concat(*[with_kind(i, k) for i, k in enumerate(KINDS)])
    rows = base.select("rid", F.inline(each))
    # ends by a running sum over a text's matches of one kind
    run = W.partitionBy("rid", "ord").orderBy("j").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(run)).withColumn("start", F.col("end") - F.col("len"))
    rows = stored(rows.where("ok").select("rid", "ord", "start", "end"), "parts")
    strong, weak = rows.where("ord < 3"), rows.where("ord >= 3")
    # a weak part goes when a base span overlaps it: the nearest base end and start around it
    around = W.partitionBy("rid").orderBy("start", "ord").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("rid").orderBy("start", "ord").rowsBetween(0, W.unboundedFollowing)
    marked = rows.withColumn("_e", F.max(F.when(F.col("ord") < 3, F.col("end"))).over(around)) \
        .withColumn("_s", F.min(F.when(F.col("ord") < 3, F.col("start"))).over(after))
    free = F.coalesce(F.col("_e") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("_s") >= F.col("end"), F.lit(True))
    weak = marked.where((F.col("ord") >= 3) & free).select("rid", "ord", "start", "end")
    secret = strong.where("ord in (0, 2)").unionByName(weak.where("ord = 4"))
    ident = strong.where("ord = 1").unionByName(weak.where("ord = 3"))
    linked = _near(weak.where("ord = 3"), secret, scope).unionByName(_near(weak.where("ord = 4"), ident, scope)) \
        .unionByName(_near(_near(weak.where("ord = 5"), ident, scope), secret, scope))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("ord") + 1)
    span = F.struct("start", "ord", kind.alias("kind"), "end")
    per = strong.withColumn("b", F.lit(True)).unionByName(linked.withColumn("b", F.lit(False))).groupBy("rid").agg(
        *[F.count_if(F.col("ord") == i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sort_array(F.collect_list(F.when(F.col("b"), span))).alias("base"),
        F.sort_array(F.collect_list(F.when(~F.col("b"), span))).alias("linked"))
    out = base.select("doc_id", "rid").join(per, "rid", "left")
    none = F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint>>")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
                      *[F.coalesce(c, none).alias(c) for c in ("base", "linked")])


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
