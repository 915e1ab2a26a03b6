"""Quality rules judged per host (DataFrame functions only).

Every document is measured and checked against two rules; the failures are counted per
host (``source``), each host's failure rate is shrunk towards all hosts' by an empirical
beta prior, and the host's verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import bind, salted_lookup, stored, words_of

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: a host goes when its shrunken failure rate is above this
MAX_HOST_RATE = 0.5
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(words: Column) -> Column:
    """Words inside a 5-word window that occurs twice or more in the text.  Windows are
    compared by a 64-bit hash within one text.  Most texts repeat none: then the hashes are
    distinct and nothing is sorted."""
    hashes = F.transform(F.slice(words, F.lit(1), F.size(words) - (WINDOW - 1)),
                         lambda x, i: F.xxhash64(x, *[F.get(words, i + j) for j in range(1, WINDOW)]))

    def counted(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            same = lambda x, j, k: F.coalesce(F.get(s, j + k)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, j: F.when(j > 0, same(x, j, -1)).otherwise(False) | same(x, j, 1)), lambda x: x["i"]))

        def covered(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))),
                               F.lit(0), lambda a, x: a + x)

        return bind(bind(pairs, marked), covered)

    return F.when(F.size(words) < WINDOW, 0).otherwise(
        bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(counted(h))))


def _measures(text: Column) -> Column:
    """One struct of all measures, so that the words are found once."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_CHAR))
    return bind(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(F.regexp_extract_all(text, F.lit(SYMBOLS), F.lit(0))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words")))


WORD_CHAR = r"[^\x20\x09-\x0D]"
BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words"


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id, source``, the measures and ``base_failed`` of every document (null text: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    m = docs.select("doc_id", "source", *keep, _measures(text).alias("_m"))
    return m.select("doc_id", "source", *keep, "_m.*").withColumn("base_failed", F.expr(BASE_FAILED))


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``source, n_host_docs, n_host_failed, host_rate, host_ok``; a null source is a host too.

    The prior's mean is the failure rate of all documents; its weight (pseudo-documents)
    comes from the variance between hosts beyond what chance gives (method of moments),
    kept within 1 and 1e6.
    """
    hosts = stored(measured.groupBy("source").agg(F.count("*").alias("n_host_docs"), F.count_if("base_failed").alias("n_host_failed")), "hosts")
    n, k = F.col("n_host_docs"), F.col("n_host_failed")
    total = hosts.agg(F.sum(n).alias("n"), F.sum(k).alias("k"), F.count("*").alias("h")).first()
    docs, hosts_n = int(total["n"] or 0), int(total["h"])
    mean = (total["k"] or 0) / docs if docs else 0.0
    spread = hosts.agg(F.sum(n * F.pow(k / n - F.lit(mean), 2))).first()[0] or 0.0
    chance = mean * (1 - mean)
    between = max(0.0, spread / docs - (hosts_n - 1) * chance / docs) if docs else 0.0
    weight = min(1e6, max(1.0, chance / between - 1)) if between > 0 else 1e6
    rate = (k + F.lit(mean * weight)) / (n + F.lit(weight))
    return hosts.select("source", n, k, rate.alias("host_rate"), (rate <= max_rate).alias("host_ok"))


def judge(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``doc_id``, the measures, ``base_failed`` and ``kept``, one row per row of ``docs``.

    Null texts have no words (so they fail); null sources are one host; repeated rows are
    judged each; an empty table gives an empty one.
    """
    m = stored(measure(docs), "measures")
    out = salted_lookup(m, host_verdicts(m, max_rate), "source")
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & F.col("host_ok")).alias("kept"),
                      "n_host_docs", "n_host_failed")


def kept_documents(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that pass, with the columns of ``docs``.  The verdicts need all rows once
    (narrow), the filter reads the texts again; no text is shuffled but for the host lookup."""
    verdicts = host_verdicts(stored(measure(docs).select("source", "base_failed"), "measures"), max_rate).select("source", "host_ok")
    packed = docs.select("doc_id", "source", "text", F.struct("*").alias("_row"))
    out = salted_lookup(measure(packed, "_row").where("not base_failed").select("doc_id", "source", "_row"), verdicts, "source")
    return out.where("host_ok").select("_row.*")
