"""The corpus pipeline: every stage against brute force on its own input."""

from collections import Counter

import numpy as np
from tests.llm import brute
from tests.llm.test_first import reference_encode

import corpus_pipeline as cp

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark, docs, rows):
    now = docs.select(*DOCUMENT)
    after = {}
    for name, stage in cp.STAGES:
        now = cp.stored(stage(spark, now, ""), "t")
        after[name] = now
        assert name == "packing" or now.columns == DOCUMENT
    m = {r[0]: brute.measures(r[1]) for r in rows}
    first = [r for r in rows if m[r[0]][0] >= 10 and 100 * m[r[0]][4] <= 20 * m[r[0]][0]]
    assert Counter(rows_of(after["quality rules"])) == Counter(first)
    lines = brute.line_dedup([r[:2] for r in first])
    second = {d: t for d, _, _, t in lines}
    assert {r[0]: r[1] for r in rows_of(after["line dedup"])} == second
    assert all(r[4] == len(r[1]) for r in rows_of(after["line dedup"]))
    comp = brute.jaccard_groups(list(second.items()))
    third = sorted(d for d in second if comp[d][1] == d)
    assert sorted(r[0] for r in rows_of(after["n-gram Jaccard join"])) == third
    mixed = Counter(r[0] for r in rows_of(after["mixing sources to target weights"]))
    assert set(mixed) <= set(third) and max(mixed.values()) <= 2
    source, sizes = {r[0]: r[3] for r in rows}, {d: len(brute.words(second[d])) for d in third}
    per = {s: sum(n for d, n in sizes.items() if source[d] == s) for s in {source[d] for d in third}}
    for s, target in brute.targets(per).items():
        own = [d for d in third if source[d] == s]
        assert abs(sum(sizes[d] * mixed[d] for d in own) - target) <= max(sizes[d] for d in own) / 2 + 1
    packed = after["packing"].collect()
    assert sum(r["length"] for r in packed) == sum(n * len(reference_encode("byte_bpe_50k.json", second[d], 0)) for d, n in mixed.items())
    for s in {r["sequence_id"] for r in packed}:
        own = sorted((r["offset"], r["length"]) for r in packed if r["sequence_id"] == s)
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own[:-1]]).tolist()


def test_run_and_edges(spark, docs, doubled, no_docs, tmp_path):
    for k, d in enumerate((docs, doubled, no_docs)):
        d.write.parquet(str(tmp_path / f"{k}/documents.parquet"))
        out = cp.run(spark, str(tmp_path / str(k)))
        assert (out.count() > 0) == (k < 2)
    near = cp.near_copies(spark, doubled, "")
    assert near.columns == doubled.columns and near.where("doc_id is null").count() == 2
    assert near.where("doc_id is not null").count() == cp.near_copies(spark, docs, "").count()


def test_rows_that_share_an_id_are_documents(spark):
    """Clean texts under one id stay, also when another row of the id is a near copy."""
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abc"}
    data = [(1, text["a"]), (2, text["b"]), (2, text["a"] + " end"), (2, text["c"]), (2, text["c"]), (None, text["b"])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in cp.near_copies(spark, docs, "").collect())
    assert got == Counter({(1, text["a"]): 1, (2, text["b"]): 1, (2, text["c"]): 1})
