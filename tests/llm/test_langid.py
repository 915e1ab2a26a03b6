"""Language identification: profiles against plain loops, accuracy on held-out documents."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from weft.llm import langid


def plain_profile(text, width):
    import re
    out = np.zeros(width)
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        p = [0, *map(ord, word), 0]
        for a, b, c in zip(p, p[1:], p[2:]):
            va, vb, vc = (langid.letter_vector(x, width).astype(float) for x in (a, b, c))
            out += np.roll(va, 2) * np.roll(vb, 1) * vc
    return out


def test_profiles_are_bound_bundles(monkeypatch):
    texts = ["Hello, wörld a", "", None, "123 !?", "x", "ÄÖ\nü ß 中文字 \U00020000", "two words\n\nand lines"]
    want = np.stack([plain_profile(t or "", 256) for t in texts])
    assert (langid.profiles(texts, 256) == want).all()
    monkeypatch.setattr(langid, "_TABLE", 1)
    assert (langid.profiles(texts, 256) == want).all()


def test_accuracy_on_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d).withColumnRenamed("doc_id", "i").join(d, F.col("i") == F.col("doc_id")).collect()
    assert len(got) == d.count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"] and r["lang"] and len(r["text"]) >= 100]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held) and len(held) > 100


def test_edges(docs, doubled, no_docs, rows):
    assert langid.identify(no_docs).count() == 0
    assert langid.identify(doubled).count() == doubled.count()
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (1, 2, 3))
    nothing = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
