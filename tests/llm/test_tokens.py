"""Cached encoding against the library on whole texts."""

import random

import numpy as np
import pytest

from weft.llm import tokens

PARTS = [*"abcXYZ 12 \n\n\t  .,;:!?'\"-_()é ß中²Ⅷ́  <>\x01\x02\x1f\U0001f600", " 're", "'s ", "I'll", "<|endoftext|>", "  ", "\r\n", "word ",
         " the", "Straße. ", "\n\n", "the, ", "ΑΣ ", "İx ", "x" * 70 + " "]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_whole_texts(name, monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(0, 50))) for _ in range(6000)] + [None, "", "a b c " * 500]
    e = tokens.Encoder(name)
    want = [e.whole([t])[0] if t else b"" for t in texts]
    assert [x for i in range(0, len(texts), 200) for x in e.encode(texts[i:i + 200])] == want
    monkeypatch.setattr(tokens, "CACHE", 300)  # emptied again and again
    small = tokens.Encoder(name)
    assert [x for i in range(0, len(texts), 7) for x in small.encode(texts[i:i + 7])] == want
    assert small.table.n <= 300 and len(small.table.first) <= 1024


def test_word_table():
    r = np.random.default_rng(1)
    words = list({b"w%d" % x for x in r.integers(0, 5000, 4000)})
    t = tokens.WordTable(4000)
    for part in np.array_split(np.arange(len(words)), 7):
        counts = part % 5
        t.add(t.hashes([words[i] for i in part]), np.repeat(part, counts).astype(np.uint32), counts)
    at = t.find(t.hashes(words))
    assert (at >= 0).all() and len(set(at.tolist())) == len(words)
    for i in (0, 1, 77, len(words) - 1):
        assert t.ids[t.at[at[i]]:t.at[at[i]] + t.count[at[i]]].tolist() == [i] * (i % 5)
    assert (t.find(t.hashes([b"x%d" % i for i in range(1000)])) == -1).all()
