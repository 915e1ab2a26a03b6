"""Language identification with hyperdimensional profiles.

Every letter (and the word border) has a random vector of +1 and -1.  A trigram's vector
binds its three letters' vectors, the first rotated twice, the second once, by elementwise
product.  A text's profile bundles (adds) the vectors of its trigrams; a language's prototype
bundles the profiles of its labelled texts.  The prediction is the language whose prototype
has the largest cosine with the text's profile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import prepare, stored

WIDTH = 1024
UNKNOWN = "und"
#: languages that a model can hold (prototypes go to every task: 8 kB each)
MAX_LANGUAGES = 4096
#: letters of one text block are numbered; up to this many, trigrams are counted in a table
_TABLE = 96
_letters: dict[int, np.ndarray] = {}
_is_letter = np.full(0x110000, -1, np.int8)  # -1: not looked up yet


def letter_vector(point: int, width: int) -> np.ndarray:
    """The random vector of a code point (0: the border), the same on every machine."""
    key = (point << 16) | width
    if key not in _letters:
        _letters[key] = np.random.Generator(np.random.Philox(key=key)).integers(0, 2, width, dtype=np.int8) * 2 - 1
    return _letters[key]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, trigram code) of all trigrams in one batch, and the letters' code points:
    a code is (a * n + b) * n + c over the n letter numbers.  Words are runs of letters,
    lower-cased, with a border on either side."""
    points = np.frombuffer("\n".join(["", *[(t or "").lower().replace("\n", " ") for t in texts], ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    new = np.unique(points[_is_letter[points] < 0])
    _is_letter[new] = [chr(p).isalpha() for p in new]
    doc = np.cumsum(points == 10) - 1
    points = np.where(_is_letter[points] == 1, points, 0)
    keep = (points > 0) | np.r_[True, points[:-1] > 0]  # borders in a row count once
    points, doc = points[keep], doc[keep]
    letters, code = np.unique(points, return_inverse=True)
    if not len(letters) or letters[0] != 0:
        letters, code = np.r_[0, letters], code + 1
    n = len(letters)
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    tri = (code[:-2] * n + code[1:-1]) * n + code[2:]
    whole = code[1:-1] > 0  # the middle is a letter, so a border is at an end only
    return doc[1:-1][whole], tri[whole], letters


def profiles(texts: list[str | None], width: int = WIDTH) -> np.ndarray:
    """The bundled profile of each text (float32, whole numbers)."""
    doc, tri, letters = trigrams(texts)
    out = np.zeros((len(texts), width), np.float32)
    if not len(tri):
        return out
    n = len(letters)
    if n <= _TABLE:
        used = np.flatnonzero(np.bincount(tri, minlength=n ** 3))
        place = np.zeros(n ** 3, np.int64)
        place[used] = np.arange(len(used))
        at = place[tri]
    else:
        used, at = np.unique(tri, return_inverse=True)
    table = np.stack([letter_vector(int(p), width) for p in letters])
    first, second = np.roll(table, 2, axis=1), np.roll(table, 1, axis=1)
    for lo in range(0, len(used), 4096):  # a block of trigrams at a time
        part = used[lo:lo + 4096]
        vectors = (first[part // (n * n)] * second[part // n % n] * table[part % n]).astype(np.float32)
        mine = (at >= lo) & (at < lo + len(part))
        counts = np.bincount(doc[mine] * len(part) + at[mine] - lo, minlength=len(texts) * len(part)).reshape(len(texts), len(part))
        out += counts.astype(np.float32) @ vectors
    return out


BATCH = 64


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, BATCH):
            yield b.slice(lo, BATCH)


def _bundle(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """One partial prototype per language and task, in whole numbers (any order sums alike)."""
    total: dict[str, np.ndarray] = {}
    for b in _blocks(batches):
        langs = np.array(b.column("lang").to_pylist(), dtype=object)
        p = profiles(b.column("text").to_pylist(), width)
        for lang in set(langs):
            total[lang] = total.get(lang, 0) + p[langs == lang].sum(axis=0, dtype=np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "v"])


def learn(labelled: DataFrame, width: int = WIDTH) -> tuple[list[str], np.ndarray]:
    """Prototypes from ``labelled (text, lang)``; rows without lang or text teach nothing."""
    prepare(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null").select("text", "lang")
    parts = stored(rows.mapInArrow(lambda it: _bundle(it, width), "lang string, v array<double>"), "prototypes")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")) \
        .groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    found = sums.where(F.exists("v", lambda x: x != 0)).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: is this the language column?")
    return [r["lang"] for r in found], np.array([r["v"] for r in found], dtype=np.float64).reshape(len(found), width)


def _predict(batches: Iterator[pa.RecordBatch], langs: list[str], prototypes: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    unit = (prototypes / np.linalg.norm(prototypes, axis=1, keepdims=True)).astype(np.float32) if langs else prototypes
    for b in _blocks(batches):
        p = profiles(b.column("text").to_pylist(), width)
        norm = np.linalg.norm(p, axis=1)
        some = (norm > 0) & bool(langs)
        names, score = np.array([UNKNOWN] * len(p), dtype=object), np.zeros(len(p))
        if some.any():
            cosine = (p[some] / norm[some][:, None]) @ unit.T
            best = cosine.argmax(axis=1)
            names[some] = np.array(langs, dtype=object)[best]
            score[some] = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names.tolist(), pa.string()), pa.array(score)],
                                         names=["doc_id", "held_out", "lang_pred", "score"])


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2 (a null id is not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` (cosine, 0 to 1) of every row's whole text.

    Learns from the rows that are not held out and have a lang.  Texts that are null or have
    no letter are ``und`` with score 0, and so is every text when nothing was learned; ties
    go to the language that sorts first; repeated rows count as often as they occur.
    """
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    langs, prototypes = learn(rows.where("not held_out"), width)
    return rows.select("doc_id", "held_out", "text").mapInArrow(lambda it: _predict(it, langs, prototypes, width),
                                                                 "doc_id long, held_out boolean, lang_pred string, score double")
