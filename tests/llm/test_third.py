"""Conversation trie, Merkle manifest and WARC archives against plain Python."""

import base64
import gzip
import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from tests.llm import brute
from weft.llm import merkle, sha256, trie, warc


# ---- conversation trie

def brute_trie(rows):
    digest = lambda r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()[:32]
    turns = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            turns[r[0]].append(r)
    for c in turns:
        turns[c].sort(key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        own = [(r[2] or "", r[3] or "") for r in turns[c]]
        built[c] = [(r[2] or "", r[3] or "") for r in turns.get(c - c % 20, [])][:h] + own[h:]
    members = defaultdict(set)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].add(c)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ended = sorted(c for c in m if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], sum(not kids[q] for q in below),
                    sum((len(members[q]) - 1) * len(brute.words(q[-1][1])) for q in below if q), brute.sha(",".join(map(str, ended)))))
    return out


TURNS = "conv_id long, turn long, role string, text string, path string, words int, _p int"


def talks(seed, convs, deep=0):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        same = r.random() < 0.4
        for t in range(r.randrange(1, 7)):
            text = "the very same opening line" if same and t < 3 else r.choice(["a b", "c", "a  b ", "", None, "d e f"])
            rows.append((c - 3, r.choice([t, t, None]), r.choice(["user", "assistant", None]) if not same else "user", text))
    rows += [(500, t, "user", f"w{t % 3} x") for t in range(deep)] + [(501, t, "user", f"w{t % 3} x") for t in range(deep)]
    return rows + rows[:5] + [(None, 0, "user", "no id"), (-41, 0, "user", "negative")]


@pytest.mark.parametrize("parts", [1, 2, 9])
def test_trie(spark, parts):
    rows = talks(parts, 70, deep=45)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS).repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = trie.conversation_trie(df)
        assert out.columns == trie.RESULT
        assert Counter(map(tuple, out.collect())) == Counter(brute_trie(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_identical_conversations(spark, monkeypatch):
    """One path in many shards: ended members in pieces, a chain of skeleton nodes."""
    monkeypatch.setattr(trie, "PIECE", 20)
    rows = [(c, t, "u", f"line {t}") for c in range(200) for t in range(4)] + [(c, 0, "u", "other") for c in range(300, 310)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS).repartition(5)
    assert Counter(map(tuple, trie.conversation_trie(df).collect())) == Counter(brute_trie(rows))


def test_trie_edges(spark):
    none = spark.createDataFrame([], TURNS)
    assert trie.conversation_trie(none).columns == trie.RESULT and trie.conversation_trie(none).count() == 0
    null = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert trie.conversation_trie(null).count() == 0
    turnless = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)  # no base, its one turn is replaced by nothing
    one = spark.createDataFrame([(turnless, 0, None, "x " * 3000)], "conv_id long, turn long, role string, text string")
    assert list(map(tuple, trie.conversation_trie(one).collect())) == [(turnless, 0, None, 1, 0, 1, 0, brute.sha(str(turnless)))]


def test_common_depth():
    a = bytes(range(64))
    for k in range(5):
        b = a[:16 * k] + b"\xff" * (64 - 16 * k)
        assert trie.common_depth(a, b) == k and trie.common_depth(a[:16 * k], a) == k
    assert trie.common_depth(b"", a) == 0


# ---- SHA-256 and the manifest

def test_states_resume():
    r = np.random.default_rng(1)
    runs = [[r.bytes(32) for _ in range(k)] for k in (1, 2, 16, 9)]
    for run in runs:
        s, seen = sha256.start(1), []
        for d in run:
            seen.append(s)
            s = sha256.compress(s, sha256.hex_blocks(sha256.from_bytes(d)))
        whole = lambda x: hashlib.sha256("".join(d.hex() for d in x).encode()).digest()
        assert sha256.to_bytes(sha256.finish(s, np.array([len(run)]))) == [whole(run)]
        k, new = len(run) // 2, r.bytes(32)
        s = seen[k]
        for d in [new, *run[k + 1:]]:
            s = sha256.compress(s, sha256.hex_blocks(sha256.from_bytes(d)))
        assert sha256.to_bytes(sha256.finish(s, np.array([len(run)]))) == [whole([*run[:k], new, *run[k + 1:]])]


def brute_merkle(rows):
    """rows (doc_id, source, lang, n_chars, text) -> Counter of the query's rows."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: brute.sha("".join(map(field, r)))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def other(r):
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        return leaf((*r[:4], r[4].translate(low))) if hit and r[4] is not None else leaf(r)

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([brute.sha("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    def climb(tree, i, new):
        proof = []
        for level in tree[:-1]:
            lo = i - i % 16
            run = level[lo:lo + 16]
            proof += run[:i - lo] + run[i - lo + 1:]
            new = brute.sha("".join([*run[:i - lo], new, *run[i - lo + 1:]]))
            i //= 16
        return new, proof

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [levels([leaf(r) for r in by[s]]) for s in names]
    top = levels([t[-1][0] for t in trees])
    root = top[-1][0]
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            mid, p1 = climb(trees[k], i, other(r))
            end, p2 = climb(top, k, mid)
            out.append((r[0], leaf(r), trees[k][-1][0], root, brute.sha("".join(p1 + p2)), end, end == root))
    return Counter(out)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx int, digest string, name string"


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_manifest(spark, depth):
    r = random.Random(depth)
    rows = [(i, r.choice(["hot"] * 6 + ["a", "b", "é", "Z", "", None]), r.choice(["en", None]), r.choice([i, None]), r.choice(["Some Text", "low", None, "", "É Ü x" * 300])) for i in range(700)]
    rows += [(1000 + i, f"s{i:03}", None, 1, "T") for i in range(40)]  # more sources than a run holds
    rows += rows[:20] + [(None, "hot", None, None, None), (None, None, None, None, "X"), (5, "hot", "xx", 1, "Other Text")]
    df = spark.createDataFrame([(*x, "t", 1, "d", "n") for x in rows], DOCS).repartition(7)
    m = merkle.manifest(df, merkle.tampered(df), depth=depth)
    out = merkle.fold(m)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute_merkle(rows)
    assert Counter(map(tuple, out.collect())) == want
    assert {x["root"] for x in m.root().collect()} == {k[3] for k in want}
    if depth == 3:  # without changes every leaf folds to the root
        assert merkle.fold(merkle.manifest(df)).where("not verified").count() == 0


@pytest.mark.parametrize("n", [0, 1, 16, 17, 256, 257])
def test_manifest_sizes(spark, n):
    rows = [(i, "one", "en", i, f"Text {i}") for i in range(n)]
    df = spark.createDataFrame([(*x, "t", 1, "d", "n") for x in rows], DOCS)
    out = merkle.fold(merkle.manifest(df, merkle.tampered(df), depth=1))
    assert Counter(map(tuple, out.collect())) == (brute_merkle(rows) if n else Counter())


# ---- WARC

PAGES = "page_id long, url string, html string, type string, payload string, key string, n long"


def wanted_pages(rows, least=0):
    first = defaultdict(list)
    for p, u, t in rows:
        first[(t or "").encode()].append((p is None, p or 0))
    out, used = [], set()
    for p, u, t in rows:
        body = (t or "").encode()
        low = min(first[body])
        again = len(body) >= least and ((p is None, p or 0) != low or body in used)
        if (p is None, p or 0) == low:
            used.add(body)
        out.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", (None if low[0] else low[1]) if again else None))
    return Counter(out)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "t", "p", "k", 1) for r in rows], PAGES).repartition(4)


PAGE_ROWS = [(1, "u", "aa"), (1, "u", "aa"), (2, "v", "aa"), (3, None, None), (None, "w", ""), (None, "w", ""), (5, "x\r\nInjected: y", "zz"), (1, "a", "aa"),
             (7, "q", "é\r\n\r\nWARC/1.1\r\n中"), (8, "l", "long " * 60_000), (9, "l", "long " * 60_000), (-4, "m", "zz"), (None, None, "alone"), (11, "h", "a" * 3)]


@pytest.mark.parametrize("least", [0, 3])
def test_pages(spark, least, tmp_path):
    out = warc.archive(pages(spark, PAGE_ROWS), str(tmp_path / "w"), least).collect()
    assert Counter(tuple(r)[:5] for r in out) == wanted_pages(PAGE_ROWS, least)
    assert all(r["digest_ok"] for r in out if r["record_type"] == "response")


def test_pages_edges(spark, tmp_path):
    assert warc.archive(pages(spark, PAGE_ROWS).limit(0)).count() == 0
    many = [(i, f"u{i}", "copy" if i % 3 == 0 else f"page {i}") for i in range(400)]
    folder = str(tmp_path / "w")
    warc.write_pages(pages(spark, many), folder, fileBytes=2000)
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) > 4 and not list((tmp_path / "w").glob("_temporary*"))
    spark.conf.set("weft.skew.threshold", "20")
    try:
        assert Counter(tuple(r)[:5] for r in warc.read_pages(spark, folder).collect()) == wanted_pages(many)
        assert Counter(tuple(r)[:5] for r in warc.archive(pages(spark, many)).collect()) == wanted_pages(many)
    finally:
        spark.conf.unset("weft.skew.threshold")
    parts = warc.WarcReader(warc.StructType.fromDDL("type string"), {"path": folder, "taskBytes": "4000"}).partitions()
    assert len(parts) > 2 and sorted(p for x in parts for p in x.paths) == sorted(map(str, (tmp_path / "w").glob("*.warc.gz")))


def test_predicates_are_pushed_and_payloads_skipped(spark, tmp_path):
    folder = str(tmp_path / "w")
    warc.write_pages(pages(spark, PAGE_ROWS), folder)
    got = warc.read(spark, folder, where="type = 'revisit' and refers_to = 'urn:page:1' and target_uri is not null")
    text = got._jdf.queryExecution().executedPlan().toString()
    assert " Filter " not in text  # nothing is left for Spark
    assert {r["record_id"] for r in got.collect()} == {"urn:page:1", "urn:page:2"} and got.where("payload is null").count() == 0
    some = "type string, target_uri string, payload_length long"
    every = warc.read(spark, folder, some).collect()
    for cond in ("type in ('revisit', 'warcinfo')", "not type = 'response'", "payload_length > 2", "target_uri like 'x%'", "target_uri is null", "target_uri <=> null", "not payload_length in (2, 0)"):
        both = spark.createDataFrame(every, some).where(cond)
        assert Counter(warc.read(spark, folder, some, cond).collect()) == Counter(both.collect()), cond


def plain_file(records, gz=False):
    data = [warc.record({"type": t, "record_id": f"<urn:x:{i}>"}, b) for i, (t, b) in enumerate(records)]
    return b"".join(gzip.compress(d) if gz else d for d in data)


@pytest.mark.parametrize("kind", ["plain", "gzip", "member"])
def test_unwanted_payloads_are_not_read(kind):
    """Foreign files too: plain records, and gzip members without the length field."""
    big = np.random.default_rng(0).bytes(3 << 20)
    recs = [("response", big), ("metadata", b"small"), ("response", big), ("revisit", b"")]
    raw = b"".join(warc.member(warc.record({"type": t, "record_id": f"<urn:x:{i}>"}, b)) for i, (t, b) in enumerate(recs)) if kind == "member" else plain_file(recs, kind == "gzip")
    w = warc.Window(pa.BufferReader(raw))
    got = list(warc.records(w, lambda r: r["type"] != "response", True))
    assert [(r["type"], r["payload"]) for r in got] == [("metadata", b"small"), ("revisit", b"")]
    assert [r["payload"] for r in warc.records(warc.Window(pa.BufferReader(raw)), lambda r: r["type"] == "response", True)] == [big, big]
    if kind != "gzip":
        assert w.fetched < 1 << 21 < len(raw)
    if kind != "plain":
        assert gzip.GzipFile(fileobj=io.BytesIO(raw)).read() == plain_file(recs)


def test_judging_nulls():
    row = {"type": None, "target_uri": "x"}
    assert warc.judge(ds.EqualTo(("type",), "a"), row) is None and warc.judge(ds.Not(ds.EqualTo(("type",), "a")), row) is None
    assert warc.judge(ds.EqualNullSafe(("type",), None), row) and warc.judge(ds.IsNull(("type",)), row)
    assert not warc.can_judge(ds.EqualTo(("payload",), b"")) and warc.can_judge(ds.Not(ds.In(("type",), ("a",))))


def test_base32(spark):
    data = [b"", b"a", "é".encode(), b"x" * 999]
    df = spark.createDataFrame([(bytearray(x),) for x in data], "x binary").select(warc.base32(F.sha1("x")).alias("b"))
    assert [r["b"] for r in df.collect()] == [base64.b32encode(hashlib.sha1(x).digest()).decode() for x in data]
