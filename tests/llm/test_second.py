"""Substring dedup, Jaccard join and embedding near-dedup against brute force."""

import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from weft.llm import embedding_dedup, jaccard_join, substring_dedup, words


# ---- kernels

def test_anchors_depend_on_windows_alone():
    r = np.random.default_rng(3)
    common = r.integers(0, 2**63, 100, dtype=np.uint64)
    seen = []
    for _ in range(5):
        before, after = (r.integers(0, 2**63, r.integers(0, 60), dtype=np.uint64) for _ in range(2))
        h = np.r_[before, common, after]
        a = words.Anchors(h, np.array([len(h)]), 35, 8)
        inside = a.at[(a.at >= len(before) + 27) & (a.at < len(before) + 100 - 35)] - len(before)
        seen.append(inside.tolist())
        for s in np.flatnonzero(a.window):
            assert ((a.at >= s) & (a.at <= s + 27) & (a.hash == a.low[s])).any()
    assert all(x == seen[0] for x in seen) and seen[0]


def test_polynomial_ranges():
    h = words.hash_words([b"a", b"b", b"c", b"a", b"b", b"c", b"d"])
    for lane in range(2):
        p = words.Polynomial(h, 2)
        x = p.of(np.array([0, 3, 1, 0]), np.array([3, 6, 4, 2]), lane)
        assert x[0] == x[1] and len({int(v) for v in x}) == 3


# ---- substring dedup

def by_text(df):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect())


def wanted(rows):
    return Counter((d, *x) for (d, _), x in zip(rows, brute.without_repeats([t for _, t in rows])))


def test_substring_dedup(docs, rows):
    out = substring_dedup.remove_repeats(docs)
    got = by_text(out)
    assert got == wanted([r[:2] for r in rows])
    assert all(sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in out.collect())


def test_substring_edges(doubled, no_docs):
    assert by_text(substring_dedup.remove_repeats(doubled)) == wanted([(r["doc_id"], r["text"]) for r in doubled.collect()])
    assert substring_dedup.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_substring_random_overlaps(spark, seed):
    """Texts glued from shared passages of many lengths: branches, partial overlaps, loops."""
    r = np.random.default_rng(seed)
    pool = [[f"p{i}w{j % (7 if i == 3 else 500)}" for j in range(r.integers(5, 90))] for i in range(12)]
    data = []
    for d in range(60):
        t = []
        for _ in range(r.integers(1, 5)):
            p = pool[r.integers(len(pool))]
            a = r.integers(0, max(1, len(p) // 2)) if r.random() < 0.5 else 0
            t += p[a:] + [f"u{d}x{x}" for x in range(r.integers(0, 20))]
        data.append((d, " ".join(t)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    assert by_text(substring_dedup.remove_repeats(df)) == wanted(data)


@pytest.mark.parametrize("ids", [None, 7])
def test_substring_many_equal_rows(spark, ids):
    """Rows that share id and text share their places: the work grows with the rows, not their square."""
    text = [f"w{i}" for i in range(400)]
    data = [(ids, " ".join(text))] * 2_400 + [(1, " ".join(["a", *text[:200]])), (2, "nothing else")]
    start = time.time()
    got = by_text(substring_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(8)))
    assert got == Counter({(ids, 400, 400, ""): 2_400, (1, 201, 200, "a"): 1, (2, 2, 0, "nothing else"): 1})
    assert time.time() - start < 60


# ---- Jaccard join

def groups(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_jaccard(docs, rows):
    want = brute.jaccard_groups([r[:2] for r in rows])
    assert groups(jaccard_join.join_groups(docs)) == want
    assert len({c for _, c in want.values()}) < len(want)


@pytest.mark.parametrize("list_rows", [1, 100_000])
def test_jaccard_chains_and_split_lists(spark, list_rows):
    """Chains of small edits: neighbours link, ends do not; and unrelated texts with a common part."""
    r = np.random.default_rng(5)
    data, n = [], 0
    for g in range(12):
        w = [f"g{g}w{i}" for i in range(int(r.integers(8, 120)))]
        for _ in range(int(r.integers(1, 14))):
            data.append((n, " ".join(w)))
            n += 1
            for _ in range(max(1, len(w) // 60)):
                w[r.integers(len(w))] = f"e{r.integers(10**6)}"
    hot = [f"hot{i}" for i in range(40)]
    for i in range(30):
        data.append((n + i, " ".join(hot + [f"q{i}z{j}" for j in range(int(r.integers(0, 60)))])))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    assert groups(jaccard_join.join_groups(df, list_rows=list_rows)) == brute.jaccard_groups(data)


def test_parity_bounds_the_overlap():
    """Differing bits never exceed the symmetric difference, at any size."""
    r = np.random.default_rng(3)
    for n in (1, 5, 80, 900, 20_000):
        for share in (0.0, 0.5, 0.9, 1.0):
            pool = words.mix64(r.integers(0, 2**63, 2 * n).astype(np.uint64))
            a, b = np.unique(pool[:n]), np.unique(pool[int(n * (1 - share)):int(n * (1 - share)) + n])
            differ = int(np.bitwise_count((jaccard_join.parity(a) ^ jaccard_join.parity(b)).view(np.uint64)).sum())
            assert differ <= len(np.setxor1d(a, b))


def template_sets(pages, seed):
    """Pages of 12 of 24 passages of 16 shingles: any two share passages, few reach 80 %."""
    r = np.random.default_rng(seed)
    passages = words.mix64(r.integers(0, 2**63, (24, 16)).astype(np.uint64))
    return [np.sort(passages[np.sort(r.permutation(24)[:12])].ravel()) for _ in range(pages)]


def one_list(spark, sets):
    data = [(7, i, len(s), 0, i, [int(x) for x in jaccard_join.parity(s)]) for i, s in enumerate(sets)]
    return spark.createDataFrame(data, "shingle long, class long, n int, pos int, root long, parity array<long>")


@pytest.mark.parametrize("block", [50, 10_000])
def test_pairs_apart_lose_no_link(spark, block):
    """Members of very different sizes on one list, in blocks or not: every link comes out, each pair
    of the same root or of sizes too far apart does not."""
    r = np.random.default_rng(8)
    sets = template_sets(150, 1)
    for s in list(sets[:60]):
        sets.append(np.unique(np.r_[s, words.mix64(r.integers(0, 2**63, int(r.integers(0, 60))).astype(np.uint64))]))
        sets.append(np.sort(s[r.permutation(len(s))[:int(r.integers(100, len(s) + 1))]]))
    got = {(x["a"], x["b"]) for x in jaccard_join.pairs_apart(one_list(spark, sets), block=block).collect()}
    links = {(i, j) for i, s in enumerate(sets) for j in range(i + 1, len(sets))
             if 100 * len(np.intersect1d(s, sets[j])) >= 80 * len(np.union1d(s, sets[j]))}
    assert len(links) > 60 and links <= got and len(got) < len(links) + 200
    same = one_list(spark, sets).withColumn("root", F.lit(1).cast("long"))
    assert jaccard_join.pairs_apart(same, block=block).isEmpty()


def test_ten_thousand_template_pages_on_one_list(spark):
    """10^4 pages below 80 % on one list: cut into blocks, and hardly a pair is left to verify."""
    sets = template_sets(10_000, 2)
    start = time.time()
    got = {(x["a"], x["b"]) for x in jaccard_join.pairs_apart(one_list(spark, sets), block=1_000).collect()}
    assert time.time() - start < 60
    assert len(got) < 50_000_000 // 500
    for a, b in sorted(got)[:200]:  # what is left is near the threshold
        assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))


def test_jaccard_template_pages(spark):
    """The whole join over template pages, with blocks of 40 rows, against all pairs."""
    r = np.random.default_rng(9)
    passages = [" ".join(f"p{i}w{j}" for j in range(14)) for i in range(14)]
    texts = [" ".join(passages[i] for i in np.sort(r.permutation(14)[:7])) for _ in range(260)]
    texts += [t + " one more" for t in texts[:20]]
    data = list(enumerate(texts))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    assert groups(jaccard_join.join_groups(df, block=40)) == brute.jaccard_groups(data)


def test_jaccard_clashing_keys(docs, rows):
    """Keys of four bits: nearly every key is shared by different sets, which stay apart."""
    assert groups(jaccard_join.join_groups(docs, key_bits=4)) == brute.jaccard_groups([r[:2] for r in rows])


@pytest.mark.parametrize("turns", [{}, {5: 1, -(2**63): 63, -1: 17}])
def test_jaccard_names_of_columns_and_numbers_agree(spark, turns):
    data = [(k, c, 1) for k in (5, 6, -1, -(2**63), 2**63 - 1) for c in (0, 1, -1, 2**62 + 3, -(2**63), 2**63 - 1)]
    df = spark.createDataFrame(data, "key long, check long, n long")
    got = {(r["key"], r["check"]): r["class"] for r in jaccard_join._named(df, turns).collect()}
    assert got == {(k, c): jaccard_join._name(k, c, turns) for k, c, _ in data}


def test_shared_lists_across_batches():
    """The lists that come out are the same however the batches are cut."""
    import pyarrow as pa
    r = np.random.default_rng(2)
    rows = sorted((int(s), 0, int(c) % 3 + 1, int(c)) for s, c in zip(r.integers(0, 12, 60), r.integers(0, 9, 60)))
    cols = list(zip(*[(s, p, c, n, 0) for s, p, n, c in dict.fromkeys(rows)]))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["shingle", "part", "class", "n", "pos"])
    parts = np.ones(jaccard_join.CELLS, np.int32)

    def run(step, parts):
        cut = [whole.slice(i, step) for i in range(0, whole.num_rows, step)]
        return sorted(tuple(x.values()) for b in jaccard_join._shared(iter(cut), parts) for x in b.to_pylist())

    several = {s for s in range(12) if len({c for t, _, _, c in rows if t == s}) > 1}
    want = sorted((s, c, n, 0) for s, _, n, c in set(rows) if s in several)
    assert want and all(run(k, parts) == want for k in (1, 2, 3, 7, 1000))
    every = sorted((s, c, n, 0) for s, _, n, c in set(rows))
    assert all(run(k, parts + 1) == every for k in (1, 2, 3, 7, 1000))


def test_jaccard_edges(no_docs, doubled):
    assert jaccard_join.join_groups(no_docs).count() == 0
    data = [(10**6 + i if r["doc_id"] is None else r["doc_id"], r["text"]) for i, r in enumerate(doubled.collect())]
    want = brute.jaccard_groups(data)
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard_join.join_groups(doubled).collect())
    assert got == Counter((None if d >= 10**6 else d, None if c >= 10**6 else c) for d, c in ((d, want[d][1]) for d, _ in data))


# ---- embeddings

def planted(n=1500, groups=40, width=32, seed=1):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, width))
    for g in range(groups):
        size = int(r.integers(2, 40))
        at = r.choice(n, size, replace=False)
        x[at] = x[at[0]] + r.standard_normal((size, width)) * r.choice([0.0, 0.05, 0.15])
    return x.astype(np.float32)


def test_embeddings_recall_and_precision(spark):
    x = planted()
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(5000, None, 1), (5001, [0.0] * 32, 1), (5002, [float("nan")] * 32, 1), (5003, [1.0, None] * 16, 1), (5004, [], 1), (5005, [float("inf")] + [1.0] * 31, 1), (5006, x[0][:16].tolist(), 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(5)
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = y @ y.T >= 0.95
    np.fill_diagonal(s, False)
    true = s.sum(1)
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()
    want = brute.grouped(range(len(x)), zip(*map(np.ndarray.tolist, np.nonzero(s))))
    same = sum(got[i]["component_id"] == want[i] for i in range(len(x)))
    assert same >= 0.97 * len(x)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(5000, 5007))


def test_embeddings_window_spans_blocks(spark, monkeypatch):
    x = planted(400, 20)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, embedding_dedup.near_vectors(df, window=16).collect()))
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    assert sorted(map(tuple, embedding_dedup.near_vectors(df, window=16).collect())) == whole


def test_embeddings_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_vectors(empty).count() == 0
    d = spark.createDataFrame([(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "y"), (None, [0.0, 1.0], "z")], "vec_id long, embedding array<float>, id string")
    got = Counter(tuple(r) for r in embedding_dedup.near_vectors(d).collect())
    assert got == Counter({(1, 2, 1, True): 2, (2, 2, 1, False): 1, (None, 0, None, False): 1})


def true_links(x):
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = y @ y.T >= 0.95
    np.fill_diagonal(s, False)
    return s


def near(spark, x, **options):
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    return {r["vec_id"]: r for r in embedding_dedup.near_vectors(df, **options).collect()}


def check_whole(got, s):
    want = brute.grouped(range(len(s)), zip(*map(np.ndarray.tolist, np.nonzero(s))))
    assert [got[i]["n_links"] for i in range(len(s))] == s.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(s))] == [want[i] for i in range(len(s))]


@pytest.mark.parametrize("noise", [1e-4, 0.01, 0.1])
def test_embeddings_links_of_a_large_group_are_whole(spark, noise):
    """More near-equal, not equal, vectors than any window: every link counts."""
    r = np.random.default_rng(4)
    x = np.r_[r.standard_normal(64) + noise * r.standard_normal((1500, 64)), r.standard_normal((300, 64))].astype(np.float32)
    s = true_links(x)
    assert s[:1500].sum() >= 0.999 * 1500 * 1499
    check_whole(near(spark, x), s)


def test_embeddings_pairs_off_centre(spark):
    """Isolated pairs among vectors with a common direction; the window is 0.4 % of the rows."""
    r = np.random.default_rng(6)
    x = 2 * r.standard_normal(64) + r.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.r_[x, x[:300] + r.standard_normal((300, 64)) * np.sqrt(2 / 0.95 - 2) / 8 / 1.02].astype(np.float32)
    s = true_links(x)
    assert s.sum() > 300
    check_whole(near(spark, x, window=16), s)


def test_embeddings_tiny_and_huge_norms(spark):
    """Norms that under- or overflow when squared spoil neither their own links nor others'."""
    x = planted(300, 12).astype(np.float64)
    tiny, huge = 1e-200 * x[:3], 1e200 * x[:3]
    y = np.r_[x, tiny, huge, np.full((1, 32), 1e-310)]
    unit = embedding_dedup.unit(y)
    s = unit @ unit.T >= 0.95
    np.fill_diagonal(s, False)
    assert all(s[i, 300 + i] and s[i, 303 + i] for i in range(3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "vec_id long, embedding array<double>").repartition(3)
    check_whole({r["vec_id"]: r for r in embedding_dedup.near_vectors(df).collect()}, s)


@pytest.mark.parametrize("kind", ["tight", "loose", "off centre"])
def test_embeddings_passes_reach_the_pairs(spark, kind):
    """The edges of the passes alone, the window far below 1 % of the rows."""
    r = np.random.default_rng(8)
    x = r.standard_normal((2500, 32)) + (3 * r.standard_normal(32) / np.sqrt(2) if kind == "off centre" else 0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = {"tight": 0.01, "loose": 0.31, "off centre": 0.31}[kind]
    x = np.r_[x, x[:200] + noise * r.standard_normal((200, 32)) / np.sqrt(32)]
    s = true_links(x)
    units = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(embedding_dedup.unit(x))], "id long, v array<double>, size long").repartition(4)
    found = {(min(e), max(e)) for e in map(tuple, embedding_dedup.edges_of_passes(units, 0.95, 16).collect())}
    true = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(s))) if i < j}
    assert found <= true  # every edge is verified
    comp = brute.grouped(range(len(x)), found)
    assert len(true) >= 100 and sum(comp[i] == comp[j] for i, j in true) >= 0.98 * len(true)


def test_passes_are_planned_from_all_pairs(spark, monkeypatch):
    """Pairs off centre that next to no row has: no sample of the rows may decide on the passes."""
    monkeypatch.setattr(embedding_dedup, "QUERIES", 1, raising=False)
    r = np.random.default_rng(8)
    x = r.standard_normal((2500, 32)) + 3 * r.standard_normal(32) / np.sqrt(2)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.r_[x, x[:200] + 0.31 * r.standard_normal((200, 32)) / np.sqrt(32)]
    passes = []
    keep = embedding_dedup._in_order
    monkeypatch.setattr(embedding_dedup, "_in_order", lambda *a: (passes.append(a[4] - a[3]), keep(*a))[1])
    units = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(embedding_dedup.unit(x))], "id long, v array<double>, size long").repartition(4)
    found = {(min(e), max(e)) for e in map(tuple, embedding_dedup.edges_of_passes(units, 0.95, 16).collect())}
    comp = brute.grouped(range(len(x)), found)
    true = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(true_links(x)))) if i < j}
    assert sum(comp[i] == comp[j] for i, j in true) >= 0.98 * len(true)
    n = len(x)
    assert sum(passes) > embedding_dedup.plan(n, [(1 - np.arccos(0.95) / np.pi, 1)], 16)[1]


def test_plan_of_passes():
    at = [(0.9, 1)]
    assert embedding_dedup.plan(500, at)[1] == 1  # all rows in one window
    few, many = embedding_dedup.plan(10**5, at), embedding_dedup.plan(10**9, at)
    assert few[1] < many[1] < 400 and few[0] <= many[0]
    assert embedding_dedup.plan(10**5, [(0.8, 1)], 256)[1] > embedding_dedup.plan(10**5, at, 256)[1]


def test_embeddings_plan_has_no_product(spark, monkeypatch):
    plans = []
    keep = embedding_dedup.stored
    monkeypatch.setattr(embedding_dedup, "stored", lambda df, n: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, n))[1])
    out = near(spark, planted(300, 10))
    assert out and plans and not any("CartesianProduct" in p or "NestedLoop" in p for p in plans)
