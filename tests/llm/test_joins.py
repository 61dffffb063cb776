import random

import data
import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import graph, near_dup, vectors


def sets(rows):
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        out.append((i, {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()))
    return out


def components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def near(rows):
    s = sets(rows)
    links = [(i, j) for a, (i, x) in enumerate(s) for j, y in s[:a] if None not in (i, j) and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    c = components(links, {i for i, _ in s if i is not None})
    return sorted(((str(i), len(x), None if i is None else c[i]) for i, x in s), key=str)


def found(df):
    return sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def copies():
    """Groups of near copies that drift apart, documents that share passages, and a common line."""
    rng = random.Random(7)
    word = lambda: rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice("lmnr") + str(rng.randint(0, 99))
    line, passage = " ".join(word() for _ in range(12)), " ".join(word() for _ in range(60))
    rows = []
    for g in range(12):
        words = [word() for _ in range(rng.choice([6, 40, 150, 400]))]
        for _ in range(rng.choice([1, 2, 9])):
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = word()
            text = " ".join(words) + " " + line * (g % 2) + " " + passage * (g % 3 == 0)
            rows.append((len(rows) * 3 % 101 + 101 * (len(rows) // 101), text))
    return rows


LIMITS = [(1 << 24, 1 << 22, 2048), (2000, 1 << 22, 2048), (1, 1 << 22, 4), (1, 5000, 3)]


def limit(monkeypatch, window, chunk, block):
    monkeypatch.setattr(near_dup, "WINDOW_BYTES", window)
    monkeypatch.setattr(near_dup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(near_dup, "BLOCK_NODES", block)


@pytest.mark.parametrize(("window", "chunk", "block"), LIMITS)
def test_near_copies(spark, copies, window, chunk, block, monkeypatch):
    limit(monkeypatch, window, chunk, block)
    df = spark.createDataFrame(copies, "doc_id bigint, text string")
    assert found(near_dup.near_components(df)) == near(copies)


@pytest.mark.parametrize(("window", "chunk", "block"), LIMITS)
def test_links_of_followers(spark, window, chunk, block, monkeypatch):
    """A follower is linked to a document, or to its follower, that its leader is too large to be linked to."""
    limit(monkeypatch, window, chunk, block)
    rows = []
    for g in range(12):
        words = [f"w{g}x{k}" for k in range(104)]
        cuts = [(0, 104), (10, 94), (18, 87), (24, 79)][: 3 + g % 2]
        rows += [(len(rows) + k, " ".join(words[a:z])) for k, (a, z) in enumerate(cuts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    want = near(rows)
    assert len({c for *_, c in want}) == 12
    assert found(near_dup.near_components(df)) == want


def test_large_group_of_near_copies(spark):
    """5,000 near copies of 400 shingles: all linked, in tests of about one for each."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(404)]
    rows = []
    for i in range(5000):
        words = list(base)
        for _ in range(4):
            words[rng.randrange(404)] = f"x{i}"
        rows.append((i + 7, " ".join(words)))
    sets = [near_dup_set(t) for _, t in rows]
    tests, plain = [0], near_dup.linked

    def counted(*args):
        tests[0] += 1
        return plain(*args)

    near_dup.linked = counted
    try:
        groups = near_dup.Groups(len(sets))
        assert len(near_dup.connect(sets, groups, 75)) == len(sets) - 1 and tests[0] < 3 * len(sets)
    finally:
        near_dup.linked = plain
    got = near_dup.near_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(16)).collect()
    assert len(got) == 5000 and {r["component_id"] for r in got} == {7}


def test_copies_below_the_threshold_are_told_apart_by_signatures():
    """400 copies of 400 shingles, all of them a little too far from each other: few pairs are tested on whole sets."""
    rng = np.random.default_rng(5)
    draw = lambda k: rng.integers(0, 1 << 48, k).astype(np.uint64)
    base, sets = draw(400), []
    for _ in range(400):
        k = int(rng.integers(60, 110))
        sets.append(np.unique(np.concatenate([rng.permutation(base)[k:], draw(k)])))
    sets += [sets[0][5:], sets[1][5:]]
    want = {(a, b) for b, y in enumerate(sets) for a, x in enumerate(sets[:b]) if near_dup.linked(x, y, 75)}
    tests, plain = [0], near_dup.linked

    def counted(*args):
        tests[0] += 1
        return plain(*args)

    near_dup.linked = counted
    try:
        got = near_dup.connect(sets, near_dup.Groups(len(sets)), 75)
    finally:
        near_dup.linked = plain
    assert components(got, range(len(sets))) == components(want, range(len(sets))) and {(0, 400), (1, 401)} <= want
    assert tests[0] < 4 * len(sets)


def test_frequent_shingles_are_counted_over_all_rows(spark, monkeypatch):
    """No sample and no length limit: exact counts, in one run of a task or in several, and the most frequent ones where a list would be too long."""
    from plumbline.llm.words import pack48

    rng = np.random.default_rng(3)
    common = [(int(x), n) for x, n in zip(rng.integers(0, 1 << 48, 9), [31, 32, 33, 63, 64, 100, 128, 200, 300], strict=True)]
    sets = [np.unique(np.concatenate([rng.integers(0, 1 << 48, 5000 if i < 40 else 20), [x for x, n in common if i < n]]).astype(np.uint64)) for i in range(6000)]
    rows = spark.createDataFrame([(bytearray(pack48(s << np.uint64(16))),) for s in sets], "set binary").repartition(7)
    want = sorted((x >> 16, n.bit_length() - 1) for x, n in common if n >= near_dup.FREQUENT)
    listed = lambda: [(int(k), int(v)) for k, v in zip(*near_dup.frequent_shingles(rows, 5), strict=True)]
    assert listed() == want
    monkeypatch.setattr(near_dup, "LISTED", 4)
    assert listed() == [x for x in want if x[1] >= 7]
    monkeypatch.setattr(near_dup, "RUN_KEYS", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array([pack48(s << np.uint64(16)) for s in sets[:300]], pa.binary())], names=["set"])
    (out,) = near_dup._count_keys(near_dup._key_rows([batch]))
    assert sorted(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)) == sorted((x >> 16, min(n, 300).bit_length() - 1) for x, n in common if n >= 32)
    key, level = (np.array(c) for c in zip(*want, strict=True))
    first = near_dup.prefix(sets[0], key.astype(np.uint32), level, 75)
    assert len(first) == len(sets[0]) - -(-75 * len(sets[0]) // 100) + 1 and not {x for x, n in common if n >= 32} & set(first.tolist())


def near_dup_set(text):
    from plumbline.llm.words import shingles, unpack48, pack48

    return unpack48(pack48(shingles(text)))


def test_near_copies_edges(spark):
    assert found(near_dup.near_components(data.documents(spark))) == near(data.ROWS)
    assert near_dup.near_components(data.empty(spark)).count() == 0
    kept = near_dup.keep_one(data.documents(spark))
    want = [x for x in near(data.ROWS) if x[0] == "None" or int(x[0]) == x[2]]
    assert kept.count() == len(want) and kept.columns == data.documents(spark).columns


def test_threshold_is_exact():
    a = np.arange(7, dtype=np.uint64)
    assert near_dup.linked(a[:6], a[:6], 75) and near_dup.linked(a[:3], a[:4], 75) and not near_dup.linked(a[:5], a, 75) and not near_dup.linked(a[:0], a[:0], 75)


def test_tree_prunes_no_linked_pair():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 1 << 60, rng.integers(20, 200)).astype(np.uint64)) for _ in range(12)]
    many = [np.unique(np.where(rng.random(len(b)) < 0.05, rng.integers(0, 1 << 60, len(b)).astype(np.uint64), b)) for b in base for _ in range(9)]
    w = 128
    signs = np.stack([near_dup.fold(near_dup.signature(s, max(w, near_dup.width_of(len(s)))), w) for s in many])
    n = np.array([len(s) for s in many])
    found = list(near_dup.tree_pairs(near_dup.Nodes(n, n, signs, signs), 75))
    pairs = {p for i, j in found for p in zip(i.tolist(), j.tolist())}
    linked = {(a, b) for b in range(len(many)) for a in range(b) if near_dup.linked(many[a], many[b], 75)}
    assert linked and linked <= pairs and len(pairs) < len(many) * (len(many) - 1) // 4


def test_components(spark, monkeypatch):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(400, 460)]
    want = components(links, {x for p in links for x in p})
    df = spark.createDataFrame(links, "u bigint, v bigint")
    for size in (1 << 20, 100):
        monkeypatch.setattr(graph, "TASK_LINKS", size)
        got = {r["node"]: r["component"] for r in graph.components(df).collect()}
        assert got == {k: v for k, v in want.items() if k in got} and all(want[k] == k for k in want if k not in got)


def brute(rows, least=0.93):
    good = [(i, k, np.array(v, float), lab) for k, (i, v, lab) in enumerate(rows) if v is not None and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    n, links = [0] * len(rows), []
    for a in range(len(good)):
        for b in range(a):
            (i, k, x, p), (j, m, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                n[k] += 1
                n[m] += 1
                links.append((i, j))
    c = components([p for p in links if None not in p], {r[0] for r in rows if r[0] is not None})
    return sorted((str(r[0]), n[k], c.get(r[0]), r[0] is not None and c[r[0]] == r[0]) for k, r in enumerate(rows))


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(12):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 15)):
            rows.append((len(rows), (centre + rng.normal(size=16) * 0.25).astype(np.float32).astype(float).tolist(), int(g % 3)))
    same = rows[0][1]
    rows += [(1000 + i, same, 0) for i in range(40)] + [(2000, [2 * x for x in same], 0), (2001, same, 1), (2002, same, None), (2003, None, 0), (2004, [0.0] * 16, 0), (2005, [float("nan")] * 16, 0), (2006, [float("inf")] + same[1:], 0), (2007, [None] + same[1:], 0), (2008, same[:8], 0), (2009, [], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    for interval in (512, 7):
        monkeypatch.setattr(vectors, "INTERVAL", interval)
        monkeypatch.setattr(vectors, "LEAF", 4)
        got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect())
        assert got == brute(rows)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_extreme_size(spark):
    rows = [(1, [1e-200, 1e-200], 0), (2, [1.0, 1.0001], 0), (3, [1e200, 1e200], 0), (4, [1e200, 1.0001e200], 0), (5, [5e-324, 0.0], 0), (6, [1.0, 0.1], 0), (7, [-1.0, 1.0], 0), (8, [3.0], 0), (9, [-0.0, 2.0], 0), (10, [0.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id bigint, embedding array<double>, label int, key string, class int, n int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8), 9: (1, 9), 10: (1, 9)}


def test_vectors_in_many_runs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(9, 12))
    rows = [(i, (centres[i % 9] + rng.normal(size=12) * 0.2).tolist(), i % 2) for i in range(260)]
    rows += [(1000 + i, rows[i % 3][1], 0) for i in range(60)] + [(2000 + i, rng.normal(size=5 + i % 20).tolist(), 0) for i in range(60)]
    monkeypatch.setattr(vectors, "INTERVAL", 5)
    monkeypatch.setattr(vectors, "RUN_BYTES", 1000)
    monkeypatch.setattr(vectors, "BASES", 2)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect())
    assert got == brute(rows)


def test_distant_intervals_are_skipped():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 6))
    x[:, 0] = np.where(np.arange(500) < 250, 5.0, -5.0)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = vectors.interval_links(x, x, u, u, 0.93, True)
    want = {(a, b) for a in range(500) for b in range(a + 1, 500) if u[a] @ u[b] >= 0.93}
    assert set(zip(i.tolist(), j.tolist())) == want
