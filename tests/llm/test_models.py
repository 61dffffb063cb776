import hashlib
import math
import re
import zlib
from collections import Counter

import data
import numpy as np
import pytest

from plumbline.llm import lm, quality, secrets

DATA = "/root/testdata/sf0.001"


def base_spans(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]


def test_secrets(spark):
    names = ("assign", "access", "hex")
    rows = secrets.find_secrets(data.documents(spark), batch_bytes=200).collect()
    want = []
    for i, text, *_ in data.ROWS:
        s = base_spans(text or "")
        joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(s))
        want.append((i, *(sum(x[1] == k for x in s) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"])) for r in rows)
    assert sum(r["n_assign"] for r in rows) == 4 and secrets.find_secrets(data.empty(spark)).count() == 0


def test_all_spans_by_plain_search(spark):
    added = {"pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "jwt": r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "hub": r"gh[pousr]_[A-Za-z0-9]+"}
    names = ["assign", "access", "hex", *added]
    texts = ["x -----BEGIN RSA PRIVATE KEY----- y", "-----BEGIN PRIVATE KEY-----", "t eyJ" + "a" * 30 + ".eyJ" + "b" * 9 + ".c-_ eyJa.eyJb.c", "ghp_" + "Aa1" * 14 + " ghx_" + "a" * 40 + " gho_short", "é😀 secret = ghs_" + "0" * 40 + "\nAKIA" + "Q" * 16, None, ""]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id bigint, text string, spans string, n_hex int, base_sha256 int")
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(df).collect()}
    for i, t in enumerate(texts):
        spans = base_spans(t or "")
        for k, (name, pattern) in enumerate(added.items(), 3):
            spans += [(m.start(), k, m.end()) for m in re.finditer(pattern, t or "") if name == "pem" or len(m[0]) >= 40]
        assert got[i] == ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
    assert sum(len(x) > 0 for x in got.values()) == 5


def test_patterns_are_read_as_they_are():
    tri = secrets.trigram_query
    assert tri("abcd") == ("all", ("abc", "bcd")) and tri("ab?cd") == ("any", (("all", ("abc", "bcd")), "acd")) and tri("(?:abc|xyz)+[0-9]*") == ("any", ("abc", "xyz"))
    assert tri("a{3}b") is None and tri("(foo){3,}") == "foo"
    assert tri(r"\d+.x\x41BC") == ("all", ("xab", "abc")) and tri("(a|b)*") is None
    for bad in ("[^a]bcd", "(?i:abc)"):
        with pytest.raises(ValueError):
            tri(bad)


def test_trigram_queries_miss_no_match():
    rng = np.random.default_rng(5)
    texts = ["xx" + s + "yy" for s in ("PassWd='abcdefghijklmnop'", "api_key: qqqqqqqqqqqqqqq", "AKIA" + "Z" * 16, "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "ghp_" + "a1" * 20, "eyJ" + "a" * 20 + ".eyJ" + "b" * 20 + ".cc", "0123456789abcdef")]
    texts += ["".join(rng.choice(list("apikey_tokensecret=: AKI-"), 40)) for _ in range(200)]
    asked = [secrets.trigram_query(r[1]) for r in secrets.RULES]
    assert asked[2] is None and all(q is not None for i, q in enumerate(asked) if i != 2)
    index = secrets.Index(set().union(*map(secrets._trigrams, asked)))
    index.build([t.encode() for t in texts])
    for rule, query in zip(secrets.RULES, asked):
        found = set(index.find(query).tolist())
        assert {i for i, t in enumerate(texts) if re.search(rule[1], t)} <= found
        assert query is None or len(found) < len(texts)


def test_language_model_counts_and_base(spark):
    rows = lm.score_documents(data.documents(spark)).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    c = Counter(x for i, t, *_ in data.ROWS if fold(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t)), 4)) for i, t, *_ in data.ROWS)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in rows) == want
    assert {r["train_tokens"] for r in rows} == {n} and all(r["held_out"] == (fold(r["doc_id"]) == 0) and r["score"] < 0 for r in rows)
    assert lm.score_documents(data.empty(spark)).count() == 0


def interpolated(rows):
    """log10 probabilities of texts by plain counting and expectation-maximisation over single tokens."""
    tokens = [(zlib.crc32(("" if i is None else str(i)).encode()) % 10, [*(t or "").encode().lower().split(), None]) for i, t, *_ in rows]
    one, two = ({k: Counter() for k in ("all", "kept")} for _ in range(2))
    for fold, words in tokens:
        for kind in [k for k, ok in (("all", fold != 0), ("kept", fold not in (0, 1))) if ok]:
            one[kind].update(words)
            two[kind].update(zip(["start", *words[:-1]], words))
    uniform = 1 / (len(one["all"]) + 1)

    def parts(kind, before, word):
        context = one[kind][None if before == "start" else before]
        bucket = min(15, 1 + int(math.log2(context))) if context else 0
        return bucket, two[kind][before, word] / context if context else 0.0, one[kind][word] / max(1, sum(one[kind].values()))

    rounded = lambda p: 2.0 ** (-np.round(-4 * math.log2(p)) / 4) if p else 0.0
    seen = [parts("kept", b, w) for fold, words in tokens if fold == 1 for b, w in zip(["start", *words[:-1]], words)]
    weights = {}
    for bucket in range(16):
        mine, m = [(rounded(p2), rounded(p1), uniform) for b, p2, p1 in seen if b == bucket], [0.4, 0.4, 0.2] if bucket else [0.0, 0.7, 0.3]
        for _ in range(40 if mine else 0):
            shares = [[a * b / sum(x * y for x, y in zip(p, m)) for a, b in zip(p, m)] for p in mine]
            m = [sum(s[k] for s in shares) / len(shares) for k in range(3)]
        m = [m[0], max(m[1], 1e-6), max(m[2], 1e-6)]
        weights[bucket] = [x / sum(m) for x in m]
    out = []
    for _, words in tokens:
        terms = [parts("all", b, w) for b, w in zip(["start", *words[:-1]], words)]
        out.append(sum(math.log10(sum(x * y for x, y in zip(weights[b], (p2, p1, uniform)))) for b, p2, p1 in terms))
    return out


@pytest.mark.parametrize("size", [1 << 24, 300])
def test_language_model_scores_by_brute_force(spark, size, monkeypatch):
    """A third of the rows are one row, repeated."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", size)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["a", "B", "b", "cc", "d", "e"], rng.integers(0, 30), p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.1]))) for i in range(60)]
    rows += [(77, "a cc d a")] * 30 + [(None, "a e"), (91, None)]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    want = sorted((str(r[0]), round(x, 6)) for r, x in zip(rows, interpolated(rows)))
    for a, b in zip(sorted((str(r["doc_id"]), round(r["score"], 6)) for r in got), want, strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-5


def test_language_model_is_a_distribution_and_beats_the_base(spark):
    rows = lm.score_documents(spark.read.parquet(f"{DATA}/documents.parquet")).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    weights = lm.learn_weights(np.array([0, 3, 3]), np.array([0.0, 0.5, 0.0]), np.array([0.1, 0.1, 0.0]), 0.001, np.array([5, 8, 2]))
    assert np.allclose(weights.sum(axis=1), 1) and weights[3, 0] > weights[3, 1] and (weights[:, 2] > 0).all()


def test_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality.score_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in found]
    assert sum(right) / len(right) > 0.9 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0.5 < kept.count() / docs.count() < 1


def test_quality_by_brute_force():
    """The hinge loss over dense vectors: descent closes the duality gap, and scores are those of dense products."""
    rng = np.random.default_rng(2)
    vocabulary = [["good", "plain", "text", "here", "a"], ["###", "BUY", "x9", "a", "!!"]]
    texts = [" ".join(rng.choice(vocabulary[i % 2 if rng.random() < 0.9 else 1 - i % 2], rng.integers(1, 12))) for i in range(50)]
    y = np.array([1 - i % 2 for i in range(50)])
    rows = [quality.features(t) for t in texts]
    names = np.unique(np.concatenate(rows))
    dense = np.array([np.isin(names, r) for r in rows], float)
    train = np.flatnonzero(np.arange(50) % 5 != 4)
    sign = np.where(y > 0, 1.0, -1.0)
    count = {s: 1 + dense[train][sign[train] == s].sum(axis=0) for s in (1.0, -1.0)}
    rest = quality.DIMS - len(names)
    ratio = np.log(count[1.0] / (count[1.0].sum() + rest)) - np.log(count[-1.0] / (count[-1.0].sum() + rest))
    ratio[names == 0] = 1.0
    x = dense * ratio
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sparse = {i: x[i][dense[i] > 0] for i in range(50)}
    w, alpha = quality.descend(rows, sparse, sign, train, 1.0, 400, np.random.default_rng(3))
    w = w[names]
    assert np.allclose(w, (alpha * sign) @ x) and alpha.min() >= 0 and alpha.max() <= 1
    primal, dual = w @ w / 2 + np.maximum(0, 1 - sign[train] * (x[train] @ w)).sum(), alpha.sum() - w @ w / 2
    assert 0 <= primal - dual + 1e-9 and primal - dual < 0.01 * primal

    w, _ = quality.descend(rows, sparse, sign, train, 1.0, 8, np.random.default_rng(3))
    w = np.where(np.abs(w[names]) < 1e-9, 0, w[names])
    w = 0.75 * w + 0.25 * np.abs(w).sum() / np.count_nonzero(w) * np.sign(w)
    margins = x @ w
    check = np.flatnonzero(np.arange(50) % 5 == 4)
    a, b = quality._logistic(margins[check], y[check].astype(float))
    score = quality.Scorer(quality.fit(rows, y))
    assert np.allclose([score(t) for t in texts], 1 / (1 + np.exp(-(a * margins + b))), atol=1e-9)


def test_quality_shapes_are_of_whole_words():
    small, signs = (set(quality.features("A" * 64 + x).tolist()) for x in ("b" * 64, "#!" * 32))
    assert len(small - signs) > 1 and len(signs - small) > 1  # more than the hash of the word


def test_quality_reads_no_held_out_label(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "!!! ### $$$", i % 2) for i in range(200)], "doc_id bigint, text string, y int")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = spark.createDataFrame([(i, (1 - i % 2) if held(i) else i % 2) for i in range(200)], "doc_id bigint, quality int")
    for r in quality.score_quality(docs, labels).collect():
        assert r["predicted"] == r["doc_id"] % 2 and r["held_out"] == held(r["doc_id"])


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (None, 1)]])
def test_quality_edges(spark, labels):
    df = spark.createDataFrame(labels, "doc_id bigint, quality int")
    rows = quality.score_quality(data.documents(spark), df).collect()
    assert len(rows) == len(data.ROWS) and len({r["score"] for r in rows}) == 1
    assert quality.score_quality(data.empty(spark), df).count() == 0
