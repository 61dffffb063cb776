"""Quality classifier: a linear support-vector machine over n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import caches
from plumbline.llm.common import id_fold, ship_package, text_or_empty

DIMS = 1 << 20
#: Labelled rows that the classifier is fitted on, at most: those first by a hash of the id.
SAMPLE = 8000
#: Characters of a word that one shape is of; a longer word has a shape for each piece of it.
PIECE = 64
REJECT = 0.3
_RUNS = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|[^\x00-\x7f]+|[^A-Za-z0-9]")
_KINDS = re.compile(r"[A-Z]|[a-z]|[0-9]|[^\x00-\x7f]")


class _Words(dict):
    """Of a word: a hash of it lower-cased and one of the shape of its first PIECE characters. Emptied when full."""

    def __missing__(self, word: str) -> tuple[int, int]:
        runs = [r if not _KINDS.match(r) else "A" if r[0].isupper() else "0" if r[0].isdigit() else "a" for r in _RUNS.findall(word[:PIECE])]
        shape = "".join(r for i, r in enumerate(runs) if i == 0 or r != runs[i - 1])
        if len(self) > 200_000:
            self.clear()
        found = self[word] = (zlib.crc32(word.lower().encode()), zlib.crc32(shape.encode(), 7))
        return found


_WORDS = _Words()
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(*parts: np.ndarray, tag: int) -> np.ndarray:
    h = np.full(len(parts[0]), tag, np.uint64)
    for p in parts:
        h = (h ^ p) * _M
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(12)) % np.uint64(DIMS - 1) + np.uint64(1)


def terms(text: str) -> np.ndarray:
    """Indicators of a text, as numbers below DIMS, some more than once; 0 is in every text.

    They are n-grams: words and pairs of words, lower-cased; shapes (runs of capitals, small letters,
    digits and each sign) of one, two and three words, a word longer than PIECE counting as its pieces; and whether a word repeats the one before, or the
    one two places before, alone and in pairs.
    """
    words = text.split()
    if not words:
        return np.zeros(1, np.uint32)
    pairs = np.fromiter(map(_WORDS.__getitem__, words), np.dtype((np.uint64, 2)), len(words))
    w, s = pairs[:, 0], pairs[:, 1]
    if max(map(len, words)) > PIECE:
        s = np.fromiter((_WORDS[x[a : a + PIECE]][1] for x in words for a in range(0, len(x), PIECE)), np.uint64)
    out = [np.zeros(1, np.uint64), _mix(w, tag=1), _mix(s, tag=3)]
    if len(w) > 1:
        same = (w[1:] == w[:-1]).astype(np.uint64)
        out += [_mix(w[:-1], w[1:], tag=2), _mix(same, tag=6)]
    if len(w) > 2:
        out += [_mix(same[:-1], same[1:], tag=7)]
    if len(s) > 1:
        out += [_mix(s[:-1], s[1:], tag=4)]
    if len(s) > 2:
        out += [_mix(s[:-2], s[1:-1], s[2:], tag=5)]
    return np.concatenate(out).astype(np.uint32)


def features(text: str) -> np.ndarray:
    """The distinct indicators of a text, sorted."""
    return np.unique(terms(text))


def descend(rows, x, sign: np.ndarray, train: np.ndarray, cost: float, epochs: int, random) -> tuple[np.ndarray, np.ndarray]:
    """Weights and dual variables of the hinge loss by dual coordinate descent; rows x are of length 1, so the diagonal is 1."""
    w, alpha = np.zeros(DIMS), np.zeros(len(sign))
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(train):
            gradient = sign[i] * (w[rows[i]] @ x[i]) - 1
            new = min(max(alpha[i] - gradient, 0.0), cost)
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * sign[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, alpha


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, epochs: int = 8, keep: float = 0.25, seed: int = 3) -> np.ndarray:
    """Weights by feature, and two numbers that turn a margin into a probability, all in one array.

    Ratios and the machine learn from four fifths of the rows; a logistic curve over the margins of the
    last fifth gives probabilities. Without rows of both classes every score is the share of label 1 (0.5
    without rows).
    """
    weights = np.zeros(DIMS + 2, np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    weights[-1] = np.log(share / (1 - share)) if len(y) else 0.0
    held = np.arange(len(y)) % 5 == 4
    train = np.flatnonzero(~held)
    if len(train) == 0 or y[train].min() == y[train].max():
        return weights
    sign = np.where(y > 0, 1.0, -1.0)
    counts = {k: np.ones(DIMS) for k in (-1.0, 1.0)}
    for i in train:
        counts[sign[i]][rows[i]] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    ratio[0] = 1.0
    x = {i: ratio[rows[i]] for i in train}
    x = {i: v / max(np.sqrt(v @ v), 1e-12) for i, v in x.items()}
    w, _ = descend(rows, x, sign, train, cost, epochs, np.random.default_rng(seed))
    w[np.abs(w) < 1e-9] = 0.0  # what rounding leaves of zeros has no sign
    w = (1 - keep) * w + keep * np.abs(w).sum() / max(1, np.count_nonzero(w)) * np.sign(w)
    weights[:DIMS] = w * ratio
    norms = np.abs(ratio)
    check = np.flatnonzero(held) if held.any() and len(set(y[held])) > 1 else train
    m = np.array([margin(weights, norms, rows[i]) for i in check])
    a, b = _logistic(m, y[check].astype(float))
    # A margin is scaled by its row's length, which needs the ratios: they are kept beside the weights.
    weights[-2], weights[-1] = a, b
    return np.concatenate([weights, norms])


def margin(weights: np.ndarray, norms: np.ndarray, row: np.ndarray) -> float:
    n = norms[row]
    return float(weights[row].sum() / max(np.sqrt(n @ n), 1e-12))


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1) by Newton's method, with targets drawn in a little so that separable data stay finite."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 1e-6 * a, (p - t).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * m * m).sum() + 1e-6, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 10 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return a, b


class Scorer:
    """Scores of texts by one model. A place for each feature tells the first of its repeats, so none is sorted."""

    def __init__(self, model: np.ndarray):
        self.weights, self.norms, self.slope, self.offset = model[:DIMS], None, model[DIMS], model[DIMS + 1]
        if len(model) > DIMS + 2:
            self.norms = model[DIMS + 2 :] ** 2
        self.last = np.zeros(DIMS, np.int32)

    def __call__(self, text: str) -> float:
        z = self.offset
        if self.norms is not None:
            row = terms(text)
            order = np.arange(len(row), dtype=np.int32)
            self.last[row] = order
            row = row[self.last[row] == order]
            z += self.slope * self.weights[row].sum() / max(np.sqrt(self.norms[row].sum()), 1e-12)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train_model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> np.ndarray:
    """The model of SAMPLE labelled rows at most, whose fold is not 0, fitted in one task of that bounded size."""
    ship_package(docs.sparkSession)
    labelled = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (id_fold(F.col("_id"), 5) != 0))
    chosen = labelled.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(F.col(text_col)).alias("_t")).join(F.broadcast(chosen), "_id")  # at most `sample` rows of two numbers

    def extract(batches):
        caches.only("quality")
        for batch in batches:
            found = [features(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["id", "y", "f"])

    def train(t: pa.Table) -> pa.Table:
        order = np.argsort([zlib.crc32(str(i).encode()) for i in t.column("id").to_pylist()], kind="stable")
        y = t.column("y").to_numpy()[order]
        f = t.column("f")
        model = fit([np.frombuffer(f[int(i)].as_buffer(), np.uint32) for i in order], y)
        return pa.table({"model": pa.array([model.astype(np.float32).tobytes()], pa.binary())})

    # Should an id be repeated in docs, its rows beyond the sample's size are left out of the fit.
    bounded = rows.mapInArrow(extract, f"id {docs.schema[id_col].dataType.simpleString()}, y int, f binary").orderBy(F.xxhash64("id"), F.xxhash64("f")).limit(sample)
    fitted = bounded.groupBy(F.lit(0).alias("g")).applyInArrow(train, "model binary").first()
    return np.frombuffer(fitted[0], np.float32).astype(np.float64) if fitted else fit([], np.zeros(0))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, score (0 to 1) and predicted (1 if score >= REJECT).

    Labels of fold 0 (crc32 of the id as text, modulo 5) are never read; null labels and ids are ignored,
    an id with two labels counts as the lower. Null and empty texts are scored by the constant feature.
    The model is the only thing broadcast: 2 * DIMS numbers, whatever the input's size.
    """
    model = docs.sparkSession.sparkContext.broadcast(train_model(docs, labels, id_col, text_col, label_col, sample).astype(np.float32))

    def score(batches):
        caches.only("quality")
        score_text = Scorer(model.value.astype(np.float64))
        for batch in batches:
            scores = pa.array([score_text(t.as_py()) for t in batch.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("bigint"), (id_fold(F.col(id_col), 5) == 0), text_or_empty(F.col(text_col)))
    scored = rows.mapInArrow(score, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs whose text scores REJECT or more, with their columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(train_model(docs, labels, id_col, text_col, label_col, sample).astype(np.float32))
    at = docs.columns.index(text_col)

    def keep(batches):
        caches.only("quality")
        score_text = Scorer(model.value.astype(np.float64))
        for batch in batches:
            yield batch.filter(pa.array([score_text(t.as_py() or "") >= REJECT for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import table

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
