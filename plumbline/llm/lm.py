"""Language-model scoring: a bigram model by deleted interpolation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import caches
from plumbline.llm.common import id_fold, input_bytes, materialise, ship_package, text_or_empty

#: Text of a block of documents, whose words are looked up together, and of a bucket of the counts.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
FOLDS, HELD_OUT, DELETED = 10, 0, 1
CONTEXTS = 16  # context-frequency buckets: unseen, then by powers of two
STEPS = 4  # estimates in an octave that expectation-maximisation tells apart
_END, _START = 0x5BF0A8B1457A3C11, 0x2545F4914F6CDD1D
_ONE, _M = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)


def _pack(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as a byte each, and those of 255 and more beside them."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype("<u8").tobytes()


def _unpack(small, large) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, "<u8").astype(np.int64)
    return out


def _sixes(keys: np.ndarray) -> bytes:
    """The low 48 bits: a bucket has the high ones in common, up to bits that tell no keys apart in practice."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def encode(ids: list, folds: list, words: list[np.ndarray]) -> bytes:
    """A block's documents: ids, null marks, folds, lengths, hashes of the distinct words, and each token as their numbers."""
    lengths = np.array([len(w) for w in words], "<i8")
    distinct, at = np.unique(np.concatenate(words), return_inverse=True)
    at = at.astype("<u2" if len(distinct) <= 1 << 16 else "<u4")
    head = np.array([len(ids), len(distinct), at.itemsize], "<i8")
    names = np.array([0 if i is None else i for i in ids], "<i8"), np.array([i is None for i in ids], np.uint8), np.array(folds, np.uint8)
    return b"".join(x.tobytes() for x in (head, *names, lengths, distinct.astype("<u8"), at))


class Block:
    """What encode() wrote, with the keys of its words (odd) and of the pairs of a word and the one before (even).

    words, pairs and contexts give, for each token, the place of its word, its pair and the word before
    among the sorted keys. The word before a document's first one is an end, as often as ends are starts.
    """

    def __init__(self, data):
        n, v, width = np.frombuffer(data, "<i8", 3).tolist()
        at = 24
        parts = []
        for kind, k in (("<i8", n), ("u1", n), ("u1", n), ("<i8", n), ("<u8", v)):
            parts.append(np.frombuffer(data, kind, k, at))
            at += parts[-1].nbytes
        self.ids, null, self.folds, self.lengths, hashes = parts
        self.null = null.astype(bool)
        token = np.frombuffer(data, f"<u{width}", -1, at)
        from plumbline.llm.words import mixed

        word_keys = mixed(hashes) | _ONE
        self.starts = np.cumsum(self.lengths) - self.lengths
        # The word before each token: its number, or v for a start.
        before = np.roll(token, 1).astype(np.int64)
        before[self.starts] = v
        code, pair_at = np.unique(before * v + token, return_inverse=True)
        first = np.append(hashes, np.uint64(_START))
        pair_keys = mixed(first[code // v] * _M + hashes[code % v]) & ~_ONE
        self.keys, places = np.unique(np.concatenate([word_keys, pair_keys]), return_inverse=True)
        self.words, self.pairs = places[:v][token], places[v:][pair_at]
        self.contexts = np.roll(self.words, 1)

    def counts(self) -> np.ndarray:
        """Of each key, how often the block's training documents have it."""
        train = np.repeat(self.folds != HELD_OUT, self.lengths).astype(float)
        return (np.bincount(self.words, train, len(self.keys)) + np.bincount(self.pairs, train, len(self.keys))).astype(np.int64)


def context_bucket(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.minimum(CONTEXTS - 1, 1 + np.log2(np.maximum(counts, 1)).astype(np.int64)), 0)


def estimates(pair, context, word, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates of a token after its context and by itself; 0 where there is no count."""
    return np.where(context > 0, pair / np.maximum(context, 1), 0.0), word / max(total, 1)


def learn_weights(bucket: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, times: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) of each context bucket by expectation-maximisation."""
    weights = np.tile([0.4, 0.4, 0.2], (CONTEXTS, 1))
    weights[0] = [0.0, 0.7, 0.3]
    for b in range(CONTEXTS):
        here = bucket == b
        if not here.any():
            continue
        p, n = np.stack([p2[here], p1[here], np.full(here.sum(), p0)], axis=1), times[here].astype(float)
        for _ in range(rounds):
            share = p * weights[b]
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
            weights[b] = n @ share / n.sum()
    weights = np.maximum(weights, [[0.0, 1e-6, 1e-6]])
    return weights / weights.sum(axis=1, keepdims=True)


def codes(p: np.ndarray) -> np.ndarray:
    """Estimates to a STEPS-th of a power of two; 0 for none."""
    return np.where(p > 0, 1 + np.round(-STEPS * np.log2(np.maximum(p, 1e-300))), 0).astype(np.int64)


def decoded(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 2.0 ** (-(code - 1) / STEPS), 0.0)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    A task's documents become blocks of BLOCK_BYTES of text, each token a number: written once, they are
    what all later steps read. A block asks once for each distinct word and pair in it, with its own
    training count, in a row for each bucket of the hashed keys; a bucket adds up the counts of all blocks
    and answers each in the order it asked, a byte a key. So no table of the vocabulary is broadcast or
    collected, and a frequent word or a row that is repeated many times reaches its bucket with a key per
    block. There are blocks * buckets rows, which is no more than keys that are asked for, but rows get
    short where the corpus has some 100,000 blocks. Keys are 48 bits and the bucket's own.

    Training documents are those whose fold (crc32 of the id as text, modulo 10) is not 0. Of them fold 1
    is deleted from the counts for which the mixture weights are learned: a histogram of its tokens over
    (context bucket, estimates to a fourth of a power of two), some 100,000 rows at most whatever the
    corpus, is all that reaches the driver. Scores use all training counts. Null and empty texts are one
    end token; without training documents every token is equally likely.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"), id_fold(F.col(id_col), FOLDS).alias("fold"))

    def deal(batches):
        from pyspark import TaskContext

        from plumbline.llm.words import word_hashes

        caches.only("words")
        number, end = TaskContext.get().partitionId() << 32, np.array([_END], np.uint64)
        held = {False: ([], [], []), True: ([], [], [])}  # by whether the documents are deleted
        size = {False: 0, True: 0}

        def block(deleted: bool) -> pa.RecordBatch:
            nonlocal number
            number += 1
            out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([deleted]), pa.array([encode(*held[deleted])], pa.binary())], names=["block", "deleted", "data"])
            held[deleted], size[deleted] = ([], [], []), 0
            return out

        for batch in batches:
            for i, text, fold in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text, deleted = text.as_py(), fold == DELETED
                for x, value in zip(held[deleted], (i, fold, np.append(word_hashes(text), end)), strict=True):
                    x.append(value)
                size[deleted] += len(text)
                if size[deleted] >= BLOCK_BYTES:
                    yield block(deleted)
        for deleted in held:
            if held[deleted][0]:
                yield block(deleted)

    blocks = materialise(rows.mapInArrow(deal, "block bigint, deleted boolean, data binary"), "lm-blocks")

    buckets = 1 << max(3, (input_bytes(docs) // BUCKET_BYTES).bit_length())
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    asked_schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("deleted", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary()), ("large", pa.binary())])

    def ask(batches):
        caches.only("none")
        for batch in batches:
            for number, deleted, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                b = Block(data.as_buffer())
                counts = b.counts()
                ends = np.searchsorted(b.keys, np.arange(1, buckets, dtype=np.uint64) << shift)
                parts = zip([0, *ends], [*ends, len(b.keys)], strict=True)
                out = [(k, number, deleted, _sixes(b.keys[a:z]), *_pack(counts[a:z])) for k, (a, z) in enumerate(parts) if z > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), asked_schema, strict=True)], schema=asked_schema)

    answer_schema = "block bigint, deleted boolean, bucket int, counts binary, large binary, kept binary, kept_large binary, vocabulary bigint, tokens bigint, kept_tokens bigint"

    def answer(t: pa.Table) -> pa.Table:
        from plumbline.llm.words import unpack48

        caches.only("none")
        number, deleted, bucket = t.column("block").to_pylist(), t.column("deleted").to_pylist(), t.column("bucket")[0].as_py()
        keys = [unpack48(k.as_buffer()) for k in t.column("keys")]
        counts = [_unpack(a.as_buffer(), b.as_buffer()) for a, b in zip(t.column("counts"), t.column("large"), strict=True)]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        own = np.concatenate(counts)
        total = np.bincount(inverse, own, len(distinct)).astype(np.int64)
        rest = np.bincount(inverse, own * np.repeat([not d for d in deleted], [len(k) for k in keys]), len(distinct)).astype(np.int64)
        word = distinct & _ONE == 1
        out, at = [], 0
        for b, d, k in zip(number, deleted, keys, strict=True):
            here = inverse[at : at + len(k)]
            at += len(k)
            out.append((b, d, bucket, *_pack(total[here]), *(_pack(rest[here]) if d else (None, None)), None, None, None))
        out.append((None, None, bucket, None, None, None, None, int((total[word] > 0).sum()), int(total[word].sum()), int(rest[word].sum())))
        types = [pa.int64(), pa.bool_(), pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 3]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=[f.split()[0] for f in answer_schema.split(", ")])

    asked = blocks.mapInArrow(ask, "bucket int, block bigint, deleted boolean, keys binary, counts binary, large binary")
    answers = materialise(asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, answer_schema), "lm-counts")
    sums = answers.filter("block IS NULL").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("vocabulary", "tokens", "kept_tokens"))).first()
    vocabulary, tokens, kept_tokens = (int(x) for x in sums)
    uniform = 1.0 / (vocabulary + 1)

    def counts_of(t: pa.Table, small: str, large: str) -> np.ndarray:
        t = t.sort_by("bucket")
        return np.concatenate([_unpack(a.as_buffer(), b.as_buffer()) for a, b in zip(t.column(small), t.column(large), strict=True)])

    def histogram(own: pa.Table, found: pa.Table) -> pa.Table:
        b, c = Block(own.column("data")[0].as_buffer()), counts_of(found, "kept", "kept_large")
        context = c[b.contexts]
        p2, p1 = estimates(c[b.pairs], context, c[b.words], kept_tokens)
        keys, times = np.unique(context_bucket(context) << 32 | codes(p2) << 16 | codes(p1), return_counts=True)
        return pa.table({"key": pa.array(keys), "times": pa.array(times.astype(np.int64))})

    n_blocks = blocks.groupBy("deleted").count().collect()
    n_deleted, n_all = sum(r["count"] for r in n_blocks if r["deleted"]), sum(r["count"] for r in n_blocks)
    there = answers.filter("block IS NOT NULL")

    def with_answers(own: DataFrame, found: DataFrame, n: int):
        tasks = max(1, n)
        return own.repartition(tasks, "block").groupBy("block").cogroup(found.repartition(tasks, "block").groupBy("block"))

    some = with_answers(blocks.filter("deleted"), there.filter("deleted").select("block", "bucket", "kept", "kept_large"), n_deleted)
    seen = some.applyInArrow(histogram, "key bigint, times bigint").groupBy("key").agg(F.sum("times").alias("times")).toArrow()
    key, times = (seen.column(c).to_numpy() for c in ("key", "times"))
    weights = learn_weights(key >> 32, decoded(key >> 16 & 0xFFFF), decoded(key & 0xFFFF), uniform, times)

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        b, c = Block(own.column("data")[0].as_buffer()), counts_of(found, "counts", "large")
        word, context = c[b.words], c[b.contexts]
        p2, p1 = estimates(c[b.pairs], context, word, tokens)
        mix = weights[context_bucket(context)]
        logs = np.log10(mix[:, 0] * p2 + mix[:, 1] * p1 + mix[:, 2] * uniform)
        base = np.log10((word + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
        add = lambda x: pa.array(np.add.reduceat(x, b.starts))
        n = len(b.lengths)
        return pa.table({"doc_id": pa.array(b.ids, mask=b.null), "held_out": pa.array(b.folds == HELD_OUT), "n_tokens": pa.array(b.lengths), "n_known": add((word > 0).astype(np.int64)), "train_tokens": pa.array(np.full(n, tokens)), "base_score": add(base), "score": add(logs)})

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return with_answers(blocks.drop("deleted"), there.select("block", "bucket", "counts", "large"), n_all).applyInArrow(score, schema)


def query(spark, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import table

    return score_documents(table(spark, sf_dir, "documents"))
