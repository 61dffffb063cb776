"""Token-id files: one concatenated id array and Elias-Fano encoded document boundaries."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import hinted, input_bytes, materialise, scratch_path, ship_package, text_or_empty

MAGIC = b"PLTOK1\0\0"
#: magic, documents, ids, bytes of an id, low bits, bytes of: doc ids, low part, high part, select samples.
HEADER = struct.Struct("<8sQQBB6xQQQQ")
RUN = 4096  # parts whose files' places are summed up together
SAMPLE = 256  # every so many-th one of the high part has its position stored


#: The place of the n-th set bit of each byte.
_NTH_BIT = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[:8] for b in range(256)], np.int64)


class EliasFano:
    """A non-decreasing sequence of n numbers up to top in n * (2 + log2(top / n)) bits, about; select(i) is the i-th."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if bits and n:
            parts = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(parts.astype(np.uint8).ravel(), bitorder="little")
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        ones[at] = 1
        return cls(n, bits, low, np.packbits(ones, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th number, from the sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, seen = int(self.samples[i // SAMPLE]), i // SAMPLE * SAMPLE
        byte = at >> 3
        bits = int(self.high[byte]) >> (at & 7) << (at & 7)
        while seen + bits.bit_count() <= i:
            seen += bits.bit_count()
            byte += 1
            bits = int(self.high[byte])
        for _ in range(i - seen):
            bits &= bits - 1
        place = (byte << 3) + (bits & -bits).bit_length() - 1
        start = i * self.low_bits
        low = int.from_bytes(self.low[start >> 3 : (start + self.low_bits + 7) >> 3].tobytes(), "little") >> (start & 7)
        return (place - i) << self.low_bits | low & ((1 << self.low_bits) - 1)

    def select_all(self, i: np.ndarray) -> np.ndarray:
        """select for many numbers at once: the byte of each one's bit by the sums of the bytes' bits, its place there from a table."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return i
        if i.min() < 0 or i.max() >= self.n:
            raise IndexError("select_all")
        upto = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)
        byte = np.searchsorted(upto, i, side="right")
        nth = i - (upto[byte] - np.bitwise_count(self.high[byte]))
        out = ((byte << 3) + _NTH_BIT[self.high[byte], nth] - i) << self.low_bits
        if self.low_bits:
            at = i * self.low_bits
            low = np.concatenate([self.low, np.zeros(8, np.uint8)])
            words = np.zeros(len(i), np.uint64)
            for k in range((self.low_bits + 14) // 8):
                words |= low[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
            out |= ((words >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)
        return out

    def decode(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits and self.n:
            parts = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= (parts.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out


def dump(doc_ids: list[int | None], documents: list[np.ndarray], dtype: np.dtype) -> bytes:
    """One file: header, document ids (a null one is flagged), Elias-Fano ends of documents, ids."""
    ends = np.cumsum([len(d) for d in documents], dtype=np.uint64) if documents else np.zeros(0, np.uint64)
    ef = EliasFano.encode(ends)
    names = np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes() + np.packbits(np.array([i is None for i in doc_ids], np.uint8), bitorder="little").tobytes()
    head = HEADER.pack(MAGIC, len(documents), int(ends[-1]) if documents else 0, dtype.itemsize, ef.low_bits, len(names), ef.low.nbytes, ef.high.nbytes, ef.samples.nbytes)
    return b"".join([head, names, ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes(), *(d.astype(dtype, copy=False).tobytes() for d in documents)])


class TokenFile:
    """A file's documents by number, without reading the others; ids are not copied."""

    def __init__(self, data):
        magic, self.n, self.n_ids, width, low_bits, n_names, n_low, n_high, n_samples = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        part, at = np.frombuffer(data, np.uint8), HEADER.size
        names, at = part[at : at + n_names], at + n_names
        low, at = part[at : at + n_low], at + n_low
        high, at = part[at : at + n_high], at + n_high
        samples, at = part[at : at + n_samples].tobytes(), at + n_samples
        self.null = np.unpackbits(names[8 * self.n :], bitorder="little")[: self.n].astype(bool)
        self.doc_ids = names[: 8 * self.n].tobytes()
        self.doc_ids = np.frombuffer(self.doc_ids, "<i8")
        self.ends = EliasFano(self.n, low_bits, low, high, np.frombuffer(samples, "<u4"))
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, at)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def __getitem__(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.ids[a:b]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 12 << 20) -> None:
    """Write every text's ids and an end id in files part-P-K.tok under path, in ascending id order over all files.

    A range partition (by id, then a hash of the text for equal ids; null ids first) becomes a file or,
    above file_bytes of text, several. A file is written under a task's own name and then renamed, so a
    retried task or a lost executor leaves one whole file. Files are ordered by the numbers P and K; the
    table _index beside them has each one's name, P, K, documents, ids and the ids of all files before it,
    so that no file is opened for its place. path is a folder that all executors see.
    """
    ship_package(docs.sparkSession)
    n, size = docs.count(), input_bytes(docs)
    rows = docs.select(F.col(id_col).cast("bigint").alias("i"), text_or_empty(F.col(text_col)).alias("t")).withColumn("h", F.xxhash64("t"))
    parts = max(1, -(-size // file_bytes))
    ordered = rows.repartitionByRange(parts, F.col("i").asc_nulls_first(), "h").sortWithinPartitions(F.col("i").asc_nulls_first(), "h")

    def write(batches):
        import uuid

        from pyarrow import fs as pafs
        from pyspark import TaskContext

        from plumbline.llm.tokens import encoder

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        dtype = enc.dtype if end_id < 1 << (8 * enc.dtype.itemsize) else np.dtype("<u4")
        files, root = pafs.FileSystem.from_uri(path)
        ids, found, held, k = [], [], 0, 0
        index: list[tuple] = []

        def flush() -> None:
            nonlocal ids, found, held, k
            index.append((f"part-{part}-{k}.tok", part, k, len(ids), sum(map(len, found))))
            name = f"{root}/{index[-1][0]}"
            files.create_dir(root, recursive=True)
            with files.open_output_stream(own := f"{root}/_{uuid.uuid4().hex}") as out:
                out.write(dump(ids, found, dtype))
            files.move(own, name)
            ids, found, held, k = [], [], 0, k + 1

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids.append(i)
                found.append(np.append(enc.encode(text).astype(dtype, copy=False), np.array([end_id], dtype)))
                held += len(text)
                if held >= 2 * file_bytes:
                    flush()
        if ids:
            flush()
        if index:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["name", "part", "k", "documents", "n"])

    written = materialise(ordered.mapInArrow(write, "name string, part bigint, k bigint, documents bigint, n bigint"), "token-index")
    # Sums of runs of parts, then of the files within a run: no task sees the index of all files.
    run = F.floor(F.col("part") / RUN)
    runs = written.groupBy(run.alias("run")).agg(F.sum("n").alias("of_run"))
    runs = runs.select("run", F.coalesce(F.sum("of_run").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("of_runs"))
    within = Window.partitionBy("run").orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)
    placed = written.withColumn("run", run).withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(runs, "run")
    placed.select("name", "part", "k", "documents", "n", (F.col("of_runs") + F.col("within")).alias("before")).write.mode("overwrite").parquet(f"{path}/_index")
    done = written.agg(F.sum("documents")).first()[0] or 0
    if done != n:
        raise RuntimeError(f"{done} of {n} documents written")


def read_token_files(spark, path: str) -> DataFrame:
    """A row for each document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32.

    Each document's place in its file comes from the select structure of the file's boundaries.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tok").load(path)
    schema = "name string, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"

    def read(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = TokenFile(memoryview(data.as_buffer()))
                ends = f.ends.select_all(np.arange(f.n))
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if f.n else ends
                crcs = [zlib.crc32(f.ids[a:b].astype("<u4")) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.rpartition("/")[2]] * f.n, pa.string()), pa.array(f.doc_ids, pa.int64(), mask=f.null), pa.array(starts), pa.array(ends - starts), pa.array(crcs, pa.int64())],
                    names=["name", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = files.select("path", "content").mapInArrow(read, schema)
    index = spark.read.schema("name string, before bigint").parquet(f"{path}/_index")
    return rows.join(hinted(index), "name").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from plumbline.llm.common import table

    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path)
