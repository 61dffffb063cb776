"""Packing documents into sequences by bin completion over the histogram of piece lengths."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialise, ship_package, text_or_empty

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

#: Wastes of a filling that descents allow, and nodes of the search beyond them.
WASTES = (0, 1, 2, 3, 4, 6, 8, 10, 12, 16, 24, 32, 64, 128, 256)
NODES = 2000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n ids: whole if it fits, else full pieces after a shorter first one."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = [0, *range(first, n, capacity)] if first else [*range(0, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """A number of sequences below which no packing exists: for each k, pieces above capacity - k have a
    sequence each, those above half the capacity one each, and the room left in these can take of the pieces
    from k to half only so much (Martello and Toth)."""
    lengths = sorted(counts)
    of = lambda low, high, weight: sum((x if weight else 1) * counts[x] for x in lengths if low < x <= high)
    best = -(-of(0, capacity, True) // capacity)
    for k in {0, *(x for x in lengths if 2 * x <= capacity)}:
        alone, half = of(capacity - k, capacity, False), of(capacity // 2, capacity - k, False)
        room = half * capacity - of(capacity // 2, capacity - k, True)
        best = max(best, alone + half + max(0, -(-(of(k - 1, capacity // 2, True) - room) // capacity)))
    return best


def filling(room: int, counts: dict[int, int], waste: int) -> list[int]:
    """The filling of room with available pieces that takes the longest pieces first and wastes no more than
    waste, or than the least that is possible.

    It is not dominated within that waste: no other such filling has its pieces in longer ones. The sums
    that shorter lengths reach, a bit for each, say which branch leads to a filling, so none is taken back.
    """
    lengths = sorted(x for x in counts if x <= room)
    whole, reach = (1 << (room + 1)) - 1, [1]
    for x in lengths:
        sums, n, step = reach[-1], min(counts[x], room // x), 1
        while n > 0:
            step = min(step, n)
            sums |= (sums << (step * x)) & whole
            n -= step
            step *= 2
        reach.append(sums)
    allowed = max(waste, room - (reach[-1].bit_length() - 1))
    out, left = [], room
    for i in range(len(lengths) - 1, -1, -1):
        x, n = lengths[i], min(counts[lengths[i]], left // lengths[i])
        while n > 0:
            low = max(0, left - n * x - allowed)
            if reach[i] >> low & ((1 << (left - n * x - low + 1)) - 1):
                break
            n -= 1
        out += [x] * n
        left -= n * x
    return out


def _take(left: dict[int, int], pattern: tuple[int, ...]) -> tuple[dict[int, int], int]:
    """What is left after a pattern is repeated as often as its pieces last, and how often that is."""
    need = {x: pattern.count(x) for x in pattern}
    times = min(left[x] // n for x, n in need.items())
    return {x: n - times * need.get(x, 0) for x, n in left.items() if n > times * need.get(x, 0)}, times


def _fillings(left: dict[int, int], capacity: int, wastes) -> list[tuple[int, ...]]:
    """Fillings around the longest piece, one for each waste that is allowed, without repeats."""
    largest = max(left)
    rest = {x: n - (x == largest) for x, n in left.items() if n > (x == largest)}
    return list(dict.fromkeys((largest, *filling(capacity - largest, rest, w)) for w in wastes))


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (piece lengths, longest first) with how many sequences have them, for all pieces.

    Bin completion: a node of the search completes the longest piece that remains, with an undominated
    filling for each waste allowed, and repeats the pattern as often as its pieces last, so that every step
    uses up a length: the work does not grow with the number of pieces. Descents with one allowed waste
    give the incumbents, the first of them, with none, best-fit ones; then a depth-first search branches
    over the fillings. A node is pruned when its waste leaves no way to beat the incumbent, and the search
    ends when the incumbent meets lower_bound(). NODES bounds the depth-first search, which only decides
    how close to the bound the packing comes: all pieces are always placed.
    """
    start = {k: v for k, v in counts.items() if v > 0}
    if not start:
        return []
    bound, total = lower_bound(start, capacity), sum(k * v for k, v in start.items())
    best: list[tuple[tuple[int, ...], int]] = []
    fewest, best_waste = total + 1, 0  # a sequence holds a piece or more

    def wasted(pattern, times) -> int:
        return times * (capacity - sum(pattern))

    for allowed in WASTES:
        left, out, waste = start, [], 0
        while left and total + waste <= (fewest - 1) * capacity:
            pattern = _fillings(left, capacity, [allowed])[0]
            left, times = _take(left, pattern)
            out.append((pattern, times))
            waste += wasted(pattern, times)
        if not left and sum(n for _, n in out) < fewest:
            best, fewest, best_waste = out, sum(n for _, n in out), allowed
        if fewest == bound:
            return best
    wastes = [best_waste, *(w for w in WASTES if w != best_waste)]
    stack = [(start, (), 0)]
    for _ in range(NODES):
        if not stack or fewest == bound:
            break
        left, path, waste = stack.pop()
        if total + waste > (fewest - 1) * capacity:
            continue
        if not left:
            out = []
            while path:
                path, pattern, times = path
                out.append((pattern, times))
            best, fewest = out[::-1], sum(n for _, n in out)
            continue
        for pattern in reversed(_fillings(left, capacity, wastes)):
            rest, times = _take(left, pattern)
            stack.append((rest, (path, pattern, times), waste + wasted(pattern, times)))
    return best


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank, first sequence and offset of each run of pieces of that length."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for x in pattern:
            runs.setdefault(x, []).append((given.get(x, 0), sequence, offset))
            given[x] = given.get(x, 0) + times
            offset += x
        sequence += times
    return {x: tuple(np.array(v, np.int64) for v in zip(*r, strict=True)) for x, r in runs.items()}


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each document: its ids' place, number and checksum. Null texts are empty."""

    def pieces(batches):
        from plumbline.llm.tokens import encoder

        enc = encoder(tokenizer)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py()).astype("<u4")
                ids = np.append(ids, np.array([end_id], "<u4"))
                rows += [(i, k, a, n, zlib.crc32(ids[a : a + n])) for k, (a, n) in enumerate(cut(len(ids), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("bigint"), text_or_empty(F.col(text_col))).mapInArrow(pieces, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    Documents longer than capacity are cut, no others; sequences hold whole pieces. Only the histogram of
    piece lengths, capacity numbers at most, reaches the driver, where bin completion finds patterns of
    lengths and their numbers. A piece's rank among those of its length gives its place: tasks number their
    own pieces, and the first rank of each task and length comes from the tasks' counts. Rows with equal
    ids are separate documents; empty and null texts are one end id; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    pieces = materialise(tokenised_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(pack_histogram(counts, capacity)))
    # A lane is a hash of the document: its pieces are numbered by length within the lane.
    lanes = max(1, sum(counts.values()) // 200_000) * 16
    laned = pieces.withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(lanes)).cast("int"))
    lane_counts = laned.groupBy("length", "lane").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    firsts = lane_counts.select("length", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("length", "lane").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = laned.withColumn("nth", nth).join(firsts, ["length", "lane"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth") - 1).alias("rank"))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                first, sequence, offset = places.value[int(x)]
                here = length == x
                run = np.searchsorted(first, rank[here], "right") - 1
                seq[here], off[here] = sequence[run] + rank[here] - first[run], offset[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(seq), pa.array(off)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id bigint, offset bigint")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from plumbline.llm.common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
