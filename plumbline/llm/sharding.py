"""Sharding by minimax contiguous partition, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialise, text_or_empty

#: Bits of a group's hash that make the first bins, and those that each refinement adds.
BITS, FINER = 16, 8
#: Slots are numbered in so many pieces of each shard.
PIECES = 4096


def _cuts(bins: DataFrame, shards: int, capacity: int | None = None) -> DataFrame:
    """One row: the least capacity that can be (low), the capacity, and the bins at which the second shard and those after it begin.

    bins has bin and bytes, and is bounded. A binary search finds the smallest capacity for which
    greedy filling in bin order needs no more than shards shards, unless one is given; the cuts are made
    at that capacity.
    """
    greedy = """aggregate(sizes, struct(0L AS held, 1 AS used),
        (s, x) -> if(s.held + x > {cap}, struct(x AS held, s.used + 1 AS used), struct(s.held + x AS held, s.used AS used)))"""
    one = bins.agg(F.array_sort(F.collect_list(F.struct(F.col("bin").cast("bigint").alias("bin"), F.col("bytes").cast("bigint").alias("bytes")))).alias("b"))
    one = one.selectExpr("transform(b, x -> x.bytes) AS sizes", "transform(b, x -> x.bin) AS ids")
    share = f"cast(ceil(aggregate(sizes, 0L, (a, x) -> a + x) / {shards}.0D) AS bigint)"
    one = one.selectExpr("*", f"{share} AS share", f"greatest(coalesce(array_max(sizes), 0L), {share}) AS low", "aggregate(sizes, 0L, (a, x) -> a + x) AS high")
    step = f"""aggregate(sequence(1, 63), struct(low AS lo, greatest(low, high) AS hi), (r, i) ->
        if(r.lo >= r.hi, r, transform(array(r.lo + (r.hi - r.lo) div 2L), mid ->
            if({greedy.format(cap='mid')}.used <= {shards}, struct(r.lo AS lo, mid AS hi), struct(mid + 1L AS lo, r.hi AS hi)))[0])).hi"""
    one = one.selectExpr("sizes", "ids", "share", f"{step if capacity is None else f'{capacity}L'} AS capacity")
    cut = """aggregate(arrays_zip(ids, sizes), struct(0L AS held, cast(array() AS array<bigint>) AS cuts),
        (s, x) -> if(s.held + x.sizes > capacity, struct(x.sizes AS held, concat(s.cuts, array(x.ids)) AS cuts), struct(s.held + x.sizes AS held, s.cuts AS cuts))).cuts"""
    return one.selectExpr("share", "capacity", f"{cut} AS cuts")


def group_cuts(rows: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest largest shard over contiguous groups, and the keys at which the second shard and those after it begin.

    rows has key, which a group shares and whose order is the groups' order, and size. Bins of keys give an
    upper bound of the capacity. For any capacity between it and the least that can be, the k-th cut lies
    between where filling whole bins at the least one puts it and k times the upper bound. So only bins
    there are taken apart, by FINER more bits, until they are single groups: then the search over them is the
    search over all groups. What the search holds is bounded by the bins and the shards.
    """
    rows = rows.select(F.col("key").bitwiseXOR(F.lit(-(2**63))).alias("u"), "key", "size")  # u's bits are in the order of key

    def binned(rows: DataFrame, bits: int) -> DataFrame:
        bins = rows.groupBy(F.shiftrightunsigned("u", 64 - bits).alias("top")).agg(F.sum("size").alias("bytes"), F.min("key").alias("bin"), F.max("key").alias("last"))
        return bins.select("top", "bytes", "bin", "last")

    bits = BITS
    bins = materialise(binned(rows, bits), "shard-bins")
    while True:
        found = _cuts(bins, shards).first()
        capacity, cuts = found["capacity"] or 0, list(found["cuts"] or [])  # shards - 1 numbers at most
        largest = bins.filter("bin = last").agg(F.max("bytes")).first()[0] or 0
        least = max(found["share"] or 0, largest)
        if bits >= 64 or least >= capacity:
            return capacity, cuts
        early = list(_cuts(bins, shards, least).first()["cuts"])[: shards - 1]
        begin = F.coalesce(F.sum("bytes").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        near = F.lit(False)
        for k, cut in enumerate(early, 1):
            near = near | ((F.col("bin") >= cut) & (F.col("begin") <= k * capacity))
        placed = materialise(bins.withColumn("begin", begin).withColumn("near", near & (F.col("bin") < F.col("last"))), "shard-bins")
        apart = placed.filter("near").select("top")
        if not apart.limit(1).count():
            return capacity, cuts
        # At most as many bins as all cuts have nearby.
        finer = binned(rows.join(F.broadcast(apart), F.shiftrightunsigned("u", 64 - bits) == apart["top"]).drop("top"), min(64, bits + FINER))
        bits = min(64, bits + FINER)
        bins = materialise(placed.filter("NOT near").select("top", "bytes", "bin", "last").unionByName(finer), "shard-bins")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard added; clashing columns are replaced.

    Law `bytes`: sizes (UTF-8 bytes plus 1, null text: 1) are near equal. Rows with equal texts stay
    together: their groups (by the text's 64-bit hash) are ordered by that hash and split contiguously
    with the smallest possible largest shard (see group_cuts); a group larger than a shard's share has
    a shard to itself. Null and empty texts are one group. Slots number each shard's
    rows from 0, in the order of a hash of id and text, then id; rows equal in both are interchangeable.
    """
    text = text_or_empty(F.col(text_col))
    rows = docs.withColumn("size", (F.octet_length(text) + F.lit(1)).cast("bigint"))
    rows = rows.withColumns({"_key": F.xxhash64(text), "text_crc32": F.crc32(text).cast("bigint"), "_hash": F.xxhash64(F.col(id_col), text)})
    _, cuts = group_cuts(rows.select(F.col("_key").alias("key"), "size"), shards)
    shard = sum(((F.col("_key") >= c).cast("int") for c in cuts), F.lit(0))
    found = rows.withColumn("shard", shard)
    found = found.withColumn("_piece", F.pmod("_hash", F.lit(PIECES)).cast("int")).drop("_key")
    pieces = found.groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("shard", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_piece").orderBy("_hash", id_col)
    found = found.withColumn("_nth", F.row_number().over(within)).join(pieces, ["shard", "_piece"])
    return found.select(
        *[c for c in docs.columns if c not in {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}],
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_before") + F.col("_nth") - 1).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import table

    return shard_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
