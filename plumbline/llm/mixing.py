"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import SMALL, WORD, discard, materialise, text_or_empty

#: Blocks of each source, and the finer pieces in which a source's boundary is found.
BLOCKS, PIECES = 64, 1024
CHUNK = 256  # sources whose quotas are in one row
MOST = 3  # times its own size that a source or document is taken


def n_words(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights: int = 3) -> DataFrame:
    """sizes (source, source_size), a row for each source, with rank, weight and target added.

    Sources in code-point order, null last, weigh 1, 2, .. weights, repeating, and share the sum of all
    sizes; no target exceeds MOST times its source's size. Resharing the excess until none is above is
    filling to one level: sorted by cap / weight, the sources before the level get their cap and the
    others level * weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    x = sizes.withColumn("rank", F.row_number().over(order) - 1)
    x = x.withColumn("weight", (F.col("rank") % weights + 1).cast("double")).withColumn("_cap", F.lit(float(MOST)) * F.col("source_size"))
    by = Window.orderBy(F.col("_cap") / F.col("weight"), "rank")
    before, rest, whole = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    x = x.withColumn("_level", F.when(level * F.col("weight") <= F.col("_cap"), level))
    x = x.withColumn("_first", F.first("_level", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_first") * F.col("weight"), F.col("_cap")))
    return x.select("source", "source_size", "rank", "weight", target.alias("target"))


def _uniform(*cols: str) -> str:
    return f"((pmod(xxhash64({', '.join(cols)}), 4503599627370496L) + 0.5D) / 4503599627370496.0D)"


def _hypergeometric(pop: str, good: str, draws: str, u: str) -> str:
    """SQL for how many of good among pop items are in a draw without replacement, by inversion at u."""
    low, high = f"greatest(0L, {draws} - ({pop} - {good}))", f"least({good}, {draws})"
    return f"""transform(array(struct({low} AS lo, {high} AS hi)), b -> if(b.hi <= b.lo, b.lo,
      transform(array(transform(sequence(b.lo, b.hi - 1L), k -> ln(({good} - k) * ({draws} - k) / ((k + 1D) * ({pop} - {good} - {draws} + k + 1D))))), steps ->
        transform(array(transform(sequence(0, size(steps)), i -> if(i = 0, 0D, aggregate(slice(steps, 1, i), 0D, (a, v) -> a + v)))), logs ->
          transform(array(transform(logs, v -> exp(v - array_max(logs)))), w ->
            least(b.hi, b.lo + aggregate(w, struct(0D AS below, 0L AS n), (s, v) ->
              struct(s.below + v AS below, s.n + if(s.below + v < {u} * aggregate(w, 0D, (a, z) -> a + z), 1L, 0L) AS n)).n))[0])[0])[0]))[0]"""


def _chain(items: str, draws: str, *keys: str) -> str:
    """SQL for how many of draws fall on each of items (key, quota), one univariate draw after the other."""
    take = _hypergeometric("s.pop", "x.quota", "s.draws", _uniform(*keys, "x.key"))
    return f"""aggregate({items}, struct(aggregate({items}, 0L, (a, x) -> a + x.quota) AS pop, {draws} AS draws, cast(array() AS array<bigint>) AS out),
      (s, x) -> transform(array({take}), t -> struct(s.pop - x.quota AS pop, s.draws - t AS draws, concat(s.out, array(t)) AS out))[0]).out"""


def split_quotas(quotas: DataFrame, shards: int, seed: int, chunk: int = CHUNK) -> DataFrame:
    """Exact block quotas of each source in each shard: rows (rank, shard, n), n > 0.

    quotas: (rank, quota). The root of a binary tree over the shards holds all quotas. Each node gives
    its left half so many blocks as its share of the shards, and draws how many come from each source
    from the multivariate hypergeometric distribution: first how many come from each chunk of sources, then
    how many of a chunk's come from each source in it, each as a chain of univariate draws; the right half
    gets the rest. Leaves are shards, and every source's leaves add up to its quota. A row holds a number
    for each source of one chunk, or one for each chunk.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col("rank").cast("bigint").alias("key"), F.col("quota").cast("bigint").alias("quota"))))
    nodes = quotas.groupBy(F.floor(F.col("rank") / chunk).alias("chunk")).agg(items.alias("q")).select(F.lit(0).alias("first"), F.lit(shards).alias("n"), "chunk", "q")
    total = "aggregate({}, 0L, (a, x) -> a + x.quota)"
    written = None
    for depth in range((shards - 1).bit_length()):
        nodes = materialise(nodes, "mix-nodes")
        if written is not None:
            discard(written)
        written = nodes
        chunks = nodes.selectExpr("first", "n", "chunk AS key", f"{total.format('q')} AS quota").groupBy("first", "n").agg(F.array_sort(F.collect_list(F.struct("key", "quota"))).alias("c"))
        draws = f"cast(round({total.format('c')} * if(n < 2, 1, n div 2) / n) AS bigint)"
        chunks = chunks.selectExpr("first", "c", f"{_chain('c', draws, f'{seed}L', str(depth), 'first', '-1L')} AS t")
        chunks = chunks.selectExpr("first", "inline(transform(c, (x, i) -> struct(x.key AS chunk, t[i] AS draws)))")
        nodes = nodes.join(chunks, ["first", "chunk"]).selectExpr("first", "n", "chunk", "q", f"if(n < 2, transform(q, x -> x.quota), {_chain('q', 'draws', f'{seed}L', str(depth), 'first')}) AS t")
        nodes = nodes.selectExpr(
            """inline(filter(array(
              struct(first AS first, if(n < 2, n, cast(n div 2 AS int)) AS n, chunk, transform(q, (x, i) -> struct(x.key AS key, t[i] AS quota)) AS q),
              struct(cast(first + n div 2 AS int) AS first, if(n < 2, 0, cast(n - n div 2 AS int)) AS n, chunk, transform(q, (x, i) -> struct(x.key AS key, x.quota - t[i] AS quota)) AS q)), x -> x.n > 0))"""
        )
    return nodes.selectExpr("first AS shard", "inline(q)").selectExpr("cast(key AS int) AS rank", "shard", "quota AS n").filter("n > 0")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 16, weights: int = 3, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target, taken and draws (array of pass and shard) added; clashing columns are replaced.

    A document lies in one of BLOCKS blocks of its source, by a hash of id and text. A source with target
    T is taken floor(T / size) times as a whole and once more up to the word where T is reached, so that
    its words miss T by less than one; the last document is cut there. Drawn blocks (pass, block) are
    numbered in a permuted order of their own, and each shard takes as many of them, one after the other,
    as the splitting tree gives it, so no block is drawn twice. A hash with a fixed seed makes all choices:
    reruns agree. Null texts are empty, a null source is a source, empty tables give empty results; a
    source with words in no document has target 0. Sources are spread over BLOCKS * PIECES keys, so a
    source with a third of all rows is no hot key. Sources are ranked in one task, a row for each.
    Texts stay where they are read but for those of a source's last piece, in which the cut is looked for:
    the plan is a row for each block, broadcast if there are few.
    """
    key = F.xxhash64(F.lit(seed), F.col(id_col), text_or_empty(F.col(text_col)))
    # The table's own columns go by number, so that none of them clashes with what is added.
    own = {c: f"_own{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], n_words(F.col(text_col)).alias("size"), F.col(source_col).alias("_src"), key.alias("_hash"))
    rows = rows.withColumn("_block", F.pmod(F.shiftright("_hash", 20), F.lit(BLOCKS)).cast("int")).withColumn("_piece", F.pmod("_hash", F.lit(PIECES)).cast("int"))
    pieces = materialise(rows.groupBy("_src", "_block", "_piece").agg(F.sum("size").alias("_words")), "mix-pieces")
    targets = source_targets(pieces.groupBy(F.col("_src").alias("source")).agg(F.sum("_words").alias("source_size")), weights)
    targets = targets.withColumn("_goal", F.least(F.round("target"), MOST * F.col("source_size").cast("double")).cast("bigint"))
    whole = F.when(F.col("source_size") > 0, (F.col("_goal") - F.col("_goal") % F.col("source_size")) / F.col("source_size")).otherwise(0)
    targets = materialise(targets.withColumn("_passes", F.coalesce(whole, F.lit(0)).cast("int")).withColumn("_rest", F.col("_goal") - F.col("_passes") * F.col("source_size")), "mix-targets")
    running = Window.partitionBy("_src").orderBy("_block", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_words").over(running), F.lit(0)))
    pieces = pieces.join(targets, pieces["_src"].eqNullSafe(targets["source"])).drop("source")

    # A source is cut in the last piece that begins before its rest is reached; pieces before are taken whole, those after not.
    number = F.col("_block") * PIECES + F.col("_piece")
    per_source = [F.first(c).alias(c) for c in ("_src", "_passes", "_rest", "source_size", "target")]
    last_piece = F.max(F.when(F.col("_before") < F.col("_rest"), number)).alias("_last")
    blocks = pieces.groupBy("rank", "_block").agg(F.min("_before").alias("_before"), F.sum("_words").alias("_words"), last_piece, *per_source)
    blocks = materialise(blocks, "mix-blocks")
    edges = blocks.groupBy("rank").agg(F.max("_last").alias("_edge"))
    edge_starts = pieces.filter(F.col("_before") < F.col("_rest")).groupBy("rank").agg(F.max("_before").alias("_start"))
    last = F.when((F.col("_words") > 0) & (F.col("_before") < F.col("_rest")), F.array("_passes")).otherwise(F.array().cast("array<int>"))
    full = F.when((F.col("_words") > 0) & (F.col("_passes") > 0), F.sequence(F.lit(0), F.col("_passes") - 1)).otherwise(F.array().cast("array<int>"))
    drawn = blocks.select("rank", "_block", F.explode(F.concat(full, last)).alias("_pass"))
    quotas = split_quotas(drawn.groupBy("rank").agg(F.count(F.lit(1)).alias("quota")), shards, seed)
    upto = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = quotas.withColumn("_from", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    places = places.select("rank", "shard", F.explode(F.sequence(F.col("_from") + 1, F.col("_from") + F.col("n"))).alias("_place"))
    permuted = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 1), "rank", "_pass", "_block"), "_pass", "_block")
    drawn = drawn.withColumn("_place", F.row_number().over(permuted).cast("bigint")).join(places, ["rank", "_place"])
    drawn = drawn.groupBy("rank", "_block").agg(F.array_sort(F.collect_list(F.struct(F.col("_pass").alias("pass"), "shard"))).alias("_draws"))
    where = blocks.join(drawn, ["rank", "_block"], "left").join(edges, "rank").join(edge_starts, "rank", "left")
    where = where.select(F.col("_src").alias("_s"), F.col("_block").alias("_b"), "_passes", "_rest", "source_size", "target", "_draws", "_edge", "_start")
    where = materialise(where, "mix-plan")

    at = F.broadcast(where) if where.count() <= SMALL // 8 else where
    rows = rows.join(at, rows["_src"].eqNullSafe(at["_s"]) & (rows["_block"] == at["_b"]))
    number = F.col("_block") * PIECES + F.col("_piece")
    inner = rows.filter(F.coalesce(number != F.col("_edge"), F.lit(True))).withColumn("_cut", F.when(number < F.col("_edge"), F.col("size")).otherwise(0))
    within = Window.partitionBy("_src").orderBy("_hash", own[id_col]).rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.filter(number == F.col("_edge")).withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    cut = F.least(F.greatest(F.col("_rest") - F.col("_start") - F.col("_within"), F.lit(0)), F.col("size"))
    rows = inner.unionByName(edge.withColumn("_cut", cut).drop("_within"))
    draws = F.filter(F.coalesce("_draws", F.array().cast("array<struct<pass:int,shard:int>>")), lambda d: (F.col("size") > 0) & ((d["pass"] < F.col("_passes")) | (F.col("_cut") > 0)))
    added = {"size", "source_size", "target", "taken", "draws", "cut", "mix_hash"}
    return rows.select(
        *[F.col(n).alias(c) for c, n in own.items() if c not in added],
        "size",
        "source_size",
        "target",
        (F.col("_passes") * F.col("size") + F.col("_cut")).cast("bigint").alias("taken"),
        draws.alias("draws"),
        F.col("_cut").cast("bigint").alias("cut"),
        F.col("_hash").alias("mix_hash"),
    )


def mix_order(mix_hash: Column, number: Column, seed: int = 17) -> Column:
    """The place of a document's pass in its shard's shuffle."""
    return F.xxhash64(F.lit(seed + 2), mix_hash, number)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 16, weights: int = 3, seed: int = 17) -> DataFrame:
    """The mixed documents: each row of docs as often as it is drawn, with its shard and mix_order.

    A shard's rows are shuffled by sorting on mix_order within its partitions (see shuffled). The one
    document at a source's boundary has its text cut after its last drawn word. See plan_mix for the rest.
    """
    plan = plan_mix(docs, id_col, text_col, source_col, shards, weights, seed)
    rows = plan.withColumn("_d", F.explode("draws"))
    partial = (F.col("_d.pass") == F.floor((F.col("taken") - F.col("cut")) / F.col("size"))) & (F.col("cut") < F.col("size"))
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    prefix = F.array_join(F.slice(words, F.lit(1), F.col("cut").cast("int")), "")
    text = F.when(partial, prefix).otherwise(F.col(text_col))
    order = mix_order(F.col("mix_hash"), F.col("_d.pass"), seed)
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in {"shard", "mix_order"}], F.col("_d.shard").alias("shard"), order.alias("mix_order"))


def shuffled(mixed: DataFrame, pieces: int = 8) -> DataFrame:
    """The rows of a mix, each shard's dealt into pieces by hash and shuffled within each."""
    return mixed.repartition(F.col("shard"), F.pmod("mix_order", F.lit(pieces))).sortWithinPartitions("shard", "mix_order")


def write_mix(mixed: DataFrame, path: str, pieces: int = 8) -> None:
    """Write a mix in a folder for each shard, its rows shuffled (see shuffled)."""
    shuffled(mixed, pieces).write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import table

    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).alias("shards"), F.transform("draws", lambda d: mix_order(F.col("mix_hash"), d["pass"])).alias("mix_orders"))
