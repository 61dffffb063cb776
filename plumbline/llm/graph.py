"""Connected components of links between rows, without gathering them anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, materialise, ship_package

#: Links that a task contracts at once.
TASK_LINKS = 500_000


def smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For numbers below n, the smallest that links a-b lead to."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root


def _contract(batches):
    tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.concat_tables(tables)
    u, v = (t.column(i).to_numpy() for i in range(2))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = smallest(len(nodes), at[: len(u)], at[len(u) :])
    far = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """links (u, v) to rows (node, component): the smallest node reachable, for each node with a link.

    Tasks of TASK_LINKS links at most contract them to stars; then large-star and small-star steps
    alternate until nothing changes (Kiveris et al., 2014), each written to the shared folder.
    """
    ship_package(links.sparkSession)
    star = links.filter("u <> v").select(F.greatest("u", "v").cast("bigint").alias("u"), F.least("u", "v").cast("bigint").alias("v"))
    given = materialise(star.distinct(), "links")
    tasks = max(1, -(-given.count() // TASK_LINKS))
    star = materialise(given.repartition(tasks).mapInArrow(_contract, "u bigint, v bigint"), "stars")
    discard(given)
    before = None
    while tasks > 1:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that each join has plain shuffles on both sides, of which Spark splits a hot root's.
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct(), "large-stars")
        lower = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        moved = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, star = star, materialise(moved.unionByName(lower.withColumnRenamed("m", "v")).distinct(), "stars")
        discard(old, low, large, lower)
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
