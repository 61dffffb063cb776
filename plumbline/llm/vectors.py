"""Embedding near-duplicates by an epsilon grid order join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialise, ship_package
from plumbline.llm.graph import components, smallest

LEADING = 8  # principal dimensions that have grid cells
SAMPLE = 4096  # vectors, at most, that the dimensions are found from; any directions give right results
BASES = 16  # of the most frequent lengths of vectors; others take their first components as directions
INTERVAL = 512  # vectors of a sequence interval
RUN_BYTES = 8 << 20  # vectors of a run of intervals, which travel together
LEAF = 64


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of x divided by the power of two next to their largest component, which changes no cosine and lets no square overflow or vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def interval_links(x, y, px, py, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) with cosine of least or more, from two intervals in grid order.

    The longer interval is halved until both are short; two parts whose boxes on the leading dimensions
    are further apart than the distance that least allows are skipped. same: x is y, and i < j are wanted.
    """
    limit = max(0.0, 2 - 2 * least) + 1e-9
    nx, ny = _norms(x), _norms(y)
    found_i, found_j = [], []
    stack = [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        if a >= b or c >= d or (same and d <= a + 1):
            continue
        gap = np.maximum(0, np.maximum(px[a:b].min(axis=0) - py[c:d].max(axis=0), py[c:d].min(axis=0) - px[a:b].max(axis=0)))
        if (gap * gap).sum() > limit:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero((x[a:b] @ y[c:d].T) / nx[a:b, None] / ny[None, c:d] >= least)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            found_i.append(i)
            found_j.append(j)
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            stack += [(a, b, c, m), (a, b, m, d)]
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93) -> DataFrame:
    """A row for each row: vec_id, n_links, component_id and kept.

    Vectors are compared when their labels are equal and not null and they have as many components; they
    are linked when their cosine in double precision is least or more. Null or zero vectors and those with
    null or non-finite components have no links and are their own component. Identical vectors of a label
    are one class (by 128 bits of hashes): its members link with each other, and links between classes
    count all members, so a vector that a third of all rows share is compared once. Classes are sorted by
    the grid cells, as wide as the largest distance of linked vectors, of their leading principal
    dimensions; the sequence is cut into intervals, and pairs of intervals whose boxes are not provably
    distant are joined recursively. Pairs are dealt to tasks by the runs that their intervals lie in, and
    an interval travels to a task once, however many of its pairs are there.

    A region in which all vectors are near each other has to be compared pair by pair, by pairs of runs,
    since n_links counts them. Rows with the same id are separate vectors and one node of the components.
    A null id's row counts as a vector for others and has a null component_id. An empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    element = F.col(vector_col).cast("array<double>")
    good = F.col(label_col).isNotNull() & element.isNotNull() & F.forall(element, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(element, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), element.alias("v"), F.coalesce(good, F.lit(False)).alias("good"))
    same = F.transform("v", lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    compared = rows.filter("good").withColumn("h1", F.xxhash64(F.lit(1), same)).withColumn("h2", F.xxhash64(F.lit(2), same))
    classes = compared.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = materialise(classes.withColumn("class", F.xxhash64("label", "h1", "h2")).withColumn("dim", F.size("v")), "vector-classes")

    dims = [r[0] for r in classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(BASES).collect()]
    bases = {}
    for dim in dims:
        some = classes.filter(F.col("dim") == dim).orderBy("class").limit(SAMPLE).select("v").toArrow().column(0)
        x = scaled(np.array(some.combine_chunks().flatten()).reshape(-1, dim))
        x /= _norms(x)[:, None]
        bases[dim] = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :LEADING]
    shared = spark.sparkContext.broadcast(bases)  # BASES matrices of LEADING columns at most
    eps = float(np.sqrt(max(1e-12, 2 - 2 * least)))

    def project(batches):
        for batch in batches:
            dim = batch.column(4).to_numpy()
            for d in np.unique(dim).tolist():
                here = np.flatnonzero(dim == d)
                part = batch.take(pa.array(here))
                x = scaled(part.column(5).flatten().to_numpy().reshape(-1, d))
                basis = shared.value.get(d)
                p = (x / _norms(x)[:, None]) @ (np.eye(d, min(d, LEADING)) if basis is None else basis)
                cells = pa.FixedSizeListArray.from_arrays(pa.array(np.floor(p / eps).astype(np.int32).ravel()), p.shape[1]).cast(pa.list_(pa.int32()))
                as_bytes = [pa.array([r.tobytes() for r in m.astype("<f8")], pa.binary()) for m in (x, p)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), cells, *as_bytes], names=["label", "class", "n", "id", "dim", "cells", "v", "p"])

    placed = classes.select("label", "class", "n", "id", "dim", "v").mapInArrow(project, "label string, class bigint, n bigint, id bigint, dim int, cells array<int>, v binary, p binary")
    tasks = max(1, classes.count() // 4000)
    ordered = placed.repartitionByRange(tasks, "label", "dim", "cells", "class").sortWithinPartitions("label", "dim", "cells", "class").drop("cells", "id")

    def intervals(batches):
        from pyspark import TaskContext

        k, run, filled = TaskContext.get().partitionId() << 32, TaskContext.get().partitionId() << 32, 0
        held, of = [], None

        def out():
            nonlocal k, run, filled, held
            label, dim = of
            rows = pa.Table.from_batches(held)
            p = np.frombuffer(b"".join(rows.column("p").to_pylist()), "<f8").reshape(rows.num_rows, -1)
            v = b"".join(rows.column("v").to_pylist())
            k, filled = k + 1, filled + len(v)
            if filled > RUN_BYTES:
                run, filled = run + 1, len(v)
            held = []
            ends = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (p.min(axis=0), p.max(axis=0))]
            names = [pa.array([rows.column(c).to_numpy().astype("<i8").tobytes()], pa.binary()) for c in ("class", "n")]
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([run], pa.int64()), pa.array([label]), pa.array([dim], pa.int32()), *ends, *names, pa.array([v], pa.binary()), pa.array([p.tobytes()], pa.binary())], names=["interval", "run", "label", "dim", "low", "high", "class", "n", "v", "p"])

        for batch in batches:
            label, dim = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            a = 0
            while a < batch.num_rows:
                if held and (sum(b.num_rows for b in held) == INTERVAL or of != (label[a], dim[a])):
                    yield out()
                of = (label[a], dim[a])
                room = INTERVAL - sum(b.num_rows for b in held)
                z = a + 1
                while z < batch.num_rows and z - a < room and (label[z], dim[z]) == of:
                    z += 1
                held.append(batch.slice(a, z - a))
                a = z
        if held:
            yield out()

    cut = materialise(ordered.mapInArrow(intervals, "interval bigint, run bigint, label string, dim int, low array<double>, high array<double>, class binary, n binary, v binary, p binary"), "vector-intervals")

    # Boxes meet in a cell of the first two dimensions, where one side is widened by a cell, or not at all.
    cell = lambda c, i: F.floor(F.coalesce(F.get(c, F.lit(i)), F.lit(0.0)) / eps)
    boxes = cut.select("interval", "run", "label", "dim", "low", "high", *(cell(c, i).alias(f"{c}{i}") for c in ("low", "high") for i in (0, 1)))
    left = boxes.select(F.col("interval").alias("a"), F.col("run").alias("ra"), "label", "dim", F.col("low").alias("la"), F.col("high").alias("ha"), F.explode(F.sequence(F.col("low0") - 1, F.col("high0") + 1)).alias("c0"), F.sequence(F.col("low1") - 1, F.col("high1") + 1).alias("s"))
    right = boxes.select(F.col("interval").alias("b"), F.col("run").alias("rb"), "label", "dim", F.col("low").alias("lb"), F.col("high").alias("hb"), F.explode(F.sequence("low0", "high0")).alias("c0"), F.sequence("low1", "high1").alias("s"))
    left, right = (x.withColumn("c1", F.explode("s")).drop("s") for x in (left, right))
    gap = F.aggregate(F.sequence(F.lit(0), F.size("la") - 1), F.lit(0.0), lambda s, i: s + F.pow(F.greatest(F.lit(0.0), F.get("la", i) - F.get("hb", i), F.get("lb", i) - F.get("ha", i)), F.lit(2)))
    near = left.join(right, ["label", "dim", "c0", "c1"]).filter("a <= b").filter(gap <= 2 - 2 * least + 1e-9)
    near = materialise(near.select("ra", "rb", "a", "b").distinct(), "vector-pairs")
    needed = near.selectExpr("ra AS pa", "rb AS pb", "a AS interval").unionByName(near.selectExpr("ra AS pa", "rb AS pb", "b AS interval")).distinct()
    sent = needed.join(cut.select("interval", "class", "n", "v", "p"), "interval")
    tasks = max(1, near.select("ra", "rb").distinct().count())

    def join(pairs: pa.Table, own: pa.Table) -> pa.Table:
        side, size = {}, 0
        names, times = [], []
        for r in own.to_pylist():
            c, n = (np.frombuffer(r[k], "<i8") for k in ("class", "n"))
            v, p = (np.frombuffer(r[k], "<f8").reshape(len(c), -1) for k in ("v", "p"))
            side[r["interval"]] = (size, v, p)
            size += len(c)
            names.append(c)
            times.append(n)
        names, times = np.concatenate(names), np.concatenate(times)
        links, us, vs = np.zeros(size, np.int64), [], []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            (fa, va, pa_), (fb, vb, pb) = side[a], side[b]
            i, j = interval_links(va, vb, pa_, pb, least, a == b)
            np.add.at(links, i + fa, times[j + fb])
            np.add.at(links, j + fb, times[i + fa])
            # A row and the first of its links are enough to connect, with the others of that one.
            root = smallest(size, np.concatenate([*us, i + fa]), np.concatenate([*vs, j + fb]))
            on = np.flatnonzero(root != np.arange(size))
            us, vs = [on], [root[on]]
        root = np.arange(size)
        if us:
            root[us[0]] = vs[0]
        on = np.flatnonzero(links)
        return pa.table({"class": pa.array(names[on]), "links": pa.array(links[on]), "root": pa.array(names[root[on]])})

    dealt = near.repartition(tasks, "ra", "rb").groupBy("ra", "rb").cogroup(sent.repartition(tasks, "pa", "pb").groupBy("pa", "pb"))
    linked = materialise(dealt.applyInArrow(join, "class bigint, links bigint, root bigint"), "vector-links")
    counts = linked.groupBy("class").agg(F.sum("links").alias("links"))
    reached = components(linked.select(F.col("class").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "class")
    whole = classes.drop("v").join(counts, "class", "left").join(reached, "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest_id = whole.groupBy("component").agg(F.min("id").alias("first"))
    whole = whole.join(smallest_id, "component").select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "first")
    found = compared.select("vec_id", "label", "h1", "h2").join(materialise(whole, "vector-found"), ["label", "h1", "h2"]).select("vec_id", "n_links", "first")
    alone = rows.filter("NOT good").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("first"))
    out = found.unionByName(alone).select("vec_id", F.col("n_links").cast("bigint").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("first", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import table

    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = r"""
WITH RECURSIVE g AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), r AS (
  SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u
), c AS (
  SELECT u, least(u, min(v)) AS component_id FROM r GROUP BY u
), n AS (
  SELECT u, count(*) AS n_links FROM l GROUP BY u
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.u LEFT JOIN n ON vec_id = n.u
"""
