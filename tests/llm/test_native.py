import hashlib
import re
import zlib
from collections import Counter, defaultdict

import data
import pyarrow.parquet as pq
import pytest

from plumbline.llm import exact_dedup, mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def best(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r)
    key = lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)
    return {k: (min(v, key=key)[0], len(v)) for k, v in groups.items()}


def test_copies(spark):
    want = best(data.ROWS)
    got = exact_dedup.copy_groups(data.documents(spark)).collect()
    assert len(got) == len(data.ROWS)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == by_sha[r["text_sha256"]]
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(list(by_sha))
    kept = exact_dedup.drop_copies(data.documents(spark))
    assert kept.columns == data.documents(spark).columns and kept.count() == len(want)
    assert exact_dedup.copy_groups(data.empty(spark)).count() == 0


def test_copies_compare_content_under_a_weak_digest(spark):
    from pyspark.sql import functions as F

    weak = lambda c: F.encode(F.substring(c, 1, 1), "utf-8")
    strong = {(r["doc_id"], r["group_size"]) for r in exact_dedup.copy_groups(data.documents(spark)).collect()}
    assert {(r["doc_id"], r["group_size"]) for r in exact_dedup.copy_groups(data.documents(spark), digest=weak).collect()} == strong


def test_shards(spark):
    rows = sharding.shard_documents(data.documents(spark), shards=4).collect()
    assert len(rows) == len(data.ROWS) and rows[0]["law"] == "bytes" and rows[0]["grown_shard"] is None
    groups, slots, sizes = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        text = r["text"] or ""
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
        groups[text].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in groups.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) >= len(data.LONG)
    assert sharding.shard_documents(data.empty(spark)).count() == 0


def greedy(sizes, cap):
    used, held = 1, 0
    for x in sizes:
        if held + x > cap:
            used, held = used + 1, 0
        held += x
    return used


def test_capacity_is_the_smallest_feasible(spark):
    sizes = [7, 3, 9, 2, 8, 8, 1, 14, 5, 6, 3, 3]
    bins = spark.createDataFrame([(i * 10, x) for i, x in enumerate(sizes)], "bin int, bytes bigint")
    for shards in (1, 2, 3, 5, 12, 16):
        row = sharding._cuts(bins, shards).first()
        want = next(c for c in range(max(sizes), sum(sizes) + 1) if greedy(sizes, c) <= shards)
        assert row["capacity"] == want and len(row["cuts"]) < shards


def test_shards_are_minimal_over_groups_of_texts(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(8)
    texts = [f"t{i} " + "x" * rng.choice([3, 40, 40, 900]) for i in range(400)]
    df = spark.createDataFrame([(i, rng.choice(texts[:120]) if i % 3 == 0 else texts[i % 400]) for i in range(900)], "doc_id bigint, text string")
    groups = [r["b"] for r in df.groupBy("text").agg(F.sum(F.octet_length("text") + 1).alias("b")).orderBy(F.xxhash64("text")).collect()]
    for bits, finer, shards in ((2, 3, 4), (4, 8, 16), (16, 8, 5), (1, 1, 3)):
        monkeypatch.setattr(sharding, "BITS", bits)
        monkeypatch.setattr(sharding, "FINER", finer)
        want = next(c for c in range(max(groups), sum(groups) + 1) if greedy(groups, c) <= shards)
        sizes = [r["b"] for r in sharding.shard_documents(df, shards=shards).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
        assert max(sizes) == want and len(sizes) <= shards


def fill(sizes, weights):
    """Shares by weight; those above three times their size stop there and the rest is shared again."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > 3 * sizes[i]}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
            left -= target[i]
        open_ -= over
    return target


def test_mix(spark):
    df = data.documents(spark)
    rows = mixing.plan_mix(df).collect()
    assert len(rows) == len(data.ROWS)
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        n = len(WORD.findall(r["text"] or ""))
        assert r["size"] == n and 0 <= r["taken"] <= 3 * n
        sizes[r["source"]] += n
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert (r["taken"] > 0) == (len(r["draws"]) > 0)
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = fill([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))])
    for s, t in zip(names, want):
        assert abs(target[s] - t) < 1e-6 and abs(taken[s] - t) <= 0.5 + 1e-9
    again = {(r["doc_id"], r["text"], r["taken"]) for r in mixing.plan_mix(df.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["text"], r["taken"]) for r in rows}
    mixed = mixing.mix(df).collect()
    assert sum(len(WORD.findall(r["text"])) for r in mixed) == sum(taken.values())
    assert mixing.plan_mix(data.empty(spark)).count() == 0


@pytest.mark.parametrize("small", [500_000, 0])
def test_mix_moves_no_text_but_at_boundaries(spark, small, monkeypatch):
    """Documents meet the plan where they are read, or in one join; only those of a source's last piece go to a window."""
    monkeypatch.setattr(mixing, "SMALL", small)
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0L, id % 7), k -> concat('w', id + k))) AS text", "if(id % 5 = 0, null, concat('s', id % 5)) AS source")
    plan = mixing.plan_mix(docs)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Window [") == 1 and "_piece" not in text.split("Window [")[1].split("\n")[0]
    if small:
        assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()
    rows = plan.collect()
    sizes, taken, cuts = Counter(), Counter(), Counter()
    for r in rows:
        n = r["doc_id"] % 7 + 1
        passes = (r["taken"] - r["cut"]) // n
        assert r["size"] == n and 0 <= r["cut"] <= n and r["taken"] <= 3 * n and len(r["draws"]) == passes + (r["cut"] > 0)
        sizes[r["source"]] += n
        taken[r["source"]] += r["taken"]
        cuts[r["source"]] += 0 < r["cut"] < n
    names = ["s1", "s2", "s3", "s4", None]
    want = fill([sizes[s] for s in names], [1 + i % 3 for i in range(5)])
    assert len(rows) == 3000 and max(cuts.values()) <= 1
    assert all(abs(taken[s] - t) <= 0.5 + 1e-9 for s, t in zip(names, want))


def test_mix_of_clashing_columns(spark):
    names = ["source_size", "target", "taken", "rank", "quota", "cut", "draws", "weight", "_src", "_hash", "_block"]
    plain = spark.createDataFrame([(i, "a b c", "ab"[i % 2]) for i in range(40)], "doc_id bigint, text string, source string")
    clashing = plain.selectExpr("*", *[f"'x' AS {n}" for n in names])
    got = mixing.plan_mix(clashing)
    assert got.columns == ["doc_id", "text", "source", "rank", "quota", "weight", "_src", "_hash", "_block", "size", "source_size", "target", "taken", "draws", "cut", "mix_hash"]
    assert sorted(got.select("doc_id", "taken").collect()) == sorted(mixing.plan_mix(plain).select("doc_id", "taken").collect())
    assert mixing.mix(clashing).columns == [*clashing.columns, "shard", "mix_order"]


def test_copies_of_repeated_rows_and_extreme_ids(spark):
    rows = [(5, "a b")] * 200 + [(i, "a b ") for i in range(6, 90)] + [(-(2**63), "q"), (2**63 - 1, "q"), (None, "q"), (None, "r"), (None, "r")]
    got = exact_dedup.copy_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)).collect()
    assert len(got) == len(rows) and sorted((str(r["keep_id"]), r["group_size"]) for r in got if r["kept"]) == [("-9223372036854775808", 3), ("6", 284), ("None", 2)]
    assert {r["doc_id"] for r in got if r["kept"]} == {6, -(2**63), None}


def test_mix_is_shuffled_within_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"w{i} a b c", "ab"[i % 2]) for i in range(300)], "doc_id bigint, text string, source string")
    mixed = mixing.mix(df)
    want = sorted((r["shard"], r["mix_order"], r["doc_id"]) for r in mixed.collect())
    mixing.write_mix(mixed, str(tmp_path / "mix"), 1)
    written = []
    for folder in sorted((tmp_path / "mix").glob("shard=*"), key=lambda f: int(f.name[6:])):
        for file in sorted(folder.glob("*.parquet")):
            written += [(int(folder.name[6:]), r["mix_order"], r["doc_id"]) for r in pq.ParquetFile(file).read(["mix_order", "doc_id"]).to_pylist()]
    assert written == want
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = mixing.query(spark, str(tmp_path)).collect()
    assert sorted((s, o, r["doc_id"]) for r in rows for s, o in zip(r["shards"], r["mix_orders"], strict=True)) == want


def test_stage_writes_shards_in_their_order(spark):
    import corpus_pipeline

    df = spark.createDataFrame([(i, f"w{i} a b c", "ab"[i % 2]) for i in range(300)], "doc_id bigint, text string, source string")
    order = {}
    for r in mixing.mix(df).collect():
        order.setdefault(r["doc_id"], set()).add((r["shard"], r["mix_order"]))
    for part in corpus_pipeline.mix_sources(spark, df, "").select("doc_id").rdd.glom().collect():
        at = (-1, 0)
        for r in part:
            at = min(x for x in order[r["doc_id"]] if x > at)  # none is left where a row is out of order


def test_splitting_tree_keeps_quotas(spark):
    quotas = {0: 40, 1: 7, 2: 100, 3: 1}
    df = spark.createDataFrame(list(quotas.items()), "rank int, quota bigint")
    for shards, chunk in ((1, 256), (5, 256), (16, 256), (5, 2), (16, 1)):
        rows = mixing.split_quotas(df, shards, 3, chunk).collect()
        assert {k: sum(r["n"] for r in rows if r["rank"] == k) for k in quotas} == quotas
        by_shard = Counter()
        for r in rows:
            by_shard[r["shard"]] += r["n"]
        assert max(by_shard.values()) - min(by_shard.values()) <= 4 and len(by_shard) == shards


def test_split_draws_follow_the_hypergeometric_mean(spark):
    df = spark.createDataFrame([(0, 60), (1, 20)], "rank int, quota bigint")
    left = [next(r["n"] for r in mixing.split_quotas(df, 2, seed).collect() if r["rank"] == 0 and r["shard"] == 0) for seed in range(12)]
    assert 28 <= sum(left) / len(left) <= 32 and len(set(left)) > 1


def test_mix_of_many_sources(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "'a b c' AS text", "concat('s', id) AS source")
    rows = mixing.plan_mix(df).collect()
    assert len(rows) == 3000 and abs(sum(r["taken"] for r in rows) - 9000) <= 3000 and {r["draws"][0]["shard"] for r in rows if r["draws"]} == set(range(16))
