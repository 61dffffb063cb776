import json
import subprocess
import sys
from pathlib import Path

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
ROOT = Path(__file__).resolve().parents[2]
DATA = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    """Each stage against plain Python on its own input, and the last one's pieces against the tokenizer's ids."""
    import zlib
    from collections import Counter

    import numpy as np
    import public_tokenizers
    from test_joins import near
    from test_native import WORD, best, fill
    from tokenizers import Tokenizer

    from plumbline.llm import packing, quality

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    columns, ins = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        ins.append([tuple(r) for r in docs.select("doc_id", "text", "source").collect()])
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
    mixed = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    all_rows, good, distinct, apart = ins
    ids = lambda rows: sorted(r[0] for r in rows)

    score = quality.Scorer(quality.train_model(spark.read.parquet(f"{DATA}/documents.parquet"), labels, "doc_id", "text", "quality", quality.SAMPLE).astype(np.float32).astype(float))
    assert ids(good) == ids(r for r in all_rows if score(r[1] or "") >= quality.REJECT)
    assert ids(distinct) == sorted(i for i, _ in best(good).values())
    assert ids(apart) == sorted(int(i) for i, _, c in near(distinct) if int(i) == c)

    words = lambda t: len(WORD.findall(t or ""))
    sizes, taken = Counter(), Counter()
    for rows, into in ((apart, sizes), (mixed, taken)):
        for _, t, source in rows:
            into[source] += words(t)
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    for s, want in zip(names, fill([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))])):
        assert abs(taken[s] - want) <= 0.5 + 1e-9
    times, whole = Counter(ids(mixed)), {i: t for i, t, _ in apart}
    assert max(times.values()) <= 3 and all((whole[i] or "").startswith(t or "") for i, t, _ in mixed)

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, total = Counter(), 0
    for i, t, _ in mixed:
        x = plain.encode(t or "", add_special_tokens=False).ids + [2]
        total += len(x)
        want.update((i, a, n, zlib.crc32(np.array(x[a : a + n], "<u4"))) for a, n in packing.cut(len(x), 1024))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(bins) <= -(-total // 1024) * 1.01 + 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact copies", "near copies", "mix", "packing"]


def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and max(r["offset"] + r["length"] for r in rows) <= 1024


def test_the_rest_imports_without_this_subpackage(tmp_path):
    import shutil

    for name in ("plumbline", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / name)
    code = "import json, __spark_entry__ as e; print(json.dumps([len(e.queries()), [k for k in e.queries() if k.startswith('op') or k == 'pipeline']]))"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, own = json.loads(found.stdout)
    assert n > 90 and own == []
