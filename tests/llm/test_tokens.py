import random
import zlib

import data
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import packing, token_files, tokens

ODD = ["", " ", "  a  b", " a", "a ", "x\n\n y", "a <|endoftext|>b", "don't  stop now", "ÉCOLE ecolé İstanbul ΣΑΣ. 123,45!", "a\tb\n c", "...!!,, x!.", "ſ K", "a.\nB c\n", "\nq", "a\n b", "k.\nL.\nM, n", "  x  y", "x" * 500]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    path = public_tokenizers.path(name)
    plain, cached = Tokenizer.from_file(path), tokens.Encoder(path)
    rng = random.Random(1)
    mixed = ["".join(rng.choice(["a", "B", " ", "\n", ".", ",", "é", "7", "'s", "\t", "word"]) for _ in range(30)) for _ in range(300)]
    for text in [*ODD, *mixed, data.LONG]:
        assert cached.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text[:60])


def test_cut():
    assert packing.cut(5, 8) == [(0, 5)] and packing.cut(8, 8) == [(0, 8)] and packing.cut(16, 8) == [(0, 8), (8, 8)] and packing.cut(17, 8) == [(0, 1), (1, 8), (9, 8)]


def optimum(items, capacity):
    """Fewest bins by trying all placements."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                place(i + 1, bins)
                bins[k] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_histogram_packing_is_close_to_the_optimum():
    rng, above = random.Random(2), 0
    for _ in range(60):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        counts = {x: items.count(x) for x in set(items)}
        packed = packing.pack_histogram(counts, 20)
        placed = [x for p, n in packed for x in p * n]
        assert sorted(placed) == sorted(items) and all(sum(p) <= 20 for p, _ in packed)
        least, used = optimum(items, 20), sum(n for _, n in packed)
        assert packing.lower_bound(counts, 20) <= least <= used <= least + 1
        above += used > least
    assert above <= 1


def test_packing_of_many_lengths_meets_the_bound():
    rng = random.Random(3)
    counts: dict[int, int] = {}
    for _ in range(1500):
        x = 1024 if rng.random() < 0.33 else min(1023, int(rng.expovariate(1 / 300)) + 1)
        counts[x] = counts.get(x, 0) + 1
    for times in (1, 1000):
        many = {x: n * times for x, n in counts.items()}
        used = sum(n for _, n in packing.pack_histogram(many, 1024))
        assert used <= 1.001 * packing.lower_bound(many, 1024) + 1


def test_filling_is_the_fullest_or_within_the_waste():
    lengths = [256, *range(448, 512)]
    assert packing.filling(512, {x: 2 if x == 256 else 1 for x in lengths}, 0) == [256, 256]
    assert packing.filling(512, {x: 2 if x == 256 else 1 for x in lengths}, 1) == [511]
    rng = random.Random(5)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 7))}
        room, waste, sums = rng.randint(1, 90), rng.randint(0, 9), {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        least = room - max(s for s in sums if s <= room)
        filling = packing.filling(room, counts, waste)
        assert least <= room - sum(filling) <= max(least, waste) and all(filling.count(x) <= counts[x] for x in filling)


def test_pack(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = packing.pack(data.documents(spark), path).collect()
    texts = {}
    for r in data.ROWS:
        texts.setdefault(r[0], []).append(plain.encode(r[1] or "", add_special_tokens=False).ids + [2])
    bins = {}
    for r in rows:
        assert any(zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")) == r["ids_crc32"] for ids in texts[r["doc_id"]])
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(len(i) for v in texts.values() for i in v)
    assert sum(r["length"] for r in rows) == total and len(bins) <= -(-total // 1024) + 1
    assert packing.pack(data.empty(spark), path).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5], [0, 0, 0], [1, 1, 7, 7, 1000000], np.sort(rng.integers(0, 10**7, 3000)), np.arange(1000), np.repeat(4, 900)):
        ef = token_files.EliasFano.encode(np.array(values, np.uint64))
        assert ef.decode().tolist() == list(values)
        for i in range(0, len(values), max(1, len(values) // 50)):
            assert ef.select(i) == values[i]
    big = token_files.EliasFano.encode(np.cumsum(rng.integers(1, 2000, 10000)))
    assert big.low.nbytes + big.high.nbytes + big.samples.nbytes < 10000 * 2


@pytest.mark.parametrize("step", [0, 1, 3, 700, 10**6, 1 << 40])
def test_select_of_many_numbers(step):
    rng = random.Random(step)
    values = np.cumsum([rng.randint(0, step) for _ in range(1000)], dtype=np.int64)
    ef = token_files.EliasFano.encode(values)
    some = np.array([rng.randrange(1000) for _ in range(50)])
    assert ef.select_all(np.arange(1000)).tolist() == values.tolist() == [ef.select(i) for i in range(1000)]
    assert ef.select_all(some).tolist() == values[some].tolist() and len(ef.select_all(some[:0])) == 0
    for i in (-1, 1000):
        with pytest.raises(IndexError):
            ef.select_all(np.array([0, i]))


def test_words_at_a_lines_end_are_cached():
    """The vocabulary that drops white space takes a line's end as a space: a word is tokenized once wherever it stands."""
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, cached = Tokenizer.from_file(path), tokens.Encoder(path)
    text = "one two\nthree one\n\ntwo three\none \n e\n\u0301t <|endoftext|>\n's\n"
    assert cached.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert {"one", "two", "three"} <= set(cached.first) and not any("\n" in w for w in {**cached.first, **cached.later})


def test_symbols_behind_letters_are_cached_apart():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, cached = Tokenizer.from_file(path), tokens.Encoder(path)
    rng = random.Random(2)
    words = ["".join(rng.choice("aTéÖ") for _ in range(rng.randint(1, 4))) + "".join(rng.choice("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for _ in range(rng.randint(1, 4))) for _ in range(2000)]
    for word in ["to%%%", "An,&&&", *words]:
        assert cached.encode(word).tolist() == plain.encode(word, add_special_tokens=False).ids, word
    assert {"to", "%%%", "An", ",&&&"} <= set(cached.first)


def test_file_round_trip():
    docs = [np.array(x, "<u2") for x in ([1, 2, 3], [2], [], [65535, 0])]
    f = token_files.TokenFile(token_files.dump([4, None, -7, 2**60], docs, np.dtype("<u2")))
    assert [f[i].tolist() for i in range(4)] == [d.tolist() for d in docs]
    assert f.doc_ids.tolist() == [4, 0, -7, 2**60] and f.null.tolist() == [False, True, False, False]
    assert token_files.TokenFile(token_files.dump([], [], np.dtype("<u2"))).n == 0


def test_write_and_read(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    place = f"file://{tmp_path}/tok"
    token_files.write_token_files(data.documents(spark), place, path, file_bytes=20000)
    rows = sorted(token_files.read_token_files(spark, place).collect(), key=lambda r: r["start"])
    want = sorted(((r[0], len(ids), zlib.crc32(np.array(ids, "<u4"))) for r in data.ROWS for ids in [plain.encode(r[1] or "", add_special_tokens=False).ids + [2]]), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=str) == want
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in rows]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert len(list((tmp_path / "tok").glob("*.tok"))) > 1


def test_files_are_ordered_by_number(spark, tmp_path, monkeypatch):
    """Starts follow the numbers of parts, however many digits they have."""
    path, place = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/tok"
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(60)], "doc_id bigint, text string")
    monkeypatch.setattr(token_files, "RUN", 3)
    monkeypatch.setattr(token_files, "input_bytes", lambda df: 12)
    token_files.write_token_files(docs, place, path, file_bytes=1)
    assert (tmp_path / "tok" / "part-10-0.tok").exists()
    rows = sorted(token_files.read_token_files(spark, place).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == list(range(60))
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:]))
