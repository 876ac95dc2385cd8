"""HyperMinHash links against brute force."""

import random
import re
import time

import numpy as np
import pytest

from nearkin.llm import hyperminhash as hm
from nearkin.runtime import FREED

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def set_brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(" ".join(words[i : i + 4]) for i in range(len(words) - 3)) if len(words) >= 4 else frozenset([" ".join(words)] if words else [])


def links_brute(rows):
    """(size, component, kept) by row, of documents with an identifier of their own."""
    sets = {i: set_brute(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def family(rng, words, n, copies, edits):
    """A text and copies of it, each with some words changed; copies are further from each other than from it."""
    base = [rng.choice(words) for _ in range(n)]
    out = [" ".join(base)]
    for _ in range(copies):
        other = list(base)
        for _ in range(rng.randrange(edits + 1)):
            other[rng.randrange(n)] = rng.choice(words)
        out.append(" ".join(other))
    return out


@pytest.mark.parametrize("block", [512, 6])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hm, "BLOCK", block)
    rng = random.Random(block)
    words = [f"w{i}" for i in range(500)]
    texts = [None, "", " \n", None, "one", "One", "one two", "one  two\n", "É é A b", "é É a b", "a b c d e", "A b c d e", "long word " * 40_000, "long word " * 30_000]
    # exactly at the threshold and just below it: 8 of 10, and 7 of 9 shingles
    texts += [" ".join(f"t{i}" for i in range(a, b)) for a, b in ((0, 12), (1, 13), (100, 111), (101, 112))]
    texts += ["x " + " ".join(f"u{i}" for i in range(12)), " ".join(f"u{i}" for i in range(12)), " ".join(f"u{i}" for i in range(10))]
    for n in (5, 8, 12, 20, 30, 60, 120, 200, 500, 700, 3000):
        for _ in range(3):
            texts += family(rng, words, n, 6, max(1, n // 22))
    texts += family(rng, words, 80, 60, 4) + family(rng, words, 100, 40, 9)
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts += [f"{passage} {' '.join(rng.choice(words) for _ in range(rng.randrange(5, 60)))}" for _ in range(60)]
    texts += rng.sample(texts, 30)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert set(map(tuple, hm.minhash_dedup(frame(spark, rows)).collect())) == links_brute(rows)


def test_edges(spark):
    assert hm.minhash_dedup(frame(spark, [])).collect() == []
    odd = spark.createDataFrame([(None, "a b c d", 1, "k"), (7, "a b c d", 1, "k"), (7, "a b c d", 1, "k"), (None, "other text of its own", 2, "k"), (None, None, 3, "k")], "doc_id long, text string, n int, key string")
    found = sorted(map(tuple, hm.minhash_dedup(odd).collect()), key=str)
    assert found == sorted([(None, 1, 7, False), (7, 1, 7, True), (7, 1, 7, True), (None, 2, None, True), (None, 0, None, True)], key=str)


def test_one_document_many_times(spark):
    """Repeated rows of a document that is linked do not multiply."""
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(5, base)] * 3000 + [(6, base + " end")] * 3000 + [(7, "far " + base + " away end")]
    found = hm.minhash_dedup(frame(spark, rows)).groupBy("doc_id", "n_shingles", "component_id", "kept").count().collect()
    assert {tuple(r) for r in found} == {(5, 37, 5, True, 3000), (6, 38, 5, False, 3000), (7, 40, 5, False, 1)}


def test_registers():
    least = np.array([0xFFFFFFFFFFFFFFFF, 1 << 63, (1 << 62) | (1 << 61), 1, 0], np.uint64)
    assert hm.compressed(least).tolist() == [0, 1 << 10, (2 << 10) | 512, 54 << 10, 54 << 10]


@pytest.mark.parametrize("n", [20, 100, 300, 2000, 50_000])
def test_estimates(n):
    rng = np.random.default_rng(n)
    pool = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
    for share in (0.5, 0.8, 0.95):
        both = round(n * share)
        a, b = pool[:n], pool[n - both : 2 * n - both]
        true = both / (2 * n - both)
        for kind in {hm.size_class(n)}:
            found = hm.estimates(hm.sketch(a, kind)[None, :], hm.sketch(b, kind))[0]
            assert abs(found - true) < 0.12


def test_sizes_share_a_class():
    for n in range(1, 3000):
        for m in {n, n * 100 // hm.SIMILARITY}:
            assert hm.size_class(m) in hm.size_classes(n) and hm.size_class(m) in hm.size_classes(m)


@pytest.mark.parametrize(("block", "listed"), [(512, hm.RARE), (40, hm.RARE), (40, 0)])
def test_far_copies_of_one_text_do_not_give_all_pairs(spark, monkeypatch, block, listed):
    """Copies with so many changes that few are linked, though most resemble each other, are told apart without listing their pairs;
    without the bound (no shingle is rare) the result is the same."""
    monkeypatch.setattr(hm, "BLOCK", block)
    monkeypatch.setattr(hm, "RARE", listed)
    given, plain = [], hm._verified

    def counted(pairs, *a):
        given.append(pairs.count())
        return plain(pairs, *a)

    monkeypatch.setattr(hm, "_verified", counted)
    rng = random.Random(block)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for k in range(400):
        other = list(base)
        for j in range(rng.randrange(8)):
            # some changes are of few words, which many copies make at the same place
            other[rng.randrange(len(base))] = rng.choice(("the", "of", "and")) if rng.random() < 0.3 else f"own{k}-{j}"
        texts.append(" ".join(other))
    rows = list(enumerate(texts))
    want = links_brute(rows)
    assert set(map(tuple, hm.minhash_dedup(frame(spark, rows)).collect())) == want
    sets = [set_brute(t) for t in texts]
    near = sum(100 * len(a & b) >= 64 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert near > 20_000 and len({c for _, _, c, _ in want}) > 40 and (sum(given) < 10 * len(rows)) == (listed > 0)


@pytest.mark.parametrize("listed", [hm.RARE, 3])
def test_what_sets_share_at_most(spark, monkeypatch, listed):
    """The bound is never below what sets share, and exact about shingles that few have."""
    monkeypatch.setattr(hm, "RARE", listed)
    rng = np.random.default_rng(listed)
    often, pool = rng.integers(0, 1 << 63, 60).astype(np.uint64), rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(often, 50, False), rng.choice(pool, rng.integers(1, 6), False), rng.integers(0, 1 << 63, rng.integers(9)).astype(np.uint64)])) for _ in range(150)]
    sets.append(np.zeros(0, np.uint64))
    found = {r["cid"]: r for r in hm.rare_shingles(spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "cid long, hashes binary")).collect()}
    names, of = np.unique(np.concatenate(sets), return_counts=True)
    df = dict(zip(names.tolist(), of.tolist(), strict=True))
    for i, x in enumerate(sets):
        want = sum(df[h] == 1 for h in x.tolist()), {h for h in x.tolist() if 1 < df[h] <= listed}
        assert (found[i]["own"], set(np.frombuffer(found[i]["rare"], np.uint64).tolist())) == want if i in found else want == (0, set())
    n = np.array([len(x) for x in sets])
    rare = [bytes(found[i]["rare"]) if i in found else b"" for i in range(len(sets))]
    rare[7] = None
    common = n - np.array([found[i]["own"] if i in found else 0 for i in range(len(sets))])
    zero = np.zeros(len(n), np.int64)
    most = hm.most_shared(hm.Block(zero, zero, zero, n, common, zero, np.array(rare, object), zero))
    shared = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    for i in range(len(sets)):
        got = most(i)
        assert all(g >= s for j, (g, s) in enumerate(zip(got, shared[i], strict=True)) if i != j)


def test_nearest_of_each_component():
    """Of each label its best pair with another one, by blocks of one side and of two."""
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([pool[: 300 - k], rng.integers(0, 1 << 63, k).astype(np.uint64)])) for k in range(0, 60, 5)]
    registers = np.array([hm.sketch(x, 2) for x in sets])
    n, m = np.array([len(x) for x in sets]), len(sets)
    label = np.arange(m) // 2
    for side in (np.full(m, 2), label % 2):
        block = hm.Block(side, np.arange(m), label, n, n, np.zeros(m, np.int64), np.array([None] * m, object), registers)
        e = {(i, j): hm.estimates(registers[i : i + 1], registers[j])[0] for i in range(m) for j in range(m)
             if label[i] != label[j] and (side[i] == side[j] == 2 or side[i] != side[j])}
        want = {k: max(v for (i, _), v in e.items() if label[i] == k) for k in set(label)}
        (a, b), = hm.nearest(block)
        got = [e[i, j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert sorted(got) == sorted(want.values())


def shuffle_files(spark):
    """The names of the shuffle files that the session's local folders hold."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {name for f in files if (name := f.rpartition("/")[2]).startswith("shuffle_")}


def test_rounds_leave_no_shuffle_files(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(500)]
    rows = list(enumerate(t for n in (40, 200) for t in family(rng, words, n, 12, n // 12)))
    before, setting = shuffle_files(spark), spark.conf.get(FREED, None)
    got = hm.minhash_dedup(frame(spark, rows))
    # files go in the background
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(FREED, None) == setting
    # the result itself can be computed again
    for _ in range(2):
        assert {tuple(r) for r in got.collect()} == links_brute(rows)
