"""Merkle manifests and vector codes against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearkin.llm import merkle, vector_codes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_brute(i, text, lang, source, n):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def climb(nodes):
    """The levels of a tree from its leaves."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def steps(levels, at):
    for level in levels[:-1]:
        run = at - at % 8
        yield "".join(level[run:at]), "".join(level[at + 1 : run + 8])
        at //= 8


def audit_brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_brute(*r), r))
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: climb([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in names}
    top = climb([trees[k][-1][0] for k in names])
    out = []
    for g, k in enumerate(names):
        for at, (_, _, node, r) in enumerate(sorted(groups[k], key=lambda x: x[:3])):
            proof = [*steps(trees[k], at), *steps(top, g)]
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now = leaf_brute(r[0], text, *r[2:])
            for a, b in proof:
                now = sha(a + now + b)
            out.append((r[0], node, trees[k][-1][0], top[-1][0], sha("".join(a + b for a, b in proof)), now, now == top[-1][0]))
    return out


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_manifest_brute_force(spark, depth):
    rng = random.Random(depth)
    sizes = {"en": 700, "de": 64, "fr": 65, None: 9, "": 1, "é": 8, "zz": 2}
    rows = [(None, "A", "en", None, 1), (None, None, None, None, None), (5, "same Text", "en", "s", 9), (5, "same Text", "en", "s", 9), (5, "other", "en", "s", 9), (-3, "Ä B" * 50_000, "de", "s", 0)]
    for lang, n in sizes.items():
        rows += [(rng.randrange(10**9), rng.choice(["", "Plain text", "plain text", "É\U0001f600 X"]), lang, rng.choice(["a", None]), i) for i in range(n)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", pos int, node string").repartition(5)
    made = merkle.manifest(docs, depth=depth, changed={"text": F.col("text")})
    found = made.rows.select("doc_id", "node", "subroot", F.sha2(merkle.siblings(F.col("proof")), 256), merkle.folded(F.col("changed"), F.col("proof"))).collect()
    want = audit_brute(rows)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(((w[0], w[1], w[2], w[4], w[3]) for w in want), key=key)
    assert made.root == want[0][3]
    if depth == 4:
        assert sorted(map(tuple, merkle.audit(docs).collect()), key=key) == sorted(want, key=key)


def test_manifest_edges(spark):
    assert merkle.audit(spark.createDataFrame([], DOCS)).collect() == []
    row = (7, "Only", "en", "s", 4)
    found = merkle.audit(spark.createDataFrame([row], DOCS)).collect()
    assert list(map(tuple, found)) == audit_brute([row]) and found[0]["leaf"] == found[0]["root"]


@pytest.mark.parametrize("count", [1, 7, 8, 9, 63, 64, 65, 511, 513, 700])
def test_paths(count):
    leaves = [sha(str(i)) for i in range(count)]
    levels = climb(leaves)
    for height in (1, 2, 3):
        got = list(merkle.paths(leaves, merkle.least_depth(count), height))
        assert got == [list(steps(levels, i)) for i in range(count)]
    stack = merkle.Stack()
    for x in leaves:
        stack.add(x)
    assert stack.root(merkle.least_depth(count)) == levels[-1][0]


def codes_brute(rows, entries=256):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [int(np.floor(1024 * float(np.float32(x)))) for x in r[1]]))
    q = np.array([[int(np.floor(1024 * float(np.float32(x)))) for x in r[1]] for r in kept], np.int64)
    w = q.shape[1] // 4
    parts = [q[:, p * w : (p + 1) * w] for p in range(4)]
    books = [p[:entries].copy() for p in parts]

    def nearest(p):
        d = ((parts[p][:, None, :] - books[p][None, :, :]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(4):
        for p in range(4):
            at, _ = nearest(p)
            for c in range(len(books[p])):
                if (at == c).any():
                    books[p][c] = parts[p][at == c].sum(0) // (at == c).sum()
    found = [nearest(p) for p in range(4)]
    errors = sum(f[1] for f in found)
    by = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by[label] = by.get(label, 0) + int(e)
    digest = sha(",".join(str(x) for b in books for x in b.reshape(-1)))
    return [(r[0], "".join(f"{f[0][n]:02x}" for f in found), int(errors[n]), by[r[2]], digest) for n, r in enumerate(kept)]


VECTORS = "vec_id long, embedding array<float>, label int"


def test_vector_codes_brute_force(spark):
    rng = np.random.default_rng(4)
    hot = [float(x) for x in rng.normal(0, 0.3, 16)]
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 16)], int(rng.integers(0, 3)) if i % 5 else None) for i in range(600)]
    rows += [(1000 + i, hot, 1) for i in range(300)] + [(1, rows[1][1], 2), (None, hot, None), (None, rows[4][1], 1), (3, rows[9][1], 1)]
    # equal distances, and halves of an integer below zero
    rows += [(2000 + i, [(-1) ** i * i / 2048] * 16, 0) for i in range(40)]
    bad = [(5000, None, 1), (5001, [None] + hot[1:], 1), (5002, [float("nan")] + hot[1:], 1), (5003, [float("inf")] + hot[1:], 1), (5004, [-float("inf")] + hot[1:], 2)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + bad], VECTORS + ", row int, part string").repartition(7)
    got = vector_codes.code_rows(df).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(codes_brute(rows), key=key)


def test_vector_codes_edges(spark):
    empty = vector_codes.code_rows(spark.createDataFrame([], VECTORS))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.collect() == []
    odd = spark.createDataFrame([(1, [0.5] * 6, 1), (2, [0.25] * 6, None), (3, [1.0], 1), (4, [1e30] * 6, 1)], VECTORS)
    found = vector_codes.encode(odd, carry=["label"])
    rows = {r["id"]: r for r in found.codes.collect()}
    assert sorted(rows) == [1, 2, 4] and [b.shape[1] for b in found.codebooks] == [1, 2, 1, 2]
    assert rows[4]["error"] == 0 and found.decode(rows[1]["codes"]).tolist() == [512] * 6
    assert vector_codes.code_rows(spark.createDataFrame([(1, [], 1)], VECTORS)).first()["code"] == "00000000"


def test_nearest_is_exact_beyond_doubles():
    rng = np.random.default_rng(1)
    book = rng.integers(-vector_codes.LIMIT, vector_codes.LIMIT, (9, 40))
    values = np.concatenate([book[:4] + rng.integers(-2, 3, (4, 40)), book[[8, 8]]])
    at, error = vector_codes.nearest(values, book)
    d = ((values.astype(object)[:, None, :] - book.astype(object)[None, :, :]) ** 2).sum(2)
    assert at.tolist() == [int(np.argmin(r)) for r in d] and error.tolist() == [int(min(r)) for r in d]
