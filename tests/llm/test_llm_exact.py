"""Exact dedup, SimHash links, WARC and mixing against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from nearkin.llm import exact_dedup as ed
from nearkin.llm import mixing, simhash, warc
from nearkin.runtime import new_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, texts, source=lambda i: f"s{i % 3}"):
    return spark.createDataFrame([(i, t, "en", source(i), len(t or "")) for i, t in texts], DOCS)


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[3]
        for m in members:
            out[m[3]] = (keep, len(members), m[3] == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_exact_dedup_brute_force(spark, buckets):
    rng = random.Random(buckets)
    pool = ["", " ", "a b", "ab", " a\tb\n", "same head " * 9 + "x", "same head " * 9 + "y", " a", "é\U0001f600", "z" * 5000, None]
    rows = [(i, rng.choice(pool) if i % 3 else "hot copy" + " " * rng.randrange(3)) for i in range(300)]
    rows += [(1000 + i, f"text {i} {rng.random()}") for i in range(100)]
    got = ed.exact_dedup(docs_frame(spark, rows), buckets=buckets).collect()
    assert {r[0]: tuple(r)[1:5] for r in got} == exact_brute(rows)
    kept = ed.drop_copies(docs_frame(spark, rows), "doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, v in exact_brute(rows).items() if v[2])
    assert kept[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_exact_dedup_edges(spark):
    assert ed.exact_dedup(docs_frame(spark, [])).collect() == []
    odd = spark.createDataFrame([(None, "a", 1), (None, "a", 2), (4, "a", 3), (4, "a", 3)], "doc_id long, text string, _norm int")
    rows = ed.exact_dedup(odd, carry=["_norm"]).collect()
    assert len(rows) == 4 and sum(r["kept"] for r in rows) == 1 and {r["keep_id"] for r in rows} == {4} and {r["group_size"] for r in rows} == {4}


def simhash_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(prints):
    label = {i: i for i in prints}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("dense", [1024, 4])
def test_near_dedup_brute_force(spark, dense):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "one two"), (5, "É é A b c d"), (6, "long word " * 40000)]
    for g in range(20):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 300))]
        for _ in range(8):
            other = list(base)
            for _ in range(rng.randrange(3)):
                other[rng.randrange(len(other))] = rng.choice(words)
            rows.append((len(rows), " ".join(other)))
    expected = {i: simhash_brute(t) for i, t in rows}
    got = simhash.near_dedup(docs_frame(spark, rows), dense=dense).collect()
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == expected
    assert {r["doc_id"]: r["component_id"] for r in got} == components_brute(expected)


def test_near_links_dense_ball(spark):
    """A ball of near fingerprints, larger than a bucket may be, loses no link."""
    rng = np.random.default_rng(8)
    base = int(rng.integers(0, 1 << 62))
    fps = {base}
    while len(fps) < 600:
        fps.add(base ^ sum({1 << int(b) for b in rng.integers(0, 64, 4)}))
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 200)}
    ids = dict(enumerate(sorted(fps)))
    signed = [((x - (1 << 64)) if x >> 63 else x,) for x in ids.values()]
    from nearkin.operators.components import connected_components

    comps = connected_components(simhash.near_links(spark.createDataFrame(signed, "fp long"), dense=20)).collect()
    got = defaultdict(set)
    for r in comps:
        got[r["component"]].add(r["node"] & (1 << 64) - 1)
    want = defaultdict(set)
    for i, root in components_brute(ids).items():
        want[root].add(ids[i])
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_covering_masks_cover_every_pair():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(3, 5)]
    rng = random.Random(1)
    assert len(masks) == 15
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))
        assert any(diff & m == 0 for m in masks)


def test_near_dedup_edges(spark):
    assert simhash.near_dedup(docs_frame(spark, [])).collect() == []
    odd = spark.createDataFrame([(None, "a b c d", 1), (7, "a b c d", 1), (7, "a b c d", 1)], "doc_id long, text string, fp int")
    assert [(r[0], r[2]) for r in simhash.near_dedup(odd).orderBy("doc_id").collect()] == [(None, 7), (7, 7), (7, 7)]


def test_warc_round_trip(spark):
    big = "".join(chr(33 + i % 90) for i in range(200_000))
    data = [(0, "http://a/x", "<p>é</p>\r\n\r\nWARC/1.1"), (1, "http://a/y z", big), (2, None, ""), (3, "u", None), (4, "http://b\r\nX: 1", big), (5, "u", "<p>é</p>\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame([(*r, 1) for r in data], "page_id long, url string, html string, sha int")
    folder = new_folder(spark, "warc")
    index = warc.write_archives(pages, folder)
    got = {r["page_id"]: r for r in warc.read_records(index, folder, with_payload=True).collect()}
    first = {}
    for i, _, html in data:
        payload = (html or "").encode()
        to = first.setdefault(payload, i)
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), warc.digest(payload))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if to == i else ("revisit", to))
        assert bytes(r["payload"]) == (payload if to == i else b"")
    assert sorted((r["page_id"], r["url"]) for r in index.collect()) == sorted((i, u) for i, u, _ in data)
    some = warc.read_records(index.filter("page_id = 4"), folder).collect()
    assert [r["page_id"] for r in some] == [4]
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_min_bytes_and_repeats(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd"), (None, "u", "abcd"), (3, "u", "abcd")], "page_id long, url string, html string")
    folder = new_folder(spark, "warc")
    got = warc.read_records(warc.write_archives(pages, folder, min_bytes=3), folder).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got) == [
        (0, "revisit", 3), (1, "response", None), (2, "response", None), (3, "response", None), (3, "response", None), (4, "revisit", 3)]


def targets_brute(sizes, weights, share, cap):
    out, left, free = [0.0] * len(sizes), share * sum(sizes), {i for i, n in enumerate(sizes) if n}
    while free:
        unit = left / sum(weights[i] for i in free)
        over = {i for i in free if unit * weights[i] > cap * sizes[i]}
        if not over:
            return [unit * weights[i] if i in free else out[i] for i in range(len(sizes))]
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
        free -= over
    return out


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_mixing(spark, block):
    rng = random.Random(block)
    names = ["b", "a", None, "\U0001f600", "�", "empty"]
    rows = [(i, None if i % 40 == 0 else "w " * rng.choice([0, 1, 5, 80, 700]), "en", names[min(int(rng.expovariate(1.2)), 4)], 0) for i in range(400)] + [(999, " ", "en", "empty", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(docs, block=block, shard_slots=16)
    out = got.documents.collect()
    by = defaultdict(list)
    for i, t, _, s, _ in rows:
        by[s].append((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, n in by[s]) for s in order]
    want = targets_brute(sizes, [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2.0)
    source = {i: s for s in by for i, _ in by[s]}
    size = {i: n for s in by for i, n in by[s]}
    assert len(out) == len(rows)
    took = defaultdict(int)
    for r in out:
        k = order.index(source[r["doc_id"]])
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[k]) and abs(r["target"] - want[k]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        took[k] += r["taken"]
    assert all(abs(took[k] - t) < 1 for k, t in enumerate(want)), (dict(took), want)
    again = mixing.mix_sources(docs.repartition(7), block=block, shard_slots=16)
    assert sorted(map(tuple, again.documents.collect())) == sorted(map(tuple, out))
    check_mix(spark, docs, rows, got, block, {r["doc_id"]: r["taken"] for r in out})


def check_mix(spark, docs, rows, got, block, taken):
    """The mix slot by slot: counts per document, spans and texts agree with the packed sources."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, *_ in rows}
    packed = defaultdict(dict)
    for r in got.places.collect():
        for k, w in enumerate(words[r["doc_id"]]):
            packed[r["s"]][r["start"] + k] = (r["doc_id"], w)
    assert all(sorted(p) == list(range(len(p))) for p in packed.values())
    slots, count = got.slots.collect(), defaultdict(int)
    by = defaultdict(list)
    for r in slots:
        by[r["s"]].append(r)
    for s, own in by.items():
        blocks = -(-len(packed[s]) // block)
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        for at in range(0, len(own), blocks):
            some = [r["block"] for r in own if at <= r["slot"] < at + blocks]
            assert len(set(some)) == len(some) and set(some) <= set(range(blocks))
    texts = {(r["s"], r["slot"]): r["text"] for r in mixing.mixed_texts(docs, got, block).collect()}
    spans = defaultdict(list)
    for r in got.spans().collect():
        spans[r["s"], r["slot"]].append(r)
    for r in slots:
        held = [packed[r["s"]][k] for k in range(r["block"] * block, r["block"] * block + r["limit"]) if k in packed[r["s"]]]
        for i, _ in held:
            count[i] += 1
        assert texts[r["s"], r["slot"]] == " ".join(w for _, w in held)
        parts = sorted(spans[r["s"], r["slot"]], key=lambda p: p["lo"])
        assert [w for p in parts for w in words[p["doc_id"]][p["at"] : p["at"] + p["words"]]] == [w for _, w in held]
    assert {i: count[i] for i in taken} == taken


def test_mixing_of_many_sources(spark, monkeypatch):
    """Sources by the thousand, shards in several groups, the table of sources joined in copies."""
    monkeypatch.setattr(mixing, "GROUP", 5)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 10)
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(30), "en", f"s{rng.randrange(1500):04d}" if i % 3 else "hot", 0) for i in range(4000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS), block=8, shard_slots=64)
    out = got.documents.collect()
    assert len(out) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in out)
    sizes = defaultdict(int)
    for i, t, _, s, _ in rows:
        sizes[s] += len(t.split())
    order = sorted(sizes)
    want = dict(zip(order, targets_brute([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2.0), strict=True))
    took, source = defaultdict(int), {i: s for i, _, _, s, _ in rows}
    for r in out:
        assert abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6
        took[source[r["doc_id"]]] += r["taken"]
    assert all(abs(took[s] - want[s]) < 1 for s in order)
    shards = got.slots.groupBy("shard").count().collect()
    assert len(shards) > 5 and max(r["count"] for r in shards) < 3 * 64


def test_mixing_writes_shards(spark):
    rows = [(i, f"{'w' + str(i)} " * (i + 1), "en", f"s{i % 2}", 0) for i in range(40)]
    docs = spark.createDataFrame([*rows, (None, "x y z", "en", "s0", 0), (3, "other text", "en", "s1", 0), (5, rows[5][1], "en", "s1", 0)], DOCS).withColumn("same", F.lit(1)).withColumn("s", F.lit("a")).withColumn("size", F.lit(0))
    got = mixing.mix_sources(docs, block=16, shard_slots=4)
    out = got.documents.collect()
    assert len(out) == 43 and sum(r["doc_id"] == 5 for r in out) == 2 and all(r["taken"] <= 2 * r["size"] for r in out)
    written = mixing.write_shards(docs, got, new_folder(spark, "shards"), block=16).collect()
    assert sum(len(r["text"].split()) for r in written) == sum(r["taken"] for r in out)


def test_mixing_edges(spark):
    assert mixing.mix_sources(docs_frame(spark, [])).documents.collect() == []
    assert [tuple(r) for r in mixing.mix_sources(docs_frame(spark, [(1, None)])).documents.collect()] == [(1, 0, 0, 0.0, 0)]


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 1000):
        x = np.arange(n)
        y = mixing.permuted(x, np.full(n, n), np.full(n, 12345))
        assert sorted(y) == list(range(n))
        assert (mixing.permuted(y, np.full(n, n), np.full(n, 12345), backwards=True) == x).all()
