"""Bounds that hold whatever repeats, linear rules, and decisions by brute force."""

import math
import random
import shutil
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame as ClassicFrame
from test_llm_text import DOCS, leaks_brute, longest_match_phrases, prose

from nearkin.llm import decontaminate, language_id, secrets, toxicity

ROOT = Path(__file__).resolve().parent.parent.parent


@pytest.fixture
def collected(monkeypatch):
    """The numbers of rows that reach the driver."""
    counts, plain = [], ClassicFrame.collect

    def collect(self):
        rows = plain(self)
        counts.append(len(rows))
        return rows

    monkeypatch.setattr(ClassicFrame, "collect", collect)
    return counts


def test_language_sample_of_one_identifier(spark, collected):
    """100,000 rows of one identifier, with few and with many texts, leave a bounded sample and the other languages' texts."""
    hot = spark.range(100_000)
    rng = random.Random(1)
    rest = spark.createDataFrame([(i, prose(rng, "bb", 30), "bb") for i in range(40)], "doc_id long, text string, lang string")
    for text in (F.lit("ba be bi bo bu " * 5), F.concat(F.lit("ba be "), F.col("id").cast("string"))):
        docs = hot.select(F.lit(3).cast("long").alias("doc_id"), text.alias("text"), F.lit("aa").alias("lang")).union(rest)
        collected.clear()
        model = language_id.fit(docs, train_docs=16)
        assert model.languages == ("aa", "bb") and all(len(t) > 50 for t in model.texts)
        assert sum(collected) <= 2 + 2 * 2 * 16


def test_toxicity_sample_of_one_identifier(spark, collected):
    docs = spark.range(100_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).union(spark.createDataFrame([(4, "you idiot"), (6, "a flower")], "doc_id long, text string"))
    labels = spark.createDataFrame([(3, 0), (4, 1), (6, 0)], "doc_id long, toxic int")
    sample = toxicity._sample(docs, labels, "doc_id", "text", "doc_id", "toxic", 100).collect()
    assert len(sample) <= 3 and len({r["id"] for r in sample}) == len(sample)
    collected.clear()
    toxicity.fit(docs, labels, train_rows=100)
    assert sum(collected) < 100


def test_language_decision_and_score_brute_force():
    rng = random.Random(14)
    model = language_id.LanguageModel(("aa", "bb", "cc"), (prose(rng, "aa", 200), prose(rng, "bb", 350), prose(rng, "cc", 100)), "abeioutx")
    p = language_id.parser(model)
    texts = [None, "", "12 !", "ba", "te", "zz", "q" * 600]
    texts += [prose(rng, rng.choice(["aa", "bb", "cc"]), rng.randrange(1, 80)) + " " + prose(rng, "aa", rng.randrange(5)) for _ in range(60)]
    best, score = p.predict(texts)
    plain = lambda t: "".join(chr(65 + c) for c in p.encode(t)[0])
    for text, b, s in zip(texts, best, score, strict=True):
        letters = sum(c.isalpha() for c in text or "")
        if not letters:
            assert (b, s) == (-1, 0)
            continue
        bits = [longest_match_phrases(plain(text), plain(t), language_id.SEGMENT) * math.log2(len(t)) for t in model.texts]
        assert b == bits.index(min(bits))
        assert s == pytest.approx(1 / sum(2 ** -((x - min(bits)) / letters * min(letters, 50)) for x in bits))


def test_secrets_are_linear():
    """Texts made to be read again and again; a megabyte of each takes about a second at most."""
    hostile = [
        "X: -----BEGIN PRIVATE KEY-----\n", "-----BEGIN PRIVATE KEY-----\nX: y\n", "-----BEGIN PRIVATE KEY-----\n", "-----BEGIN A PRIVATE KEY-----\nAAAA\n", "a-b-c: -d\n", "http://", "a+b-c.d", "http://u", "x://aaaaaaaa:bbb", "eyJaaaaaaaaaaa.", "ghp_", "xox", "token=", "://:@", "A"]
    for part in hostile:
        text = "-----BEGIN PRIVATE KEY-----\n" + part * (1_000_000 // len(part))
        began = time.process_time()
        secrets.spans(text)
        assert time.process_time() - began < 3, part


def test_secret_kinds_without_bounds():
    found = lambda t: [(secrets.KINDS[k], t[s:e]) for s, k, e in secrets.spans(t)[1] if secrets.KINDS[k] in ("url", "pem")]
    for scheme, user in (("https", "u" * 150), ("s" * 60, "me"), ("git+ssh", "a.b")):
        assert found(f"see 1{scheme}://{user}:secret-1@host") == [("url", f"{scheme}://{user}:secret-1@")]
    assert found("h://u:pass@x") == [] and found("http://u:abc@x") == []
    assert found("http://a:pass1@http://b:pass2@c") == [("url", "http://a:pass1@"), ("url", "http://b:pass2@")]
    assert found("+-9x9://a:pass1@") == [("url", "x9://a:pass1@")]
    key = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,AB-CD-\n\nAAAA\nBBBB==\n-----END RSA PRIVATE KEY-----"
    assert found(key) == [("pem", key)] and found("x-----BEGIN PRIVATE KEY-----\nA: " + key) == [("pem", key)]


def test_decontamination_of_long_repetitive_texts(spark):
    """Time does not grow with windows times their length; results are those of all windows."""
    item = "one two three four five six seven eight nine ten eleven twelve".split()
    items = [(1, "same " * 100), (2, "same " * 300), (3, " ".join(item))]
    docs = [(0, "same " * 20_000), (1, "same " * 250), (2, ("same " * 40 + "other ") * 30), (3, " ".join(item[:6] + ["x"] + item[6:] + item)), (4, "same " * 90 + "end")]
    frames = spark.createDataFrame([(*d, "en", "s", 0) for d in docs], DOCS), spark.createDataFrame(items, "item_id long, text string")
    took = []
    for n in (1, 2):
        began = time.time()
        decontaminate.contaminated(frames[0], frames[1].filter(f"item_id = {n}")).collect()
        took.append(time.time() - began)
    assert took[1] < 2 * took[0] + 5
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(*frames).collect()}
    assert got == set(leaks_brute([d for d in docs if d[0]], items)) | {(0, 1), (0, 2)}


def test_a_missing_library_is_an_error(tmp_path):
    """Only the optional parts themselves may be absent."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    (tmp_path / "r" / "xxhash.py").write_text("raise ModuleNotFoundError('no xxhash', name='xxhash')")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "r", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
    assert out.returncode != 0 and "xxhash" in out.stderr
