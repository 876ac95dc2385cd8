"""The pipeline against brute force, stage by stage, and the query registry."""

import random
from collections import defaultdict

import corpus_pipeline
from test_llm_exact import components_brute, exact_brute, simhash_brute, targets_brute
from test_llm_text import leaks_brute, prose

import __spark_entry__

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(rng):
    texts = [None, "", " 12 ", "!!"]
    base = [prose(rng, lang, rng.randrange(40, 120)) for lang in ["aa", "bb", "cc"] * 12]
    items = [(i, prose(rng, "aa", 30)) for i in range(4)]
    texts += base
    texts += [b + " " for b in base[:8]] + base[:3]
    for b in base[8:20]:
        words = b.split()
        words[rng.randrange(len(words))] = "ba"
        texts.append(" ".join(words))
    texts += [f"{prose(rng, 'bb', 20)} {t} {prose(rng, 'bb', 20)}" for _, t in items]
    rng.shuffle(texts)
    lang = lambda t: "bb" if (t or "").startswith("t") else "aa"
    return [(i, t, lang(t), rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)], items


def test_pipeline_brute_force(spark, tmp_path):
    docs, items = corpus(random.Random(12))
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [d for d in docs if any(c.isalpha() for c in d[1] or "")]
    kept = exact_brute([(d[0], d[1]) for d in left])
    left = [d for d in left if kept[d[0]][2]]
    roots = components_brute({d[0]: simhash_brute(d[1]) for d in left})
    left = [d for d in left if roots[d[0]] == d[0]]
    leaks = {i for i, _ in leaks_brute([(d[0], d[1]) for d in left], items)}
    left = [d for d in left if d[0] not in leaks]
    assert 0 < len(left) < len(docs) and leaks

    frame, stages = spark.createDataFrame(docs, DOCS), {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        stages[name] = frame
        if name != "mixing sources":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(map(tuple, stages["benchmark decontamination"].collect())) == sorted(left)

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by = defaultdict(dict)
    for d in left:
        by[d[3]][d[0]] = len(d[1].split())
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = targets_brute([sum(by[s].values()) for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2.0)
    took, source = defaultdict(int), {i: s for s in by for i in by[s]}
    assert sorted(r["doc_id"] for r in out) == sorted(source)
    for r in out:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (by[s][r["doc_id"]], sum(by[s].values())) and r["taken"] <= 2 * r["size"]
        took[s] += r["taken"]
    assert all(abs(took[s] - t) < 1 for s, t in zip(order, want, strict=True))


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_with_clashing_names(spark):
    """Extra columns named like those that the operators use, repeated identifiers and null ones."""
    names = ["_lost", "_again", "_hit", "_id", "_same", "_c0", "same", "fp", "id", "stays", "n", "item", "row", "keep_id", "lang_pred", "score", "_key", "kept"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    rng = random.Random(3)
    a, b, c, leak = (prose(rng, "aa", n) for n in (900, 900, 60, 60))
    near = lambda t: t + " ba"
    texts = [(5, a), (7, near(a)), (5, b), (2, near(b)), (None, c), (None, c), (9, leak), (9, prose(rng, "bb", 60)), (11, "solo " * 30), (11, "solo " * 30)]
    docs = spark.createDataFrame([(i, t, "aa", "s", 1, *range(len(names))) for i, t in texts], schema)
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    from nearkin.llm import decontaminate, simhash

    prints = {t: simhash_brute(t) for _, t in texts}
    assert (prints[a] ^ prints[near(a)]).bit_count() <= 3 and (prints[b] ^ prints[near(b)]).bit_count() <= 3
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr)
    assert kept == sorted([(5, a), (2, near(b)), (None, c), (9, leak), (9, texts[7][1]), (11, "solo " * 30)], key=repr)
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.first()["_lost"] == 0
    assert sorted((r["doc_id"] or 0, r["text"]) for r in clean.collect()) == sorted((i or 0, t) for i, t in texts if t != leak)
    for _, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 0


def test_registry():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES][3] == "benchmark decontamination"
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_sql_matches(spark):
    import duckdb

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name in ("op1_exact_dedup", "op4_decontamination", "op6_secrets", "op8_warc"):
        got = __spark_entry__.queries()[name](spark, folder)
        want = con.sql(__spark_entry__.oracle_sql()[name])
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
