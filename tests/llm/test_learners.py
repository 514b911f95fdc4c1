import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import language_id as li
from gridloom.llm import quality as ql
from gridloom.llm import toxicity as tx

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, held_out string, kept string, words string"
LABELS = "doc_id long, quality int, toxic int"


def out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def small(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None, "x", "x", "x", "x") for i, t, lang in rows], DOCS)


EDGES = [(1, None, None), (2, "", "en"), (3, "12 34 --", "en"), (4, "word " * 20000, "en"), (4, "word " * 20000, "en"), (None, "no id", "en")]


def test_toxicity_held_out(spark):
    docs, labels = tables(spark)
    got = {r["doc_id"]: r for r in tx.toxicity(docs, labels).collect()}
    assert all(r["held_out"] == out(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    held = [(r["toxic"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if out(r["doc_id"])]
    hits = sum(a and b for a, b in held)
    assert hits / max(1, sum(b for _, b in held)) >= 0.9 and hits / sum(a for a, _ in held) >= 0.5


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(2, 1, 1), (3, 0, 0)], LABELS)
    for known in (labels, spark.createDataFrame([], LABELS)):
        got = tx.toxicity(small(spark, EDGES), known).collect()
        assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)
    assert tx.toxicity(spark.createDataFrame([], DOCS), labels).count() == 0


def test_fit_lowers_the_stated_risk():
    """The fit ends near the least risk: no nearby weights are clearly better."""
    rng = np.random.default_rng(0)
    lists = [[f"w{k}" for k in np.flatnonzero(rng.random(6) < p)] for p in [0.7] * 40 + [0.3] * 80]
    index = {f"w{k}": k for k in range(6)}
    p, u = (tx.SparseRows(np.repeat(np.arange(len(x)), list(map(len, x))), np.array([index[w] for ws in x for w in ws]), len(x), 6) for x in (lists[:40], lists[40:]))
    w, b = tx.fit_nnpu(p, u, 0.2, 2000, 0.02)

    def risk(w, b):
        gp, gu = p.times(w) + b, u.times(w) + b
        return 0.2 * np.logaddexp(0, -gp).mean() + max(0.0, np.logaddexp(0, gu).mean() - 0.2 * np.logaddexp(0, gp).mean()) + 5e-4 * (w @ w)

    best = risk(w, b)
    assert best < risk(np.zeros(6), float(np.log(0.25))) and all(risk(w + rng.normal(0, 0.2, 6), b + rng.normal(0, 0.2)) > best - 0.02 for _ in range(50))


def test_only_near_copies_leave_the_sample():
    """Unrelated texts of a small vocabulary stay; equal sets and sets of similarity 0.8 or more go, whatever their order."""
    rng = np.random.default_rng(4)
    vocabulary = [f"word{k}" for k in range(300)]
    lists = [sorted(rng.choice(vocabulary, 40, replace=False).tolist()) for _ in range(60)]
    lists += [lists[3][::-1], [*lists[5][:38], "other", "another"], [*lists[7][:30], *(f"new{k}" for k in range(10))], ["of", "a"], []]
    kind = [1] * 60 + [1, 1, 1, 1, 1]
    rows = pa.table({"kind": pa.array(kind), "words": pa.array(lists, pa.list_(pa.string()))})
    assert tx.Sample(rows).first_of_families().tolist() == [True] * 60 + [False, False, True, True, True]
    assert tx.Sample(rows.set_column(0, "kind", pa.array([1] * 60 + [2] * 5))).first_of_families().all()


def test_word_beginnings_are_features():
    """By hand: a word, a beginning that some word goes on from, and a beginning that two words share."""
    words = ["abcdef", "abcdxy", "abcd", ""]
    index = {"abcd": 0, "abcd*": 1, "abcd**": 2, "abcde*": 3, "zzzz*": 4}
    row, number = np.array([0, 0, 1, 2, 2]), np.array([0, 1, 0, 2, 3])
    r, c = tx.feature_rows(row, number, words, index)
    assert sorted(zip(r.tolist(), c.tolist(), strict=True)) == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 3), (2, 0)]
    assert all(len(x) == 0 for x in tx.feature_rows(row[:0], number[:0], [], {}))


def test_candidates_against_brute_force():
    """Words, beginnings and shared beginnings of three or more of the marked documents, in order, with their counts."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abü*"), rng.integers(0, 10))).strip("*") for _ in range(300)]
    lists = [sorted(set(rng.choice(words, 25).tolist())) for _ in range(40)]
    own = rng.random(40) < 0.7
    once, twice = {}, {}
    for ws in (ws for ws, mine in zip(lists, own, strict=True) if mine):
        stems = [w[:k] + "*" for w in ws for k in tx.STEMS if len(w) > k and w[k - 1] != "*"]
        for f in {*ws, *stems} - {""}:
            once[f] = once.get(f, 0) + 1
        for f in {f for f in stems if stems.count(f) > 1}:
            twice[f] = twice.get(f, 0) + 1
    want = [*((f, k) for f, k in sorted(once.items()) if k >= 3), *((f + "*", k) for f, k in sorted(twice.items()) if k >= 3)]
    rows = pa.table({"kind": pa.array([1] * 40), "words": pa.array(lists, pa.list_(pa.string()))})
    spelled, count = tx.Sample(rows).candidates(own)
    assert list(zip(spelled, count.tolist(), strict=True)) == want and len(want) > 50
    assert tx.Sample(rows).candidates(np.zeros(40, bool))[0] == [] == tx.Sample(rows.slice(0, 0)).candidates(np.zeros(0, bool))[0]


def test_candidates_take_little_memory():
    """120,000 different words, most of one document: only features that are found are spelled out (11 MB; 224 MB when all were)."""
    rng = np.random.default_rng(8)
    lists = [["common", *("".join(map(chr, x)) for x in rng.integers(97, 123, (2000, 10)))] for _ in range(60)]
    sample = tx.Sample(pa.table({"kind": pa.array([1] * 60), "words": pa.array(lists, pa.list_(pa.string()))}))
    tracemalloc.start()
    spelled, _ = sample.candidates(np.ones(60, bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert "common" in spelled and peak < 30e6


def test_only_toxic_texts_reach_the_driver(spark, monkeypatch):
    """Word lists come from confirmed toxic rows; other rows send chosen features only."""
    seen = []

    class Watched(tx.Sample):
        def __init__(self, rows):
            seen.append(set(rows["kind"].to_pylist()))
            super().__init__(rows)

    monkeypatch.setattr(tx, "Sample", Watched)
    docs, labels = tables(spark)
    assert tx.toxicity(docs, labels).count() == docs.count() and seen == [{1}]


def test_language_held_out(spark):
    docs, _ = tables(spark)
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = li.identify_language(docs).collect()
    held = [(truth[r["doc_id"]] == r["lang_pred"]) for r in got if r["held_out"]]
    assert np.mean(held) > 0.97 and all(r["held_out"] == out(r["doc_id"]) for r in got)


def test_language_edges(spark):
    rows = EDGES + [(i, "the cat sat on the mat " * 3, "en") for i in range(20, 40)] + [(i, "der hund und die katze " * 3, "de") for i in range(40, 60)]
    got = {(r["doc_id"]): r for r in li.identify_language(small(spark, rows)).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[1]["score"] == 0
    assert got[20]["lang_pred"] == "en" and got[41]["lang_pred"] == "de"
    assert li.identify_language(small(spark, EDGES[:1])).first()["lang_pred"] == "und"
    assert li.identify_language(spark.createDataFrame([], DOCS)).count() == 0


def test_cross_parsing_against_brute_force():
    sample = "the cat sat on the mat and the dog ate the mat"
    model = li.LanguageModel((("a", sample), ("b", "xyz zyx")))
    random.seed(4)
    texts = [" ".join("".join(random.choice("thecatsondmxyzq ") for _ in range(random.randint(1, 700))).split()) for _ in range(200)]
    texts = [t for t in texts if t]
    count, size = model.counts(texts)
    for t, own, n in zip(texts, count, size, strict=True):
        phrases = 0
        for a in range(0, len(t), li.STRETCH):
            s, i = t[a : a + li.STRETCH], 0
            while i < len(s):
                k = 1
                while i + k < len(s) and s[i : i + k + 1] in sample:
                    k += 1
                i, phrases = i + k, phrases + 1
        assert own[0] == phrases and n == len(t)


def test_quality_held_out(spark):
    docs, labels = tables(spark)
    got = {r["doc_id"]: r for r in ql.classify_quality(docs, labels).collect()}
    held = [(r["quality"], got[r["doc_id"]]["kept"]) for r in labels.collect() if out(r["doc_id"])]
    assert np.mean([bool(a) == b for a, b in held]) > 0.97
    assert np.mean([b for a, b in held if a]) > 0.98


def test_quality_edges(spark):
    labels = spark.createDataFrame([(2, 1, 1), (3, 0, 0)], LABELS)
    for known in (labels, spark.createDataFrame([], LABELS)):
        got = ql.classify_quality(small(spark, EDGES), known).collect()
        assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)
        whole = ql.classify_quality(small(spark, EDGES), known, whole=True)
        assert whole.columns[: len(DOCS.split(","))] == [c.split()[0] for c in DOCS.split(", ")] and whole.count() == len(EDGES)
    assert ql.classify_quality(spark.createDataFrame([], DOCS), labels).count() == 0


def test_views_exchange_labels():
    """A metadata view that sees nothing at first learns from the content view's sure labels."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 600).astype(float)
    content = (2 * y - 1)[:, None] * 3 + rng.normal(0, 1, (600, 1))
    meta = np.stack([y, rng.normal(0, 1, 600)], 1)
    label = np.where(np.arange(600) < 60, y, -1)
    c, m, last = ql.co_train(content, meta, label, 3, 200, 0.9)
    assert ((m.odds(meta) > 0) == (y > 0)).mean() > 0.95 and last[0] > 0


@pytest.mark.parametrize("word,want", [("hello", "a"), ("Hello###", "Aa###"), ("A1b2", "A9a9"), ("x!!!!!!", "a!!!"), ("ü", "a")])
def test_shapes(word, want):
    assert ql.shape(word) == want


def test_samples_are_bounded_for_repeated_rows(spark):
    from gridloom.llm import common

    rows = spark.range(5000).selectExpr("cast(7 as long) as doc_id", "concat('same ', id % 3) as text").unionByName(spark.range(100).selectExpr("id + 100 as doc_id", "concat('own ', id) as text"))
    keys = common.row_keys(rows.repartition(4))
    taken = common.bounded_sample(keys, 50, 10_000, "s")
    assert len(taken) == len(set(taken)) == 50 and taken == common.bounded_sample(keys.repartition(3), 50, 10_000, "s")
    every = common.bounded_sample(keys, 1000, 100_000, "s")
    assert len(every) == 103
    assert common.sample_texts(rows, {1: every, 0: taken}).count() == 153
    assert 0 < sum(6 for _ in common.bounded_sample(keys, 1000, 60, "s")) <= 72
    few = common.bounded_sample(spark.range(20000).selectExpr("id as doc_id", "'t' as text").transform(common.row_keys), 300, 10**6, "s")
    assert len(few) == 300


def test_learners_with_repeated_ids(spark):
    from gridloom.llm import quality, toxicity

    schema = "doc_id long, text string, source string, lang string, n_chars long, _score string, _kept string"
    train = next(i for i in range(50) if __import__("zlib").crc32(str(i).encode()) % 3 != 1)
    rows = [(train, f"vile filth number {i % 4}", "a", "en", 10, "s", "k") for i in range(800)]
    rows += [(i, f"calm words of day {i}", "b", "en", 10, "s", "k") for i in range(1000, 1200)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    labels = spark.createDataFrame([(train, 0, 1)] + [(i, 1, 0) for i in range(1000, 1200)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 1000
    out = quality.classify_quality(docs, labels, whole=True)
    assert out.columns == [*docs.columns, "__score", "__kept"] and out.count() == 1000
    assert {(r["_score"], r["_kept"]) for r in out.select("_score", "_kept").distinct().collect()} == {("s", "k")}
