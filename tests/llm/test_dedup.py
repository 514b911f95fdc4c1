import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import grace_dedup as gd
from gridloom.llm import line_dedup as ld
from gridloom.llm import simhash as sh
from gridloom.llm.graph import components, local_stars
from gridloom.llm.xxh import xxh64_many

random.seed(11)
SCHEMA = "doc_id long, text string, h string, n string, gid string, fp string, rep string, n_lines string, kept_text string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, *"abcdefg") for i, t in texts], SCHEMA).repartition(5)


def test_xxh64():
    raw = bytes(random.randrange(256) for _ in range(5000))
    starts = np.array([random.randrange(4900) for _ in range(2000)])
    lengths = np.array([random.randrange(70) for _ in range(2000)])
    got = xxh64_many(np.frombuffer(raw, np.uint8), starts, lengths)
    assert got.tolist() == [xxhash.xxh64_intdigest(raw[a : a + n], 42) for a, n in zip(starts, lengths, strict=True)]


@pytest.mark.parametrize("table_bytes", [64 << 20, 300])
def test_exact_dedup(spark, table_bytes):
    texts = [(i, random.choice(["a", "b", "ß", "x" * 5000, "", None, "same " * 50, str(i)])) for i in range(400)] + [(7, "dup"), (7, "dup"), (None, "only null id"), (None, "a")]
    got = gd.exact_dedup(frame(spark, texts), table_bytes).collect()
    by: dict = {}
    for i, t in texts:
        by.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    want = [(i, keep[t or ""], len(by[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert gd.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_hashes_compare_content():
    records = [(5, k, k, 1, c) for k, c in enumerate([b"x", b"y", b"x", b"z" * 100, b"y"])]
    got = sorted((sorted(m), keep, size) for m, keep, size, _ in gd.groups(iter(records), most=10))
    assert got == [([0, 2], 2, 2), ([1, 4], 4, 2), ([3], 3, 1)]


def brute_lines(texts, common, keep_first=False):
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans(ld.UPPER, ld.LOWER)
    key = lambda x: x.strip(strip).translate(low)
    count: dict = {}
    for _, t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + (k != "")
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[key(x)] < common]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 7])
def test_line_dedup(spark, batches):
    lines = ["Common Line", " common line\t", "COMMON ÄÖ", "common äö", "\x0bvt", "", " ", "rare"]
    texts = [(i, random.choice([None, "", "\n\n", "\n".join(random.choice([*lines, f"own {i}"]) for _ in range(random.randint(1, 6)))])) for i in range(150)] + [(500, "rep\nrare"), (500, "rep\nrare"), (None, "Common Line\nnull id")]
    got = [tuple(r) for r in ld.drop_common_lines(frame(spark, texts), 10, batches=batches).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_lines(texts, 10)))
    assert ld.drop_common_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_first_copy_of_a_line_stays(spark):
    texts = [(i, f"shared\nown {i}") for i in range(20)]
    got = {r["doc_id"]: r["kept_text"] for r in ld.drop_common_lines(frame(spark, texts), 10, batches=3, keep_first=True).collect()}
    assert sum("shared" in t for t in got.values()) == 1 and all(f"own {i}" in got[i] for i in got)


def test_runs_are_compacted_and_merge_without_shuffles(spark):
    runs = ld.LineRuns(spark, 3, fanout=2, partitions=4)
    for b in range(5):
        runs.add(spark.createDataFrame([(1, 1, 3, b), (b, 2, 1, b), (7, 7, 1, b)], "h1 long, h2 long, n long, first long"))
    assert len(runs.runs()) < 5 and sorted(tuple(r)[:2] for r in runs.common_keys().collect()) == [(1, 1), (7, 7)]
    a, b = runs.runs()[:2] if len(runs.runs()) > 1 else (runs.runs()[0],) * 2
    plan = a.join(b.hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def brute_simhash(texts, width=3, bits=3):
    prints = []
    for _, t in texts:
        w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if x]
        shingles = [b" ".join(w[j : j + width]) for j in range(max(1, len(w) - width + 1))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    f = np.array(prints, np.uint64)
    for a in range(len(f)):
        for b in np.flatnonzero(np.bitwise_count(f[a] ^ f[a + 1 :]) <= bits) + a + 1:
            root[find(int(b))] = find(a)
    least: dict = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, f"{prints[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(texts)]


@pytest.mark.parametrize("tile", [2048, 3])
def test_simhash(spark, tile):
    base = [" ".join(random.choice(["alpha", "Be", "c", "ddd", "long" * 9, "é"]) for _ in range(12)) for _ in range(40)]
    texts = [(i, random.choice([None, "", " \t", "a", "A b", "x\x0by z w", *base])) for i in range(150)]
    texts = [(i, t + " zz" if t and i % 5 == 0 else t) for i, t in texts] + [(3, "twice here now"), (3, "twice here now"), (None, base[0])]
    got = [(r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in sh.near_duplicates(frame(spark, texts), tile=tile).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_simhash(texts)))


def test_simhash_of_nothing(spark):
    assert sh.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dense_ball_of_fingerprints(spark):
    """Near copies by the hundred: buckets are split, no link is lost."""
    rng = np.random.default_rng(2)
    center = rng.integers(0, 2**63, dtype=np.int64)
    fp = {int(center ^ np.bitwise_or.reduce(np.int64(1) << rng.choice(14, rng.integers(1, 4), replace=False).astype(np.int64))) for _ in range(400)} | set(rng.integers(0, 2**63, 100).tolist())
    rows = list(enumerate(sorted(fp)))
    nodes = spark.createDataFrame([(f, i) for i, f in rows], "fp long, rep long")
    got = {r["node"]: r["component"] for r in components(sh.find_links(nodes, 3, tile=16)).collect()}
    f = np.array([x for _, x in rows], np.int64).view(np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3, 1))
    x, y = local_stars(a, b)
    assert {k: v for k, v in got.items() if k != v} == dict(zip(x.tolist(), y.tolist(), strict=True))


def test_long_text_fingerprint(monkeypatch):
    t = pa.array(["one two three four five " * 400, "a b c"], pa.large_string())
    want = sh.fingerprints(t, 3)
    monkeypatch.setattr(sh, "STEP", 50)
    assert (sh.fingerprints(t, 3) == want).all()


def test_components_of_a_chain(spark):
    n = 120
    links = spark.range(n - 1).select((F.col("id") * 37 % n).alias("x")).select(F.col("x").alias("a"), ((F.col("x") + 1) % n).alias("b"))
    got = components(links).collect()
    edges = {(int(k * 37 % n), int((k * 37 % n + 1) % n)) for k in range(n - 1)}
    x, y = local_stars(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    want = dict(zip(x.tolist(), y.tolist(), strict=True))
    assert all(want.get(r["node"], r["node"]) == r["component"] for r in got)


@pytest.mark.parametrize("tile", [sh.TILE, 1])
def test_links_run_through_texts_of_null_ids(spark, monkeypatch, tile):
    """A and B are 6 bits apart, and a text of null id is 3 bits from either."""
    prints = {"A": 0, "N": 0b111, "B": 0b111111, "M": 0x0FFFFFFF00000000}
    monkeypatch.setattr(sh, "fingerprint_batches", lambda width: made_prints(prints))
    docs = spark.createDataFrame([(5, "A"), (None, "N"), (3, "B"), (None, "M")], "doc_id long, text string")
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in sh.near_duplicates(docs, tile=tile).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(5, 0, 3), (None, 7, 3), (3, 63, 3), (None, 0x0FFFFFFF00000000, None)]))


def made_prints(prints):
    def run(batches):
        for batch in batches:
            fp = [prints[t] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return run


def test_lines_with_clashing_columns_and_long_texts(spark):
    from gridloom.llm import line_dedup as ld

    long_ = "\n".join(f"line {i}" for i in range(30_000))
    rows = [(i, "same\nown" + str(i), "d", "c", "k") for i in range(12)] + [(100, long_, "d", "c", "k"), (101, None, "d", "c", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc string, _common string, _kept string").repartition(3)
    out = ld.drop_common_lines(docs, common=3)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped", "kept_text"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == 14 and all((r["_doc"], r["_common"], r["_kept"]) == ("d", "c", "k") for r in got.values())
    assert got[3]["kept_text"] == "own3" and got[100]["kept_text"] == long_ and (got[101]["n_lines"], got[101]["kept_text"]) == (1, "")
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_pivots_form_fewer_pairs_and_miss_none():
    import numpy as np

    from gridloom.llm import simhash as sh

    rng = np.random.default_rng(6)
    per_node = []
    for n in (4000, 16000):
        fp = rng.integers(0, 2**63, n).astype(np.uint64)
        fp[n // 2 :] = fp[: n - n // 2] ^ (np.uint64(1) << rng.integers(0, 64, n - n // 2).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n - n // 2).astype(np.uint64))
        key = rng.integers(0, n // 200, n // 2)
        key = np.concatenate([key, key[: n - n // 2]])
        mask = np.zeros(n, np.int64)
        a, b, formed = sh.linked_pairs(mask, key, fp, 3)
        whole = sum(int(x) * (int(x) - 1) // 2 for x in np.bincount(key))
        want = {(i, j) for k in np.unique(key).tolist() for at in [np.flatnonzero(key == k)] for i, j in zip(*(at[x] for x in np.nonzero(np.triu(np.bitwise_count(fp[at][:, None] ^ fp[at][None, :]) <= 3, 1))), strict=True)}
        assert {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)} == want
        assert formed < 0.7 * whole
        per_node.append(formed / n)
    assert per_node[1] < 1.5 * per_node[0]  # as many a node where buckets are as large
