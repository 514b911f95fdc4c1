import random

import numpy as np
import pandas as pd
import pyarrow as pa

import corpus_pipeline as cp
from gridloom.llm import set_similarity as ss

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, width=5):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[j : j + width]) for j in range(max(1, len(w) - width + 1))) if w else frozenset()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute_groups(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            if alike(sets[a], sets[b]):
                root[find(b)] = find(a)
    return [find(i) for i in range(len(sets))]


def some_texts():
    rng = random.Random(5)
    texts = [None, "", " \t", "one two", "One  Two", "one two three"]
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 20, 60, 200, 900]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(50)}"
            texts.append(" ".join(copy[rng.randrange(3) :]))
    # A chain: neighbours are alike, its ends are not.
    texts += [" ".join(f"c{k}" for k in range(9 * i, 9 * i + 104)) for i in range(12)]
    return texts


def test_stage_finds_all_pairs_of_similarity_0_8(spark):
    texts = some_texts()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    group = brute_groups(texts)
    want = sorted(min(i for i in range(len(texts)) if group[i] == g) for g in set(group))
    assert sorted(r["doc_id"] for r in cp.near_dedup_stage(spark, docs, SF).collect()) == want
    assert 20 < len(want) < len(texts) - 20


def test_one_row_of_each_group_stays_for_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(50)) for k in "abc")
    rows = [(1, a), (1, a), (1, a + " more"), (None, b), (None, b), (None, c), (7, c), (7, "other text of the same id here"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    got = [(r["doc_id"], (r["text"] or "")[:2]) for r in cp.near_dedup_stage(spark, docs, SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "a0"), (None, "b0"), (7, "c0"), (7, "ot"), (None, "")]))


def test_maps_never_count_more_than_differs():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, m = rng.integers(1, 400, 2)
        pool = rng.integers(0, 2**63, 500).astype(np.uint64)
        x, y = np.unique(rng.choice(pool, n)), np.unique(rng.choice(pool, m))
        p, q = ss.parity_maps(np.array([len(x), len(y)]), np.concatenate([x, y]))
        size = min(len(p), len(q))
        assert np.bitwise_count(ss.folded(p, size) ^ ss.folded(q, size)).sum() <= len(np.setxor1d(x, y))


def test_no_texts(spark):
    assert ss.near_copies(spark.createDataFrame([], "_row long, text string")).count() == 0


def test_heavy_shingles_change_no_group(spark):
    texts = some_texts()
    passage = [f"p{k}" for k in range(80)]
    texts += [" ".join([f"u{i}x{k}" for k in range(10 + i)] + passage) for i in range(40)]  # alike where own words are few
    rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string").repartition(3)
    group = brute_groups(texts)
    for share, seen in ((1.0, 2), (1.0, 30), (0.5, 3)):
        got = {r["_row"]: r["component"] for r in ss.near_copies(rows, share=share, seen=seen).collect()}
        assert len(set(zip(group, (got[i] for i in range(len(texts)))))) == len(set(group)) == len(set(got.values()))


def test_stage_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, 6), (2, "a b c", 7, 8), (3, "d", 9, 1)], "doc_id long, text string, _row long, component long")
    got = cp.near_dedup_stage(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, "a b c", 5, 6), (3, "d", 9, 1)]


def test_a_pair_is_tried_at_one_meeting(spark):
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join([f"u{i}x{k}" for k in range(1 + i % 6)] + passage + [f"v{rng.randrange(9)}"]) for i in range(50)]
    rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    heavy = ss.heavy_shingles(rows, 5, 1.0, 3)
    arrow = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(texts, pa.large_string())], ["_row", "text"])
    for heavy in (heavy, heavy[:0]):
        nodes = next(ss.describe(5, heavy)([arrow])).to_pandas().set_index("node")
        met = next(ss.first_shingles(5, heavy)([arrow])).to_pandas().drop_duplicates()
        met["component"], met["outer"] = met["node"], True
        inner = met["node"] == met["node"].min()
        met.loc[inner, "outer"] = False
        late = met[(met["part"] >= 0) & met["outer"]]
        met = pd.concat([met, *(late.assign(part=p) for p in range(ss.PARTS))]).drop_duplicates().sort_values(["h", "part"])
        met = met.join(nodes[["bits", "lead"]], "node").astype({"part": "int32"})
        wanted = set()
        for _, here in met.groupby(["h", "part"]):
            at = here["node"].tolist()
            wanted |= {(max(x, y), min(x, y)) for x in at for y in at if x != y}
        got = []
        for batch in ss.pairs_across([pa.RecordBatch.from_pandas(met, preserve_index=False)]):
            got += list(zip(batch["a"].to_pylist(), batch["b"].to_pylist()))
        full = ss.Maps(nodes["bits"].tolist())
        place = {x: i for i, x in enumerate(nodes.index)}
        n = nodes["n"].to_numpy()
        kept = {(x, y) for x, y in wanted if 9 * full.apart(place[x], np.array([place[y]]))[0] <= n[place[x]] + n[place[y]]}
        assert len(got) == len(set(got)) and set(got) == kept and len(kept) > 100


def test_leads_name_the_first_common_shingle():
    rng = np.random.default_rng(8)
    lists = [np.sort(rng.choice(40, rng.integers(0, ss.LEAD + 1), replace=False)).astype(np.int64) for _ in range(60)]
    leads = ss.Leads([x.tobytes() for x in lists])
    for i in range(60):
        for h in range(0, 40, 7):
            got = leads.meet_here(i, np.arange(60), h)
            for j in range(60):
                both = sorted(set(lists[i].tolist()) & set(lists[j].tolist()))
                assert got[j] == (not both or both[0] == h)
