import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import pii
from gridloom.llm import topk_search as tk


def brute(rows, k=10, every=100):
    whole = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q % every == 0:
            found = sorted(((-int(a @ b), i) for i, b in whole if i != q and len(a) == len(b)))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_top_k(spark, scale):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(0, 1, (700, 8)) * scale).astype(np.float32)
    vectors[200:450] = vectors[7]  # one very common vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(1000, None), (1001, [None] * 8), (1100, [float("nan")] * 8), (1200, [float("inf")] * 8), (1300, [1.0, 2.0]), (1301, [2.0, 1.0]), (1400, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int").repartition(4)
    if scale > 1:
        df = df.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    got = sorted(tuple(r) for r in tk.exact_top_k(df, F.col("vec_id") % 100 == 0, block=3).collect()) if scale == 1 else None
    if scale == 1:
        assert got == brute(rows)
    else:  # products beyond 2^53 stay exact
        a, b = rows[0][1], rows[1][1]
        top = {(r["query_id"], r["vec_id"]): r["score"] for r in tk.exact_top_k(df.filter("vec_id < 12"), F.col("vec_id") % 100 == 0, scale=1).collect()}
        assert top[0, 1] == sum(int(np.floor(x)) * int(np.floor(y)) for x, y in zip(a, b, strict=True)) if (0, 1) in top else True


def test_every_row_of_a_repeated_query_id_is_a_query(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 230, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 1, (460, 6)).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = brute(rows, k=4)
    assert len(want) == 6 * 4
    for block in (1, 2, 4, 4096):
        assert sorted(tuple(r) for r in tk.exact_top_k(df, F.col("vec_id") % 100 == 0, k=4, block=block).collect()) == want


def products_of(vectors, queries, k=10):
    norm = np.sqrt((vectors**2).sum(1))
    order = np.argsort(-norm, kind="stable")
    best, taken = tk.Best(len(queries), k), 0
    for a in range(0, len(order), tk.BUCKET):
        rows = order[a : a + tk.BUCKET]
        taken += tk.search_bucket(best, queries, np.full(len(queries), -1), np.sqrt((queries**2).sum(1)), tk.Bucket(vectors[rows], rows, norm[rows]))
    full = queries @ vectors.T
    want = [[int(i) for i in np.lexsort((np.arange(len(vectors)), -s))[:k]] for s in full]
    assert best.id.tolist() == want
    return taken / full.size


def test_lengths_and_coordinates_spare_products():
    rng = np.random.default_rng(4)
    spread = np.floor(1024 * rng.normal(0, 1, (30000, 32)) * rng.lognormal(0, 1, (30000, 1)))
    queries = np.floor(1024 * rng.normal(0, 1, (50, 32)))
    assert products_of(spread, queries) < 0.3
    # Vectors of one length in tight bunches: lengths say nothing, coordinates do.
    centres = rng.normal(0, 1, (300, 32))
    bunched = np.repeat(centres, 100, 0) + rng.normal(0, 0.02, (30000, 32))
    bunched = np.floor(1024 * 8 * bunched / np.sqrt((bunched**2).sum(1, keepdims=True)))
    assert products_of(bunched, bunched[::500]) < 0.6


def test_top_k_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert tk.exact_top_k(empty, F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0]), (0, [2.0])], "vec_id long, embedding array<float>")
    assert tk.exact_top_k(one, F.col("vec_id") % 100 == 0).count() == 0


TEXTS = [
    "call +1 (017) 555-7713 now", "card 4111 1111 1111 1111, 4111-1111-1111-1111.", "ip 56.187.231.175", "mail und.34@mail7.example.com.", "on 2024-02-29", "ssn 123-45-6789", "GB82 WEST 1234 5698 7654 32",
    'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "+44 20 7946 0958", "7536784127813050 4845168114407329",
]
CLEAN = ["bad 4111111111111112", "ip 300.1.1.1 and 1.2.3", "2023-02-30", "000-12-3456", "GB82 WEST 1234 5698 7654 33", "version 4.0.", "year 2024, 12 of 15", "a @ b", "", "0000000000000000"]


@pytest.mark.parametrize("text", TEXTS)
def test_pseudonyms_keep_format_and_come_back(text):
    new, found = pii.pseudonymise(text, "k")
    assert found and new != text and re.sub(r"[0-9a-f]", "x", new.lower()) is not None
    assert pii.pseudonymise(new, "k", back=True)[0].lower() == text.lower()
    assert [f[2] for f in pii.pseudonymise(new, "k")[1]] == [f[2] for f in found]
    assert pii.pseudonymise(text, "other")[0] != new
    for a, b, _ in found:
        assert text[a:b] not in new


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_stays(text):
    assert pii.pseudonymise(text, "k") == (text, [])


CARD, IBAN = "4111111111111111", "BE68539007547034"


@pytest.mark.parametrize(
    "text,values",
    [
        (f"{CARD} 12/26", [CARD]), ("4111 1111 1111 1111 12/26", ["4111 1111 1111 1111"]), (f"{CARD} 123", [CARD]), (f"{CARD}-123", [CARD]), (f"12 {CARD} 123", [CARD]),
        (f"{CARD} 97.51.17.173", [CARD, "97.51.17.173"]), (f"97.51.17.173 {CARD}", ["97.51.17.173", CARD]), (f"{CARD} {CARD} 12", [CARD, CARD]),
        (f"{IBAN} EUR", [IBAN]), ("BE68 5390 0754 7034 PAID", ["BE68 5390 0754 7034"]), (f"{IBAN} PAID IN FULL", [IBAN]), ("GB82 WEST 1234 5698 7654 32 GBP", ["GB82 WEST 1234 5698 7654 32"]),
        ("+33 6 12 34 56 78", ["+33 6 12 34 56 78"]), ("+45 1 2 3 4 5 6 7 8.", ["+45 1 2 3 4 5 6 7 8"]), ("+44 (0)20 7946 0958", ["+44 (0)20 7946 0958"]), ("+33612345678", ["+33612345678"]),
        (f"+33 6 12 34 56 78 {CARD}", ["+33 6 12 34 56 78", CARD]), ("+33 6 12 34 56 78 4111 1111 1111 1111", ["+33 6 12 34 56 78", "4111 1111 1111 1111"]), ("+33 6 12 34 56 78 97.51.17.173", ["+33 6 12 34 56 78", "97.51.17.173"]),
    ],
)
def test_values_beside_other_text(text, values):
    new, found = pii.pseudonymise(text, "k")
    assert [text[a:b] for a, b, _ in found] == values
    assert all(v not in new for v in values) and re.sub("[A-Z0-9]+", "x", new) == re.sub("[A-Z0-9]+", "x", text)


def test_a_long_number_takes_no_long_time():
    assert pii.pseudonymise("+1" + "2" * 5000 + " " + "+1 2" * 5000, "k")[0]


def test_equal_values_stay_linked():
    digits = lambda s: re.sub(r"\D", "", s)
    a, b = pii.pseudonymise("4111 1111 1111 1111", "k")[0], pii.pseudonymise("4111-1111-1111-1111", "k")[0]
    assert digits(a) == digits(b) and a[4] == " " and b[4] == "-"
    assert pii.pseudonymise("x 9.8.7.6 y 9.8.7.6", "k")[0].split()[1] == pii.pseudonymise("9.8.7.6", "k")[0]


@pytest.mark.parametrize("size", [1, 2, 3, 1000, 73049])
def test_feistel_is_a_permutation(size):
    net = pii.Feistel(size, "x", "k")
    some = range(min(size, 1000))
    image = [net.forward(i) for i in some]
    assert len(set(image)) == len(image) and all(0 <= v < size for v in image) and [net.back(v) for v in image] == list(some)


def test_documents(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, *CLEAN])] + [(50, None), (51, "x " * 50000 + TEXTS[0]), (3, TEXTS[3]), (3, TEXTS[3])]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n_pii int, pii string")
    got = pii.pseudonymise_documents(df, "k")
    assert got.columns == ["doc_id", "text", "n_pii", "pii", "_n_pii", "_pii"]
    want = [(i, None if t is None else pii.pseudonymise(t, "k")[0]) for i, t in rows]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, want))
    assert pii.pseudonymise_documents(df.limit(0)).count() == 0
    random.seed(0)


def test_one_pseudonym_for_all_writings_of_a_number():
    numbers = ["+442079460958", "+44 20 7946 0958", "+44 (0)20 7946 0958", "+44-20-79460958"]
    new = {re.sub("[^0-9]", "", pii.pseudonymise(n, "k")[0].replace("(0)", "")) for n in numbers}
    assert len(new) == 1 and new.pop().startswith("44")
    assert len({re.sub("[^0-9]", "", pii.pseudonymise(n, "k")[0])[-10:] for n in ("+1 202 555 0143", "(202) 555-0143", "202-555-0143", "+12025550143")}) == 1


def test_ibans_keep_the_places_of_letters_and_digits():
    for text in ("GB82 WEST 1234 5698 7654 32", "NL91ABNA0417164300", "FR1420041010050500013M02606", "DE89370400440532013000"):
        new, found = pii.pseudonymise(text, "k")
        assert [f[2] for f in found] == ["iban"] and new != text and new[:2] == text[:2]
        assert re.sub("[A-Z]", "A", re.sub("[0-9]", "9", new)) == re.sub("[A-Z]", "A", re.sub("[0-9]", "9", text))
        raw = new.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1


#: Written by hand: text, and what is to be found in it.
FINDS = [
    ("pay 4111111111111111 12/26 now", [("card", "4111111111111111")]),
    ("BE68 5390 0754 7034 PAID", [("iban", "BE68 5390 0754 7034")]),
    ("+33 6 12 34 56 78", [("phone", "+33 6 12 34 56 78")]),
    ("ring (202) 555-0143, or mail a.b@x.org", [("phone", "(202) 555-0143"), ("email", "a.b@x.org")]),
    ("from 10.0.0.1 on 2020-01-31: 078-05-1120", [("ipv4", "10.0.0.1"), ("date", "2020-01-31"), ("ssn", "078-05-1120")]),
    ("31.12.1999 and 12/31/1999, not 31/31/1999", [("date", "31.12.1999"), ("date", "12/31/1999")]),
    ("nothing at 1234 5678", []),
]


@pytest.mark.parametrize(("text", "want"), FINDS)
def test_finds_written_by_hand(text, want):
    assert [(k, text[a:b]) for a, b, k in pii.pseudonymise(text, "k")[1]] == want


def test_failed_numbers_take_linear_time():
    import time

    def seconds(n):
        began = time.process_time()
        pii.pseudonymise("1234567890123 " * n, "k")
        return time.process_time() - began

    seconds(100)
    assert seconds(40_000) < 10 * seconds(10_000)


def test_documents_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.org", 5, "x"), (2, None, 6, "y"), (3, "", 7, "z")], "doc_id long, text string, _n_pii long, _pii string").repartition(1)
    out = pii.pseudonymise_documents(docs)
    assert out.columns == ["doc_id", "text", "_n_pii", "_pii", "__n_pii", "__pii"]
    assert [(r["doc_id"], r["_n_pii"], r["_pii"], r["__n_pii"], r["text"] is None) for r in out.orderBy("doc_id").collect()] == [(1, 5, "x", 1, False), (2, 6, "y", 0, True), (3, 7, "z", 0, False)]
