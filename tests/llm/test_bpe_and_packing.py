import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridloom.llm.bpe import IdStore
from gridloom.llm.common import gather, text_words
from gridloom.llm.packing import WordEncoder, best_fit_pack, plan_slots, public_tokenizer
from gridloom.llm.sentencepiece_codec import PieceModel, sentencepiece_round_trip

VOCABULARY, MODEL = public_tokenizer("word_bpe_49k.json"), public_tokenizer("piece_bpe_32k.model")
random.seed(5)
ODD = ["", " ", "  ", " a", "a ", "aaaa aaaaaaa", "the        of      x", " ▁ ▁▁", "\n\n a", "ÀÉ", "<|endoftext|> x", "don't I'LL", "x" * 5000, "word " * 3000]
ODD += ["".join(random.choice("aab  \n▁éßщ中😀1234\t\x00İΣς'sItI\x85\x1c") for _ in range(random.randint(1, 60))) for _ in range(800)]
SCHEMA = "doc_id long, text string, piece string, length string, fp string"


def frame(spark, texts):
    """Extra columns have names that the operators use themselves."""
    return spark.createDataFrame([(i, t, "p", "l", "f") for i, t in texts], SCHEMA).repartition(3)


def test_pieces_equal_the_library():
    model, library = PieceModel(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids, bounds = model.encode_texts(pa.array(ODD, pa.large_string()))
    want = library.encode(ODD)
    for i, w in enumerate(want):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == w, ODD[i]
        assert model.decode(np.array([1, *w, 2])).decode() == library.decode([1, *w, 2])
    for _ in range(500):  # broken byte runs and control ids in the middle
        some = [random.choice([5, 131, 233, 0x90, 256, 259, 300, 1, 2]) for _ in range(random.randint(1, 8))]
        assert model.decode(np.array(some)).decode() == library.decode(some)


def test_words_equal_the_library():
    store, library = IdStore(WordEncoder(VOCABULARY).encode), Tokenizer.from_file(VOCABULARY)
    offsets, number, words = text_words(pa.array(ODD, pa.large_string()))
    rows = store.look_up(words)[number]
    flat = store.flat[gather(store.starts[rows], store.lengths[rows])]
    bounds = np.concatenate([[0], np.cumsum(store.lengths[rows])])[offsets]
    for i, e in enumerate(library.encode_batch(ODD, add_special_tokens=False)):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == e.ids, ODD[i]


def test_store_forgets_without_harm():
    store, one = IdStore(WordEncoder(VOCABULARY).encode, 3), WordEncoder(VOCABULARY)
    for w in ("alpha", "beta", "gamma", "delta", "epsilon", "alpha"):
        row = store.look_up([w, "beta"])[0]
        assert store.flat[store.starts[row] : store.starts[row] + store.lengths[row]].tolist() == one.encode([w])[0].tolist()


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing(spark, capacity):
    texts = [(i, t) for i, t in enumerate(ODD[:120])] + [(500, None), (500, None), (501, "same text"), (501, "same text"), (None, "no id")]
    got = best_fit_pack(frame(spark, texts), VOCABULARY, capacity, with_ids=True).collect()
    library = Tokenizer.from_file(VOCABULARY)
    want = []
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k, a, ids[a : a + capacity]) for k, a in enumerate(range(0, len(ids), capacity))]
    order = lambda x: (-1 if x[0] is None else x[0], *x[1:])
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["ids"]) for r in got), key=order) == sorted(want, key=order)
    places: dict = {}
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        end = 0
        for a, n in sorted(own):
            assert a == end
            end += n
        assert end <= capacity
    total = sum(r["length"] for r in got)
    assert len(places) <= -(-total // capacity) * 11 / 9 + 1


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(30):
        items = [rng.randint(1, 40) for _ in range(rng.randint(1, 200))]
        bins: list[int] = []
        for n in sorted(items, reverse=True):
            fit = [b for b in range(len(bins)) if bins[b] >= n]
            if fit:
                bins[min(fit, key=lambda b: bins[b])] -= n
            else:
                bins.append(40 - n)
        assert int(plan_slots({n: items.count(n) for n in set(items)}, 40)["bins"]) == len(bins)


def test_empty_tables(spark):
    empty = frame(spark, []) if False else spark.createDataFrame([], SCHEMA)
    assert best_fit_pack(empty, VOCABULARY).count() == 0
    assert sentencepiece_round_trip(empty, MODEL).count() == 0


def test_round_trip_rows(spark):
    texts = [(i, t) for i, t in enumerate(ODD[:60])] + [(99, None), (99, None), (None, "x")]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sentencepiece_round_trip(frame(spark, texts), MODEL, with_ids=True).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=key) == sorted(((i, [1, *library.encode(t or ""), 2], library.decode(library.encode(t or ""))) for i, t in texts), key=key)
