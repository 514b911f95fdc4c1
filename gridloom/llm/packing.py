"""Operator 1, best-fit packing.

Documents become token sequences of at most `capacity`. The plan is made from the histogram of piece lengths (at most `capacity`
counts, whatever the corpus): best-fit decreasing over counts of equal pieces and of equal bins. Pieces then take the planned
slots by joining on their rank within their length. Ranks are dealt by (length, salt), so that a frequent length is no hot key.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives no rows; other
columns are ignored; ties in a rank are broken by doc_id, piece and checksum.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import IdStore, PairTable, merge_rounds
from .common import cut, gather, keep, slices, text_words

CAPACITY, END_ID = 4096, 1
#: The split pattern of the word vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words in these characters are encoded here; all others go to the tokenizers library.
PLAIN = re.compile("[!-~À-ÖØ-öø-įĲ-ňŊ-ſ]*")


def public_tokenizer(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of a lower-casing word-end BPE vocabulary file, equal to the tokenizers library's."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.end = model["end_of_word_suffix"]
        self.table = PairTable([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], range(len(merges)), [vocab[a + b] for a, b in merges])
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.inner = np.array([vocab[letter[b]] for b in range(256)])
        self.last = np.array([vocab[letter[b] + self.end] for b in range(256)])
        self.split = regex.compile(WORD_PATTERN).findall
        self.pieces = IdStore(self._merge, 200_000)

    def _merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [p.encode() for p in pieces]
        data = np.frombuffer(b"".join(raw), np.uint8)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[data[ends]]
        return merge_rounds(self.table, symbols, lengths)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each): words without spaces or line ends."""
        parts: list[list[str]] = []
        other: list[int] = []
        for i, w in enumerate(words):
            if PLAIN.fullmatch(w) and "<|" not in w:
                parts.append([w.lower()] if w.isalpha() else self.split(unicodedata.normalize("NFC", w).lower()) if w else [])
            else:
                other.append(i)
                parts.append([])
        pieces = list({p for ps in parts for p in ps})
        rows = dict(zip(pieces, self.pieces.look_up(pieces).tolist(), strict=True)) if pieces else {}
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        row = np.fromiter((rows[p] for ps in parts for p in ps), np.int64, int(count.sum()))
        sizes = self.pieces.lengths[row]
        flat = self.pieces.flat[gather(self.pieces.starts[row], sizes)]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        lengths = np.diff(bounds[np.concatenate([[0], np.cumsum(count)])])
        if other:
            found = [e.ids for e in self.library.encode_batch([words[i] for i in other], add_special_tokens=False)]
            cuts = np.concatenate([[0], np.cumsum(lengths)])
            out, at = [], 0
            for i, ids in zip(other, found, strict=True):
                out += [flat[at : cuts[i]], np.asarray(ids, np.int32)]
                at = cuts[i]
                lengths[i] = len(ids)
            flat = np.concatenate([*out, flat[at:]])
        return flat, lengths


def word_store(path: str) -> IdStore:
    return IdStore(WordEncoder(path).encode, 250_000)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = keep(word_store, path)
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, number, words = text_words(part.column("text"))
                rows = store.look_up(words)[number]
                sizes = store.lengths[rows]
                flat = store.flat[gather(store.starts[rows], sizes)]
                bounds = np.concatenate([[0], np.cumsum(sizes)])[offsets]
                out: list[tuple] = []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids = np.append(flat[a:b], end_id).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        one = ids[at : at + capacity]
                        out.append((doc, k, at, len(one), zlib.crc32(one.tobytes()), *([one] if with_ids else [])))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names[: len(columns)])

    return run


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece of each document's ids: place, length, checksum and, if asked, the ids themselves."""
    return docs.select("doc_id", "text").mapInArrow(pieces_of(vocabulary, capacity, end_id, with_ids), PIECES + (", ids array<long>" if with_ids else ""))


def plan_slots(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Best-fit decreasing over counts.

    Bins of one history form a group [first bin, number, free room]; the pieces of a length fill the tightest group that has
    room, k to a bin. Each row of the plan says: of this length, ranks from `rank` on go k to a bin, from bin `bin` and place `offset` on.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    tight: list[int] = []  # the free rooms that have groups
    bins = 0
    rows: list[tuple[int, int, int, int, int]] = []

    def put(free: int, first: int, number: int):
        if free and number:
            if not room[free]:
                heappush(tight, free)
            room[free].append((first, number))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        aside: list[int] = []
        refilled: list[tuple[int, int, int]] = []
        while left and tight:
            free = heappop(tight)
            if free < length:
                aside.append(free)
                continue
            groups, room[free] = room[free], []
            per = free // length
            while groups and left:
                first, number = groups.pop()
                full = min(number, left // per)
                if full:
                    rows.append((length, rank, per, first, capacity - free))
                    rank, left = rank + full * per, left - full * per
                    refilled.append((free - per * length, first, full))
                if full < number and left:  # fewer than a whole bin's worth remain
                    rows.append((length, rank, left, first + full, capacity - free))
                    refilled.append((free - left * length, first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < number:
                    groups.append((first + full, number - full))
            for g in groups:
                put(free, *g)
        for free in aside:
            heappush(tight, free)
        if left:
            per = capacity // length
            full, rest = divmod(left, per)
            if full:
                rows.append((length, rank, per, bins, 0))
                refilled.append((capacity - per * length, bins, full))
            if rest:
                rows.append((length, rank + full * per, rest, bins + full, 0))
                refilled.append((capacity - rest * length, bins + full, 1))
            bins += full + bool(rest)
        for free, first, number in refilled:
            put(free, first, number)
    table = np.array(rows, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return {"length": table[:, 0], "rank": table[:, 1], "per": table[:, 2], "bin": table[:, 3], "offset": table[:, 4], "bins": np.int64(bins)}


def take_slots(plan: dict[str, np.ndarray]):
    """Sequence and offset of (length, rank), by search in the plan."""
    reach = np.int64(1) << np.int64(48)
    key = plan["length"] * reach + plan["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            at = np.searchsorted(key, length * reach + rank, side="right") - 1
            nth = rank - plan["rank"][at]
            per = plan["per"][at]
            names = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(plan["bin"][at] + nth // per), pa.array(plan["offset"][at] + nth % per * length)], [*names, "sequence_id", "offset"])

    return run


def best_fit_pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): every piece's place in the packed sequences."""
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, vocabulary, capacity, end_id, with_ids))
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    nth = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("_nth", nth).join(before, ["length", "_salt"])
    kept = pieces.columns
    ranked = ranked.select(*kept, (F.col("_nth") + F.col("_before") - 1).cast("long").alias("rank"))
    out = PIECES + (", ids array<long>" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.mapInArrow(take_slots(plan_slots(histogram, capacity)), out)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer("word_bpe_49k.json"))
