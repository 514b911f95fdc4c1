"""Operator 2, SentencePiece encoding and decoding by vectorised merge rounds.

Works on BPE models with byte fallback, no normalisation, a dummy prefix and kept spaces; other models are refused. No piece has
the space mark after another character, so merges stay inside (marks + word) and equal words are merged once (bpe.py).

Defined results: a null text counts as empty, and an empty text has the begin and end ids only and decodes to the empty text;
repeated rows are encoded each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import IdStore, PairTable, merge_rounds
from .common import gather, keep, slices, text_words
from .packing import public_tokenizer

MARK = "▁"


def repaired(raw: bytes) -> bytes:
    """The same bytes if they are UTF-8; otherwise with U+FFFD for each byte that is not."""
    try:
        raw.decode()
    except UnicodeDecodeError:
        return re.sub("[\udc80-\udcff]", "�", raw.decode("utf-8", "surrogateescape")).encode()
    return raw


class PieceModel:
    """A SentencePiece BPE model file as numpy tables."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        spec = m.normalizer_spec
        kinds = {p.type for p in m.pieces}
        if m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or kinds - {1, 2, 3, 6} or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("this model needs rules that are not implemented")
        normal = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("this model has pieces across words")
        self.bos, self.eos = m.trainer_spec.bos_id, m.trainer_spec.eos_id
        self.size = len(m.pieces)
        symbol = dict(normal)
        for c in sorted({c for p in normal for c in p} - set(normal)):  # characters that are only parts of pieces
            symbol[c] = self.size + ord(c)
        scores = {s: -i for i, s in enumerate(sorted({m.pieces[i].score for i in normal.values()}))}
        pairs = [(symbol[p[:k]], symbol[p[k:]], scores[m.pieces[i].score], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        low = min((r for *_, r, _ in pairs), default=0)
        self.table = PairTable([a for a, *_ in pairs], [b for _, b, *_ in pairs], [r - low for *_, r, _ in pairs], [i for *_, i in pairs])
        self.char = np.arange(self.size, self.size + 0x110000, dtype=np.int64)
        for c, i in symbol.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        self.byte = np.array([next(i for i, p in enumerate(m.pieces) if p.type == 6 and p.piece == f"<0x{b:02X}>") for b in range(256)])
        raw = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() if p.type == 1 else b"" for p in m.pieces]
        self.piece_length = np.fromiter(map(len, raw), np.int64, len(raw))
        self.piece_start = np.cumsum(self.piece_length) - self.piece_length
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.store = IdStore(self.encode_words, 250_000)
        self.runs = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of words that are complete merge units."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids, sizes = merge_rounds(self.table, self.char[code], lengths)
        odd = np.flatnonzero(ids >= self.size)
        if len(odd):  # byte fallback
            spelled = [chr(c).encode("utf-8", "surrogatepass") for c in (ids[odd] - self.size).tolist()]
            width = np.ones(len(ids), np.int64)
            width[odd] = list(map(len, spelled))
            ends = np.cumsum(sizes)
            total = np.concatenate([[0], np.cumsum(width)])
            out = np.repeat(ids, width)
            out[gather(total[:-1][odd], width[odd])] = self.byte[np.frombuffer(b"".join(spelled), np.uint8)]
            ids, sizes = out, total[ends] - total[ends - sizes]
        return ids, sizes

    def encode_texts(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, bounds of the texts), without begin and end ids."""
        plain = pc.invert(pc.or_(pc.match_substring(text, "  "), pc.or_(pc.match_substring(text, MARK), pc.or_(pc.starts_with(text, " "), pc.ends_with(text, " ")))))
        plain = pc.and_(plain, pc.greater(pc.binary_length(text), 0))
        rows = np.asarray(plain.cast(pa.int8())).astype(bool)
        offsets, number, words = text_words(pc.if_else(plain, text, ""), "")
        counts = np.diff(offsets)
        counts[~rows] = 0
        number = number[np.repeat(rows, np.diff(offsets))]
        words = [MARK + w for w in words]
        if not rows.all():
            known = {w: i for i, w in enumerate(words)}
            split: dict[int, list[int]] = {}
            for r in np.flatnonzero(~rows).tolist():
                t = text[r].as_py()
                units = self.runs(MARK + t.replace(" ", MARK)) if t else []
                split[r] = [known.setdefault(u, len(known)) for u in units]
            words = list(known)
            parts, at = [], 0
            bounds = np.concatenate([[0], np.cumsum(counts)])
            for r, own in split.items():
                parts += [number[at : bounds[r]], np.asarray(own, np.int64)]
                at = bounds[r]
                counts[r] = len(own)
            number = np.concatenate([*parts, number[at:]])
        row = self.store.look_up(words)[number]
        sizes = self.store.lengths[row]
        ids = self.store.flat[gather(self.store.starts[row], sizes)]
        return ids, np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text: pieces joined, marks as spaces, without the dummy prefix; broken byte runs as U+FFFD for each byte."""
        sizes = self.piece_length[ids]
        out = self.piece_bytes[gather(self.piece_start[ids], sizes)].tobytes()
        shown = np.flatnonzero(sizes)
        if len(shown) and not (self.byte == ids[shown[0]]).any() and out[:1] == b" ":
            out = out[1:]
        if not (sizes[1:-1] == 0).any():
            return repaired(out)
        silent = np.flatnonzero(sizes == 0)  # control ids part byte runs
        ends = (np.cumsum(sizes) - (int(sizes.sum()) - len(out)))[silent].clip(0).tolist()
        return b"".join(repaired(out[a:b]) for a, b in zip([0, *ends], [*ends, len(out)], strict=True))


def encode_batches(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = keep(PieceModel, path)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, bounds = model.encode_texts(part.column("text"))
                n, hashed, back, kept = [], [], [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids = np.concatenate([[model.bos], flat[a:b], [model.eos]])
                    n.append(len(ids))
                    hashed.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text = model.decode(ids)
                    back.append(hashlib.sha256(text).hexdigest())
                    if with_ids:
                        kept.append((ids, text.decode()))
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(hashed), pa.array(back)]
                if with_ids:
                    columns += [pa.array([k[0] for k in kept], pa.list_(pa.int64())), pa.array([k[1] for k in kept], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return run


def sentencepiece_round_trip(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids and decoded."""
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(encode_batches(model, with_ids), out)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return sentencepiece_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer("piece_bpe_32k.model"))
