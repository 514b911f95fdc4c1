"""Operator 6, language identification by cross-parsing entropy.

A suffix automaton holds every substring of a language's labelled sample. A text is parsed greedily into the longest phrases that
occur in the sample; the language that needs the fewest phrases per character wins. Whole texts are parsed, many at once: they
are cut into stretches of `STRETCH` characters (a phrase ends at a cut, for every language alike), and a step moves all stretches
by one character through a dense transition table.

A language's sample is bounded by `characters`, taken from at most `rows` training documents per language.

Defined results: `und` with score 0 if the text is null, has no letter, or nothing could be learned; a tie goes to the language
that comes first in order; rows that repeat a doc_id are classified each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, keep, slices

STRETCH = 256
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_text(text: str) -> str:
    """Lower-cased letters, with one space for what stands between them."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class SuffixAutomaton:
    """All substrings of a text; next states per character class in a dense table. State 0 is none, state 1 the start."""

    def __init__(self, code: list[int], classes: int):
        after: list[dict[int, int]] = [{}, {}]
        link, length = [0, 0], [0, 0]
        last = 1
        for c in code:
            new = len(after)
            after.append({})
            length.append(length[last] + 1)
            link.append(1)
            p = last
            while p and c not in after[p]:
                after[p][c] = new
                p = link[p]
            if p:
                q = after[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(after)
                    after.append(dict(after[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p and after[p].get(c) == q:
                        after[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        table = np.zeros((len(after), classes), np.int32)
        for s, step in enumerate(after):
            for c, to in step.items():
                table[s, c] = to
        # Twice the next state; odd where the phrase ended before this character and a new one began with it. A character
        # that no sample has is a phrase of its own, after which any character begins another (state 0).
        start = table[1]
        self.step = np.where(table > 0, 2 * table, 2 * start[None, :] + 1).astype(np.int32)
        self.step[1][table[1] == 0] = 0
        self.step = self.step.reshape(-1)
        self.classes = classes

    def phrases(self, code: np.ndarray) -> np.ndarray:
        """Phrase ends in each row of (steps x rows) classes; class 0 is padding."""
        state = np.full(code.shape[1], self.classes, np.int64)
        count = np.zeros(code.shape[1], np.int64)
        for row in code:
            if (pad := row == 0).any():
                go = np.flatnonzero(~pad)
                to = self.step[state[go] + row[go]]
                count[go] += to & 1
                state[go] = (to >> 1).astype(np.int64) * self.classes
            else:
                to = self.step[state + row]
                count += to & 1
                state = (to >> 1).astype(np.int64) * self.classes
        return count


class LanguageModel:
    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.names = [lang for lang, _ in samples]
        signs = sorted({c for _, text in samples for c in text if c != " "})
        # Classes: 0 padding, 1 space, 2 letters of no sample, then the letters of the samples.
        self.classes = len(signs) + 3
        self.of = np.where(letters(), 2, 1).astype(np.int16)
        for i, c in enumerate(signs):
            self.of[ord(c)] = i + 3
        self.automata = [SuffixAutomaton(self.of[np.frombuffer(text.encode("utf-32-le"), "<u4")].tolist(), self.classes) for _, text in samples]

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases of each text and language, characters parsed): of lower-cased texts."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        code = self.of[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")]
        owner = np.repeat(np.arange(len(texts)), lengths)
        begin = np.ones(len(code), bool)
        begin[1:] = owner[1:] != owner[:-1]
        gap = code == 1
        drop = gap.copy()
        drop[1:] &= gap[:-1] | begin[1:]  # a space after a space, or in front
        drop &= gap
        code, owner = code[~drop], owner[~drop]
        sizes = np.bincount(owner, minlength=len(texts))
        first = np.cumsum(sizes) - sizes
        parts = -(-sizes // STRETCH)
        of_part = np.repeat(np.arange(len(texts)), parts)
        at = np.repeat(first, parts) + STRETCH * (np.arange(len(of_part)) - np.repeat(np.cumsum(parts) - parts, parts))
        width = np.minimum(np.repeat(first + sizes, parts) - at, STRETCH)
        order = np.argsort(-width, kind="stable")
        out = np.zeros((len(texts), len(self.names)), np.int64)
        padded = np.append(code, np.zeros(STRETCH, code.dtype))
        for a in range(0, len(order), 4096):
            rows = order[a : a + 4096]
            steps = int(width[rows[0]])
            grid = padded[at[rows][None, :] + np.arange(steps)[:, None]].astype(np.int64)
            grid[np.arange(steps)[:, None] >= width[rows][None, :]] = 0
            for k, automaton in enumerate(self.automata):
                np.add.at(out[:, k], of_part[rows], automaton.phrases(grid) + 1)
        return out, sizes


def classify(samples: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = keep(LanguageModel, samples) if samples else None
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = pc.utf8_lower(part.column("text")).to_pylist()
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if model:
                    count, size = model.counts(texts)
                    rate = count / np.maximum(size, 1)[:, None]
                    best = rate.argmin(1)
                    # Phrases spared against another language, as evidence of so many nats each.
                    odds = np.exp(-np.minimum((count - count[np.arange(len(texts)), best][:, None]) * 0.5, 60))
                    share = 1 / odds.sum(1)
                    for i, t in enumerate(texts):
                        if size[i] and any(map(str.isalpha, t)):
                            lang[i], score[i] = model.names[best[i]], share[i]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def language_samples(docs: DataFrame, characters: int, rows: int) -> tuple[tuple[str, str], ...]:
    """Letter text of each learned language, `characters` at most, from the `rows` training documents with the lowest hashes among
    those of no more characters (longer ones only where there are too few)."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("lang", F.substring("text", 1, characters).alias("text"), (F.length("text") > characters).alias("long"), F.xxhash64("doc_id").alias("h"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("long", "h"))
    taken = known.withColumn("nth", nth).filter(F.col("nth") <= rows).collect()
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in taken:
        texts.setdefault(r["lang"], []).append((r["nth"], letter_text(r["text"])))
    joined = {lang: " ".join(t for _, t in sorted(own) if t)[:characters] for lang, own in texts.items()}
    return tuple((lang, joined[lang]) for lang in sorted(joined) if joined[lang].strip())


def identify_language(docs: DataFrame, characters: int = 40_000, rows: int = 40) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per document."""
    samples = language_samples(docs, characters, rows)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return out.mapInArrow(classify(samples), "doc_id long, held_out boolean, lang_pred string, score double")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    return identify_language(spark.read.parquet(f"{sf_dir}/documents.parquet"))
