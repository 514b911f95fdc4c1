"""Operator 7, quality classification by co-training.

Two views of a document: its content (shares of word shapes, and statistics of words and lines) and its page metadata (source,
language, length). A logistic classifier of each view is fitted on labelled rows. In each round a view labels the unlabelled
documents of which it is surest (by its calibrated probability, as many of each class as the labels' rate asks for) and hands them
to the other view, which is fitted again. At the end both views' calibrated log odds are combined by a last logistic fit, and all
documents are scored.

Samples are bounded by parameters: at most `labelled` labelled training documents, by the classes' shares, and a pool of at most
`pool` unlabelled ones, as co-training has it, each of at most `characters` in all; rows that repeat in all columns count once. Rows whose
crc32(doc_id as text) leaves 1 when divided by 3 are not learned from. Scoring covers whole texts of all documents.

Defined results: null and empty texts have an empty content view; null metadata is a value of its own; without labels of both
classes every document is kept with score 1; rows that repeat a doc_id are scored each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructType

from .common import bounded_sample, fresh, held_out, keep_nothing, row_keys, sample_texts, slices, text_words

UPPER, LOWER, DIGITS, REPEAT = re.compile("[A-Z]+"), re.compile(r"[^\W\d_A-Z]+"), re.compile(r"\d+"), re.compile(r"([^\w\s])\1{2,}")
STATS = 7


def shape(word: str) -> str:
    """Aa, a, A9, a,, a### ...: letters and digits by kind, runs of one sign as three."""
    if word.islower() and word.isalpha():
        return "a"
    return REPEAT.sub(r"\1\1\1", DIGITS.sub("9", LOWER.sub("a", UPPER.sub("A", word))))[:12]


def content_parts(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(row, shape number, share, shapes, statistics): shares of word shapes and STATS numbers per text."""
    offsets, number, raw = text_words(text, "\n\t\r")
    n = len(offsets) - 1
    known: dict[str, int] = {}
    code = np.fromiter((known.setdefault(shape(w), len(known)) if w else -1 for w in raw), np.int64, len(raw))
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    row = np.repeat(np.arange(n), np.diff(offsets))
    full = code[number] >= 0 if len(raw) else np.zeros(0, bool)
    row, number = row[full], number[full]
    words = np.bincount(row, minlength=n)
    pair, times = np.unique(row * (len(known) + 1) + code[number], return_counts=True)
    r = pair // (len(known) + 1)
    kinds = np.unique(row * (len(raw) + 1) + number) // (len(raw) + 1)
    texts = text.to_pylist()
    lines = np.fromiter((t.count("\n") + 1 for t in texts), np.float64, n)
    per = np.maximum(words, 1)
    stats = np.stack([
        np.log1p(words), np.log1p(lines), np.bincount(row, length[number], n) / per, np.bincount(kinds, minlength=n) / per,
        words / lines / 50, np.bincount(r, minlength=n) / per, (words == 0).astype(float),
    ], 1)
    return r, pair % (len(known) + 1), times / per[r], list(known), stats


def meta_values(source, lang, n_chars) -> list[str]:
    """Metadata of a document as named values."""
    size = "none" if n_chars is None else str(int(np.log2(max(0, n_chars) + 1)))
    return [f"s:{source}", f"l:{lang}", f"n:{size}"]


def sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            r, s, share, shapes, stats = content_parts(part.column("text"))
            cuts = np.searchsorted(r, np.arange(part.num_rows + 1)).astype(np.int32)
            names = pa.ListArray.from_arrays(pa.array(cuts), pa.array(shapes, pa.string()).take(pa.array(s)))
            shares = pa.ListArray.from_arrays(pa.array(cuts), pa.array(share))
            numbers = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, STATS, dtype=np.int32)), pa.array(stats.reshape(-1)))
            meta = [meta_values(*x) for x in zip(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), names, shares, numbers, pa.array(meta, pa.list_(pa.string()))], ["doc_id", "quality", "shapes", "shares", "stats", "meta"])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights, the intercept last, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    pull = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull)
        move = np.linalg.solve(h, x.T @ (y - p) - pull * w)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


class View:
    """A linear classifier of one view, with its calibration."""

    def __init__(self, ridge: float):
        self.ridge = ridge

    def fit(self, x: np.ndarray, y: np.ndarray, check_x: np.ndarray, check_y: np.ndarray) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.w = fit_logistic((x - self.mean) / self.scale, y, self.ridge)
        g = self.raw(check_x)
        self.slope, self.shift = fit_logistic(g[:, None], check_y, 1e-2)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -30, 30)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log odds of good quality."""
        return np.clip(self.slope * self.raw(x) + self.shift, -12, 12)


class Model:
    def __init__(self, shapes: dict[str, int], metas: dict[str, int], content: View, meta: View, last: np.ndarray):
        self.shapes, self.metas, self.content, self.meta, self.last = shapes, metas, content, meta, last

    def score(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return sigmoid(self.last[0] * self.content.odds(content) + self.last[1] * self.meta.odds(meta) + self.last[2])


def dense(row, col, value, rows: int, width: int) -> np.ndarray:
    out = np.zeros((rows, width))
    np.add.at(out, (row, col), value)
    return out


def co_train(content: np.ndarray, meta: np.ndarray, label: np.ndarray, rounds: int, grow: int, sure: float) -> tuple[View, View, np.ndarray]:
    """label: 1, 0 or -1 (unlabelled). A fifth of the labelled rows calibrates; pseudo-labels never enter there."""
    labelled = np.flatnonzero(label >= 0)
    check = labelled[::5]
    start = np.setdiff1d(labelled, check)
    if len(np.unique(label[check])) < 2 or len(np.unique(label[start])) < 2:
        check = start = labelled
    views = (View(5.0), View(20.0))
    data = (content, meta)
    own = [{int(i): float(label[i]) for i in start} for _ in views]
    rate = label[labelled].mean()
    for turn in range(rounds + 1):
        for v, x, known in zip(views, data, own, strict=True):
            rows = np.fromiter(known, np.int64, len(known))
            v.fit(x[rows], np.fromiter(known.values(), float, len(known)), x[check], label[check])
        if turn == rounds:
            break
        for v, x, other in ((views[0], content, own[1]), (views[1], meta, own[0])):
            free = np.array([i for i in np.flatnonzero(label < 0).tolist() if i not in other], np.int64)
            if not len(free):
                continue
            p = sigmoid(v.odds(x[free]))
            for good, share in ((1.0, rate), (0.0, 1 - rate)):
                conf = p if good else 1 - p
                best = np.argsort(-conf, kind="stable")[: max(1, round(grow * share))]
                other.update((int(free[i]), good) for i in best if conf[i] >= sure)
    both = np.stack([v.odds(x[check]) for v, x in zip(views, data, strict=True)], 1)
    return *views, fit_logistic(both, label[check], 1.0)


def train(docs: DataFrame, labels: DataFrame, labelled: int, pool: int, characters: int, rounds: int, grow: int, sure: float, shapes: int) -> Model | None:
    known = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    plain = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "source", "lang", "n_chars")
    keys = row_keys(plain)
    marked = keys.join(known, "doc_id")
    good = marked.agg(F.avg((F.col("quality") > 0).cast("double"))).first()[0]
    if good is None or not 0 < good < 1:
        return None
    share = round(labelled * good)
    chosen = {
        1: bounded_sample(marked.filter("quality > 0").drop("quality"), max(1, share), characters, "good"),
        0: bounded_sample(marked.filter("quality <= 0").drop("quality"), max(1, labelled - share), characters, "bad"),
        -1: bounded_sample(keys.join(labels.select("doc_id"), "doc_id", "left_anti"), pool, characters, "pool"),
    }
    rows = sample_texts(plain, chosen).withColumnRenamed("kind", "quality")
    kind = "doc_id long, quality int, shapes array<string>, shares array<double>, stats array<double>, meta array<string>"
    rows = rows.mapInArrow(sample_rows, kind).toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])  # bounded by the sample sizes
    label = np.asarray(rows["quality"]).astype(float)
    if len(np.unique(label[label >= 0])) < 2:
        return None
    n = rows.num_rows
    names, metas = rows["shapes"].combine_chunks(), rows["meta"].combine_chunks()
    count: dict[str, int] = {}
    for s in names.flatten().to_pylist():
        count[s] = count.get(s, 0) + 1
    index = {s: i for i, s in enumerate(sorted(sorted(count, key=lambda s: (-count[s], s))[:shapes]))}
    meta_count: dict[str, int] = {}
    for m in metas.flatten().to_pylist():
        meta_count[m] = meta_count.get(m, 0) + 1
    meta_index = {m: i for i, m in enumerate(sorted(sorted(meta_count, key=lambda m: (-meta_count[m], m))[:256]))}
    row = np.repeat(np.arange(n), np.diff(np.asarray(names.offsets)))
    col = np.array([index.get(s, -1) for s in names.flatten().to_pylist()], np.int64)
    share = np.sqrt(np.asarray(rows["shares"].combine_chunks().flatten()))
    content = np.column_stack([dense(row[col >= 0], col[col >= 0], share[col >= 0], n, len(index)), np.asarray(rows["stats"].combine_chunks().flatten()).reshape(n, STATS)])
    row = np.repeat(np.arange(n), np.diff(np.asarray(metas.offsets)))
    col = np.array([meta_index.get(m, -1) for m in metas.flatten().to_pylist()], np.int64)
    meta = dense(row[col >= 0], col[col >= 0], 1.0, n, len(meta_index))
    return Model(index, meta_index, *co_train(content, meta, label, rounds, grow, sure))


def score_batches(model: Model, threshold: float, returned: tuple[str, ...], added: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                n = part.num_rows
                r, s, share, shapes, stats = content_parts(part.column("text"))
                to = np.array([model.shapes.get(x, -1) for x in shapes] or [-1], np.int64)
                keep = to[s] >= 0
                content = np.column_stack([dense(r[keep], to[s[keep]], np.sqrt(share[keep]), n, len(model.shapes)), stats])
                values = [meta_values(*x) for x in zip(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]
                at = [(i, model.metas[m]) for i, ms in enumerate(values) for m in ms if m in model.metas]
                meta = dense([a for a, _ in at], [b for _, b in at], 1.0, n, len(model.metas)) if at else np.zeros((n, len(model.metas)))
                score = model.score(content, meta)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in returned), pa.array(score), pa.array(score >= threshold)], [*returned, *added])

    return run


def classify_quality(docs: DataFrame, labels: DataFrame, labelled: int = 4000, pool: int = 4000, characters: int = 32 << 20, rounds: int = 3, grow: int = 400, sure: float = 0.95, shapes: int = 200, threshold: float = 0.5, whole: bool = False) -> DataFrame:
    """doc_id, held_out, score (probability of good quality), kept: one row per document; with `whole`, docs' own columns,
    _score and _kept (with more underscores where docs has such columns, see `fresh`). `characters` bounds each sample's texts."""
    model = train(docs, labels, labelled, pool, characters, rounds, grow, sure, shapes)
    rows = docs if whole else docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", "source", "lang", "n_chars")
    returned = tuple(docs.columns) if whole else ("doc_id", "held_out")
    score, kept = (fresh("_score", docs), fresh("_kept", docs)) if whole else ("score", "kept")
    if model is None:
        return rows.select(*returned, F.lit(1.0).alias(score), F.lit(True).alias(kept))
    schema = StructType([*rows.select(*returned).schema.fields]).add(score, DoubleType()).add(kept, BooleanType())
    return rows.mapInArrow(score_batches(model, threshold, returned, (score, kept)), schema)


def op7_quality_cotraining(spark, sf_dir: str) -> DataFrame:
    return classify_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
