"""Operator 3, toxicity by non-negative positive-unlabelled learning.

Trained from confirmed toxic documents (positives) and all training documents, whose labels are not looked at (unlabelled). The risk
of a linear scorer g over words and word beginnings is  pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])  with the logistic loss
l and the class prior pi, the share of toxic ones among the labelled training rows, held between 0.01 and 0.5; where the second term
would be negative its gradient is turned round.

1. Confirmed toxic documents, `positives` at most, come to the driver as word lists. Their features are the candidates.
2. All unlabelled documents are counted for the candidates, and the features far over their share there are chosen. Of all other
   documents the driver sees only which of these few features they have.
3. All unlabelled documents are dealt by a hash to groups of about `GROUP`. Each group is fitted against the positives where it lies,
   and the weights are averaged (parameter mixing), so that no document is left out and nothing grows on the driver.
4. A score is a fixed monotone map of g, set on labelled training rows (`checked` at most) so that 0.7 is the cut of the best F1.

Samples of labelled rows are bounded in rows and in characters; rows that repeat both id and text count once there. The penalty is
chosen on `trial` unlabelled rows. All scoring covers whole texts of all documents.

Defined results: null and empty texts score as the intercept alone; without toxic training rows every score is 0; rows that
repeat a doc_id are scored each; a null doc_id is held out and scored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, coded_words, gather, held_out, release, row_keys, sample_texts, slices

#: Lengths of the word beginnings that are features.
STEMS = (4, 5, 6, 7, 8)
#: Penalties to choose from on training rows; the first where they are too few.
PENALTIES = (1e-3, 1e-4, 1e-2)
#: Unlabelled documents of one fit, and the most where many rows are alike.
GROUP, MOST_GROUP = 4096, 8192
EDGES = r"^[^\p{L}]+|[^\p{L}]+$"


def plain_words(raw: pa.Array) -> pa.Array:
    """Words without what is no letter at their ends, in lower case."""
    return pc.utf8_lower(pc.if_else(pc.utf8_is_alpha(raw), raw, pc.replace_substring_regex(raw, EDGES, "")))


def document_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, word number, words): the distinct plain words of each text."""
    offsets, number, raw = coded_words(text, "\n\t\r")
    coded = plain_words(raw).dictionary_encode()
    code, n = np.asarray(coded.indices).astype(np.int64), len(coded.dictionary) + 1
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pair = np.unique(row * n + code[number])
    return pair // n, pair % n, coded.dictionary


def word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            row, code, words = document_words(part.column("text"))
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), words.take(pa.array(code)).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("kind"), lists], ["doc_id", "kind", "words"])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class SparseRows:
    """0/1 rows over chosen features."""

    def __init__(self, row: np.ndarray, col: np.ndarray, n: int, width: int):
        self.row, self.col, self.n, self.width = row, col, n, width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.width)

    def part(self, features: np.ndarray, rows: np.ndarray | None = None) -> SparseRows:
        """The marked rows (all) over some of the features, in the order given."""
        rows = np.ones(self.n, bool) if rows is None else rows
        nth, place = np.cumsum(rows) - 1, np.full(self.width, -1)
        place[features] = np.arange(len(features))
        some = rows[self.row] & (place[self.col] >= 0)
        return SparseRows(nth[self.row[some]], place[self.col[some]], int(rows.sum()), len(features))


class FeatureIndex:
    """Features by number, ready to be looked up for whole arrays of words: those of a kind (the word, or a beginning of so many
    letters; once or twice in a text) in one list."""

    def __init__(self, index: dict[str, int]):
        self.width = max(index.values(), default=0) + 1
        lists: dict[tuple[int, int], tuple[list[str], list[int]]] = {}
        for f, i in index.items():
            bare = f.rstrip("*")
            names, numbers = lists.setdefault((len(bare) if f != bare else 0, max(1, len(f) - len(bare))), ([], []))
            names.append(bare)
            numbers.append(i)
        self.lists = {kind: (pa.array(names, pa.large_string()), np.array([*numbers, -1])) for kind, (names, numbers) in lists.items()}

    def codes(self, words: pa.Array):
        """For each kind: (feature of every word or -1, documents' words that must share it)."""
        words = words.cast(pa.large_string())
        length = np.asarray(pc.utf8_length(words))
        for (letters, least), (names, numbers) in self.lists.items():
            found = pc.index_in(pc.utf8_slice_codeunits(words, 0, letters) if letters else words, names)
            code = numbers[np.asarray(pc.fill_null(found, -1))]
            yield np.where(length > letters, code, -1), least


def feature_rows(row: np.ndarray, number: np.ndarray, words: pa.Array | list[str], index: FeatureIndex | dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once, of (row, word number) pairs. A beginning that two different words of a text share is a
    second feature, written with two stars."""
    index = index if isinstance(index, FeatureIndex) else FeatureIndex(index)
    words = words if isinstance(words, pa.Array) else pa.array(words, pa.large_string())
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for code, least in index.codes(words):
        f = code[number]
        some = np.flatnonzero(f >= 0)
        pair, times = np.unique(row[some] * index.width + f[some], return_counts=True)
        pair = pair[times >= least]
        rows.append(pair // index.width)
        cols.append(pair % index.width)
    return np.concatenate(rows), np.concatenate(cols)


class Sample:
    """Confirmed toxic documents (kind 1) as word numbers; every distinct word is held once."""

    def __init__(self, rows: pa.Table):
        self.kind = np.asarray(rows["kind"]).astype(np.int64)
        lists = rows["words"].combine_chunks()
        coded = lists.flatten().dictionary_encode()
        self.words = coded.dictionary.cast(pa.large_string())
        self.number = np.asarray(coded.indices).astype(np.int64)
        self.row = np.repeat(np.arange(len(self.kind)), np.asarray(lists.value_lengths()).astype(np.int64))

    def first_of_families(self) -> np.ndarray:
        """Whether a document is no copy or near copy of an earlier positive: the sets of their words of over 3 letters have a similarity
        (Jaccard) of 0.8 or more. A family of copies would otherwise make its every word look like evidence."""
        out = np.ones(len(self.kind), bool)
        long_ = np.asarray(pc.utf8_length(self.words)) > 3
        use = (self.kind[self.row] == 1) & long_[self.number]
        row, number = self.row[use], self.number[use]
        size = np.bincount(row, minlength=len(self.kind))
        order = np.lexsort((row, number))
        holders = row[order]  # of each word, in order of documents
        start = np.searchsorted(number[order], np.arange(len(self.words)))
        seen = np.zeros(len(self.words), np.int64)
        begin = np.searchsorted(row, np.arange(len(self.kind) + 1))
        for i in np.flatnonzero(size).tolist():
            own = number[begin[i] : begin[i + 1]]
            common = np.bincount(holders[gather(start[own], seen[own])], minlength=1)
            out[i] = not (9 * common >= 4 * (size[: len(common)] + size[i])).any() if common.any() else True
            seen[own] += 1
        return out

    def candidates(self, own: np.ndarray, least: int = 3) -> tuple[list[str], np.ndarray]:
        """(features, counts) of those that `least` documents marked in `own` have. A word is a feature, and so are its beginnings of
        STEMS letters, with a star: inflected and compound forms share those. Only the features found are ever spelled out."""
        here = own[self.row]
        row, number = self.row[here], self.number[here]
        length = np.asarray(pc.utf8_length(self.words))
        once: dict[str, int] = {}
        twice: dict[str, int] = {}
        for letters in (0, *STEMS):
            coded = (pc.utf8_slice_codeunits(self.words, 0, letters) if letters else self.words).dictionary_encode()
            names, code, width = coded.dictionary, np.asarray(coded.indices).astype(np.int64), len(coded.dictionary) + 1
            # A beginning that ends in a star itself could not be told from one with two stars.
            usable = (length > letters) & ~np.asarray(pc.ends_with(names, "*"))[code]
            some = usable[number]
            pair, times = np.unique(row[some] * width + code[number[some]], return_counts=True)
            for found, words in ((once, 1), (twice, 2)) if letters else ((once, 1),):
                count = np.bincount(pair[times >= words] % width, minlength=1)
                often = np.flatnonzero(count >= least)
                spelled = names.take(pa.array(often)).to_pylist()
                found.update(zip([x + "*" for x in spelled] if letters else spelled, count[often].tolist(), strict=True))
        spelled = [*sorted(once), *(x + "*" for x in sorted(twice))]
        return spelled, np.array([*(once[x] for x in sorted(once)), *(twice[x] for x in sorted(twice))], np.int64)

    def rows_of(self, index: dict[str, int]) -> SparseRows:
        return SparseRows(*feature_rows(self.row, self.number, self.words, index), len(self.kind), len(index))


def best_penalty(p: SparseRows, u: SparseRows, n: SparseRows, halves: list[tuple[np.ndarray, np.ndarray]], prior: float) -> float:
    """Of PENALTIES the one whose best F1 on training rows left out of the fit, one half of the positives at a time, is largest.
    p, u, n: positives, unlabelled and labelled others; halves: positives left out, and features chosen without them."""
    if p.n < 10 or not u.n or not n.n:
        return PENALTIES[0]
    total = dict.fromkeys(PENALTIES, 0.0)
    for left_out, features in halves:
        learn, plain, other, test = p.part(features, ~left_out), u.part(features), n.part(features), p.part(features, left_out)
        for penalty in PENALTIES:
            w, b = fit_nnpu(learn, plain, prior, penalty=penalty)
            gp, gn = test.times(w) + b, other.times(w) + b
            cut = best_cut(np.concatenate([gp, gn]), np.append(np.ones(len(gp)), np.zeros(len(gn))))
            hit, false = (gp >= cut).sum(), (gn >= cut).sum()
            total[penalty] += 2 * hit / max(1, hit + false + len(gp))
    return max(PENALTIES, key=lambda x: total[x])


def choose(spelled: list[str], count: np.ndarray, positives: int, unlabelled: dict[str, int], plain: int, most: int, deviations: float = 4.0, lift: float = 2.0) -> dict[str, int]:
    """Features whose share of the positives is over their share of the unlabelled documents by `deviations` standard deviations and
    `lift` times as large, the best `most` of them."""
    other = np.array([unlabelled.get(f, 0) for f in spelled], float)
    share, rest = count / max(positives, 1), other / max(plain, 1)
    pooled = (count + other + 1) / (positives + plain + 2)
    z = (share - rest) / np.sqrt(pooled * (1 - pooled) * (1 / max(positives, 1) + 1 / max(plain, 1)))
    good = np.flatnonzero((count >= 3) & (z >= deviations) & (share >= lift * rest))
    best = good[np.lexsort((good, -z[good]))][:most]
    return {spelled[i]: k for k, i in enumerate(sorted(best.tolist()))}


def fit_nnpu(positive: SparseRows, unlabelled: SparseRows, prior: float, steps: int = 300, rate: float = 0.1, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on the non-negative risk."""
    w, b = np.zeros(positive.width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        gp, gu = positive.times(w) + b, unlabelled.times(w) + b
        sp, su = sigmoid(gp), sigmoid(gu)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        dp, du = prior * (sp - 1) / positive.n, su / unlabelled.n
        dn = -prior * sp / positive.n
        if negative >= 0:
            up, uu = dp + dn, du
        else:  # turn back from fitting the unlabelled beyond what the prior allows
            up, uu = -dn, -du
        grad = np.append(positive.back(up) + unlabelled.back(uu) + penalty * w, up.sum() + uu.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def best_cut(score: np.ndarray, label: np.ndarray) -> float:
    """The cut of the best F1, in the middle of the gap below it."""
    order = np.argsort(-score, kind="stable")
    s, y = score[order], label[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    at = int(np.argmax(f1))
    return float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else float(s[at]) - 1.0


def count_features(spelled: list[str]):
    """Rows (f, k): how many of a task's texts have each feature; f -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = FeatureIndex({f: i for i, f in enumerate(spelled)})
        count, texts = np.zeros(len(spelled), np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                row, number, words = document_words(part.column("text"))
                count += np.bincount(feature_rows(row, number, words, index)[1], minlength=len(spelled))
                texts += part.num_rows
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(count[some], texts))], ["f", "k"])

    return run


def feature_lists(index: dict[str, int], by: str = "g"):
    """Rows (by, features): the chosen features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = FeatureIndex(index)
        for batch in batches:
            for part in slices(batch, "text"):
                row, col = feature_rows(*document_words(part.column("text")), lookup)
                order = np.lexsort((col, row))
                cuts = np.searchsorted(row[order], np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(col[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(by), lists], [by, "features"])

    return run


def fit_groups(positive: SparseRows, prior: float, penalty: float):
    """Rows (f, weight, n): the weights of a task's fits, each times its documents, summed; f -1 is the intercept. Rows come sorted by
    group; a group of over MOST_GROUP documents makes several fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, documents = np.zeros(positive.width + 1), 0

        def fit(rows: pa.Table) -> None:
            nonlocal documents
            lists = rows["features"].combine_chunks()
            row = np.repeat(np.arange(len(rows)), np.asarray(lists.value_lengths()).astype(np.int64))
            w, b = fit_nnpu(positive, SparseRows(row, np.asarray(lists.flatten()).astype(np.int64), len(rows), positive.width), prior, penalty=penalty)
            total[:-1] += w * len(rows)
            total[-1] += b * len(rows)
            documents += len(rows)

        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while len(rows):
                group = np.asarray(rows["g"])
                size = int(np.searchsorted(group, group[0], side="right"))
                if size == len(rows) and size <= MOST_GROUP:  # the group may go on
                    break
                fit(rows.slice(0, min(size, MOST_GROUP)))
                rows = rows.slice(min(size, MOST_GROUP))
            held = rows
        if held is not None and len(held):
            fit(held)
        if documents:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(positive.width), -1).astype(np.int32)), pa.array(total), pa.array(np.full(len(total), float(documents)))], ["f", "weight", "n"])

    return run


def score_batches(weights: dict[str, float], intercept: float, cut: float):
    index = {f: i for i, f in enumerate(weights)}
    value = np.array([*weights.values(), 0.0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = FeatureIndex(index)
        for batch in batches:
            for part in slices(batch, "text"):
                row, col = feature_rows(*document_words(part.column("text")), lookup)
                g = intercept + np.bincount(row, value[col], part.num_rows)
                score = sigmoid(g - cut + np.log(0.7 / 0.3))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.7).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def train(docs: DataFrame, labels: DataFrame, positives: int, checked: int, trial: int, characters: int, most_words: int) -> tuple[dict[str, float], float, float] | None:
    """(word weights, intercept, cut) or None without toxic training rows. Only the word lists of a bounded sample of positives, the
    chosen features of two more bounded samples, and counts and weights of bounded lists of features, come to the driver."""
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rates = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    if not rates["t"]:
        return None
    prior = min(0.5, max(0.01, rates["t"] / rates["n"]))
    plain = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text")
    keys = row_keys(plain)
    labelled = keys.join(known, "doc_id")
    toxic = {1: bounded_sample(labelled.filter("toxic = 1").drop("toxic"), positives, characters, "p")}
    others = {
        0: bounded_sample(labelled.filter("toxic <> 1").drop("toxic"), checked, characters, "n"),
        2: bounded_sample(keys, trial, characters, "u"),
    }
    drawn = Sample(sample_texts(plain, toxic).mapInArrow(word_lists, "doc_id long, kind int, words array<string>").toArrow())  # bounded by the sample size
    if not len(drawn.kind):
        return None
    own = drawn.first_of_families()
    spelled, count = drawn.candidates(own)
    counted = plain.select("text").mapInArrow(count_features(spelled), "f int, k long").groupBy("f").agg(F.sum("k").alias("k")).toArrow()  # bounded by the features
    found = np.zeros(len(spelled) + 1, np.int64)  # the texts are last
    found[np.asarray(counted["f"])] = np.asarray(counted["k"])
    documents, unlabelled = int(found[-1]), dict(zip(spelled, found[:-1].tolist(), strict=True))
    index = choose(spelled, count, int(own.sum()), unlabelled, documents, most_words)
    half = np.arange(len(own)) % 2 == 1
    tried = [choose(*drawn.candidates(own & learn), int((own & learn).sum()), unlabelled, documents, most_words) for learn in (~half, half)]
    every = {f: i for i, f in enumerate(dict.fromkeys([*index, *tried[0], *tried[1]]))}
    numbers = [np.array([every[f] for f in features], np.int64) for features in (index, *tried)]
    positive = drawn.rows_of(every)
    del drawn, spelled, count, counted, found, unlabelled
    seen = sample_texts(plain, others).select("kind", "text").mapInArrow(feature_lists(every, "kind"), "kind int, features array<int>").toArrow()  # bounded by the sample sizes
    kind, lists = np.asarray(seen["kind"]), seen["features"].combine_chunks()
    row = np.repeat(np.arange(len(kind)), np.asarray(lists.value_lengths()).astype(np.int64))
    other = SparseRows(row, np.asarray(lists.flatten()).astype(np.int64), len(kind), len(every))
    p, n = positive.part(numbers[0]), other.part(numbers[0], kind == 0)
    negative, trials = (other.part(np.arange(len(every)), kind == k) for k in (0, 2))
    penalty = best_penalty(positive, trials, negative, [(half, numbers[1]), (~half, numbers[2])], prior)
    del seen, lists, row, other, negative, trials
    release()
    groups = max(1, round(documents / GROUP))
    dealt = plain.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("g"), "text").mapInArrow(feature_lists(index), "g long, features array<int>")
    # As many tasks as there are groups, at most four times the shuffle's: their rows are small, their work is not.
    tasks = min(groups, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fitted = dealt.repartition(tasks, "g").sortWithinPartitions("g").mapInArrow(fit_groups(p, prior, penalty), "f int, weight double, n double")
    mean = {r["f"]: r["w"] for r in fitted.groupBy("f").agg((F.sum("weight") / F.sum("n")).alias("w")).collect()}
    w, b = np.array([mean[i] for i in range(len(index))]), mean[-1]
    # Labelled negatives are a sample of another rate than positives; both are weighed as found.
    share = (rates["t"] / max(1, p.n)) / (max(1, rates["n"] - rates["t"]) / max(1, n.n)) if n.n else 1.0
    gp, gn = p.times(w) + b, n.times(w) + b
    repeat = max(1, round(share)) if share >= 1 else 1
    cut = best_cut(np.concatenate([np.repeat(gp, repeat), gn]), np.concatenate([np.ones(len(gp) * repeat), np.zeros(len(gn))]))
    return {x: float(w[i]) for x, i in index.items() if abs(w[i]) > 1e-6}, b, cut


def toxicity(docs: DataFrame, labels: DataFrame, positives: int = 3000, checked: int = 6000, trial: int = 3000, characters: int = 32 << 20, most_words: int = 2000) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document. `characters` bounds the texts of each sample of labelled rows."""
    model = train(docs, labels, positives, checked, trial, characters, most_words)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    return rows.mapInArrow(score_batches(*model), "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
