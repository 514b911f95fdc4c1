"""Near copies by the sets of their word shingles: all pairs of a Jaccard similarity of 4/5 or more, and the groups they form.

1. A text's set: XXH64 of its shingles of `width` words (words as in simhash.py; fewer words make one shingle). Texts of equal sets
   are one node, named by a hash of the set; texts without words have the empty set and are one node.
2. Operator 4 proposes the pairs whose fingerprints (of the set) are within `bits` bits. No Hamming bound is sure to hold for a
   similarity of 4/5, so the rest is found by step 3.
3. Under any one order of all shingles, two sets of n and m elements that are 4/5 alike have one of the first floor(n / 5) + 1 of the
   one among the first floor(m / 5) + 1 of the other. Nodes meet at each of those (`meetings`): no pair is missed. The order is by hash,
   with the shingles of passages that many documents share last (`heavy_shingles`): texts that have only such a passage in common
   don't meet. Which shingles are heavy is estimated from a part of the rows; that changes the work, never the result.
4. Nodes of one size class at a meeting are tried with the lowest of them, one row a member however large a group is. Meetings of
   heavy shingles are dealt by node too, and the lowest nodes of their parts are tried with each other.
5. Groups found so far need no trial inside. Where a meeting holds several groups, the nodes outside its largest one are tried with
   all others of another group; in meetings of heavy shingles the outer ones are repeated in each part. A pair is tried at one meeting
   only, that of the first shingle that both have among their first `LEAD`, or at all its meetings if they share none of those.
6. Pairs to be tried are discarded by sure bounds, then verified on the real sets. Alike sets have at most (n + m) / 9 elements that
   only one of them has, and the differing bits of their parity maps are never more (a map has a bit for each of n cells or more; a
   longer map folds to a shorter one). Texts of pairs left are picked by a bitmap of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gather, keep_nothing, picked_rows, release, row_bitmap, slices, written
from .graph import components
from .simhash import find_links, word_buffer
from .xxh import xxh64_many

#: The name of the empty set.
EMPTY = 0
#: Text bytes worked on at once; shingle arrays take some twenty times as much.
PART = 2 << 20
#: Parts that a heavy shingle's meeting is dealt to.
PARTS = 16
#: Share of the rows that heavy shingles are estimated from, rows of it that must have one, and the most there can be (8 MB).
SHARE, SEEN, HEAVY = 1 / 64, 3, 1 << 20
#: First shingles of a set that are kept beside it, to name one of the meetings of a pair.
LEAD = 16
#: A size class holds sizes of which the largest is at most 5/4 of the smallest.
CLASS = float(np.log(1.25))


def shingle_sets(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(set sizes, hashes): the distinct shingle hashes of each text, ascending."""
    data, starts, ends, words = word_buffer(text)
    shingles = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    first = np.cumsum(words) - words
    at = gather(first, shingles)
    last = np.minimum(at + width - 1, np.repeat(first + words - 1, shingles))
    h = xxh64_many(data, starts[at], ends[last] - starts[at])
    row = np.repeat(np.arange(len(words)), shingles)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return np.bincount(row, minlength=len(words)).astype(np.int64), h


def set_names(sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    starts = np.cumsum(sizes) - sizes
    out = xxh64_many(np.ascontiguousarray(hashes).view(np.uint8), starts * 8, sizes * 8, 7).view(np.int64)
    return np.where(sizes > 0, out, EMPTY)


def set_fingerprints(sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """SimHash of each set: a bit is set if over half of the hashes have it."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes > 0)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        sums = np.empty((len(full), 64), np.int64)
        for byte in range(8):  # a byte of every hash at a time, to bound memory
            part = (hashes >> np.uint64(8 * byte)).astype(np.uint8)
            sums[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(np.unpackbits(part[:, None], axis=1, bitorder="little"), starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * sums > sizes[full][:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)
    return out


def parity_maps(sizes: np.ndarray, hashes: np.ndarray) -> list[bytes]:
    """Of each set the parities of the cells its hashes fall in: the least power of two of cells from n on, 64 at least."""
    width = np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    begin = np.cumsum(width) - width
    at = np.repeat(begin, sizes) + (hashes.view(np.int64) >> np.int64(8) & np.repeat(width - 1, sizes))
    bits = np.packbits(np.bincount(at, minlength=int(width.sum())).astype(np.uint8) & 1, bitorder="little").tobytes()
    return [bits[a : a + n] for a, n in zip((begin // 8).tolist(), (width // 8).tolist(), strict=True)]


def folded(bits: bytes, size: int) -> np.ndarray:
    """A map of `size` bytes, from one that is as long or longer."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8), axis=0)


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / CLASS + 1e-9).astype(np.int32)


def first_places(sizes: np.ndarray, h: np.ndarray, heavy: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(how many, their places in h): the first floor(n / 5) + 1 shingles of each set, or `most` of those, heavy ones last."""
    late = np.zeros(len(h), bool)
    if len(heavy) and len(h):
        late = heavy[np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)] == h
    order = np.argsort(2 * np.repeat(np.arange(len(sizes)), sizes) + late, kind="stable")
    many = np.where(sizes > 0, sizes // 5 + 1, 0)
    if most is not None:
        many = np.minimum(many, most)
    return many, order[gather(np.cumsum(sizes) - sizes, many)]


def describe(width: int, heavy: np.ndarray):
    """Rows (_row, node, n, fp, bits, lead): a text's set by name, size, fingerprint, parity map and up to LEAD of its first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                sizes, h = shingle_sets(part.column("text"), width)
                many, at = first_places(sizes, h, heavy, LEAD)
                lead, end = h[at].tobytes(), np.cumsum(many) * 8
                lead = [lead[a:b] for a, b in zip((end - 8 * many).tolist(), end.tolist(), strict=True)]
                columns = [part.column("_row"), pa.array(set_names(sizes, h)), pa.array(sizes), pa.array(set_fingerprints(sizes, h).view(np.int64))]
                columns += [pa.array(parity_maps(sizes, h), pa.binary()), pa.array(lead, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["_row", "node", "n", "fp", "bits", "lead"])

    return run


def new_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, sizes, hashes) of a task's texts, each set but once."""
    keep_nothing()
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch, "text", PART):
            sizes, h = shingle_sets(part.column("text"), width)
            node = set_names(sizes, h)
            fresh = np.zeros(len(node), bool)
            for i, x in enumerate(node.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh[i] = True
            yield node[fresh], sizes[fresh], h[np.repeat(fresh, sizes)]


def all_shingles(width: int):
    """Rows (h, node): every shingle of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, sizes, h in new_sets(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.repeat(node, sizes))], ["h", "node"])

    return run


def heavy_shingles(texts: DataFrame, width: int, share: float = SHARE, seen: int = SEEN, most: int = HEAVY) -> np.ndarray:
    """Hashes, ascending, of shingles that many sets have; any choice of them gives the same groups."""
    rows = texts.sample(share, seed=7).select("text").mapInArrow(all_shingles(width), "h long, node long").distinct()
    counts = rows.groupBy("h").agg(F.count("*").alias("k")).filter(F.col("k") >= seen)
    return np.sort(np.asarray(counts.orderBy(F.desc("k"), "h").limit(most).select("h").toArrow()["h"]).astype(np.int64).view(np.uint64))


def first_shingles(width: int, heavy: np.ndarray):
    """Rows (h, part, node, n): the first floor(n / 5) + 1 shingles of each set, heavy ones last. part is -1 for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, sizes, h in new_sets(batches, width):
            many, at = first_places(sizes, h, heavy)
            own, first = np.repeat(node, many), h[at]
            part = np.where(np.isin(first, heavy), own % PARTS, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(part), pa.array(own), pa.array(np.repeat(sizes, many).astype(np.int32))], ["h", "part", "node", "n"])

    return run


def whole_meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of rows sorted by h that end where a meeting ends."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        h = np.asarray(batch.column("h"))
        cut_at = int(np.searchsorted(h, h[-1]))
        if n and (cut_at or int(held[-1].column("h")[-1].as_py()) != int(h[0])) and n + cut_at >= 50_000:
            yield pa.Table.from_batches([*held, batch.slice(0, cut_at)]).combine_chunks()
            held, n = [batch.slice(cut_at)], batch.num_rows - cut_at
        else:
            held.append(batch)
            n += batch.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()
    release()


def runs_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, sizes) of the runs of equal rows."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(columns[0])))


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, part, size_class, node, n, least) of the parts of meetings at which two nodes or more meet, and of all that are parts of
    a heavy shingle's; least is the lowest node of the size class there. Rows come sorted by h."""
    for rows in whole_meetings(batches):
        h, part, node, n = (np.asarray(rows[c]) for c in ("h", "part", "node", "n"))
        kind = size_class(n)
        order = np.lexsort((node, kind, part, h))
        h, part, node, n, kind = (x[order] for x in (h, part, node, n, kind))
        one = runs_of(h, part, node)[0]
        h, part, node, n, kind = (x[one] for x in (h, part, node, n, kind))
        begin, size = runs_of(h, part, kind)
        least = np.repeat(node[begin], size)
        size = runs_of(h, part)[1]
        some = np.repeat(size > 1, size) | (part >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (h, part, kind, node, n, least)], ["h", "part", "size_class", "node", "n", "least"])


class Maps:
    """Parity maps of many rows, those of one length as a matrix."""

    def __init__(self, bits: list[bytes]):
        self.length = np.fromiter(map(len, bits), np.int64, len(bits))
        self.place = np.zeros(len(bits), np.int64)
        self.of: dict[tuple[int, int], np.ndarray] = {}
        for size in np.unique(self.length).tolist():
            rows = np.flatnonzero(self.length == size)
            self.place[rows] = np.arange(len(rows))
            self.of[size, size] = np.frombuffer(b"".join(bits[i] for i in rows.tolist()), np.uint64).reshape(len(rows), size // 8)

    def at(self, size: int, to: int) -> np.ndarray:
        """All maps of `size` bytes, folded to `to` bytes."""
        if (size, to) not in self.of:
            whole = self.of[size, size]
            self.of[size, to] = np.bitwise_xor.reduce(whole.reshape(len(whole), size // to, to // 8), axis=1)
        return self.of[size, to]

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        """Differing bits of row i and each of the others."""
        out = np.zeros(len(others), np.int64)
        own = int(self.length[i])
        for size in np.unique(self.length[others]).tolist():
            some = np.flatnonzero(self.length[others] == size)
            to = min(own, size)
            x = self.at(own, to)[self.place[i]]
            out[some] = np.bitwise_count(self.at(size, to)[self.place[others[some]]] ^ x).sum(1)
        return out


class Leads:
    """The first shingles of many rows, in their common order."""

    def __init__(self, lead: list[bytes]):
        self.many = np.fromiter(map(len, lead), np.int64, len(lead)) // 8
        self.of = np.zeros((len(lead), LEAD), np.int64)
        self.of[np.arange(LEAD) < self.many[:, None]] = np.frombuffer(b"".join(lead), np.int64)

    def meet_here(self, i: int, others: np.ndarray, h: int) -> np.ndarray:
        """Whether h is the first shingle that row i and each of the others share in these, or they share none."""
        out = np.ones(len(others), bool)
        own = self.of[i, : self.many[i]]
        for begin in range(0, len(others), 4096):  # to bound memory
            some = others[begin : begin + 4096]
            theirs = self.of[some]
            shared = (theirs[:, :, None] == own).any(2) & (np.arange(LEAD) < self.many[some, None])
            out[begin : begin + 4096] = ~shared.any(1) | (theirs[np.arange(len(some)), shared.argmax(1)] == h)
        return out


def pairs_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b), a over b, of different groups at a meeting, one of them outside the largest group there (`outer`), that the bounds
    don't discard; each at one of its meetings if their first shingles tell which. Rows come sorted by h and part."""

    def unique(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        x, y = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
        x, y = np.maximum(x, y), np.minimum(x, y)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        return pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new])], ["a", "b"])

    for rows in whole_meetings(batches):
        h, part, node, group, n, outer = (np.asarray(rows[c]) for c in ("h", "part", "node", "component", "n", "outer"))
        maps, leads = Maps(rows["bits"].to_pylist()), Leads(rows["lead"].to_pylist())
        a, b, held = [], [], 0
        for begin, size in zip(*(x.tolist() for x in runs_of(h, part)), strict=True):
            here = np.arange(begin, begin + size)
            for i in here[outer[here]].tolist():
                at = here[(group[here] != group[i]) & ~(outer[here] & (here < i)) & (5 * np.minimum(n[here], n[i]) >= 4 * np.maximum(n[here], n[i]))]
                if part[begin] >= 0:  # outer ones are in every part of a heavy shingle's meeting: that of the lower one tries them
                    at = at[~outer[at] | (np.minimum(node[at], node[i]) % PARTS == part[begin])]
                if len(at):
                    at = at[9 * maps.apart(i, at) <= n[at] + n[i]]
                    at = at[leads.meet_here(i, at, h[begin])]
                    a.append(np.full(len(at), node[i]))
                    b.append(node[at])
                    held += len(at)
                    if held >= 200_000:
                        yield unique(a, b)
                        a, b, held = [], [], 0
        yield unique(a, b)


def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of rows (a, b, n, m, x, y) whose sizes and parity maps x and y don't discard them."""
    for batch in batches:
        n, m = (np.asarray(batch.column(c)) for c in ("n", "m"))
        good = 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)
        x, y = batch.column("x"), batch.column("y")
        for i in np.flatnonzero(good).tolist():
            p, q = x[i].as_py(), y[i].as_py()
            size = min(len(p), len(q))
            good[i] = 9 * int(np.bitwise_count(folded(p, size) ^ folded(q, size)).sum()) <= n[i] + m[i]
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column(c))[good]) for c in ("a", "b")], ["a", "b"])


def alike(width: int):
    """The pairs (a, b) of rows (a, b, x, y) whose texts' sets are 4/5 alike; rows of one b mostly stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "x", PART):
                a, b = np.asarray(part.column("a")), np.asarray(part.column("b"))
                _, first, which = np.unique(b, return_index=True, return_inverse=True)
                n, own = shingle_sets(part.column("x"), width)
                m, theirs = shingle_sets(pc.take(part.column("y"), pa.array(first)).cast(pa.large_string()), width)
                rows = np.arange(len(a))
                other = theirs[gather((np.cumsum(m) - m)[which], m[which])]
                h, row = np.concatenate([own, other]), np.concatenate([np.repeat(rows, n), np.repeat(rows, m[which])])
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                common = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=len(a))
                good = 9 * common >= 4 * (n + m[which])
                yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """The pairs whose sets are 4/5 alike. nodes(node, _row, n, bits) has the row of a text of each node."""
    a, b = (nodes.select(F.col("node").alias(k), F.col("n").alias(size), F.col("bits").alias(bits)) for k, size, bits in (("a", "n", "x"), ("b", "m", "y")))
    pairs = written(pairs.join(a, "a").join(b, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(plausible, "a long, b long"))
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "_row"), "node"))
    found = texts.select("_row", "text").mapInArrow(picked_rows(row_bitmap(wanted)), "_row long, text string")
    found = written(found.join(wanted, "_row").select("node", "text"))
    both = pairs.join(found.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(found.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(alike(width), "a long, b long")


def near_copies(texts: DataFrame, width: int = 5, bits: int = 3, share: float = SHARE, seen: int = SEEN) -> DataFrame:
    """_row, component: the group of every row of texts(_row, text). Groups are joined by all pairs of sets that are 4/5 alike.
    texts is read several times and must have the same rows and row numbers each time. Null and empty texts are one group; an empty
    table has no rows."""
    heavy = heavy_shingles(texts, width, share, seen)
    described = written(texts.select("_row", "text").mapInArrow(describe(width, heavy), "_row long, node long, n long, fp long, bits binary, lead binary"))
    nodes = written(described.groupBy("node").agg(F.min("_row").alias("_row"), *(F.first(c).alias(c) for c in ("n", "fp", "bits", "lead"))))
    met = texts.select("text").mapInArrow(first_shingles(width, heavy), "h long, part int, node long, n int").repartition("h", "part").sortWithinPartitions("h", "part")
    met = written(met.mapInArrow(meetings, "h long, part int, size_class int, node long, n int, least long"))

    same = nodes.groupBy("fp").agg(F.min("node").alias("rep"))
    near = nodes.select("fp", F.col("node").alias("a")).join(same, "fp").select("a", F.col("rep").alias("b"))
    heads = met.filter("part >= 0").select("h", "size_class", "least").distinct()
    tops = heads.groupBy("h", "size_class").agg(F.min("least").alias("top"))
    tried = met.select(F.col("node").alias("a"), F.col("least").alias("b")).unionByName(near).unionByName(find_links(same, bits))
    tried = tried.unionByName(heads.join(tops, ["h", "size_class"]).select(F.col("least").alias("a"), F.col("top").alias("b")))
    tried = tried.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = written(verified(tried, texts, nodes, width))
    groups = written(components(links))

    marked = written(met.drop("size_class", "least").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
    counts = marked.groupBy("h", "component").agg(F.count("*").alias("k"))
    open_ = counts.groupBy("h").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("k")).filter("k > 1").drop("k")
    rest = marked.join(open_, "h").withColumn("outer", F.col("component") != F.col("main")).drop("main")
    everywhere = F.when(F.col("outer") & (F.col("part") >= 0), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array("part"))
    rest = rest.withColumn("part", F.explode(everywhere)).distinct().join(nodes.select("node", "bits", "lead"), "node")
    across = written(rest.repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(pairs_across, "a long, b long").distinct())
    if not across.isEmpty():
        links = written(links.unionByName(verified(across, texts, nodes, width)))
        groups = written(components(links))
    return described.select("_row", "node").join(groups, "node", "left").select("_row", F.coalesce("component", "node").alias("component"))
