"""Operator 4, SimHash near-duplicates with pivot distance tables.

1. A fingerprint per text: words are cut at ASCII white space, A-Z lower-cased; XXH64 (seed 42) of every shingle, repeats
   included; a bit is set if over half of the hashes have it.
2. Equal fingerprints are one node, named by the fingerprint; a group is named by its smallest doc_id at the end.
3. Two fingerprints within d bits agree on two of d + 2 blocks of bits, so each node goes to one bucket per pair of blocks. In a
   bucket, a table of Hamming distances to reference fingerprints proposes the pairs: only nodes whose largest coordinate difference
   is at most d can be within d bits (the triangle inequality). Nodes stand by the first coordinate and meet those that follow
   within d of it, the other coordinates discard pairs, and the survivors are verified. Nodes of buckets of over `tile` nodes (dense balls of near
   copies) meet at points instead: two nodes within 3 bits share a point within 1 bit of one and 2 of the other, so each node
   goes to a fixed number of points and a point has a bounded number of nodes: the rows grow with the bucket, not its square.
4. Tasks reduce their links to stars; components come from rounds over those (graph.py).

Defined results: null and empty texts and texts without words have fingerprint zero and are linked like any others; fewer words
than the width make one shingle; rows that repeat a doc_id each get a row; an empty table gives no rows; a null doc_id takes part
as a member, and its group is named by the smallest id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, slices, written
from .graph import components, local_stars
from .xxh import xxh64_many

#: Nodes that a bucket may have before it is split further.
TILE = 2048
PIVOTS = 4
#: Shingles whose bits are unpacked at once.
STEP = 1 << 18


def word_buffer(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with words one space apart, word starts, word ends, words per text), lower-cased in A-Z."""
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = True
    begin = np.flatnonzero(~space & before)
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    stop = np.flatnonzero(~space & after) + 1
    counts = np.diff(np.searchsorted(begin, offsets))
    lengths = stop - begin
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    kept = data[~space]
    kept = np.where((kept >= 65) & (kept <= 90), kept + np.uint8(32), kept)
    hole = np.ones(len(out), bool)
    hole[ends] = False
    out[hole] = kept
    return out, starts, ends, counts


def fingerprints(text: pa.Array, width: int) -> np.ndarray:
    """64-bit fingerprints of large_string texts."""
    data, starts, ends, words = word_buffer(text)
    shingles = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    first = np.cumsum(words) - words
    owner_first = np.repeat(first, shingles)
    total = int(shingles.sum())
    at = owner_first + np.arange(total) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(at + width - 1, np.repeat(first + words - 1, shingles))
    h = xxh64_many(data, starts[at], ends[last] - starts[at])
    out = np.zeros(len(words), np.uint64)
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    row = 0
    while row < len(words):
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + STEP, side="right")) - 1)
        rows = np.arange(row, stop)[shingles[row:stop] > 0]
        if len(rows):
            sums = np.zeros((len(rows), 64), np.int64)
            if stop == row + 1:  # a long text, in steps
                for a in range(int(bounds[row]), int(bounds[stop]), STEP):
                    b = min(a + STEP, int(bounds[stop]))
                    sums[0] += np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            else:
                bits = np.unpackbits(h[bounds[row] : bounds[stop]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                sums = np.add.reduceat(bits, bounds[rows] - bounds[row], axis=0, dtype=np.int32)
            out[rows] = np.packbits(2 * sums > shingles[rows][:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)
        row = stop
    return out


def fingerprint_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = fingerprints(part.column("text"), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return run


def block_masks(bits: int) -> list[int]:
    """Masks of every pair of bits + 2 blocks."""
    edges = np.linspace(0, 64, bits + 3).round().astype(int).tolist()
    blocks = [sum(1 << k for k in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [a | b for a, b in combinations(blocks, 2)]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def pivots() -> np.ndarray:
    """Reference fingerprints, the same in every task."""
    return xxh64_many(np.arange(PIVOTS, dtype=np.uint8), np.arange(PIVOTS), np.ones(PIVOTS, np.int64), 7)


def linked_pairs(mask: np.ndarray, key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Row numbers of the pairs within `bits` bits in the same bucket, and how many pairs were formed.

    In each bucket rows stand by their distance to the first pivot, and a row meets only those that follow within `bits` of it. The
    other pivots then discard pairs before the fingerprints themselves are compared.
    """
    table = np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], key, mask))
    mask, key, table = mask[order], key[order], table[order]
    new = np.ones(len(fp), bool)
    new[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])
    place = np.cumsum(new) * 128 + table[:, 0]  # ascending; rows of another bucket are far off
    reach = np.searchsorted(place, place + bits, side="right") - np.arange(len(fp)) - 1  # rows that each one meets
    a_all, b_all, formed = [], [], 0
    for start, stop in stretches(reach):
        a = np.repeat(np.arange(start, stop), reach[start:stop])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(reach[start:stop]) - reach[start:stop], reach[start:stop])
        formed += len(a)
        for p in range(1, PIVOTS):
            near = np.abs(table[a, p] - table[b, p]) <= bits
            a, b = a[near], b[near]
        a, b = order[a], order[b]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= bits
        a_all.append(a[near])
        b_all.append(b[near])
    none = np.zeros(0, np.int64)
    return (np.concatenate(a_all), np.concatenate(b_all), formed) if a_all else (none, none, 0)


def stretches(reach: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Stretches of rows that meet about `most` others together."""
    total = np.cumsum(reach)
    start = 0
    while start < len(reach):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, side="right")))
        if total[stop - 1] > (total[start - 1] if start else 0):
            yield start, stop
        start = stop


def links_in_buckets(bits: int):
    """Rows (a, b): stars of the links found in a task's buckets, in groups of whole buckets to bound memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: pa.Table):
            mask, key, fp = (np.asarray(rows[c]) for c in ("mask", "key", "fp"))
            node = np.asarray(rows["rep"])
            a, b, _ = linked_pairs(mask, key, fp.view(np.uint64), bits)
            x, y = local_stars(node[a], node[b])
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 200_000:
                rows = pa.Table.from_batches(held).combine_chunks()
                mask, key = np.asarray(rows["mask"]), np.asarray(rows["key"])
                last = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))  # the last bucket may go on
                whole = int(last[-1]) + 1 if len(last) else 0
                if whole:
                    yield emit(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
                n = rows.num_rows - whole
        if n:
            yield emit(pa.Table.from_batches(held).combine_chunks())

    return run


def ball(radius: int) -> np.ndarray:
    """All 64-bit patterns of at most `radius` bits."""
    return np.array([sum(1 << k for k in c) for n in range(radius + 1) for c in combinations(range(64), n)], np.uint64)


def meeting_points(bits: int):
    """Rows (z, near, rep): the points within bits // 2 (near) and within the rest of `bits` of each node. Two nodes within `bits`
    meet at a point that is near to one of them and within the rest of the other."""
    inner, outer = ball(bits // 2), ball(bits - bits // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                fp, rep = np.asarray(part.column("fp")).view(np.uint64), np.asarray(part.column("rep"))
                for points, near in ((inner, True), (outer[len(inner) :], False)):
                    z = (fp[:, None] ^ points[None, :]).reshape(-1).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(np.full(len(z), near)), pa.array(np.repeat(rep, len(points)))], ["z", "near", "rep"])

    return run


def links_at_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by z, near ones first: every member of a point that has a near one is linked to its first near one. A point has
    no more members than there are patterns of that many bits, so a point held over to the next batch is small."""
    held: pa.Table | None = None

    def emit(rows: pa.Table):
        z, near, rep = (np.asarray(rows[c].combine_chunks().cast(pa.int64())) for c in ("z", "near", "rep"))
        begin = np.flatnonzero(np.append(True, z[1:] != z[:-1]))
        size = np.diff(np.append(begin, len(z)))
        to = np.repeat(np.where(near[begin] == 1, rep[begin], -1), size)
        has = np.repeat(near[begin] == 1, size) & (to != rep)
        x, y = local_stars(rep[has], to[has])
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        z = np.asarray(rows["z"])
        whole = int(np.searchsorted(z, z[-1])) if len(z) else 0
        if whole:
            yield emit(rows.slice(0, whole))
        held = rows.slice(whole)
    if held is not None and held.num_rows:
        yield emit(held)


def find_links(nodes: DataFrame, bits: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) between nodes(fp, rep) whose components are those of all pairs within `bits` bits."""
    masks = F.array(*[F.lit(signed(m)) for m in block_masks(bits)])
    keyed = nodes.select("fp", "rep", F.explode(masks).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "rep")
    large = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > tile).select("mask", "key")
    small, dense = keyed, None
    if not large.isEmpty():
        spread = written(large).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(31))))
        salted = keyed.withColumn("_s", F.pmod(F.xxhash64("fp"), F.lit(32)).cast("int"))
        tagged = written(salted.join(spread.withColumn("_large", F.lit(True)), ["mask", "key", "_s"], "left").drop("_s"))
        small = tagged.filter("_large is null").drop("_large")
        crowd = tagged.filter("_large").select("fp", "rep").distinct()
        points = crowd.mapInArrow(meeting_points(bits), "z long, near boolean, rep long")
        dense = points.repartition("z").sortWithinPartitions("z", F.desc("near"), "rep").mapInArrow(links_at_points, "a long, b long")
    found = small.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(links_in_buckets(bits), "a long, b long")
    return found if dense is None else found.unionByName(dense)


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 3, tile: int = TILE) -> DataFrame:
    """doc_id, fp, component_id: one row per document."""
    prints = written(docs.select("doc_id", "text").mapInArrow(fingerprint_batches(width), "doc_id long, fp long"))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(find_links(nodes.select("fp", F.col("fp").alias("rep")), bits, tile))
    linked = written(nodes.join(found.withColumnRenamed("node", "fp"), "fp"))
    ids = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = nodes.join(salted_join(linked, ids, ["component"], F.col("fp")).select("fp", "component_id"), "fp", "left")
    return prints.join(written(named.select("fp", F.coalesce("component_id", "rep").alias("component_id"))), "fp")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
