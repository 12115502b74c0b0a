"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments, each
written as a run of ones (0, 1 or 2 of them), so that the Manhattan distance of two
vectors is the number of bits in which their codes differ.  It never exceeds the
Hamming distance of the fingerprints, so a range join under it loses no link.

The join is a grid: the vector is cut into ``blocks`` blocks of segments, two vectors
within ``max_distance`` agree on all but that many of them, and each choice of such
blocks names a cell that both lie in.  Cells grow finer with the number of
fingerprints, and a cell that is still large is cut again by the segments that it
leaves open.  Inside a cell, candidates are those within ``max_distance`` under the
Manhattan distance; they are verified on the fingerprints.

A cell never emits its pairs: it emits one link per fingerprint, along a
spanning forest, so rows stay linear where thousands of near copies meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, materialize, slices, texts

SEED = 42
SEGMENTS = 32
_LOW = np.uint64(0x0101010101010101)


def fingerprint(text: bytes, width: int = 3) -> int:
    """Of one text, in plain Python; the definition that tests hold the rest to."""
    words = text.lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, SEED) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of counts[i] > 0 hashes: bits set in more than half of them.

    Bits are added in byte lanes, 255 rows at a time, so no row is unpacked to 64 numbers.
    """
    starts = np.cumsum(counts) - counts
    blocks = -(-counts // 255)
    first = np.cumsum(blocks) - blocks
    at = np.repeat(starts, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    out = np.zeros(len(counts), np.uint64)
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & _LOW, at)
        per_byte = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(per_byte, first, axis=0)
        wins = (2 * total > counts[:, None]).astype(np.uint64)
        for byte in range(8):
            out |= wins[:, byte] << np.uint64(8 * byte + j)
    return out


def _fingerprints(width: int, keep: list[str]):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in slices(batches, "text", 2 << 20):
            hashes: list[int] = []
            counts = np.zeros(batch.num_rows, np.int64)
            for row, text in enumerate(texts(batch, "text")):
                words = text.lower().split()
                n = len(words)
                if not n:
                    continue
                line = b" ".join(words)
                if n <= width:
                    hashes.append(digest(line, SEED))
                    counts[row] = 1
                    continue
                size = np.fromiter(map(len, words), np.int64, n) + 1
                ends = np.cumsum(size) - 1
                begin = (ends - size + 1)[: n - width + 1].tolist()
                hashes += [digest(line[a:b], SEED) for a, b in zip(begin, ends[width - 1 :].tolist())]
                counts[row] = n - width + 1
            out = np.zeros(batch.num_rows, np.uint64)
            full = counts > 0
            if full.any():
                out[full] = _majority(np.array(hashes, np.uint64), counts[full])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out.view(np.int64))], names=[*keep, "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carry..., fp) of every row; carry are longs, fp is the 64-bit pattern as a signed long, zero without a word or text."""
    keep = ["doc_id", *carry]
    return docs.select(F.col("doc_id").cast("long"), *carry, "text").mapInArrow(_fingerprints(width, keep), ", ".join(f"{c} long" for c in [*keep, "fp"]))


def embedding(fp: Column) -> Column:
    """The 32 segment counts, each as a run of ones in its two bits: their Manhattan distance is the bits that differ."""
    even = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(high).bitwiseAND(even), fp.bitwiseAND(high).bitwiseAND(even)
    return some.bitwiseOR(F.shiftleft(both, 1))  # a lane's sum without a carry, so no ANSI overflow


def _codes(fps: np.ndarray) -> np.ndarray:
    """embedding() of an array."""
    even, one = np.uint64(0x5555555555555555), np.uint64(1)
    high = fps >> one
    return ((fps | high) & even) | ((fps & high & even) << one)


def _masks(segments: list[int], blocks: int, agree: int) -> list[int]:
    """For each choice of agree blocks, of the blocks that segments are cut into, the bits of their codes, as a signed long."""
    edge = [len(segments) * b // blocks for b in range(blocks + 1)]
    block = [sum(3 << 2 * s for s in segments[edge[b] : edge[b + 1]]) for b in range(blocks)]
    masks = [sum(c) for c in combinations(block, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def cell_masks(max_distance: int = 3, blocks: int | None = None) -> list[int]:
    """The bits that name the cells of each grid: of blocks blocks all but max_distance agree."""
    blocks = blocks or max_distance + 3
    return _masks(list(range(SEGMENTS)), blocks, blocks - max_distance)


def finer_masks(mask: int, max_distance: int = 3) -> list[int]:
    """The bits that name the parts of a cell of mask: blocks of the segments that it leaves open, of which all but max_distance agree.

    Vectors of one cell that are within max_distance differ in open segments only, so they meet in a part.
    """
    left = [s for s in range(SEGMENTS) if not mask >> 2 * s & 3]
    blocks = min(max_distance + 2, len(left))
    return _masks(left, blocks, blocks - max_distance) if blocks > max_distance else [0]


def blocks_for(fingerprints: int, max_distance: int = 3, room: int = 64) -> int:
    """How many blocks name cells of about room fingerprints each: a segment's count tells 1.5 bits."""
    blocks = max_distance + 3
    while blocks < SEGMENTS // 2 and fingerprints > room * 2 ** (1.5 * SEGMENTS * (blocks - max_distance) / blocks):
        blocks += 1
    return blocks


def _forest(fps: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join those of one cell which are connected through it; fps are distinct.

    A search from each fingerprint not yet reached compares the frontier with the
    unreached only: by total bit count, then under the Manhattan distance of the
    vectors, then exactly.
    """
    total = np.bitwise_count(fps).astype(np.int64)
    order = np.argsort(total, kind="stable")
    rest, weight = fps[order], total[order]
    codes = _codes(rest)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    while len(rest) > 1:
        root = rest[0]
        frontier, rest, weight, codes = [rest[:1]], rest[1:], weight[1:], codes[1:]
        while frontier and len(rest):
            now = frontier.pop()
            for x, code in zip(now, _codes(now)):
                ones = int(np.bitwise_count(x))
                lo, hi = np.searchsorted(weight, [ones - max_distance, ones + max_distance + 1])
                at = lo + np.flatnonzero(np.bitwise_count(codes[lo:hi] ^ code) <= max_distance)
                at = at[np.bitwise_count(rest[at] ^ x) <= max_distance]
                if len(at):
                    found = rest[at]
                    a.append(np.full(len(found), root))
                    b.append(found)
                    frontier.append(found)
                    stay = np.ones(len(rest), bool)
                    stay[at] = False
                    rest, weight, codes = rest[stay], weight[stay], codes[stay]
                    if not len(rest):
                        break
    if not a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(a), np.concatenate(b)


def _links(max_distance: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last cell, which the next batch may continue

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(rows):
                return
            edge = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            cells = np.split(rows[:, 2].view(np.uint64), edge) if len(edge) < 64 else None
            if cells is None:
                starts = np.concatenate([[0], edge])
                size = np.diff(np.concatenate([starts, [len(rows)]]))
                many = size > 1
                fps = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
                cells = [fps[s : s + n] for s, n in zip(starts[many].tolist(), size[many].tolist())]
            got = [_forest(np.unique(c), max_distance) for c in cells if len(c) > 1]
            if got and sum(len(x) for x, _ in got):
                u, v = (np.concatenate(x).view(np.int64) for x in zip(*got))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy() for i in range(3)]).astype(np.int64)
            if not len(rows):
                continue
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            if cut or (held and (held[0][0, :2] != rows[0, :2]).any()):
                yield from flush(np.concatenate([*held, rows[:cut]]))
                held = []
            held.append(rows[cut:])
        if held:
            yield from flush(np.concatenate(held))

    return run


def links(fps: DataFrame, max_distance: int = 3, large: int = 8192, blocks: int | None = None) -> DataFrame:
    """(u, v): a spanning set of the links among distinct fingerprints fps(fp).

    Cells of more than large fingerprints are cut into parts, each of them a row's
    own copy, so no cell is one task's work.
    """
    vector = embedding(F.col("fp"))
    masks = cell_masks(max_distance, blocks or blocks_for(fps.count(), max_distance))
    cells = fps.select("fp", F.posexplode(F.array(*[vector.bitwiseAND(F.lit(m)) for m in masks])).alias("grid", "cell"))
    # written first, so that its size is known where the join is planned: few are broadcast, many dealt out
    hot = materialize(cells.groupBy("grid", "cell").count().where(F.col("count") > large).select("grid", "cell", F.lit(True).alias("hot")), "cells")
    told = cells.join(hot, ["grid", "cell"], "left")
    finer = F.array(*[F.array(*map(F.lit, finer_masks(m, max_distance))) for m in masks])
    open_ = F.element_at(finer, F.col("grid") + 1)
    part = F.when(F.col("hot"), F.transform(open_, lambda m: F.struct(m.alias("kind"), vector.bitwiseAND(m).alias("part")))).otherwise(
        F.array(F.struct(F.lit(0).cast("long").alias("kind"), F.lit(0).cast("long").alias("part")))
    )
    dealt = told.select("grid", "cell", "fp", F.explode(part).alias("p")).select(F.xxhash64("grid", "p.kind").alias("grid"), F.col("cell").bitwiseOR(F.col("p.part")).alias("cell"), "fp")
    return dealt.repartition("grid", "cell").sortWithinPartitions("grid", "cell").mapInArrow(_links(max_distance), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of edges(u, v): the smallest node that it reaches.

    Label propagation with pointer jumping: O(log diameter) rounds, each written
    to the shared folder.  A hub's rows meet in joins, which AQE splits, and in
    pre-aggregated minima.
    """
    both = materialize(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "links")
    label = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root")), "labels")
    while True:
        seen = label.select(F.col("node").alias("u"), F.col("root"))
        near = both.join(seen, "u").groupBy(F.col("v").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("far"))
        step = step.join(jump, "root", "left").select("node", F.least("root", F.coalesce("far", "root")).alias("root"), "was")
        last, step = label, materialize(step, "labels")
        changed = step.where(F.col("root") != F.col("was")).limit(1).count()
        discard(last)
        if not changed:
            discard(both)
            return step.select("node", "root")
        label = step


def _rooted(distinct: DataFrame, max_distance: int) -> DataFrame:
    """distinct(fp, ...) with the root of each fingerprint's component."""
    label = components(links(distinct.select("fp"), max_distance))
    return distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def representatives(docs: DataFrame, key: tuple[str, ...], width: int = 3, max_distance: int = 3) -> DataFrame:
    """(key...) of one row of each component of docs(doc_id, text, key...): that with the smallest doc_id, null last, then the smallest key.

    key are longs that tell rows apart; components are told by their fingerprints, so
    ids may be null or shared.  Rows with equal keys must have equal texts.
    """
    own = fingerprints(docs, width, key)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *key)
    distinct = materialize(own.groupBy("fp").agg(F.min(first).alias("first")), "distinct")
    least = _rooted(distinct, max_distance).groupBy("root").agg(F.min("first").alias("first"))
    return least.select([f"first.{k}" for k in key])


def simhash_components(docs: DataFrame, width: int = 3, max_distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs(doc_id, text).

    Null and word-less texts have fingerprint zero and link like any other.  Repeated
    rows stay repeated.  A null doc_id gets a fingerprint; its component's id is the
    smallest non-null doc_id, null where there is none.  An empty table gives no rows.
    Columns besides doc_id and text are ignored.
    """
    own = materialize(fingerprints(docs, width), "fingerprints")
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    rooted = _rooted(distinct, max_distance)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
