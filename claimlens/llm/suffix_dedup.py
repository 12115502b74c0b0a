"""Removal of long byte strings that stand more than once, by external induced suffix sorting.

Which strings meet in one shard is decided by minimizers: of the ``anchor``-byte
strings inside a window of ``length`` bytes, the one with the smallest hash (the
leftmost of equals) depends on the window's bytes alone, so equal windows share it.
A text is cut into extents, the windows that share one minimizer.  Extents that are
equal as a whole are counted, not copied, and only where a minimizer has several
different extents are their bytes gathered.  There, windows are taken ``STRIDE``
starts at a time: all of them hold the same core of bytes around the minimizer, so
those whose core is nowhere else are alone; the rest is sorted by induction with
common prefixes, and windows whose neighbour shares ``length`` bytes are marked.
The extents of one minimizer are one shard's work, except where it has so many
kinds of them (a line that many documents hold, in surroundings of their own) that
they are dealt by core: equal windows share that as well.

Rows that travel are minimizers (about two per ``length - anchor`` bytes) and the
extents that differ; texts travel once for those and once for the removal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import induced
from .common import discard, lean, materialize, slices, texts

ANCHOR = 64
#: Bytes of extents that a shard takes, unless a single minimizer has more, and of bodies that one sort takes.
SHARD_BYTES = 4 << 20
#: Window starts that are judged together.
STRIDE = 48
#: Kinds of extents from which on a minimizer's extents are dealt by core.  Counted on one kind in HOT_SAMPLE, as
#: both ways find the same.  The texts that stand HOT times or more are dealt out as well.  More than HOT are needed
#: in a table of over HOT * HOT_MOST extents, so that lists of hot ones stay short enough to be sent to all.
HOT, HOT_SAMPLE, HOT_MOST = 256, 16, 1 << 20
#: Bytes of a text that are searched for minimizers at once.
PIECE = 8 << 20

_table = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def anchor_for(length: int) -> int:
    """The bytes that a minimizer of windows of length bytes has: a power of two, a sixth of them at most, and ANCHOR at most."""
    return min(ANCHOR, 1 << (max(length // 6, 1).bit_length() - 1))


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of data[i : i + size] for every i where it fits; size is a power of two."""
    h, step, factor = _table[data], 1, _M1
    while step < size:
        h = h[:-step] * factor + h[step:]
        factor = factor * _M1 * _M2 | np.uint64(1)
        step *= 2
    h ^= h >> np.uint64(32)
    h *= _M2
    return h ^ (h >> np.uint64(29))


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i : i + width]) for every i where it fits, by prefix and suffix minima of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def extents(data: bytes, bounds: np.ndarray, length: int, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts end to end (text i at bounds[i] : bounds[i + 1]): the extents' first and last window, minimizer's place and hash.

    Places are of data; windows do not leave their text.  data is at most 16 MB.
    """
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, np.empty(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    h = _gram_hashes(raw, anchor)
    low = np.uint64(0xFFFFFF)
    ordered = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    best = (_window_minima(ordered, length - anchor + 1) & low).astype(np.int64)
    text_end = np.repeat(bounds[1:], np.diff(bounds))[: len(best)]
    ok = np.arange(len(best)) + length <= text_end
    at = np.flatnonzero(ok)
    if not len(at):
        return none, none, none, np.empty(0, np.uint64)
    p = best[at]
    cut = np.flatnonzero((p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    first = np.concatenate([[0], cut])
    last = np.append(cut, len(at)) - 1
    return at[first], at[last], p[first], h[p[first]]


def _text_key(text: Column) -> list[Column]:
    """Two hashes that stand for a text; equal texts share all that is found out about them."""
    return [F.xxhash64(text).alias("t1"), F.hash(text, F.octet_length(text)).alias("t2")]


def _find(length: int, anchor: int):
    names = ["t1", "t2", "mh", "eh", "first", "last", "mid"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches, "text", 1 << 20):
            docs = texts(batch, "text")
            t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # a text too long for one piece is searched in pieces that overlap by a window less one byte
            parts = [(i, s, d[s : s + PIECE + length - 1]) for i, d in enumerate(docs) for s in range(0, max(len(d) - length + 1, 1), PIECE)]
            group: list[tuple[int, int, bytes]] = []
            held = 0
            for k, part in enumerate(parts):
                group.append(part)
                held += len(part[2])
                if held < 1 << 20 and k + 1 < len(parts):
                    continue
                size = np.fromiter((len(x) for _, _, x in group), np.int64, len(group))
                bounds = np.concatenate([[0], np.cumsum(size)])
                data = b"".join([x for _, _, x in group])
                a, b, p, mh = extents(data, bounds, length, anchor)
                if len(a):
                    eh = [digest(data[x : y + length], z) for x, y, z in zip(a.tolist(), b.tolist(), (p - a).tolist())]
                    of = np.searchsorted(bounds, a, side="right") - 1
                    doc = np.array([i for i, _, _ in group])[of]
                    shift = np.array([s for _, s, _ in group])[of] - bounds[of]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(t1[doc]), pa.array(t2[doc]), pa.array(mh.view(np.int64)), pa.array(np.array(eh, np.uint64).view(np.int64)), pa.array((a + shift).astype(np.int64)), pa.array((b + shift).astype(np.int64)), pa.array((p - a).astype(np.int64))],
                        names=names,
                    )
                group, held = [], 0

    return run


def _cut(length: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            wanted = batch.column(batch.schema.get_field_index("wanted"))
            rows = wanted.flatten()
            size = pa.compute.list_value_length(wanted).to_numpy()
            mh, eh, first, last, mid = (rows.field(i).to_numpy() for i in range(5))
            hot = rows.field(5).to_numpy(zero_copy_only=False)
            docs = texts(batch, "text")
            of = np.repeat(np.arange(len(docs)), size)
            row, part, off, body = [], [], [], []
            for k, (i, a, b, m, pieces) in enumerate(zip(of.tolist(), first.tolist(), last.tolist(), mid.tolist(), hot.tolist())):
                extent = docs[i][a : b + length]
                for core, start, piece in by_core(m, extent, length) if pieces else [(0, 0, extent)]:
                    row.append(k)
                    part.append(core)
                    off.append(start)
                    body.append(piece)
            at = np.array(off, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(mh[row]), pa.array(part, pa.int64()), pa.array(eh[row]), pa.array(at), pa.array(mid[row] - at), pa.array(body, pa.binary())], names=["mh", "part", "eh", "off", "mid", "body"])

    return run


def by_core(mid: int, body: bytes, length: int) -> Iterator[tuple[int, int, bytes]]:
    """(hash of the core, start, bytes) of the groups of windows of an extent whose minimizer is at mid; equal windows share the first."""
    span, last = length - anchor_for(length), len(body) - length
    for g in range((mid - last) // STRIDE, mid // STRIDE + 1):
        near, far = g * STRIDE, min(g * STRIDE + STRIDE - 1, span)
        a, b = max(0, mid - far), min(last, mid - near)
        core = xxhash.xxh3_64_intdigest(body[mid - near : mid - far + length], g)
        yield core - (1 << 64 if core >> 63 else 0), a, body[a : b + length]


def repeated_windows(bodies: list[bytes], length: int, memory: int = induced.MEMORY_ENTRIES) -> list[np.ndarray]:
    """For each body (different ones, of length bytes or more) the starts of windows that stand elsewhere in bodies too."""
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    stop = np.cumsum(size + 1) - 1  # the places of the marks that close the bodies
    text = np.empty(int(stop[-1]) + 2, np.uint16)
    inside = np.ones(len(text), bool)
    inside[stop] = False
    inside[-1] = False
    text[inside] = np.frombuffer(b"".join(bodies), np.uint8)
    text[inside] += 2
    text[stop] = 1
    text[-1] = 0
    hit = np.zeros(len(text), bool)
    before = -1
    for pos, lcp in induced.sort(text, 258, length, memory):
        same = lcp >= length
        hit[pos[same]] = True
        hit[np.concatenate([[before], pos[:-1]])[same]] = True
        before = pos[-1]
    start = stop - size
    return [np.flatnonzero(hit[a : b - length + 1]) for a, b in zip(start.tolist(), stop.tolist())]


def judge(rows: list[tuple[int, int, bytes]], length: int, anchor: int = ANCHOR, memory: int = induced.MEMORY_ENTRIES, room: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each extent (minimizer's hash, its place in the body, body) the starts of windows that stand in another extent too.

    Extents may be given in pieces, each with the windows of one core.  Starts are cut into groups by their distance from
    the minimizer; all windows of a group hold one core, and equal windows one core.
    A sort takes the bodies of whole cores, room bytes at most: a core that has more is
    cut into finer groups, down to single windows, which need no sort.
    """
    digest = xxhash.xxh3_128_digest
    span = length - anchor
    hits: list[list[np.ndarray]] = [[] for _ in rows]
    bodies: list[bytes] = []
    stand: list[list[tuple[int, int]]] = []  # the extents and places that each body stands for
    held = 0

    def flush() -> None:
        nonlocal held
        if bodies:
            for at, found in zip(stand, repeated_windows(bodies, length, memory)):
                if len(found):
                    for k, a in at:
                        hits[k].append(a + found)
        bodies.clear()
        stand.clear()
        held = 0

    def cut(ranges: list[tuple[int, int, int]], stride: int) -> None:
        nonlocal held
        cores: dict[tuple, list[tuple[int, int, int]]] = {}
        for k, first, last in ranges:
            mh, mid, body = rows[k]
            for g in range((mid - last) // stride, (mid - first) // stride + 1):
                near, far = g * stride, min(g * stride + stride - 1, span)
                a, b = max(first, mid - far), min(last, mid - near)
                cores.setdefault((mh, g, digest(body[mid - near : mid - far + length])), []).append((k, a, b))
        for places in cores.values():
            if len(places) < 2:
                continue
            kinds: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
            for k, a, b in places:
                kinds.setdefault((rows[k][1] - a, rows[k][2][a : b + length]), []).append((k, a))
            size = sum(len(body) for _, body in kinds)
            if len(kinds) > 1 and size > room and stride > 1:
                cut(places, max(1, stride // 6))
                continue
            for (_, body), at in kinds.items():
                if len(at) > 1:  # the same bytes in several extents: all their windows stand twice
                    for k, a in at:
                        hits[k].append(a + np.arange(len(body) - length + 1))
            if len(kinds) > 1 and stride > 1:
                if held + size > room:
                    flush()
                bodies.extend(body for _, body in kinds)
                stand.extend(kinds.values())
                held += size

    cut([(k, 0, len(body) - length) for k, (_, _, body) in enumerate(rows)], STRIDE)
    flush()
    none = np.empty(0, np.int64)
    return [np.unique(np.concatenate(h)) if h else none for h in hits]


def _judge(length: int, shard_bytes: int):
    """Over rows ordered by mh and part: judge whole parts together until a shard is full."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            mh, eh, spans = [], [], []
            for (m, _, e, off, _, _), at in zip(held, judge([(m, mid, body) for m, _, _, _, mid, body in held], length, anchor_for(length))):
                if len(at):
                    cut = np.flatnonzero(np.diff(at) > 1) + 1
                    mh.append(m)
                    eh.append(e)
                    spans.append([{"a": off + int(x[0]), "b": off + int(x[-1])} for x in np.split(at, cut)])
            return pa.RecordBatch.from_arrays([pa.array(mh, pa.int64()), pa.array(eh, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], names=["mh", "eh", "spans"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if size >= shard_bytes and held[-1][:2] != row[:2]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flush()

    return run


def _hot(kinds: DataFrame, least: int) -> DataFrame:
    """(mh, hot) of the minimizers that have least kinds or more, by a count of some; HOT_SAMPLE * HOT_MOST of them at the very most, HOT_MOST as a rule."""
    least = max(least, kinds.count() // HOT_MOST) // HOT_SAMPLE
    counted = kinds.where(F.pmod("eh", F.lit(HOT_SAMPLE)) == 0).groupBy("mh").agg(F.count("*").alias("kinds"))
    return counted.where(F.col("kinds") >= max(least, 1)).select("mh", F.lit(True).alias("hot"))


def _copied(found: DataFrame, least: int) -> DataFrame:
    """(t1, t2, ways) of the texts with least copies or more, HOT_MOST at most: their copies are dealt out in so many ways."""
    least = max(least, found.count() // HOT_MOST)
    copies = found.where("first = 0").groupBy("t1", "t2").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return copies.select("t1", "t2", F.ceil(F.col("n") / least).cast("int").alias("ways"))


def _meet(keyed: DataFrame, facts: DataFrame, copied: DataFrame, length: int, how: str) -> DataFrame:
    """keyed(t1, t2, text, ...) joined to facts(t1, t2, ...), one row a text at most.

    Copies of a text that has many are dealt out by the partition they are read from,
    which a task that runs again has too.  So are texts below length, which have no facts.
    """
    short = F.octet_length("text") < length
    place = F.xxhash64(F.spark_partition_id())
    ways = F.broadcast(copied)
    left = keyed.join(ways, ["t1", "t2"], "left").withColumn("way", F.when(short, -1).otherwise(F.pmod(place, F.coalesce("ways", F.lit(1)))).cast("int"))
    left = left.withColumn("t1", F.when(short, place).otherwise(F.col("t1"))).drop("ways")
    right = facts.join(ways, ["t1", "t2"], "left").withColumn("way", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1))).drop("ways")
    return left.join(right, ["t1", "t2", "way"], how).drop("way")


def repeats(docs: DataFrame, length: int = 400, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """docs(text, ...), no text null, with spans, the array<struct<a,b>> of the first and last windows of repeated strings, null where there are none."""
    keyed = docs.select(*_text_key(F.col("text")), *docs.columns)
    spans, copied = _spans(keyed.where(F.octet_length("text") >= length).select("t1", "t2", "text"), length, shard_bytes, hot)
    return _meet(keyed, spans, copied, length, "left").select(*docs.columns, "spans")


def _spans(keyed: DataFrame, length: int, shard_bytes: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(t1, t2, spans) of the texts that hold repeated strings, and the texts that have many copies."""
    found = keyed.mapInArrow(_find(length, anchor_for(length)), "t1 long, t2 int, mh long, eh long, first long, last long, mid long")
    found = materialize(found, "extents")
    at = F.struct("t1", "t2", "first", "last", "mid")
    copied = materialize(_copied(found, hot), "copied")
    kinds = materialize(found.groupBy("mh", "eh").agg(F.count("*").alias("n"), F.min(at).alias("at")), "kinds")
    marked = kinds.join(F.broadcast(_hot(kinds, hot)), "mh", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    # one deal by minimizer both counts its kinds and keeps them; a join with the count would deal twice.  Hot ones are open anyway
    same = Window.partitionBy("mh", F.when(F.col("hot"), F.col("eh")))
    open_ = marked.withColumn("kinds", F.count("*").over(same)).where("hot OR kinds > 1")
    wanted = open_.groupBy(F.col("at.t1").alias("t1"), F.col("at.t2").alias("t2")).agg(
        F.collect_list(F.struct("mh", "eh", F.col("at.first").alias("first"), F.col("at.last").alias("last"), F.col("at.mid").alias("mid"), "hot")).alias("wanted")
    )
    # copies of a text find the same bytes; one body an extent (or a piece of it) goes on
    bodies = _meet(keyed, wanted, copied, length, "inner").select("text", "wanted").mapInArrow(_cut(length), "mh long, part long, eh long, off long, mid long, body binary")
    once = bodies.groupBy("mh", "part", "eh", "off").agg(F.min("mid").alias("mid"), F.min("body").alias("body"))
    shards = once.repartition("mh", "part").sortWithinPartitions("mh", "part", "eh", "off")
    judged = shards.mapInArrow(_judge(length, shard_bytes), "mh long, eh long, spans array<struct<a:long,b:long>>")
    # an extent that stands several times is repeated as a whole
    whole = kinds.where("n > 1").select("mh", "eh", F.lit(None).cast("array<struct<a:long,b:long>>").alias("spans"))
    found_spans = materialize(judged.unionByName(whole).groupBy("mh", "eh").agg(F.max(F.col("spans").isNull()).alias("all"), F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    discard(kinds)
    hits = found.join(found_spans, ["mh", "eh"])
    windows = F.when(F.col("all"), F.array(F.struct(F.col("first").alias("a"), F.col("last").alias("b")))).otherwise(
        F.transform("spans", lambda s: F.struct((F.col("first") + s["a"]).alias("a"), (F.col("first") + s["b"]).alias("b")))
    )
    return hits.groupBy("t1", "t2").agg(F.sort_array(F.flatten(F.collect_set(windows))).alias("spans")), copied


def _apply(length: int, keep: list[str], digest: bool, min_words: int = 0):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
            size, removed, runs, out = [], [], [], []
            for text, windows in zip(texts(batch, "text"), spans):
                merged: list[list[int]] = []
                for w in windows or ():
                    if merged and w["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], w["b"] + length)
                    else:
                        merged.append([w["a"], w["b"] + length])
                if min_words:
                    merged = [m for m in merged if m[1] - m[0] >= 2 * length or len(text[m[0] : m[1]].split()) >= min_words]
                size.append(len(text))
                removed.append(sum(b - a for a, b in merged))
                runs.append(len(merged))
                edge = [0, *[x for m in merged for x in m], len(text)]
                left = b"".join([text[edge[i] : edge[i + 1]] for i in range(0, len(edge), 2)])
                # a cut inside a character leaves part of it, which no text can hold
                out.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "ignore"))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(out, pa.string())], names=[*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    return run


def removal_report(docs: DataFrame, length: int = 400, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs(doc_id, text).

    A byte goes if a length-byte string over it also starts anywhere else in the table,
    in its own text too.  Null counts as empty; a repeated row is a copy, so of texts
    of length bytes or more nothing stays.  Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return repeats(rows, length, hot=hot).mapInArrow(_apply(length, ["doc_id"], True), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = 400, min_words: int = 0) -> DataFrame:
    """docs with the repeated bytes taken out of text, other columns as they were; a null text stays null.

    With min_words a run of repeated bytes that holds fewer words stays, unless it has
    twice length bytes: passages are then told by their words, and length only has to
    be below what so many words take.
    A character of which part is cut away goes as a whole, and n_chars, where docs has
    it, is set to the new length.
    """
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)], F.coalesce("text", F.lit("")).alias("text"))
    joined = repeats(inner, length)
    keep = [f"in_{i}" for i in range(len(names))]
    schema = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in keep)
    done = joined.mapInArrow(_apply(length, keep, False, min_words), f"{schema}, n_bytes long, n_removed long, n_spans long, kept string")
    out = []
    for i, c in enumerate(names):
        old = F.col(f"in_{i}")
        if c == "text":
            old = F.when(old.isNotNull(), F.col("kept"))
        elif c == "n_chars":
            old = F.when(old.isNotNull(), F.char_length("kept")).cast(docs.schema[c].dataType)
        out.append(old.alias(c))
    return done.select(*out)
