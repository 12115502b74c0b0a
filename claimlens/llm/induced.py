"""Induced suffix sorting with bucketed, disk-backed priority queues that carry common prefixes.

Suffixes are typed S or L, the leftmost S suffixes are ordered by the names of
their substrings (and names of names, by doubling), and from them all L suffixes
and then all S suffixes are induced.  The queue is a monotone priority queue: one
FIFO per first letter, whose entries (suffix, common prefix with the entry before)
leave in batches, letter by letter; a batch induces its predecessors with one
vectorised step, range minima over the common prefixes of the batch included.
Queues beyond the memory limit move to files and come back chunk by chunk.

Order and common prefixes are exact up to ``limit`` letters, which is all that a
search for repeats of that length needs.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np

#: Entries that all queues of one sort keep in memory together.
MEMORY_ENTRIES = 16 << 20
CHUNK = 1 << 18


class _Store:
    """Chunks of (suffix, common prefix) by bucket, moved to files beyond the memory limit."""

    def __init__(self, folder: Path, kind: str, room: list[int]) -> None:
        self.folder, self.kind, self.room, self.files = folder, kind, room, 0
        self.chunks: dict[int, list[np.ndarray | tuple[Path, int]]] = {}
        self.taken: dict[int, int] = {}  # chunks that have left, to which nothing is added

    def push(self, bucket: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        both = np.stack([pos.astype(np.int64), lcp.astype(np.int64)])
        held = self.chunks.setdefault(bucket, [])
        if len(held) > self.taken.get(bucket, 0) and isinstance(held[-1], np.ndarray) and held[-1].shape[1] + len(pos) <= 4096:
            held[-1] = np.concatenate([held[-1], both], axis=1)
        else:
            held.append(both)
        self.room[0] -= len(pos)
        if self.room[0] < 0:
            self._spill()

    def _spill(self) -> None:
        for held in self.chunks.values():
            for i, c in enumerate(held):
                if isinstance(c, np.ndarray) and c.shape[1] > 4096:
                    self.files += 1
                    path = self.folder / f"{self.kind}{self.files}.npy"
                    np.save(path, c)
                    self.room[0] += c.shape[1]
                    held[i] = (path, c.shape[1])

    def count(self, bucket: int) -> int:
        return len(self.chunks.get(bucket, ()))

    def chunk(self, bucket: int, i: int) -> np.ndarray:
        self.taken[bucket] = max(i + 1, self.taken.get(bucket, 0))
        c = self.chunks[bucket][i]
        return c if isinstance(c, np.ndarray) else np.load(c[0])


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo : hi + 1]) of each pair, lo <= hi, by a sparse table."""
    out = np.empty(len(lo), values.dtype)
    if not len(lo):
        return out
    span = hi - lo + 1
    level = np.frexp(span)[1] - 1
    table, k = values, 0
    while True:
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k) + 1])
        if (level <= k).all():
            return out
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
        k += 1


class _Inducer:
    """One direction's step from a batch of scanned suffixes to the predecessors of the wanted type."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, letters: int, out: _Store, limit: int) -> None:
        self.text, self.wanted, self.out, self.limit = text, wanted, out, limit
        self.least = np.full(letters, -1, np.int64)  # common prefix of all scanned since a bucket's last entry; -1: none yet

    def scan(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if not len(pos):
            return
        before = pos - 1
        at = np.flatnonzero((pos > 0) & self.wanted[before])
        bucket = self.text[before[at]]
        by = np.argsort(bucket, kind="stable")
        at, bucket = at[by], bucket[by]
        if len(at):
            new = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            least = np.empty(len(at), np.int64)
            old = np.flatnonzero(~new)
            least[old] = _range_min(lcp, at[old - 1] + 1, at[old])
            head = np.flatnonzero(new)
            least[head] = np.minimum(self.least[bucket[head]], np.minimum.accumulate(lcp)[at[head]])
            shared = np.where(least < 0, 0, np.minimum(least + 1, self.limit))
            ends = np.append(head[1:], len(at))
            for a, b in zip(head.tolist(), ends.tolist()):
                self.out.push(int(bucket[a]), before[at[a:b]], shared[a:b])
        self.least = np.where(self.least >= 0, np.minimum(self.least, lcp.min()), -1)
        if len(at):
            tail = np.minimum.accumulate(lcp[::-1])[::-1]
            last = at[ends - 1] + 1
            self.least[bucket[head]] = np.where(last < len(lcp), tail[np.minimum(last, len(lcp) - 1)], self.limit + 1)


def _order_names(name: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of all suffixes of name by their first depth names at least, and the ranks of each doubling."""
    n = len(name)
    order = np.argsort(name, kind="stable")
    srt = name[order]
    new = np.concatenate([[True], srt[1:] != srt[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank], 1
    while step < depth:
        srt = rank[order]
        same = srt[1:] == srt[:-1]
        tied = np.zeros(n, bool)
        tied[1:] |= same
        tied[:-1] |= same
        open_ = np.flatnonzero(tied)
        if not len(open_):
            break
        suf = order[open_]
        tail = np.where(suf + step < n, rank[np.minimum(suf + step, n - 1)] + 1, 0)
        by = np.lexsort((tail, rank[suf]))
        order, rank_now = order.copy(), rank[suf][by]
        order[open_] = suf[by]
        rest = tail[by]
        new = np.concatenate([[True], (rank_now[1:] != rank_now[:-1]) | (rest[1:] != rest[:-1])])
        rank = rank.copy()
        rank[order[open_]] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        levels.append(rank)
        step *= 2
    return order, levels


def sort(text: np.ndarray, letters: int, limit: int, memory: int = MEMORY_ENTRIES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of text in descending order, in batches, each with its common prefix with the one before in that order.

    text: numbers below letters; its last is 0 and the only 0.  Common prefixes above
    limit are given as limit.
    """
    n = len(text)
    text = text.astype(np.int64)
    edge = np.flatnonzero(text[1:] != text[:-1])  # last places of runs, but for the last run
    run = np.diff(np.concatenate([[-1], edge, [n - 1]]))
    rises = np.concatenate([text[edge + 1] > text[edge], [True]])
    small = np.repeat(rises, run)  # type S
    run_left = np.minimum(np.repeat(np.cumsum(run), run) - np.arange(n), limit)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    # names of the substrings from one LMS place to the next; the closing mark puts a prefix last, whose end is S where the longer one's letter is L
    raw = text.astype(">u2").tobytes()
    ends = np.append(lms[1:], n - 1)
    subs = [raw[2 * a : 2 * b + 2] + b"\xff\xff" for a, b in zip(lms.tolist(), ends.tolist())]
    number = {s: i for i, s in enumerate(sorted(set(subs)))}
    name = np.fromiter((number[s] for s in subs), np.int64, len(subs))
    del subs, number, raw
    order, levels = _order_names(name, limit)
    # common prefixes of neighbours: whole names, then letters
    a, b = order[1:], order[:-1]
    k = np.zeros(len(a), np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    for j in range(len(levels) - 1, -1, -1):
        x, y = a[live] + k[live], b[live] + k[live]
        ok = (x < len(name)) & (y < len(name))
        ok[ok] = levels[j][x[ok]] == levels[j][y[ok]]
        k[live[ok]] += 1 << j
    end = len(name) - 1
    x, y = lms[np.minimum(a + k, end)], lms[np.minimum(b + k, end)]
    shared = x - lms[a]
    live = np.flatnonzero(shared < limit)
    while len(live):
        go = text[x[live]] == text[y[live]]
        go &= (x[live] < n - 1) & (y[live] < n - 1)
        live = live[go]
        x[live] += 1
        y[live] += 1
        shared[live] += 1
        live = live[shared[live] < limit]
    lms, lms_lcp = lms[order], np.concatenate([[0], np.minimum(shared, limit)])
    first_letter = text[lms]
    starts = np.searchsorted(first_letter, np.arange(letters + 1))
    with tempfile.TemporaryDirectory(prefix="claimlens-sort-") as folder:
        room = [memory]
        large, less = _Store(Path(folder), "l", room), _Store(Path(folder), "s", room)
        step = _Inducer(text, ~small, letters, large, limit)
        last_large = np.full(letters, -1)
        for c in range(letters):
            i = 0
            while i < large.count(c):  # the bucket grows by what its own entries induce
                pos, lcp = large.chunk(c, i)
                i += 1
                step.scan(pos, lcp)
                last_large[c] = pos[-1]
            for s in range(starts[c], starts[c + 1], CHUNK):
                pos = lms[s : min(s + CHUNK, starts[c + 1])]
                lcp = lms_lcp[s : s + len(pos)].copy()
                if s == starts[c]:
                    lcp[0] = min(run_left[last_large[c]], run_left[pos[0]]) if last_large[c] >= 0 else 0
                step.scan(pos, lcp)
        step = _Inducer(text, small, letters, less, limit)
        less.push(0, np.array([n - 1]), np.array([0]))
        for c in range(letters - 1, -1, -1):
            i, least = 0, -1
            while i < less.count(c):
                pos, lcp = less.chunk(c, i)
                i += 1
                step.scan(pos, lcp)
                yield pos, lcp
                least = pos[-1]
            above = 0 if least < 0 else int(min(run_left[least], run_left[last_large[c]])) if last_large[c] >= 0 else 0
            for i in range(large.count(c) - 1, -1, -1):
                pos, up = large.chunk(c, i)
                lcp = np.concatenate([up[1:], [above]])[::-1]
                above = int(up[0])
                step.scan(pos[::-1], lcp)
                yield pos[::-1], lcp
