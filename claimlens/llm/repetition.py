"""Quality rule on repetition inside a text, by word-level suffix arrays.

All texts of a slice are sorted together (a suffix of one text never equals one
of another, since ranks start from the pair of text and word) by prefix
doubling, which goes on only for suffixes that are not yet alone.  The ranks of
all doublings give the common prefix of neighbours; a suffix's longest repeat is
the larger of both, that is the value of its deepest LCP interval.  Spans of
intervals that are long enough are unioned into the covered share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, slices, texts

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
#: What word_chars leaves out: white space and the bytes of UTF-8 that start no code point.
_NOT_CHARS = SPACE + bytes(range(0x80, 0xC0))


def longest_repeats(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each place of words, the words from there on that stand elsewhere in the same text too.

    words: numbers that are equal for equal words; owner: the text of each, ascending.
    """
    n = len(words)
    if n < 2:
        return np.zeros(n, np.int64)
    key = owner.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    rank = _ranks(key[order], order, n)
    levels = [rank]
    text_end = np.searchsorted(owner, owner, side="right")  # one past the text of each place
    step = 1
    while True:
        # only those that share their rank are told apart further
        alone = np.ones(n, bool)
        srt = rank[order]
        same = srt[1:] == srt[:-1]
        alone[order[1:][same]] = False
        alone[order[:-1][same]] = False
        if alone.all():
            break
        open_ = np.flatnonzero(~alone[order])  # places in the order
        suf = order[open_]
        nxt = suf + step
        tail = np.where(nxt < text_end[suf], rank[np.minimum(nxt, n - 1)] + 1, 0)
        by = np.lexsort((tail, rank[suf]))
        order = order.copy()
        order[open_] = suf[by]
        head, rest = rank[suf[by]], tail[by]
        new = np.concatenate([[True], (head[1:] != head[:-1]) | (rest[1:] != rest[:-1])])
        # a group's rank is the place of its first in the order
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        rank = rank.copy()
        rank[order[open_]] = open_[first]
        levels.append(rank)
        step *= 2
    a, b = order[:-1], order[1:]
    lcp = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    for k in range(len(levels) - 1, -1, -1):
        x, y = a[live] + lcp[live], b[live] + lcp[live]
        inside = (x < text_end[a[live]]) & (y < text_end[b[live]])
        level = levels[k]
        hit = inside & (level[np.minimum(x, n - 1)] == level[np.minimum(y, n - 1)])
        lcp[live[hit]] += 1 << k
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a[live], lcp[live])
    np.maximum.at(out, b[live], lcp[live])
    return out


def _ranks(sorted_key: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return rank


def _covered(start: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span start[i] .. start[i] + size[i]."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, start, 1)
    np.add.at(delta, start + size, -1)
    return np.cumsum(delta[:-1]) > 0


def repetition_rules(
    docs: DataFrame,
    min_words: int = 20,
    window: int = 8,
    max_window_percent: int = 30,
    min_repeat: int = 12,
    max_covered: float = 0.2,
    max_longest: int = 60,
) -> DataFrame:
    """One row per row of docs(doc_id, text): counts, the base rule, and the verdict.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words are counts over
    the whole text; base_failed is n_words < min_words or more than max_window_percent
    of the words in a window-word string that stands twice.  Repeats of min_repeat
    words or more count for the method: covered_fraction of the words lie in one, and
    longest_repeat is the longest in words.  kept: the base holds, covered_fraction is
    at most max_covered and longest_repeat at most max_longest.  A null or empty text
    has no words, hence fails the base.  Repeated rows and null ids stay.
    """
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_fraction double, longest_repeat long, kept boolean"
    names = [c.split(" ")[0] for c in schema.split(", ")]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            docs = texts(batch, "text")
            number: dict[bytes, int] = {}
            ids: list[int] = []
            count, chars, signs, lines = [], [], [], []
            for t in docs:
                words = t.split()
                count.append(len(words))
                ids += [number.setdefault(w, len(number)) for w in words]
                chars.append(len(t.translate(None, _NOT_CHARS)))
                signs.append(len(t) - len(t.translate(None, SYMBOLS)))
                full = [x for x in t.split(b"\n") if x.strip()] if b"\n" in t else []
                lines.append(len(full) - len(set(full)))
            n = np.array(count, np.int64)
            owner = np.repeat(np.arange(len(docs)), n)
            repeat = longest_repeats(np.array(ids, np.int64), owner)
            total = len(ids)

            def words_in(least: int, size: np.ndarray) -> np.ndarray:
                at = np.flatnonzero(repeat >= least)
                return np.bincount(owner[_covered(at, size[at], total)], minlength=len(docs)) if total else np.zeros(len(docs), np.int64)

            in_window = words_in(window, np.full(total, window))
            in_repeat = words_in(min_repeat, repeat)
            longest = np.zeros(len(docs), np.int64)
            np.maximum.at(longest, owner, repeat)
            failed = (n < min_words) | (100 * in_window > max_window_percent * n)
            share = in_repeat / np.maximum(n, 1)
            kept = ~failed & (share <= max_covered) & (longest <= max_longest)
            columns = [batch.column(0), n, np.array(chars, np.int64), np.array(signs, np.int64), np.array(lines, np.int64), in_window.astype(np.int64), failed, share, longest, kept]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)
