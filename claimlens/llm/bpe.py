"""BPE encoding and decoding by speculation and verification.

A word is first cut greedily into the longest vocabulary entries.  A cut into
tokens is the BPE result exactly when every adjacent pair is what BPE makes of
the pair's own text, so all adjacent pairs of a batch are tested at once, with
vectorised steps over the merge tree; only words with a failing pair (or a
token that BPE itself never makes) are merged in rank order.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import lean, slices, texts

#: Words whose encoding a worker keeps; beyond it the memory is emptied and filled anew.
CACHE_WORDS = 250_000


_IS_SPACE, _IS_LETTER, _IS_NUMBER = (regex.compile(p).match for p in (r"\s", r"\p{L}", r"\p{N}"))


def _byte_letters() -> list[str]:
    """The printable letter that byte-level BPE writes for each byte: itself where printable, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """A word-end BPE file of the tokenizers library: lower case, white space dropped.

    The file's added tokens are found in the raw text first, as the library does;
    the text between them is NFC-normalised, lower-cased and cut by the file's pattern.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_at = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        spelled = [t.encode() + b" " for t in self.names]
        self.name_bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.name_size = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.name_at = np.cumsum(self.name_size) - self.name_size
        self.kind = np.array([_SPACE_KIND if _IS_SPACE(c) else _LETTER if _IS_LETTER(c) else _DIGIT if _IS_NUMBER(c) else _OTHER for c in map(chr, range(0x250))], np.uint8)
        self.letters = _byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        n = len(self.names)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        # the order of tokens by the merge that makes them; letters come before all merges
        self.order = np.zeros(n, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        for r, (a, b) in enumerate(merges):
            made = self.vocab[a + b]
            x, y = self.vocab[a], self.vocab[b]
            self.rank.setdefault((x, y), (r, made))
            if self.left[made] == made:
                self.left[made], self.right[made], self.order[made] = x, y, r + 1
        pairs = np.array([[x * n + y, r + 1, made] for (x, y), (r, made) in self.rank.items()], np.int64)
        self.pair_key, self.pair_rank, self.pair_made = np.ascontiguousarray(pairs[np.argsort(pairs[:, 0])].T)
        self.n = n
        #: tokens that BPE makes of their own text; no other can stand in a result
        self.sound = np.ones(n, bool)
        for t, i in self.vocab.items():
            if self.left[i] != i:
                body = t[: -len(self.end)] if self.end and t.endswith(self.end) else t
                self.sound[i] = self._merge(self._symbols(body, t != body)) == [i]
        self._grow_trie()
        self._forget()

    def _symbols(self, body: str, ends: bool) -> list[int]:
        return [self.vocab[c] for c in body[:-1]] + [self.vocab[body[-1] + (self.end if ends else "")]]

    def _merge(self, ids: list[int]) -> list[int]:
        """Exact merging in rank order, leftmost first, with a heap over a linked list."""
        n = len(ids)
        ids = list(ids)
        nxt, prv = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(*self.rank[p], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.rank]
        heap = [(r, i, made, a, b) for r, made, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for k in (prv[i], i):
                if k >= 0 and nxt[k] >= 0 and (p := (ids[k], ids[nxt[k]])) in self.rank:
                    r, new = self.rank[p]
                    heapq.heappush(heap, (r, k, new, *p))
        return [x for x in ids if x >= 0]

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves a and b apart when their texts meet.

        BPE builds both tokens at once; it would join a right flank of a with a left
        flank of b if that merge came before the merges that swallow the flanks.  The
        walk undoes the later of both flanks' merges until no merge can cross.
        """
        ok = np.ones(len(a), bool)
        idx = np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        a, b = a.copy(), b.copy()
        while len(idx):
            key = a * self.n + b
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            crosses = (self.pair_key[at] == key) & (2 * self.pair_rank[at] < limit)
            ok[idx[crosses]] = False
            oa, ob = self.order[a], self.order[b]
            # a tie is broken by place: a merge inside a lies further left than the one that crosses, one inside b further right
            in_a = oa > ob
            done = crosses | ((oa == 0) & (ob == 0))
            limit = np.where(in_a, 2 * oa, 2 * ob + 1)
            a, b = np.where(in_a, self.right[a], a), np.where(in_a, b, self.left[b])
            go = ~done
            idx, a, b, limit = idx[go], a[go], b[go], limit[go]
        return ok

    def _grow_trie(self) -> None:
        """The entries' letters as a trie: sorted keys (state, letter), the state that follows, and each state's entry (-1: none).

        Letters are bytes; a word's end is the 256th letter.
        """
        byte = {c: b for b, c in enumerate(self.letters)}
        state = {b"": 0}
        edges: dict[int, int] = {}
        entry = [-1]
        for t, i in self.vocab.items():
            ends = bool(self.end) and t.endswith(self.end) and t != self.end
            at = 0
            for x in [byte[c] for c in (t[: -len(self.end)] if ends else t)] + [256] * ends:
                key = at * 257 + x
                at = edges.setdefault(key, len(entry))
                if at == len(entry):
                    entry.append(-1)
            entry[at] = i
        self.trie_key = np.array(sorted(edges), np.int64)
        self.trie_to = np.array([edges[k] for k in self.trie_key.tolist()], np.int64)
        self.trie_entry = np.array(entry, np.int64)

    def _propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once: tokens, and the word of each, in order."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        letter = np.full(int(size.sum()), 256, np.int64)
        stop = np.cumsum(size)
        inside = np.ones(len(letter), bool)
        inside[stop - 1] = False
        letter[inside] = np.frombuffer(b"".join(words), np.uint8)
        owner = np.repeat(np.arange(len(words)), size)
        at = np.flatnonzero(inside)  # a token starts at a letter
        best, reach = np.full(len(letter), -1), np.zeros(len(letter), np.int64)
        state, here, depth = np.zeros(len(at), np.int64), at, 0
        while len(here):
            key = state * 257 + letter[here + depth]
            k = np.minimum(np.searchsorted(self.trie_key, key), len(self.trie_key) - 1)
            go = self.trie_key[k] == key
            here, state, depth = here[go], self.trie_to[k[go]], depth + 1
            got = self.trie_entry[state]
            # a last letter must take the word's end along, or the end would be left over
            lone = letter[np.minimum(here + depth, len(letter) - 1)] == 256
            fine = (got >= 0) & ~(lone & (depth > 0) & (letter[here + depth - 1] != 256))
            best[here[fine]], reach[here[fine]] = got[fine], depth
            more = owner[np.minimum(here + depth, len(letter) - 1)] == owner[here]
            more &= here + depth < len(letter)
            here, state = here[more], state[more]
        tokens, of, order = [], [], []
        now, step = stop - size, 0
        while len(now):
            tokens.append(best[now])
            of.append(owner[now])
            order.append(np.full(len(now), step))
            then = now + reach[now]
            now = then[then < stop[owner[now]]]
            step += 1
        word = np.concatenate(of)
        by = np.lexsort((np.concatenate(order), word))
        return np.concatenate(tokens)[by], word[by]

    def _merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words, one rank a round in each: all places of a word's first merge, left before right.

        Returns tokens and the word of each, in order.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        parts = [(np.array(m, np.int64), np.full(len(m), i)) for i in np.flatnonzero(size > 64).tolist() for m in [self._merge(self._symbols("".join([self.letters[b] for b in words[i]]), True))]]
        live = np.flatnonzero(size <= 64)
        size = size[live]
        plain = np.array([self.vocab[c] for c in self.letters])
        closing = np.array([self.vocab[c + self.end] for c in self.letters])
        byte = np.frombuffer(b"".join([words[i] for i in live.tolist()]), np.uint8)
        ids = plain[byte]
        last = np.cumsum(size) - 1
        ids[last] = closing[byte[last]]
        owner = np.repeat(live, size)
        none = np.iinfo(np.int64).max
        while len(ids):
            start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            rank = np.full(len(ids), none)
            key = ids[:-1] * self.n + ids[1:]
            k = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            hit = (self.pair_key[k] == key) & (owner[1:] == owner[:-1])
            rank[:-1][hit] = self.pair_rank[k[hit]]
            first = np.minimum.reduceat(rank, start)
            size = np.diff(np.concatenate([start, [len(ids)]]))
            least = np.repeat(first, size)
            over = least == none
            if over.any():
                parts.append((ids[over], owner[over]))
            take = (rank == least) & ~over
            spot = np.flatnonzero(take)
            # in a run of places that overlap, every other one
            new = np.concatenate([[True], np.diff(spot) > 1]) if len(spot) else np.empty(0, bool)
            begin = np.maximum.accumulate(np.where(new, np.arange(len(spot)), 0)) if len(spot) else spot
            spot = spot[(np.arange(len(spot)) - begin) % 2 == 0]
            ids[spot] = self.pair_made[k[spot]]
            keep = ~over
            keep[spot + 1] = False
            ids, owner = ids[keep], owner[keep]
        ids, owner = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))
        by = np.argsort(owner, kind="stable")
        return ids[by], owner[by]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words, and how many each has."""
        spelled = [w.encode() for w in words]
        flat, owner = self._propose(spelled)
        bad = np.zeros(len(words), bool)
        bad[owner[~self.sound[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, where = np.unique(flat[inner] * self.n + flat[inner + 1], return_inverse=True)
        fits = self._compatible(pairs // self.n, pairs % self.n)
        bad[owner[inner[~fits[where]]]] = True
        wrong = np.flatnonzero(bad)
        merged, of = self._merge_all([spelled[i] for i in wrong.tolist()])
        good = ~bad[owner]
        flat, owner = np.concatenate([flat[good], merged]), np.concatenate([owner[good], wrong[of]])
        by = np.argsort(owner, kind="stable")
        return flat[by], np.bincount(owner, minlength=len(words))

    def _forget(self) -> None:
        """An empty memory: words by hash, and their tokens and spellings end to end."""
        self.known, self.row = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.tokens, self.spelling = _Rows(np.int32), _Rows(np.uint8)

    def _rows(self, hashes: np.ndarray, word: Callable[[int], str]) -> np.ndarray:
        """The memory's row of each word; word(i) spells the i-th."""
        new_hash, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(new_hash) > CACHE_WORDS:
            self._forget()
        at = np.searchsorted(self.known, new_hash)
        have = np.zeros(len(new_hash), bool)
        inside = at < len(self.known)
        have[inside] = self.known[at[inside]] == new_hash[inside]
        row = np.empty(len(new_hash), np.int64)
        row[have] = self.row[at[have]]
        lack = np.flatnonzero(~have)
        if len(lack):
            row[lack] = len(self.tokens) + np.arange(len(lack))
            words = [word(i) for i in first[lack].tolist()]
            special = [i for i, w in enumerate(words) if w in self.added]
            flat, count = self._encode_words(["a" if w in self.added else w for w in words])
            for i in special:
                flat[count[:i].sum()] = self.added[words[i]]
            self.tokens.add(flat, count)
            named = self.name_size[flat]
            self.spelling.add(_gather(self.name_bytes, self.name_at[flat], named), np.add.reduceat(named, np.cumsum(count) - count))
            self.known, self.row = np.insert(self.known, at[lack], new_hash[lack]), np.insert(self.row, at[lack], row[lack])
        return row[back]

    def encode(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts end to end: the ids, and how many each text has; the bytes of the decoded texts, and how many each has.

        A text is decoded to its tokens joined by spaces, special ones kept; each
        spelling here ends with that space, so the last byte of a text is not its own.
        """
        plain, pieces, owner = [], [], []
        for i, t in enumerate(docs):
            if self.added_at is not None and "<|" in t or not _simple(t := normalize(t)):
                mine = self._pieces(docs[i])
                pieces += mine
                owner.append(np.full(len(mine), i))
                t = ""
            plain.append(t)
        big = "\n".join(plain)
        point = np.frombuffer(big.encode("utf-32-le"), "<u4")
        kind = self.kind[point] if len(point) else np.empty(0, np.uint8)
        # a piece starts where the kind changes, and at each digit
        edge = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) + 1
        start = np.concatenate([[0], edge]) if len(point) else np.empty(0, np.int64)
        end = np.concatenate([edge, [len(point)]]) if len(point) else start
        full = kind[start] != _SPACE_KIND if len(point) else np.empty(0, bool)
        start, size = start[full], (end - start)[full]
        text_at = np.cumsum(np.fromiter((len(t) + 1 for t in plain), np.int64, len(plain)))
        of = np.searchsorted(text_at, start, side="right")
        if pieces:
            odd = "".join(pieces)
            odd_size = np.fromiter(map(len, pieces), np.int64, len(pieces))
            start = np.concatenate([start, len(point) + np.cumsum(odd_size) - odd_size])
            point = np.concatenate([point, np.frombuffer(odd.encode("utf-32-le"), "<u4")])
            size, of, big = np.concatenate([size, odd_size]), np.concatenate([of, *owner]), big + odd
            by = np.argsort(of, kind="stable")
            start, size, of = start[by], size[by], of[by]
        n = len(docs)
        if not len(start):
            zero = np.zeros(n, np.int64)
            return np.empty(0, np.int32), zero, np.empty(0, np.uint8), zero
        row = self._rows(_hash(point, start, size), lambda i: big[start[i] : start[i] + size[i]])
        ids, id_count = self.tokens.take(row)
        spoken, spoken_count = self.spelling.take(row)
        count = lambda per: np.bincount(of, weights=per, minlength=n).astype(np.int64)
        return ids, count(id_count), spoken, count(spoken_count)

    def encode_decode(self, docs: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each text the ids as little-endian 32-bit integers, and the decoded text in UTF-8."""
        ids, n, spoken, m = self.encode(docs)
        ids = ids.astype("<u4")
        a, b = np.cumsum(n), np.cumsum(m)
        return [(ids[x - k : x].tobytes(), spoken[y - j : y - 1].tobytes() if j else b"") for x, k, y, j in zip(a.tolist(), n.tolist(), b.tolist(), m.tolist())]

    def _pieces(self, text: str) -> list[str]:
        """The general cut: added tokens first, then the file's pattern between them."""
        if self.added_at is None or "<|" not in text:
            return self._words(text)
        out: list[str] = []
        for k, part in enumerate(self.added_at.split(text)):
            out += [part] if k % 2 else self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if not text.isascii() and max(text) > "\u024f" and any(unicodedata.category(c) == "Cn" for c in set(text)):
            # letters newer than this Python's tables: only the library knows which it takes for letters
            lib = _library(self.path)
            plain = lib.normalizer.normalize_str(text)
            return [plain[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(plain)]
        return self.word.findall(normalize(text))


class _Rows:
    """Rows of numbers end to end, which grow."""

    def __init__(self, kind: type) -> None:
        self.flat, self.at, self.size, self.used = np.empty(1 << 16, kind), np.empty(0, np.int64), np.empty(0, np.int64), 0

    def __len__(self) -> int:
        return len(self.at)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.at = np.concatenate([self.at, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used += len(flat)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[rows]
        return _gather(self.flat, self.at[rows], size), size


def _gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[at[i] : at[i] + size[i]] for all i, end to end."""
    end = np.cumsum(size)
    return flat[np.repeat(at - (end - size), size) + np.arange(end[-1] if len(end) else 0)]


_ODD = np.random.default_rng(7)
_weights = _ODD.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _hash(point: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit multilinear hash of point[start : start + size], by random weights of the places."""
    global _weights
    if len(start) and (most := int(size.max())) > len(_weights):
        _weights = np.concatenate([_weights, _ODD.integers(1, 1 << 63, 2 * most, dtype=np.uint64) | np.uint64(1)])
    end = np.cumsum(size)
    place = np.arange(end[-1]) - np.repeat(end - size, size)
    terms = (point[np.repeat(start, size) + place].astype(np.uint64) + np.uint64(1)) * _weights[place]
    h = np.add.reduceat(terms, end - size) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


_SPACE_KIND, _LETTER, _DIGIT, _OTHER = range(4)
#: Beyond the letters that _simple lets through, and the contractions that the pattern takes whole.
_NOT_SIMPLE = re.compile("[^\x00-\u024f]|'(?:[stmd]|re|ve|ll)").search


def _simple(text: str) -> bool:
    """Whether a change of kind (letter, digit, space, other) is all that cuts the text."""
    return not _NOT_SIMPLE(text)


def normalize(text: str) -> str:
    """NFC and lower case letter by letter, without the final-sigma rule of str.lower()."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


@lru_cache
def _library(path: str):
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


_loaded: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    """The tokenizer at path, once a process."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def _file(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json")
    return path


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs(doc_id, text).

    path: a word-end BPE file that each worker can open; by default the installed
    49k one.  Null and empty texts have no token and the digests of nothing.
    Repeated rows and null ids stay; other columns are ignored.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(_file(path))
        sha = hashlib.sha256
        for batch in slices(batches, "text", 2 << 20):
            ids, n, spoken, m = tok.encode([t.decode("utf-8", "replace") for t in texts(batch, "text")])
            ids = memoryview(ids.astype("<u4").tobytes())
            spoken = memoryview(spoken.tobytes())
            a, b = (4 * np.cumsum(n)).tolist(), np.cumsum(m).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array([sha(ids[x - 4 * k : x]).hexdigest() for x, k in zip(a, n.tolist())], pa.string()), pa.array([sha(spoken[y - j : y - (j > 0)]).hexdigest() for y, j in zip(b, m.tolist())], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) with ids array<int> and the decoded text, for use of the tokens themselves."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(_file(path))
        for batch in slices(batches, "text", 2 << 20):
            got = tok.encode_decode([t.decode("utf-8", "replace") for t in texts(batch, "text")])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x, _ in got], pa.list_(pa.int32())), pa.array([y.decode() for _, y in got], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
