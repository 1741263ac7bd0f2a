"""Evaluation texts leaking into training text.

Every item has windows of its own size (the largest of a few sizes that it fills) for copies of
the whole item with small edits, and windows of `window` words for passages of it.  Each window
has a SimHash of its pairs of words in a row (texts of one field share so many words that those
alone bring unlike windows close).  The fingerprints of items and documents are compared by
multi-index Hamming blocks: cut into radius + 1 blocks, two fingerprints within the radius agree
in at least one block, so no such pair is missed, and equal windows always meet.  The radius of
item-sized windows holds one changed word (at 48 words it moves 4.7 bits on average and 8 in nine
of ten cases); short windows are for passages without edits and have a narrower radius.  A
candidate is taken when the weighted similarity of the two windows' five-word shingles reaches the threshold;
the longest run of words in common and the share of the item are told with it.
"""

from __future__ import annotations

import hashlib
import unicodedata
import re
from collections import defaultdict
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.arrow import map_rows

WINDOW, SHINGLE, THRESHOLD = 12, 5, 0.8
#: Radius of windows of an item's size and of passages.
RADIUS, NEAR = 9, 3
_RUN = re.compile(r"[^\W_]+")
#: Words of documents that are fingerprinted at once.
WORDS_AT_ONCE = 16_384


def words(text: str | None) -> list[str]:
    """Runs of letters or digits, in lower case and without diacritics."""
    if not text:
        return []
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return _RUN.findall(text.lower())


class _Hashes(dict):
    """64 bits of each word of a piece of text without blanks; forgets all once it holds 400,000."""

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > 400_000:
            self.clear()
        self[piece] = h = tuple(int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in words(piece))
        return h

    def row(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, text.split()))) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pairs_of(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of words in a row; a window of n words holds n - 1 of them."""
    return _mix(_mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])


def prefix_bits(hashes: np.ndarray, longest: int) -> np.ndarray:
    """Running counts of each of the 64 bits over a row of hashes, modulo the least type whose
    range holds the longest window."""
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
    kind = np.uint8 if longest < 256 else np.uint16 if longest < 65_536 else np.uint32
    c = np.zeros((len(hashes) + 1, 64), kind)
    np.cumsum(bits, axis=0, dtype=kind, out=c[1:])
    return c


def simhashes(hashes: np.ndarray, window: int, counts: np.ndarray | None = None) -> np.ndarray:
    """Fingerprints of all windows over a row of word hashes (uint64): majority of each bit over
    the pairs of a window, or the word itself in windows of one word.  counts: `prefix_bits` of
    the pairs."""
    if len(hashes) < window:
        return np.empty(0, np.uint64)
    if window == 1:
        return hashes.copy()
    n = window - 1
    c = prefix_bits(pairs_of(hashes), n) if counts is None else counts
    up = (c[n:] - c[:-n]) > n // 2
    return np.packbits(up, axis=1, bitorder="little").view(np.uint64).ravel()


def size_of(n: int, window: int) -> int:
    """The largest size of item windows that n words fill: window x 2 ** (k / 2)."""
    size, k = window, 0
    while round(window * 2 ** ((k + 1) / 2)) <= n:
        k += 1
        size = round(window * 2 ** (k / 2))
    return min(size, n)


class Index:
    """The windows of the items: fingerprints by block, and the words to verify with."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW, radius: int = RADIUS, near: int = NEAR):
        self.window = window
        self.items: dict[int, list[str]] = {}
        h = _Hashes()
        # (size, radius) -> fingerprints, items, places
        by_size: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        for i, t in items:
            w = words(t)
            if not w:
                continue
            self.items[i] = w
            row = np.array(h.row(t), np.uint64)
            short, whole = min(window, len(w)), size_of(len(w), window)
            fp = simhashes(row, short)
            by_size[short, near].append((fp, np.full(len(fp), i, np.int64), np.arange(len(fp))))
            if whole > short:
                # The first and the last window of that size hold all words of the item.
                at = np.unique([0, len(w) - whole])
                by_size[whole, radius].append((simhashes(row, whole)[at], np.full(len(at), i, np.int64), at))
        df: dict[tuple, int] = defaultdict(int)
        for w in self.items.values():
            for s in set(self._shingles(w)):
                df[s] += 1
        # A shingle that many items share says little: its weight is the logarithm of its rarity.
        n = len(self.items) + 1
        self.weight = {s: float(np.log(1 + n / k)) for s, k in df.items()}
        self.rare = float(np.log(1 + n))
        self.total = {i: sum(self.weight[s] for s in set(self._shingles(w))) for i, w in self.items.items()}
        self.tables, self.places = [], []
        for (size, r), parts in sorted(by_size.items()):
            fp, owner, place = (np.concatenate([p[c] for p in parts]) for c in range(3))
            cuts = [64 * k // (r + 1) for k in range(r + 2)]
            blocks = []
            for a, b in zip(cuts, cuts[1:]):
                key = (fp >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
                order = np.argsort(key, kind="stable")
                blocks.append((a, b, key[order], order))
            self.tables.append((size, fp, owner, blocks))
            self.places.append(place)
        self.longest = max((t[0] for t in self.tables), default=1)

    @staticmethod
    def _shingles(w: list[str]) -> list[tuple]:
        k = min(SHINGLE, len(w))
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]

    def candidates(self, hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, item, size, place in the document, place in the item, distance) of windows
        within the radius, nearest first.  hashes: the words of documents in a row, ends: where
        each document ends."""
        out = []
        counts = prefix_bits(pairs_of(hashes), self.longest) if len(hashes) > 1 else None
        owner_of = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
        for (size, fp, owner, blocks), place in zip(self.tables, self.places):
            doc = simhashes(hashes, size, counts)
            start = np.flatnonzero(owner_of[: len(doc)] == owner_of[size - 1 : size - 1 + len(doc)])
            doc = doc[start]
            if not len(doc):
                continue
            for a, b, keys, order in blocks:
                key = (doc >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
                if b - a <= 16:
                    # A table of where each key begins replaces the search in the sorted keys.
                    at = np.searchsorted(keys, np.arange((1 << (b - a)) + 1, dtype=np.uint64))
                    lo, hi = at[key], at[key + np.uint64(1)]
                else:
                    lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                n = hi - lo
                hit = np.flatnonzero(n)
                if not len(hit):
                    continue
                n, lo = n[hit], lo[hit]
                left = np.repeat(hit, n)
                right = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
                far = np.bitwise_count(doc[left] ^ fp[right])
                good = far < len(blocks)
                if good.any():
                    left, right = left[good], right[good]
                    out.append((owner_of[start[left]], owner[right], np.full(len(left), size), start[left], place[right], far[good]))
        if not out:
            return tuple(np.empty(0, np.int64) for _ in range(6))
        got = [np.concatenate(c) for c in zip(*out)]
        order = np.lexsort((got[5], got[1], got[0]))
        return tuple(c[order] for c in got)

    def window_similarity(self, doc: list[str], at: int, item: int, place: int, size: int) -> float:
        """Weighted similarity of the five-word shingles of two windows."""
        x, y = doc[at : at + size], self.items[item][place : place + size]
        if x == y:
            return 1.0
        x, y = set(self._shingles(x)), set(self._shingles(y))
        both = sum(self.weight[s] for s in x & y)
        return both / sum(self.weight.get(s, self.rare) for s in x | y)

    def verify(self, doc: list[str], item: int) -> tuple[int, float]:
        """(longest common run in words, weighted share of the item's shingles in the document)."""
        w = self.items[item]
        at: dict[str, list[int]] = defaultdict(list)
        for j, x in enumerate(w):
            at[x].append(j)
        best, row = 0, {}
        for x in doc:
            new = {}
            for j in at.get(x, ()):
                n = row.get(j - 1, 0) + 1
                new[j] = n
                if n > best:
                    best = n
            row = new
        own = set(self._shingles(w))
        k = min(SHINGLE, len(w))
        have = {tuple(doc[i : i + k]) for i in range(len(doc) - k + 1)} & own
        return best, sum(self.weight[s] for s in have) / self.total[item]


#: Items are held by every task; more of them than this are taken in slices, one pass each.
ITEMS_AT_ONCE = 20_000
#: A stated query set; a larger one is refused, so that the caller passes it in parts.
MOST_ITEMS = 1_000_000


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, radius: int = RADIUS, near: int = NEAR, threshold: float = THRESHOLD, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(doc_id, item_id, run, similarity, share) of documents and items with like windows.

    docs: (id, text), any size.  items: (item_id, text), a stated query set; it is taken in
    slices of `at_once`, each against all documents.  similarity is the weighted similarity of the
    best pair of windows, at least the threshold; run is the longest run of words in common, share
    the weighted share of the item's five-word shingles that the document holds.
    Null and empty texts have no words and give no rows, as do empty tables; an item shorter than
    the window is compared as a whole.  Equal texts under several ids give a row each.
    """
    sc = docs.sparkSession.sparkContext
    got: DataFrame | None = None
    todo = items.select("item_id", "text").where("item_id is not null").distinct().orderBy("item_id")
    rows = [(r.item_id, r.text) for r in todo.limit(MOST_ITEMS + 1).toLocalIterator()]
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items; pass them in parts")
    for k in range(0, max(1, len(rows)), at_once):
        part = sc.broadcast(rows[k : k + at_once])  # at most `at_once` items

        def make(part=part):
            index, h = Index(part.value, window, radius, near), _Hashes()

            def some(ids: list, texts: list, flat: list[int], ends: list[int], out: list[list]) -> None:
                doc, item, size, at, place, _ = index.candidates(np.array(flat, np.uint64), np.array(ends))
                seen: dict[int, list[str]] = {}
                best: dict[tuple[int, int], float] = {}
                for d, i, n, x, y in zip(doc.tolist(), item.tolist(), size.tolist(), at.tolist(), place.tolist()):
                    if best.get((d, i), 0.0) >= 1.0:
                        continue
                    w = seen.get(d)
                    if w is None:
                        w = seen[d] = words(texts[d])
                    sim = index.window_similarity(w, x - (ends[d - 1] if d else 0), i, y, n)
                    if sim >= threshold - 1e-12 and sim > best.get((d, i), 0.0):
                        best[d, i] = sim
                for (d, i), sim in best.items():
                    run, share = index.verify(seen[d], i)
                    for c, v in zip(out, (ids[d], i, run, sim, share)):
                        c.append(v)

            def f(ids, texts):
                out: list[list] = [[], [], [], [], []]
                flat: list[int] = []
                ends: list[int] = []
                first = 0
                for j, t in enumerate(texts):
                    flat += h.row(t)
                    ends.append(len(flat))
                    if len(flat) >= WORDS_AT_ONCE or j == len(texts) - 1:
                        some(ids[first : j + 1], texts[first : j + 1], flat, ends, out)
                        first, flat, ends = j + 1, [], []
                return out

            return f

        one = map_rows(docs, ["id", "text"], make, "doc_id long, item_id long, run int, similarity double, share double")
        got = one if got is None else got.unionByName(one)
    return got


def leaked(found: DataFrame, run: int = WINDOW) -> DataFrame:
    """The pairs that share at least `run` consecutive words."""
    return found.where(F.col("run") >= run)
