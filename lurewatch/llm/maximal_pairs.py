"""Runs (maximal periodic stretches of words) by maximal pairs.

A run is a stretch of words with smallest period q, at least ``min_length`` words and ``min_exponent`` periods long, that
no neighbouring word extends with that period.  The run that starts at s and has L words is the maximal pair (s, s + q):
the words from s and those from s + q agree on exactly L - q words, and the words to their left differ (or s is the text's
first word).  The other way round, a maximal pair of distance d and common length l with l + d >= max(min_length,
min_exponent * d) *is* a stretch of period d that cannot be extended; where d is a multiple of the smallest period q, the
pair (s, s + q) spans the same words, so the least distance of each stretch is its period.  Nothing is extended word by word.

Per text: a suffix array over word numbers (prefix doubling, in numpy, many texts at a time), the common lengths of
neighbours in it, and the LCP-interval tree bottom-up.  An interval of common length l holds its positions sorted, once
altogether and once per left word.  Joining two children, each position of the smaller one asks the larger one for
positions at most l // (min_exponent - 1) words away whose left word differs: the counts in the whole list and in the
list of its own left word tell where there are any, so what is not found costs logarithmic time, and within a text the
pairs that are found are at most linear in its words.  Intervals with common length below ``min_length`` less the longest
period that needs it cannot hold a run and are not built; texts in which no such word sequence occurs twice end there.

The work is one scan without a shuffle; a task holds the words of one chunk of texts (or of one long text).

Edge cases: null, empty and blank texts have no words and no runs; repeated rows give equal rows; a null doc_id stays
null; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lurewatch.llm.common import id_text, mix

MIN_LENGTH, MIN_EXPONENT, CHUNK_WORDS = 6, 4, 200_000
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_C = np.uint64(0x9E3779B97F4A7C15)


def least_common(min_length: int, min_exponent: int) -> int:
    """The least common length of a pair that is a run: over all periods d, max(min_length, min_exponent * d) - d."""
    return min(max(min_length, min_exponent * d) - d for d in range(1, min_length + 1))


class Positions:
    """Sorted positions of an LCP interval, together and by left word."""

    __slots__ = ("all", "by_left")

    def __init__(self, at: int, left: int):
        self.all, self.by_left = [at], {left: [at]}

    def differing(self, at: int, left: int, reach: int) -> list[int]:
        """Positions within ``reach`` of ``at`` whose left word is another."""
        whole, own = self.all, self.by_left.get(left, ())
        i, j = bisect_left(whole, at - reach), bisect_right(whole, at + reach)
        if i == j:
            return []
        found, todo = [], [(i, j, bisect_left(own, at - reach), bisect_right(own, at + reach))]
        while todo:
            i, j, a, b = todo.pop()
            if a == b:
                found += whole[i:j]
            elif j - i > b - a:  # some in this stretch have another left word
                mid = (i + j) // 2
                cut = bisect_left(own, whole[mid], a, b)
                todo += [(i, mid, a, cut), (mid, j, cut, b)]
        return found

    def take(self, other: Positions) -> None:
        for mine, more in [(self.all, other.all), *((self.by_left.setdefault(k, []), v) for k, v in other.by_left.items())]:
            if len(more) * 16 < len(mine):
                for at in more:
                    insort(mine, at)
            else:
                mine += more
                mine.sort()


def maximal_pairs(places: list[int], common: list[int], left: list[int], reach: Callable[[int], int]) -> Iterator[tuple[int, int, int]]:
    """``(first, distance, common length)`` of the maximal pairs with a distance of at most ``reach(common length)``.

    ``places`` are positions in suffix order, ``common[i]`` is the common length of places i and i + 1, ``left`` the word
    before each place.
    """
    stack: list[list] = []  # open intervals: common length, positions of their finished children
    done = Positions(places[0], left[0])

    def joined(a: Positions, b: Positions, l: int) -> Positions:
        small, large = (a, b) if len(a.all) < len(b.all) else (b, a)
        for word, some in small.by_left.items():
            for at in some:
                for other in large.differing(at, word, reach(l)):
                    pairs.append((min(at, other), abs(at - other), l))
        large.take(small)
        return large

    pairs: list[tuple[int, int, int]] = []
    for k, l in enumerate([*common, 0], 1):
        while stack and stack[-1][0] > l:
            h, held = stack.pop()
            done = joined(held, done, h)
        if k == len(places):
            break
        if stack and stack[-1][0] == l:
            stack[-1][1] = joined(stack[-1][1], done, l)
        else:
            stack.append([l, done])
        done = Positions(places[k], left[k])
        yield from pairs
        pairs.clear()
    yield from pairs


def ranks_by_doubling(words: np.ndarray, doc: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of the first 1, 2, 4, ... words from each position; equal ranks only within a text.  The last are all distinct."""
    at = np.arange(len(words))
    key, levels, h = doc * (int(words.max()) + 1) + words, [], 1
    while True:
        found, rank = np.unique(key, return_inverse=True)
        levels.append(rank)
        if len(found) == len(words):
            return levels
        inside = at + h < end
        follow = np.zeros(len(words), np.int64)  # 0: the text ends here
        follow[inside] = rank[at[inside] + h] + 1
        key, h = rank * (len(found) + 1) + follow, 2 * h


def common_lengths(order: np.ndarray, end: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Number of common words of each two neighbours in suffix order."""
    a, b = order[:-1].copy(), order[1:].copy()
    end_a, end_b = end[a], end[b]
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((a < end_a) & (b < end_b))
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        for x in (a, b, out):
            x[same] += 1 << k
    return out


def chunk_runs(texts: list[np.ndarray], min_length: int, min_exponent: int) -> dict[int, list[tuple[int, int, int]]]:
    """Runs ``(start, length, period)``, sorted, of those texts (arrays of word numbers) that have any."""
    least = least_common(min_length, min_exponent)
    long = [i for i, t in enumerate(texts) if len(t) > least]
    if not long:
        return {}
    # only texts in which a sequence of ``least`` words occurs twice; equal hashes of other sequences cost time only
    size = np.array([len(texts[i]) for i in long])
    words, doc = np.concatenate([texts[i] for i in long]), np.repeat(np.arange(len(long)), size)
    n = len(words) - least + 1
    key = mix(doc[:n].astype(np.uint64) + _C)
    for j in range(least):
        key = mix(key * _C + words[j : j + n].astype(np.uint64))
    same_text = np.flatnonzero(doc[:n] == doc[least - 1 :])
    key = key[same_text]
    by_key = np.argsort(key)
    twice = np.flatnonzero(key[by_key][1:] == key[by_key][:-1])
    some = np.unique(doc[same_text[by_key[twice]]])
    if not len(some):
        return {}
    texts, names = [texts[long[i]] for i in some], [long[i] for i in some]
    size = np.array([len(t) for t in texts])
    stop = np.cumsum(size)
    words, doc, end = np.concatenate(texts), np.repeat(np.arange(len(texts)), size), np.repeat(stop, size)
    levels = ranks_by_doubling(words, doc, end)
    order = np.empty(len(words), np.int64)
    order[levels[-1]] = np.arange(len(words))
    common = common_lengths(order, end, levels)
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    left = np.where(first, -1, np.concatenate(([-1], words[:-1])))[order]
    deep = np.concatenate(([False], common >= least, [False]))
    froms, tos = np.flatnonzero(~deep[:-1] & deep[1:]), np.flatnonzero(deep[:-1] & ~deep[1:])
    found: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)
    for i, j in zip(froms.tolist(), tos.tolist(), strict=True):
        held = found[int(doc[order[i]])]
        for at, d, l in maximal_pairs(order[i : j + 1].tolist(), common[i:j].tolist(), left[i : j + 1].tolist(), lambda l: l // (min_exponent - 1)):
            if l + d >= min_length and held.get((at, l + d), d) >= d:
                held[at, l + d] = d
    return {names[k]: sorted((at - int(stop[k] - size[k]), length, d) for (at, length), d in held.items()) for k, held in found.items() if held}


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, id_col: str = "doc_id", text_col: str = "text",
              reorder: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row: its runs by start and period, and its words joined by one blank
    without those that a run repeats (all but its first period).

    ``reorder(doc_id, n)`` may give the word numbers to read in place of 0 to n - 1 (for planted runs).
    """

    def rows(ids, texts, orders):
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        cuts = np.cumsum([len(t) for t in texts])[:-1]
        arrays = [a if o is None else a[o] for a, o in zip(np.split(flat, cuts), orders, strict=True)]
        runs = chunk_runs(arrays, min_length, min_exponent)
        collapsed, listed = [], []
        for i, (words, o) in enumerate(zip(texts, orders, strict=True)):
            of = runs.get(i, [])
            kept: np.ndarray | range = range(len(words)) if o is None else o
            if of:
                stays = np.ones(len(words), bool)
                for at, length, q in of:
                    stays[at + q : at + length] = False
                kept = np.asarray(kept)[stays]
            collapsed.append(b" ".join(words if o is None and not of else [words[k] for k in kept]).decode("utf-8", "replace"))
            listed.append([{"start": s, "length": n, "period": q} for s, n, q in of])
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(listed, kind), pa.array(collapsed)],
                                          names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches):
        for b in batches:
            ids, texts, orders, held = [], [], [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = text.as_py().split()
                if ids and held + len(words) > CHUNK_WORDS:
                    yield rows(ids, texts, orders)
                    ids, texts, orders, held = [], [], [], 0
                ids.append(doc_id)
                texts.append(words)
                orders.append(reorder(doc_id, len(words)) if reorder else None)
                held += len(words)
            if ids:
                yield rows(ids, texts, orders)

    return id_text(docs, id_col, text_col).mapInArrow(run, RUNS)
