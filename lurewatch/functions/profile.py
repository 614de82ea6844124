"""Character and n-gram numbers of URLs, from one Arrow kernel per batch.

A batch is one array of code points.  The k-grams of all its rows are keys (row, gram) in one array; sorting it once per k
gives every count of every row, so no string is sorted, joined or searched by a back-reference row by row.  What a task
holds is a small multiple of one batch.

A null string counts as empty; an empty string has no characters, no grams and entropy 0.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# executors need not have this package installed: its helpers travel with the UDF
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROFILE = (
    "url_distinct int, url_top int, url_entropy double, url_run int, bigrams int, bigram_entropy double, trigrams int, trigram_entropy double, "
    "host_distinct int, host_entropy double, host_run int, host_jumps int, host_repeats boolean, path_entropy double")


class CodePoints:
    """The strings of a batch as one array of code points, with the row of each."""

    def __init__(self, strings: list[str]):
        self.n = np.fromiter(map(len, strings), np.int64, len(strings))
        self.at = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        self.row = np.repeat(np.arange(len(strings)), self.n)
        self.left = np.repeat(np.cumsum(self.n), self.n) - np.arange(len(self.at))  # characters from here to the row's end
        self.alphabet, self.dense = np.unique(self.at, return_inverse=True)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of occurrences of each distinct k-gram of each row, in order of rows."""
        first = np.flatnonzero(self.left >= k)
        gram, size = self.dense[first], max(len(self.alphabet), 1)
        for i in range(1, k):
            gram, size = gram * max(len(self.alphabet), 1) + self.dense[first + i], size * max(len(self.alphabet), 1)
            if size * max(len(self.n), 1) * max(len(self.alphabet), 1) >= 2**62:  # renumber the grams that occur
                seen, gram = np.unique(gram, return_inverse=True)
                size = max(len(seen), 1)
        key = np.sort(self.row[first] * size + gram)
        start = np.flatnonzero(np.diff(key, prepend=-1))
        return key[start] // size, np.diff(start, append=len(key))

    def distinct(self, rows: np.ndarray) -> np.ndarray:
        return np.bincount(rows, minlength=len(self.n))

    def most(self, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The highest of the values of each row (0: none); rows in order."""
        out = np.zeros(len(self.n), np.int64)
        start = np.flatnonzero(np.diff(rows, prepend=-1))
        if len(start):
            out[rows[start]] = np.maximum.reduceat(values, start)
        return out

    def entropy(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """``log2 n - sum(c log2 c) / n`` of each row's counts, in bits."""
        total = np.bincount(rows, counts, len(self.n))
        repeated = np.bincount(rows, counts * np.log2(counts), len(self.n))
        return np.where(total > 0, np.log2(np.maximum(total, 1)) - repeated / np.maximum(total, 1), 0.0)

    def longest_run(self) -> np.ndarray:
        """Longest run of one repeated character."""
        new = np.diff(self.at, prepend=-1) != 0
        start = np.flatnonzero(new | (np.diff(self.row, prepend=-1) != 0))
        return self.most(self.row[start], np.diff(start, append=len(self.at)))

    def jumps(self, over: int = 5) -> np.ndarray:
        """Neighbouring characters whose code points differ by more than ``over``."""
        i = np.flatnonzero(self.left >= 2)
        far = i[np.abs(self.at[i + 1] - self.at[i]) > over]
        return np.bincount(self.row[far], minlength=len(self.n))


def repeats_prefix(s: str) -> bool:
    """Some prefix of length 2 .. n/2-1, repeated, covers the string up to the last partial copy."""
    n = len(s)
    k = s.find(s[:2], 2) if n >= 6 else -1
    while 0 <= k < n // 2:
        m = n // k * k
        if s[k:m] == s[: m - k]:
            return True
        k = s.find(s[:2], k + 1)
    return False


def profile_batch(urls: list[str], hosts: list[str], paths: list[str]) -> dict[str, np.ndarray]:
    url, host, path = CodePoints(urls), CodePoints(hosts), CodePoints(paths)
    one, two, three, names = url.grams(1), url.grams(2), url.grams(3), host.grams(1)
    return {
        "url_distinct": url.distinct(one[0]), "url_top": url.most(*one), "url_entropy": url.entropy(*one), "url_run": url.longest_run(),
        "bigrams": url.distinct(two[0]), "bigram_entropy": url.entropy(*two), "trigrams": url.distinct(three[0]), "trigram_entropy": url.entropy(*three),
        "host_distinct": host.distinct(names[0]), "host_entropy": host.entropy(*names), "host_run": host.longest_run(), "host_jumps": host.jumps(),
        "host_repeats": np.fromiter(map(repeats_prefix, hosts), bool, len(hosts)), "path_entropy": path.entropy(*path.grams(1)),
    }


def string_profile(url: Column, host: Column, path: Column) -> Column:
    """Struct of ``PROFILE`` for each row."""

    @F.pandas_udf(PROFILE)
    def run(u: pd.Series, h: pd.Series, p: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(profile_batch(*[x.fillna("").tolist() for x in (u, h, p)]))

    return run(url, host, path)
