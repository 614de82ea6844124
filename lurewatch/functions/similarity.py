"""String similarities Spark has no built-in for, as Arrow-batched UDFs.

Both are meant for *distinct, already pruned* inputs.  Jaro runs vectorised
over a batch (one NumPy step per character pair, not per row).
"""

from __future__ import annotations

import sys
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# executors need not have this package installed: its helpers travel with the UDF
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _codes(strings: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(strings), max(width, 1)), dtype=np.int32)
    for i, s in enumerate(strings):
        if s:
            out[i, : len(s)] = np.frombuffer(s.encode("utf-32-le"), dtype=np.int32)
    return out


def jaro_batch(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Element-wise Jaro and Jaro-Winkler (prefix <= 4, weight 0.1, boost above 0.7)."""
    n1 = np.array([len(s) for s in left], dtype=np.int64)
    n2 = np.array([len(s) for s in right], dtype=np.int64)
    w1, w2 = int(n1.max(initial=0)), int(n2.max(initial=0))
    a, b = _codes(left, w1), _codes(right, w2)
    rows = len(left)
    reach = np.maximum(np.maximum(n1, n2) // 2 - 1, 0)
    hit1, hit2 = np.zeros((rows, w1 + 1), bool), np.zeros((rows, w2 + 1), bool)
    max_reach = int(reach.max(initial=0))
    for i in range(w1):
        free = i < n1
        for j in range(max(0, i - max_reach), min(w2, i + max_reach + 1)):
            m = free & (a[:, i] == b[:, j]) & (j < n2) & ~hit2[:, j] & (abs(i - j) <= reach)
            if m.any():
                hit1[m, i] = True
                hit2[m, j] = True
                free = free & ~m
    matches = hit1.sum(axis=1)
    # k-th matched character of each side, compared in order
    moved = np.zeros(rows, dtype=np.int64)
    k1 = np.where(hit1, np.cumsum(hit1, axis=1), 0)
    k2 = np.where(hit2, np.cumsum(hit2, axis=1), 0)
    for k in range(1, int(matches.max(initial=0)) + 1):
        live = matches >= k
        i, j = (k1 == k).argmax(axis=1), (k2 == k).argmax(axis=1)
        r = np.arange(rows)
        moved += live & (a[r, np.minimum(i, a.shape[1] - 1)] != b[r, np.minimum(j, b.shape[1] - 1)])
    t = moved // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (matches / n1 + matches / n2 + (matches - t) / matches) / 3.0
    jaro = np.where(matches > 0, jaro, 0.0)
    p = np.zeros(rows, dtype=np.int64)
    same = np.ones(rows, bool)
    for i in range(min(4, w1, w2)):
        same &= (i < n1) & (i < n2) & (a[:, i] == b[:, i])
        p += same
    return jaro, np.where(jaro > 0.7, jaro + p * 0.1 * (1.0 - jaro), jaro)


def _by_length(left: list[str], right: list[str], chunk: int = 4096):
    """Index chunks of similar length, so that one long string does not widen a whole batch."""
    order = np.argsort([max(len(x), len(y)) for x, y in zip(left, right)], kind="stable")
    for i in range(0, len(order), chunk):
        yield order[i:i + chunk]


def jaro_winkler_udf():
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        xs, ys = x.fillna("").tolist(), y.fillna("").tolist()
        out = np.zeros(len(xs))
        for idx in _by_length(xs, ys):
            out[idx] = jaro_batch([xs[i] for i in idx], [ys[i] for i in idx])[1]
        return pd.Series(out)

    return run


def jaro_winkler(left: Column, right: Column) -> Column:
    return jaro_winkler_udf()(left, right)


def best_jaro(label: Column, brands: list[str]) -> Column:
    """``struct<jaro, jaro_winkler>``: maxima over a short literal brand list."""

    @F.pandas_udf("jaro double, jaro_winkler double")
    def run(x: pd.Series) -> pd.DataFrame:
        xs = x.fillna("").tolist()
        best = np.zeros((len(xs), 2))
        for idx in _by_length(xs, xs):
            part = [xs[i] for i in idx]
            for b in brands:
                j, jw = jaro_batch(part, [b] * len(part))
                best[idx, 0] = np.maximum(best[idx, 0], j)
                best[idx, 1] = np.maximum(best[idx, 1], jw)
        return pd.DataFrame({"jaro": best[:, 0], "jaro_winkler": best[:, 1]})

    return run(label)


def sequence_ratio_udf():
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(x, y)], dtype="float64")

    return run


def sequence_ratio(left: Column, right: Column) -> Column:
    """Ratcliff-Obershelp ratio of two strings."""
    return sequence_ratio_udf()(left, right)
