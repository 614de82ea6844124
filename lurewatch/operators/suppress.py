"""Look-up suppression: after a check, a key is not checked again until its time to live has passed.

Each kept check re-anchors the interval, so the scan is sequential per key.  It
is made parallel by cutting time into chunks: a chunk's effect is a step
function from the earliest allowed time at its start to the earliest allowed
time at its end; the functions are composed in order, first within blocks of
chunks, then over the blocks of a key, and with its entry known every chunk is
scanned on its own.  Times have a resolution of
one second, which bounds a chunk by its length in seconds, however many rows a
key has.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])


BLOCK = 64  # chunks whose steps are in one row


def step_function(secs: np.ndarray, ttl: int, start: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(upto, exit)``: an entry threshold ``t <= upto[i]`` (first such i) leaves the chunk with threshold ``exit[i]``.

    A check kept before the chunk's ``start`` allows the next one before ``start + ttl``; steps beyond that can never be
    entered and are left out.
    """
    after = np.searchsorted(secs, secs + ttl)
    last = np.arange(len(secs))
    nxt = np.append(after, len(secs))
    last = np.append(last, len(secs))
    # pointer doubling: the last kept check reached from every possible first one
    while True:
        jump = nxt[:-1] < len(secs)
        if not jump.any():
            break
        last[:-1][jump] = last[nxt[:-1][jump]]
        nxt[:-1][jump] = nxt[nxt[:-1][jump]]
    exits = secs[last[:-1]] + ttl
    keep = np.append(exits[1:] != exits[:-1], True)
    upto, exits = secs[keep], exits[keep]
    most = len(upto) if start is None else int(np.searchsorted(upto, start + ttl)) + 1
    return upto[:most], exits[:most]


def compose(steps: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One step function for chunks that follow each other.

    A threshold beyond the first chunk's steps passes it unused; as chunks are longer than the time to live, the next
    chunk then takes any of its checks.
    """
    upto, exits = steps[0]
    if len(steps) > 1:
        upto, exits = np.append(upto, 2**62), np.append(exits, -(2**62))
    for u, e in steps[1:]:
        i = np.searchsorted(u, exits)
        exits = np.where(i < len(u), e[np.minimum(i, len(u) - 1)], exits)
    keep = np.append(exits[1:] != exits[:-1], True)
    return upto[keep], exits[keep]


def entries(steps: list[tuple[np.ndarray, np.ndarray]], entry: int) -> list[int]:
    """The threshold with which each of the chunks is entered, the first one with ``entry``."""
    out = []
    for u, e in steps:
        out.append(entry)
        i = int(np.searchsorted(u, entry))
        entry = int(e[i]) if i < len(u) else entry
    return out


def kept_seconds(secs: np.ndarray, ttl: int, entry: int) -> np.ndarray:
    out, t = [], entry
    while True:
        i = int(np.searchsorted(secs, t))
        if i >= len(secs):
            return np.array(out, dtype=np.int64)
        out.append(int(secs[i]))
        t = int(secs[i]) + ttl


def suppress_checks(checks: DataFrame, ttl: int, chunk: int | None = None, block: int = BLOCK) -> DataFrame:
    """Checks ``key, sec`` (epoch seconds) that are actually made: ``key, sec``."""
    chunk = chunk or max(8 * 86_400, 8 * ttl)  # bounds the seconds of one (key, chunk), some 5 MB at the default

    @F.pandas_udf("upto array<bigint>, exits array<bigint>")
    def summarise(secs: pd.Series, at: pd.Series) -> pd.DataFrame:
        both = [step_function(np.asarray(s), ttl, int(c) * chunk) for s, c in zip(secs, at)]
        return pd.DataFrame({"upto": [u for u, _ in both], "exits": [e for _, e in both]})

    both = lambda us, es: [(np.asarray(u), np.asarray(e)) for u, e in zip(us, es)]

    @F.pandas_udf("upto array<bigint>, exits array<bigint>")
    def composed(upto: pd.Series, exits: pd.Series) -> pd.DataFrame:
        done = [compose(both(us, es)) for us, es in zip(upto, exits)]
        return pd.DataFrame({"upto": [u for u, _ in done], "exits": [e for _, e in done]})

    @F.pandas_udf("array<bigint>")
    def entered(upto: pd.Series, exits: pd.Series, entry: pd.Series) -> pd.Series:
        return pd.Series([entries(both(us, es), int(t)) for us, es, t in zip(upto, exits, entry)])

    @F.pandas_udf("array<bigint>")
    def scan(secs: pd.Series, entry: pd.Series) -> pd.Series:
        return pd.Series([kept_seconds(np.asarray(s), ttl, int(e)) for s, e in zip(secs, entry)])

    distinct = checks.select("key", F.col("sec").cast("bigint").alias("sec")).distinct()
    chunks = materialize(distinct.groupBy("key", F.floor(F.col("sec") / chunk).alias("chunk")).agg(
        F.sort_array(F.collect_list("sec")).alias("secs")))
    def in_order(df: DataFrame, by: str, into: list) -> DataFrame:
        return df.groupBy("key", *into).agg(F.sort_array(F.collect_list(F.struct(by, "f.upto", "f.exits"))).alias("fs"))

    def spread_entries(df: DataFrame, by: str, entry) -> DataFrame:
        rows = df.select("key", F.col(f"fs.{by}").alias(by), entered("fs.upto", "fs.exits", entry).alias("entry"))
        return rows.select("key", F.explode(F.arrays_zip(by, "entry")).alias("e")).select("key", f"e.{by}", "e.entry")

    # two levels: a row holds the steps of one block of chunks, or one composed function per block of a key
    steps = chunks.select("key", "chunk", F.floor(F.col("chunk") / block).alias("block"), summarise("secs", "chunk").alias("f"))
    blocks = materialize(in_order(steps, "chunk", ["block"]))
    whole = in_order(blocks.select("key", "block", composed("fs.upto", "fs.exits").alias("f")), "block", [])
    at_block = spread_entries(whole, "block", F.lit(-(2**62)))
    entry = spread_entries(blocks.join(at_block, ["key", "block"]), "chunk", F.col("entry"))
    return chunks.join(entry, ["key", "chunk"]).select("key", F.explode(scan("secs", "entry")).alias("sec"))
