"""Vector best-fit packing of token sequences.

A sequence has three capacities: tokens, number of document pieces, and attention cost (sum of squared piece lengths).
Pieces are placed longest first; among the open sequences with room in every dimension the one with the smallest weighted
norm of what is left (or the largest weighted dot product of room and piece) is chosen.

A piece's demands follow from its length, so equal lengths are alike.  The job counts pieces by length (at most
``tokens`` rows, whatever the corpus), places the counts, many equal pieces into many equal sequences at a time, and gets
a short table of runs: pieces a to b of length L go to sequences from s on, at offset o.  Pieces get a number within
their length by two-level prefix sums and find their run by a join on length and range.  No document passes the driver,
and the packing is the same as for one global pass over all pieces.

Edge cases: a null or empty text is the end id alone; pieces of full length fill a sequence; repeated rows are placed
each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lurewatch.llm.common import id_text, stored
from lurewatch.llm.word_ids import word_ids

MAX_TOKENS, MAX_PIECES, MAX_COST, END_ID = 4096, 4096, 4096 * 4096, 1
WEIGHTS = (1.0, 0.01, 0.01)
ORDER_ROWS = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RUNS = ["run_length", "first", "number", "per", "seq", "at"]


def cut_pieces(docs: DataFrame, tokenizer_file: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every row: only documents beyond ``max_tokens`` are cut."""

    def run(batches):
        ids = word_ids(tokenizer_file)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = []
            for doc_id, raw in zip(b.column(0).to_pylist(), ids.texts(b.column(1).to_pylist()), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * max_tokens)):
                    part = raw[at : at + 4 * max_tokens]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return id_text(docs, id_col, text_col).mapInArrow(run, PIECES)


def place_counts(counts: dict[int, int], caps: tuple[int, int, int] = (MAX_TOKENS, MAX_PIECES, MAX_COST), rule: str = "norm", weights: tuple[float, ...] = WEIGHTS) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first, number, per_sequence, sequence, offset)`` for ``counts`` pieces of each length."""
    cap, w = np.array(caps, np.float64), np.array(weights)
    room, many, base = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, first = counts[length], 0
        need = np.array([length, 1, length * length], np.int64)
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        shortest = min(x for x in counts if x <= length)
        live = (room >= np.array([shortest, 1, shortest * shortest])).all(axis=1)
        room, many, base = room[live], many[live], base[live]
        while left:
            fits = np.flatnonzero((room >= need).all(axis=1))
            if len(fits):
                if rule == "norm":
                    best = fits[np.argmin((w * ((room[fits] - need) / cap) ** 2).sum(axis=1))]
                else:
                    best = fits[np.argmax((w * (room[fits] / cap) * (need / cap)).sum(axis=1))]
                free, n, seq = room[best].copy(), int(many[best]), int(base[best])
            else:
                best, free, n, seq = None, np.array(caps, np.int64), left, sequences
            # equal pieces fill the tightest sequence one after the other; by the dot rule, which prefers room, an open one
            # gets one piece and then others of its kind are preferred (a new one is the only choice until it is full)
            per = min(int((free // need).min()), left) if best is None or rule == "norm" else 1
            bins = min(n, left // per)
            runs.append((length, first, per * bins, per, seq, int(caps[0] - free[0])))
            first, left = first + per * bins, left - per * bins
            if best is None:
                sequences += bins
            elif bins == n:
                keep = np.arange(len(many)) != best
                room, many, base = room[keep], many[keep], base[keep]
            else:
                many[best] -= bins
                base[best] += bins
            room, many, base = np.vstack((room, free - per * need)), np.append(many, bins), np.append(base, seq)
    return runs


def best_fit(docs: DataFrame, tokenizer_file: str, caps: tuple[int, int, int] = (MAX_TOKENS, MAX_PIECES, MAX_COST), rule: str = "norm", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row."""
    pieces = stored(cut_pieces(docs, tokenizer_file, caps[0], END_ID, id_col, text_col), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most caps[0] rows
    # an Arrow table becomes a frame in the JVM; a list of tuples would start one more Python daemon with workers on every executor
    columns = np.array(place_counts(counts, caps, rule), np.int64).reshape(-1, len(RUNS)).T
    runs = docs.sparkSession.createDataFrame(pa.table([pa.array(c) for c in columns], names=RUNS))
    parts = max(1, -(-sum(counts.values()) // ORDER_ROWS))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sums = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = sums.select("length", "bucket", (F.sum("c").over(Window.partitionBy("length").orderBy("bucket")) - F.col("c")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    rows = rows.withColumn("nth", nth).join(before, ["length", "bucket"]).withColumn("o", F.col("before") + F.col("nth") - 1)
    # the table of runs has a few rows per length, at most some ten thousand in all
    found = rows.join(F.broadcast(runs), (F.col("length") == F.col("run_length")) & (F.col("o") >= F.col("first")) & (F.col("o") < F.col("first") + F.col("number")))
    t = F.col("o") - F.col("first")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("seq") + F.floor(t / F.col("per"))).cast("long").alias("sequence_id"), (F.col("at") + t % F.col("per") * F.col("length")).cast("long").alias("offset"))
