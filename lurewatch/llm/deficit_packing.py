"""Packing token streams of several sources into fixed windows of target proportions, by deficit round-robin.

Every source is a queue of documents, in the order in which tasks read them.  A window of ``WINDOW`` tokens serves the
queues in proportion to their weights: each window adds its quantum to a queue's deficit, a queue is served once its
deficit reaches ``SLICE`` tokens (or all it has left), what it is owed beyond that stays on for the next window, and rounds
over the queues in order of their deficits fill what is left of the window (a queue may run ahead by one slice, which the
next windows take off again).  Documents are cut where a window or a turn ends.  When a queue runs out, the others share
its part.  The last tokens, fewer than a window, become sequences whose lengths are powers of two, so nothing is padded.

How it runs in parallel: the proportions say how far each queue has come after any number of windows, so windows are cut
into blocks of ``BLOCK_WINDOWS`` and a block's part of each queue follows from closed form (cumulative rounding, less than a
token off), with the deficits that remain carried into the block.  A block's parts meet in one task, of bounded size, and
the round-robin runs there over their lengths; a hot source is spread over all blocks.

Texts are read and tokenized once; token ids are written (two bytes each where the vocabulary allows) with their place
among the task's tokens of that source, sums over the tasks give each queue's offsets, and one shuffle brings the ids to
their blocks.

Sources too small to hold two tokens a block, and all beyond the ``MAX_QUEUES`` largest, share a queue: its windows take
them in reading order, in proportion to their joint weight.

Edge cases: a null or empty text is the end id alone; a null source is a source; repeated rows are packed each; a null
doc_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lurewatch.llm.common import in_groups, small_batches, stored
from lurewatch.llm.word_ids import word_ids
from lurewatch.session import sized_broadcast

WINDOW, END_ID, SLICE, BLOCK_WINDOWS, MAX_QUEUES = 2048, 1, 64, 1024, 1024
TOKENS = "name string, doc_id long, part long, before long, n long, ids binary"
PARTS = "block long, queue int, at long, name string, doc_id long, start long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
_BATCH_BYTES = 4_000_000


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def tokenized(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Ids of every row with the number of tokens of the same source before it in its task."""
    small_batches(docs.sparkSession)
    name = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("-"))
    rows = docs.select(name.alias("name"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"))

    def run(batches):
        ids, part, before = word_ids(tokenizer_file), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([end_id], "<u4").tobytes()
        narrow = len(ids.ends) <= 1 << 16
        for b in batches:
            out, held = [], 0
            for name, doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ids.texts(b.column(2).to_pylist()), strict=True):
                raw += end
                n = len(raw) // 4
                out.append((name, doc_id, part, before[name], n, np.frombuffer(raw, "<u4").astype("<u2").tobytes() if narrow else raw))
                before[name] += n
                held += len(raw)
                if held > _BATCH_BYTES:
                    yield _batch(out, TOKENS)
                    out, held = [], 0
            if out:
                yield _batch(out, TOKENS)

    path_rows = rows.mapInArrow(run, TOKENS)
    return stored(path_rows, "token-ids", compression="zstd")


class Schedule:
    """How many tokens each queue has given after any number of tokens, from the queues' sizes and weights (integers)."""

    def __init__(self, sizes: list[int], weights: list[int], window: int = WINDOW, block_windows: int = BLOCK_WINDOWS):
        self.sizes, self.weights, self.window, self.block_windows = sizes, weights, window, block_windows
        self.total, self.block_tokens = sum(sizes), window * block_windows
        rest = self.total % window
        self.full = self.total // window
        self.tails = [1 << k for k in range(window.bit_length(), -1, -1) if rest >> k & 1]
        self.blocks = max(1, -(-self.full // block_windows))
        # queues run out in order of size over weight
        self.order = sorted(range(len(sizes)), key=lambda s: (sizes[s] * 10**18 // weights[s], s))
        self.known: dict[int, list[int]] = {}

    def targets(self, given: int) -> tuple[list[int], int]:
        """Numerators and denominator of what each queue should have given of the first ``given`` tokens."""
        gone, active = 0, sum(self.weights)
        out = [0] * len(self.sizes)
        for k, s in enumerate(self.order):
            # while s lasts, the others that are left get their share of the rest
            if (given - gone) * self.weights[s] < self.sizes[s] * active:
                for r in self.order[:k]:
                    out[r] = self.sizes[r] * active
                for r in self.order[k:]:
                    out[r] = (given - gone) * self.weights[r]
                return out, active
            gone += self.sizes[s]
            active -= self.weights[s]
        return list(self.sizes), 1

    def boundary(self, block: int) -> list[int]:
        """What each queue has given before the block: cumulative rounding of the targets, which add up exactly."""
        if block >= self.blocks:
            return self.sizes
        if block in self.known:
            return self.known[block]
        if len(self.known) > 1000:
            self.known.clear()
        num, den = self.targets(block * self.block_tokens)
        out, upto, done = [], 0, 0
        for x in num:
            upto += x
            out.append(upto // den - done)
            done = upto // den
        self.known[block] = out
        return out

    def block_of(self, queue: int, at: int, guess: int) -> int:
        """The block that holds a queue's token number ``at``."""
        if self.boundary(guess)[queue] <= at < self.boundary(guess + 1)[queue]:
            return guess
        lo, hi = 0, self.blocks - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.boundary(mid)[queue] <= at else (lo, mid - 1)
        return lo

    def windows(self, block: int) -> list[int]:
        """Lengths of the block's sequences."""
        last = block == self.blocks - 1
        return [self.window] * (min(self.full, (block + 1) * self.block_windows) - block * self.block_windows) + (self.tails if last else [])

    def serve(self, block: int, slice_tokens: int = SLICE) -> np.ndarray:
        """Tokens of each queue (columns) in each of the block's sequences (rows), by deficit round-robin."""
        num, den = self.targets(block * self.block_tokens)
        begun = self.boundary(block)
        left = np.array(self.boundary(block + 1), np.int64) - np.array(begun, np.int64)
        deficit = np.array([(x - den * c) / den for x, c in zip(num, begun, strict=True)])
        weights = np.array(self.weights, np.float64)
        out = np.zeros((len(self.windows(block)), len(left)), np.int64)
        for w, room in enumerate(self.windows(block)):
            live = np.where(left > 0, weights, 0.0)
            deficit += room * live / live.sum()
            owed = np.minimum(np.floor(deficit + 1e-9).astype(np.int64), left)
            take = np.where((owed >= slice_tokens) | ((owed > 0) & (owed == left)), owed, 0)
            while (over := int(take.sum()) - room) > 0:  # deficits above what the window holds: the largest wait
                k = int(np.argmax(take))
                take[k] -= min(over, int(take[k]))
            spare = room - int(take.sum())
            while spare:
                for k in np.argsort(take - deficit, kind="stable").tolist():
                    more = min(spare, slice_tokens, int(left[k] - take[k]))
                    take[k] += more
                    spare -= more
                    if not spare:
                        break
            deficit -= take
            left -= take
            out[w] = take
        return out


def _cut(schedule: Schedule, width: int):
    """Documents at their places in the queues -> their parts by block."""

    def run(batches):
        guess: dict[int, int] = {}
        for b in batches:
            out, held = [], 0
            for name, doc_id, n, ids, queue, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t = 0
                while t < n:
                    block = guess[queue] = schedule.block_of(queue, at + t, guess.get(queue, 0))
                    m = min(n - t, schedule.boundary(block + 1)[queue] - at - t)
                    out.append((block, queue, at + t, name, doc_id, t, n, ids[width * t : width * (t + m)]))
                    t += m
                    held += width * m
                if held > _BATCH_BYTES:
                    yield _batch(out, PARTS)
                    out, held = [], 0
            if out:
                yield _batch(out, PARTS)

    return run


def _fill(schedule: Schedule, width: int):
    """A block's parts, sorted by queue and place -> pieces."""

    def run(batches):
        for t in in_groups(batches, "block"):
            block = t["block"][0].as_py()
            takes = schedule.serve(block)
            before = np.cumsum(takes, axis=1) - takes  # offset of a queue's tokens in the sequence
            first, queues = block * schedule.block_windows, t["queue"].to_numpy()
            ids, starts, docs, totals, names = t["ids"].to_pylist(), t["start"].to_numpy(), t["doc_id"].to_pylist(), t["doc_tokens"].to_numpy(), t["name"].to_pylist()
            for i, j in zip(*(np.searchsorted(queues, np.unique(queues), side) for side in ("left", "right")), strict=True):
                q = int(queues[i])
                part_ends = np.cumsum([len(x) // width for x in ids[i:j]])
                ends = np.cumsum(takes[:, q])
                if ends[-1] != part_ends[-1]:
                    raise ValueError(f"queue {q} of block {block}: {part_ends[-1]} tokens for {ends[-1]} places")
                whole = memoryview(np.frombuffer(b"".join(ids[i:j]), f"<u{width}").astype("<u4").tobytes())
                cuts = np.union1d(ends, part_ends)
                cuts = cuts[cuts > 0]
                froms = np.concatenate(([0], cuts[:-1]))
                window, part = np.searchsorted(ends, froms, "right"), np.searchsorted(part_ends, froms, "right")
                offset = before[window, q] + froms - (ends[window] - takes[window, q])
                start = starts[i:j][part] + froms - (part_ends[part] - np.diff(part_ends, prepend=0)[part])
                crc = [zlib.crc32(whole[4 * a : 4 * z]) for a, z in zip(froms.tolist(), cuts.tolist(), strict=True)]
                at = (part + i).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([docs[k] for k in at], pa.int64()), pa.array(start), pa.array(cuts - froms), pa.array(crc, pa.int64()), pa.array(totals[at]), pa.array(first + window), pa.array(offset),
                     pa.array([None if names[k] == "-" else names[k][1:] for k in at], pa.string())], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def pack_by_deficit(docs: DataFrame, tokenizer_file: str, weights: dict[str | None, int] | None = None, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS,
                    end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source`` for every piece of every row.

    ``weights`` (positive integers) are the target proportions of the sources, others weigh 1; without them every source
    weighs what it holds, so each window mirrors the whole table.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    tokens = tokenized(docs, tokenizer_file, end_id, id_col, text_col, source_col)
    sums = stored(tokens.groupBy("name", "part").agg(F.sum("n").alias("c")), "queue-sums")
    size = sums.groupBy("name").agg(F.sum("c").alias("size"))
    if weights is None:
        size = size.withColumn("weight", F.col("size"))
    else:
        given = F.create_map(*[F.lit(x) for s, w in weights.items() for x in ("-" if s is None else f"s{s}", int(w))]) if weights else F.create_map().cast("map<string,int>")
        size = size.withColumn("weight", F.coalesce(given[F.col("name")], F.lit(1)).cast("long"))
    size = stored(size, "queue-sizes")
    total, weight = size.agg(F.sum("size"), F.sum("weight")).first()
    if not total:
        return docs.sparkSession.createDataFrame([], PIECES)
    large = size.where(F.col("weight").cast("double") * F.lit(window * block_windows) >= F.lit(2.0) * F.lit(float(weight)))
    own = large.orderBy(F.desc("weight"), "name").limit(MAX_QUEUES - 1).collect()  # at most MAX_QUEUES - 1 rows
    sizes, shares = [r["size"] for r in own], [r["weight"] for r in own]
    rest_size, rest_weight = total - sum(sizes), weight - sum(shares)
    if rest_size and own and rest_weight * window * block_windows < 2 * weight:  # too small for a queue: with the smallest one
        own.pop()
        rest_size, rest_weight = rest_size + sizes.pop(), rest_weight + shares.pop()
    shared = len(own)
    if rest_size:
        sizes.append(rest_size)
        shares.append(rest_weight)
    schedule = Schedule(sizes, shares, window, block_windows)
    number = F.create_map(*[F.lit(x) for i, r in enumerate(own) for x in (r["name"], i)]) if own else F.create_map().cast("map<string,int>")
    placed = sums.withColumn("queue", F.coalesce(number[F.col("name")], F.lit(shared)))
    placed = placed.withColumn("offset", F.sum("c").over(Window.partitionBy("queue").orderBy("part", "name").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c"))
    placed = stored(placed.select("name", "part", "queue", "offset"), "queue-offsets")
    width = 2 if tokens_are_narrow(tokenizer_file) else 4
    rows = tokens.join(sized_broadcast(placed), ["name", "part"]).select("name", "doc_id", "n", "ids", "queue", (F.col("offset") + F.col("before")).alias("at"))
    parts = rows.mapInArrow(_cut(schedule, width), PARTS).repartition("block").sortWithinPartitions("block", "queue", "at")
    return parts.mapInArrow(_fill(schedule, width), PIECES)


def tokens_are_narrow(tokenizer_file: str) -> bool:
    return len(word_ids(tokenizer_file).ends) <= 1 << 16
