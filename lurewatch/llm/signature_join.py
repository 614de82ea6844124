"""Jaccard self-join of word n-gram sets with signature trees, and the components of its links.

Exact: two documents link when ``100 * |intersection| >= pct * |union|``.  Four steps:

1. *Classes.*  Rows with the same set (128-bit fingerprint) are one class with a number of its own; the row with its
   smallest doc_id stands for it.  All later steps see one row per class, so copies cost nothing.
2. *Meeting places.*  Sets that link differ in at most ``k`` tokens, ``k`` following from the larger set's size band.  A
   set's tokens are dealt by hash into ``k + 1 + e`` parts, of which at least ``1 + e`` are then equal in both sets.  A
   first pass over all sets counts how many of a set's parts some other set has too; a set that shares fewer than it must
   cannot link with any and is left (so a passage or line that many documents hold keeps none of them).  Sets that remain
   meet by their equal parts; each meeting is joined to its smallest member only (a star), so a meeting of m sets yields
   m - 1 rows.  Tasks combine equal parts before the shuffle, so a part that a third of all sets have costs a row a task.
3. *Signature trees.*  Sets connected by meetings form a group.  A tree over the group holds, in each node, the OR of
   token bitmaps and the range of sizes.  A dual traversal drops node pairs whose largest possible overlap is below what
   their sizes need, and node pairs that are connected already; remaining leaves are compared exactly.  A group beyond
   the block limits is cut into blocks by size: first each block by itself, then those block pairs (the top nodes)
   between different components that the same bounds leave.
4. *Components* of the verified links (large-star/small-star).

Edge cases: a null or blank text has the empty set and links with nothing; fewer than n words make one shingle of the
whole sequence; repeated rows share a class; different texts that share a doc_id are compared each for itself; rows with a
null doc_id are compared like others, and their component is null only if no linked row has a doc_id; an empty table
gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lurewatch.llm.common import WordHashes, components, id_text, in_groups, mix, stored
from lurewatch.session import sized_broadcast

WORDS64, FANOUT = 16, 8
BLOCK_SETS, BLOCK_TOKENS = 2048, 2_000_000
BAND_RATIO = 1.25
_C = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, n: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text (A-Z lower-cased, words split at ASCII blanks)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    acc = np.full(len(words) - size + 1, size, np.uint64)
    for j in range(size):
        acc = mix(acc * _C + h[j : len(h) - size + 1 + j])
    return np.unique(acc)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _bands(most: int) -> np.ndarray:
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return np.array(out)


def part_keys(s: np.ndarray, pct: int, bands: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """For each size band in which a set can link: the band, how many of its keys it must share with a partner there, and
    the keys of its parts.

    Empty parts are equal in both sets but have no key, so they lower what must be shared; a set with so many of them
    that nothing need be shared gets keys for its empty parts too.
    """
    size, out = len(s), []
    g = int(np.searchsorted(bands, size, "right")) - 1
    mixed, high = mix(s + _C), s >> np.uint64(32)
    while bands[g] <= 100 * size // pct:
        k = 2 * (int(bands[g + 1]) - 1) * (100 - pct) // (100 + pct)
        e = min(k, max(2, k // 4))
        m = k + 1 + e
        part = (high * np.uint64(m)) >> np.uint64(32)  # not decreasing, as the set is sorted
        starts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
        sums, which = np.add.reduceat(mixed, starts), part[starts]
        need = 1 + e - (m - len(starts))
        if need < 1:
            free = np.setdiff1d(np.arange(m, dtype=np.uint64), which)
            sums, which, need = np.concatenate((sums, np.zeros(len(free), np.uint64))), np.concatenate((which, free)), 1
        out.append((g, need, mix(sums ^ mix(which * _C + np.uint64(g + 1)))))
        g += 1
    return out


SLICE, HELD_KEYS = 512, 300_000
SKETCH = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "lo", "hi", "n", "doc_id")])
_PART, _COUNT = -1, -2
# member rows have the size in the low bits of n and a random number above it, which keeps copies apart in the shuffle by (key, n)
SIZE_BITS = 32


def _rows(*cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.asarray(c, np.int64)) for c in cols], names=SKETCH.names)


def _sketch(n: int, pct: int):
    """Texts -> member rows (hash of the text, lo, hi, size and random bits, doc_id); key rows (key, lo, band or -1 - band, _PART); count rows
    (random, lo, what must be shared, _COUNT, keys shared within the task).

    A task forwards each key once, for the smallest set that has it; where several sets of the task have it, their counts
    are settled here and the forwarded row says so by its negative band.
    """

    def run(batches):
        memo, spread = WordHashes(), np.random.default_rng(TaskContext.get().partitionId())
        bands = _bands(1 << 12)
        keys, needs, seen, held = [], [], set(), 0

        def flush():
            key, owner = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            lo, band, need = (np.array(c, np.int64) for c in zip(*needs, strict=True))
            order = np.lexsort((lo[owner], key))
            key, owner = key[order], owner[order]
            first = np.concatenate(([True], key[1:] != key[:-1]))
            starts = np.flatnonzero(first)
            shared = np.diff(starts, append=len(key)) > 1
            inside = np.bincount(owner[np.repeat(shared, np.diff(starts, append=len(key)))], minlength=len(keys))
            yield _rows(spread.integers(-(2**62), 2**62, len(lo)), lo, need, np.full(len(lo), _COUNT), inside)
            own = owner[starts]
            mark = np.where(shared, -1 - band[own], band[own])
            for at in range(0, len(starts), 100_000):
                to = slice(at, at + 100_000)
                yield _rows(key[starts][to], lo[own][to], mark[to], np.full(len(mark[to]), _PART), pa.nulls(len(mark[to]), pa.int64()))

        for whole in batches:
            for b in (whole.slice(at, SLICE) for at in range(0, whole.num_rows, SLICE)):
                member = []
                ids = b.column(0).to_pylist()
                for text in b.column(1).to_pylist():
                    s = shingles(text, n, memo)
                    hi, lo = fingerprint(s)
                    member.append((lo, hi, len(s)))
                    if len(s) and lo not in seen:
                        seen.add(lo)
                        if 2 * len(s) >= bands[-1]:
                            bands = _bands(4 * len(s))
                        for g, need, k in part_keys(s, pct, bands):
                            keys.append(k.view(np.int64))
                            needs.append((lo, g, need))
                            held += len(k)
                m = np.array(member, np.int64)
                salted = m[:, 2] | (spread.integers(0, 2**30, len(m)) << SIZE_BITS)
                yield _rows(b.column(2), m[:, 0], m[:, 1], salted, pa.array(ids, pa.int64()))
                if held > HELD_KEYS:
                    yield from flush()
                    keys, needs, seen, held = [], [], set(), 0
        if keys:
            yield from flush()

    return run


def _meetings(pct: int):
    """Sets (id, tokens) -> (key, id, least id of the task with that key); stars within the task have a key of their own."""

    def run(batches):
        spread, bands = np.random.default_rng(TaskContext.get().partitionId()), _bands(1 << 12)
        names = ["key", "u", "v"]
        for whole in batches:
            for b in (whole.slice(at, SLICE) for at in range(0, whole.num_rows, SLICE)):
                keys, owners = [], []
                for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    s = np.frombuffer(raw, np.uint64)
                    if 2 * len(s) >= bands[-1]:
                        bands = _bands(4 * len(s))
                    keys += [k.view(np.int64) for _, _, k in part_keys(s, pct, bands)]
                    owners += [i] * (len(keys) - len(owners))
                key, owner = np.concatenate(keys), np.repeat(np.array(owners, np.int64), [len(k) for k in keys])
                order = np.lexsort((owner, key))
                key, owner = key[order], owner[order]
                first = np.concatenate(([True], key[1:] != key[:-1]))
                least = owner[np.flatnonzero(first)][np.cumsum(first) - 1]
                star = np.unique(np.stack((owner[~first], least[~first])), axis=1)
                star = star[:, star[0] != star[1]]
                yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(owner[first]), pa.array(owner[first])], names=names)
                if star.size:
                    yield pa.RecordBatch.from_arrays([pa.array(spread.integers(-(2**62), 2**62, star.shape[1])), pa.array(star[0]), pa.array(star[1])], names=names)

    return run


SETS = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "hi", "lo", "n", "bits")] + [T.StructField("tokens", T.BinaryType())] + [T.StructField(f"b{i}", T.LongType()) for i in range(WORDS64)])


def bitmap(s: np.ndarray) -> tuple[np.ndarray, int]:
    on = np.zeros(64 * WORDS64, bool)
    on[(mix(s) >> np.uint64(54)).astype(np.int64)] = True
    return np.packbits(on).view(np.int64), int(on.sum())


def _fetch(n: int):
    """(class, text, hi, lo) -> sets of the rows whose fingerprint is the asked one, once a class within the task."""

    def run(batches):
        memo, had = WordHashes(), set()
        for whole in batches:
            for b in (whole.slice(at, SLICE) for at in range(0, whole.num_rows, SLICE)):
                out = []
                for node, text, hi, lo in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if node in had:
                        continue
                    s = shingles(text, n, memo)
                    if fingerprint(s) == (hi, lo):
                        had.add(node)
                        bits, on = bitmap(s)
                        out.append((node, hi, lo, len(s), on, s.tobytes(), *bits.tolist()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 5 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names=SETS.names)

    return run


class SignatureTree:
    """Nodes over leaves in similarity order: OR of bitmaps, range of sizes, least bits of a leaf, per level."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, on: np.ndarray):
        self.levels = [(bits, sizes, sizes, on)]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, o = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(o, at)))

    def may_link(self, level: int, i: np.ndarray, j: np.ndarray, pct: int) -> np.ndarray:
        """Can any leaf under i link with any under j?  Tokens outside the common bits are not shared."""
        b, lo, hi, on = self.levels[level]
        common = np.bitwise_count(b[i] & b[j]).sum(axis=1).astype(np.int64)
        most = np.minimum(hi[i] - np.maximum(0, on[i] - common), hi[j] - np.maximum(0, on[j] - common))
        # overlap >= pct/(100+pct) * (|x| + |y|), and the smaller size >= pct/100 of the larger
        return (most * (100 + pct) >= pct * (lo[i] + lo[j])) & (100 * hi[i] >= pct * lo[j]) & (100 * hi[j] >= pct * lo[i])


def tree_links(sets: list[np.ndarray], bits: np.ndarray, on: np.ndarray, pct: int, labels: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Verified links that connect, together with ``labels``, exactly what all links of the sets connect; and each set's component."""
    sizes = np.array([len(s) for s in sets], np.int64)
    band = np.floor(np.log(np.maximum(sizes, 1)) / np.log(100 / pct)).astype(np.int64)
    order = np.lexsort((sizes, np.array([s[0] for s in sets], np.uint64), band))
    tree = SignatureTree(bits[order].view(np.uint64), sizes[order], on[order])
    root = (np.arange(len(sets)) if labels is None else np.unique(labels, return_inverse=True)[1])[order]
    links: list[tuple[int, int]] = []
    top = len(tree.levels) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if level == 0:
            ok = i < j
            i, j = i[ok], j[ok]
        if len(i) > 4096:
            stack += [(level, i[a : a + 4096], j[a : a + 4096]) for a in range(0, len(i), 4096)]
            continue
        lo = hi = root
        for _ in range(level):
            at = np.arange(0, len(lo), FANOUT)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
        same = (lo[i] == hi[i]) & (lo[j] == hi[j]) & (lo[i] == lo[j])
        i, j = i[~same], j[~same]
        ok = tree.may_link(level, i, j, pct)
        i, j = i[ok], j[ok]
        if level:
            step = np.arange(FANOUT)
            a = (i[:, None, None] * FANOUT + step[None, :, None] + 0 * step[None, None, :]).ravel()
            b = (j[:, None, None] * FANOUT + step[None, None, :] + 0 * step[None, :, None]).ravel()
            n = len(tree.levels[level - 1][1])
            ok = (a < n) & (b < n) & (a <= b)
            if ok.any():
                stack.append((level - 1, a[ok], b[ok]))
            continue
        while len(i):
            x, y = sets[order[i[0]]], sets[order[j[0]]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= pct * (len(x) + len(y) - both):
                links.append((int(order[i[0]]), int(order[j[0]])))
                root[root == root[j[0]]] = root[i[0]]
            left = root[i[1:]] != root[j[1:]]
            i, j = i[1:][left], j[1:][left]
    component = np.empty(len(sets), np.int64)
    component[order] = root
    return links, component


def _group_links(pct: int, labelled: bool, whole: bool):
    """Arrow batches sorted by grp -> verified links (u, v); where a group is whole, each id with its smallest linked id."""

    def run(batches):
        for t in in_groups(batches, "grp"):
            ids = t["id"].to_numpy()
            ids, first = np.unique(ids, return_index=True)
            if len(first) < 2:
                continue
            raw = t["tokens"].to_pylist()
            sets = [np.frombuffer(raw[i], np.uint64) for i in first]
            bits = np.stack([t[f"b{k}"].to_numpy()[first] for k in range(WORDS64)], axis=1)
            links, component = tree_links(sets, bits, t["bits"].to_numpy()[first], pct, t["label"].to_numpy()[first] if labelled else None)
            if links:
                if whole:  # ids are sorted: the first of a component is its smallest
                    _, least, inverse = np.unique(component, return_index=True, return_inverse=True)
                    u, v = ids, ids[least][inverse]
                else:
                    u, v = (ids[list(x)] for x in zip(*links, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])

    return run


def _links_by(rows: DataFrame, pct: int, labelled: bool = False, whole: bool = False) -> DataFrame:
    cols = ["grp", "id", "bits", "tokens", *[f"b{i}" for i in range(WORDS64)], *(["label"] if labelled else [])]
    return rows.select(*cols).repartition("grp").sortWithinPartitions("grp").mapInArrow(_group_links(pct, labelled, whole), "u long, v long")


def _cut(sets: DataFrame, keys: list[str], pct: int, block_sets: int, block_tokens: int) -> DataFrame:
    """A block number for each set: by ``keys`` and size band, each block within both limits on average."""
    banded = sets.withColumn("band", F.floor(F.log(F.col("n")) / F.log(F.lit(100 / pct))).cast("long"))
    sums = banded.groupBy(*keys, "band").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    sums = sums.select(*keys, "band", F.greatest(F.ceil(F.col("c") / block_sets), F.ceil(F.col("t") / block_tokens)).alias("parts"))
    return banded.join(sums, [*keys, "band"]).withColumn("block", F.xxhash64(*keys, "band", F.pmod(F.xxhash64("id"), "parts"))).drop("parts")


def _large_group_links(sets: DataFrame, pct: int, block_sets: int, block_tokens: int) -> DataFrame:
    """Links within groups beyond the block limits: blocks alone, then pairs of top nodes between components."""
    alone = _cut(sets, ["grp"], pct, block_sets, block_tokens).withColumn("grp", F.col("block"))
    links = stored(_links_by(alone, pct), "block-links")
    labels = components(links).withColumnRenamed("component", "label")
    sets = sets.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    # members of large components get blocks of their own, which can be skipped as a whole; others share blocks
    size = sets.groupBy("grp", "label").agg((F.count(F.lit(1)) >= block_sets // 2).alias("big"))
    sets = sets.join(size, ["grp", "label"]).withColumn("cls", F.when(F.col("big"), F.col("label")))
    sets = stored(_cut(sets.fillna({"cls": -(2**63) + 1}), ["grp", "cls"], pct, block_sets // 2, block_tokens // 2), "blocks")
    nodes = sets.groupBy("grp", "block").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("bits").alias("on"), F.min("label").alias("l0"), F.max("label").alias("l1"),
        *[F.bit_or(f"b{i}").alias(f"b{i}") for i in range(WORDS64)])
    a, b = nodes.alias("a"), nodes.alias("b")
    common = sum((F.bit_count(F.col(f"a.b{i}").bitwiseAND(F.col(f"b.b{i}"))) for i in range(WORDS64)), F.lit(0))
    most = F.least(*[F.col(f"{s}.hi") - F.greatest(F.lit(0), F.col(f"{s}.on") - common) for s in "ab"])
    pairs = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.block") <= F.col("b.block"))).where(
        ~((F.col("a.l0") == F.col("a.l1")) & (F.col("b.l0") == F.col("b.l1")) & (F.col("a.l0") == F.col("b.l0")))
        & (100 * F.col("a.hi") >= pct * F.col("b.lo")) & (100 * F.col("b.hi") >= pct * F.col("a.lo"))
        & (most * (100 + pct) >= pct * (F.col("a.lo") + F.col("b.lo"))))
    pairs = pairs.select(F.col("a.block").alias("x"), F.col("b.block").alias("y"), F.xxhash64("a.block", "b.block").alias("grp"))
    sides = pairs.select("grp", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    return links.unionByName(_links_by(sets.drop("grp").join(sides, "block"), pct, labelled=True))


def _with_row(docs: DataFrame) -> DataFrame:
    """``row``: a hash of the text; with the doc_id it names a row, but for repeated ones."""
    return docs.withColumn("row", F.xxhash64("text"))


def _same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row"] == b["row"])


def _linked_classes(df: DataFrame, n: int, pct: int, id_col: str, text_col: str, block_sets: int, block_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, row, n, hi, lo), one per input row; and classes (hi, lo, rep, rep_row, first, component_id).

    ``rep, rep_row`` is the row that stands for a class; ``first`` says whether it also stands for its component.
    """
    docs = _with_row(id_text(df, id_col, text_col))
    rows = docs.mapInArrow(_sketch(n, pct), SKETCH)
    same_key = Window.partitionBy("key", "n")
    rows = rows.withColumn("met", F.min("lo").over(same_key) < F.max("lo").over(same_key))
    size = F.when(F.col("n") >= 0, F.col("n").bitwiseAND(F.lit(2**SIZE_BITS - 1))).otherwise(F.col("n"))
    found = stored(rows.where((F.col("n") != _PART) | (F.col("met") & (F.col("hi") >= 0))).select(
        size.alias("n"), "lo", "hi", "doc_id", F.when(F.col("n") >= 0, F.col("key")).alias("row")), "sketch")
    members = found.where("n >= 0")
    classes = members.where("n > 0").groupBy("hi", "lo").agg(
        F.min("doc_id").alias("rep"), F.min_by("row", "doc_id").alias("__row"), F.min(F.when(F.col("doc_id").isNull(), F.col("row"))).alias("__null_row"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "hi", "lo", "rep", F.coalesce("__row", "__null_row").alias("rep_row"))
    classes = stored(classes, "classes")
    # what a set must share is the least over its bands; what it shares is counted over all of them, which keeps too much rather than too little
    sharing = found.where("n < 0").groupBy("lo").agg(F.sum(F.when(F.col("n") == _PART, 1).otherwise(F.col("doc_id"))).alias("shared"), F.min(F.when(F.col("n") == _COUNT, F.col("hi"))).alias("need"))
    asked = classes.join(sharing.where("shared >= need").select("lo"), "lo")
    asked = stored(asked.select("node", F.col("rep").alias("doc_id"), F.col("rep_row").alias("row"), "hi", "lo"), "asked")
    sets = docs.join(sized_broadcast(asked, 500_000), _same_row(docs, asked)).select("node", "text", "hi", "lo").mapInArrow(_fetch(n), SETS)
    sets = stored(sets, "sets")
    meets = sets.select("id", "tokens").mapInArrow(_meetings(pct), "key long, u long, v long")
    meets = meets.select("u", F.least("v", F.min("u").over(Window.partitionBy("key"))).alias("v")).where("u <> v").distinct()
    groups = components(meets).select("id", F.col("component").alias("grp"))
    sets = stored(sets.join(groups, "id"), "grouped-sets")
    sums = sets.groupBy("grp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    large = stored(sums.where((F.col("c") > block_sets) | (F.col("t") > block_tokens)).select("grp"), "large")
    linked = _links_by(sets.join(large, "grp", "left_anti"), pct, whole=True).toDF("node", "component")
    if not large.isEmpty():
        linked = linked.unionByName(components(_large_group_links(sets.join(large, "grp"), pct, block_sets, block_tokens)).toDF("node", "component"))
    # links of whole groups leave out each component's first class
    linked = linked.unionByName(linked.select(F.col("component").alias("node"), "component")).distinct()
    linked = stored(classes.join(linked, "node").select("node", "component", "rep", "rep_row"), "linked")
    firsts = linked.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "rep_row", F.col("node").alias("first_node"))).alias("f"))
    linked = linked.join(firsts, "component").select("node", F.col("f.rep").alias("least"), "f.first_node")
    named = classes.join(linked, "node", "left").select(
        "hi", "lo", "rep", "rep_row", F.coalesce(F.col("first_node") == F.col("node"), F.lit(True)).alias("first"), F.coalesce("least", "rep").alias("component_id"))
    return members, named


def signature_components(df: DataFrame, n: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text",
                         block_sets: int = BLOCK_SETS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id`` (smallest doc_id reachable by links)."""
    members, named = _linked_classes(df, n, pct, id_col, text_col, block_sets, block_tokens)
    out = members.join(named.select("hi", "lo", "component_id"), ["hi", "lo"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first_of_groups(df: DataFrame, n: int = 5, pct: int = 80) -> DataFrame:
    """The rows of ``df`` without near copies: of each component one row stays, with the smallest doc_id (null last).

    Texts without words are no copies of each other and all stay.
    """
    members, named = _linked_classes(df, n, pct, "doc_id", "text", BLOCK_SETS, BLOCK_TOKENS)
    stays = F.col("first") & F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("row") == F.col("rep_row"))
    judged = members.where("n > 0").join(named, ["hi", "lo"]).groupBy("doc_id", "row").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("times"))
    judged = stored(judged.where("NOT stays OR times > 1").select(F.col("doc_id").alias("__llm_id"), F.col("row").alias("__llm_row"), "stays"), "near-copies")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = df.withColumn("__llm_key", F.xxhash64(text))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_key") == F.col("__llm_row"))
    # rows that go, and those of which one of several stays
    out = rows.join(sized_broadcast(judged.drop("stays"), 500_000), same, "left_anti").select(*df.columns)
    repeated = judged.where("stays").drop("stays")
    if repeated.isEmpty():
        return out
    again = rows.join(sized_broadcast(repeated, 500_000), same)
    # the least row, by the columns that have an order (maps have none)
    order = F.struct(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
    again = again.groupBy("__llm_id", "__llm_row").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order).alias("r"))
    return out.unionByName(again.select("r.*"))
