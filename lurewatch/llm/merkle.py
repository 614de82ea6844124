"""Merkle manifest of a table, with nested-interval labels, and proofs for its rows.

Every row is a leaf; the leaves of a source, ordered by doc_id, form a tree of fan-out ``ARITY``, and the sources' roots,
in order of the sources, form the tree above them.  A node is labelled with the interval ``[lo, hi)`` of the leaf ranks it
covers: one node is an ancestor of another where its interval contains the other's, and the siblings on a leaf's path
are the nodes of the level that cover the parent's interval less the node's own.

How it runs: ranks come from one range shuffle of the narrow leaf table (digests, no texts) and prefix sums over its
partitions.  Levels are handled ``BAND`` at a time: a block of ``ARITY ** BAND`` neighbouring nodes makes all its nodes of
these levels in one pass, then the blocks' roots are the next band's leaves, so a hundred million rows take three passes,
and a hot source is as many blocks as it needs.  The containment join that attaches ancestors is bucketed in the same way:
nodes and leaves of a band meet by block, each level is matched to the next by its intervals, and what lies above a block
(one short row per block) is joined to it.  Every table in between is written to the shared folder.

The manifest is the table of nodes (tree, level, lo, hi, digest) and the root; a tree is named after its source.

Edge cases: null fields have an encoding of their own; a null source is a source, before all others; null doc_ids come
first in their source; repeated rows are leaves of their own, equal ones in any order; a lone leaf is its source's root,
and a lone source's root is the root; an empty table has no nodes, no root (null) and no proofs.
"""

from __future__ import annotations

import binascii
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lurewatch.llm.common import in_groups, stored
from lurewatch.session import sized_broadcast

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, BAND = 3, 7
BLOCK = ARITY**BAND
#: Rows of the table of what lies above the blocks that may go to all tasks: at about a kilobyte each, 20 MB.
ABOVE_ROWS = 20_000
ROOT_TREE = ""  # sources' trees have names of at least one character


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(encoded, columns)).cast("binary"), 256))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, altered: dict[str, Column] | None = None, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``tree, doc_id, digest, altered``: one row per row of ``docs``; ``altered`` is the digest with those columns in place, null if it is the same."""
    as_is = leaf_digest([F.col(f"`{c}`") for c in fields])
    other = leaf_digest([(altered or {}).get(c, F.col(f"`{c}`")) for c in fields])
    tree = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("-"))
    rows = docs.select(tree.alias("tree"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), as_is.alias("digest"), other.alias("altered"))
    # equal rows are told apart by a number, so that the range shuffle can cut between them
    rows = rows.select("tree", "doc_id", "digest", F.when(F.col("altered") != F.col("digest"), F.col("altered")).alias("altered"), F.monotonically_increasing_id().alias("apart"))
    return stored(rows, "leaves")


def _number(batches):
    """Rows sorted by tree -> the same with the partition's number and the row's place among its tree's rows there."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for b in batches:
        tree = b.column(0).to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.flatnonzero(tree[1:] != tree[:-1]) + 1)) if len(tree) else np.empty(0, int)
        nth = np.arange(len(tree))
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(tree)], strict=True):
            begun = count if tree[i] == last else 0
            nth[i:j] += begun - i
            last, count = tree[i], begun + j - i
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(tree), part, np.int64)), pa.array(nth)], names=[*b.schema.names, "part", "nth"])


def ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` (tree first) with ``n`` and the ``rank`` from 0 within the tree, and the trees ``(tree, n)``."""
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    dealt = stored(dealt.mapInArrow(_number, f"{names}, part long, nth long"), "ranked")
    sums = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("c"))
    sums = stored(sums.select("tree", "part", (F.sum("c").over(Window.partitionBy("tree").orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy("tree")).alias("n")), "rank-offsets")
    out = dealt.join(sized_broadcast(sums), ["tree", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("part", "nth", "before")
    return out, sums.groupBy("tree").agg(F.max("n").alias("n"))


NODES = "tree string, n long, level int, lo long, hi long, digest binary"
_NODE_NAMES = [x.split()[0] for x in NODES.split(", ")]


def _in_blocks(rows: DataFrame, base: int) -> DataFrame:
    """Rows that cover part of one block of the band from level ``base`` on, together and by level and interval."""
    block = F.floor(F.col("lo") / F.lit(ARITY ** (base + BAND))).cast("long")
    rows = rows.withColumn("block", F.concat_ws(":", block.cast("string"), "tree"))
    return rows.repartition("block").sortWithinPartitions("block", "level", "lo")


def _grow(base: int):
    """A block's nodes of level ``base`` -> its nodes above, up to the block's root or the tree's."""

    def run(batches):
        for t in in_groups(batches, "block"):
            tree, n = t["tree"][0].as_py(), t["n"][0].as_py()
            digests, first = t["digest"].to_pylist(), t["lo"][0].as_py()
            out = []
            for level in range(base + 1, base + BAND + 1):
                if -(-n // ARITY ** (level - 1)) == 1:
                    break
                width = ARITY**level
                digests = [hashlib.sha256(binascii.hexlify(b"".join(digests[i : i + ARITY]))).digest() for i in range(0, len(digests), ARITY)]
                out += [(tree, n, level, lo, min(lo + width, n), d) for lo, d in zip(range(first, n, width), digests, strict=False)]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=_NODE_NAMES)

    return run


def grow(bottom: DataFrame, most: int) -> DataFrame:
    """All nodes above ``bottom`` (the level 0 of trees of at most ``most`` leaves)."""
    items, out, base = bottom.select(*_NODE_NAMES), None, 0
    while ARITY**base < most:
        nodes = stored(_in_blocks(items, base).select("block", *_NODE_NAMES).mapInArrow(_grow(base), NODES), "nodes")
        out = nodes if out is None else out.unionByName(nodes)
        base += BAND
        items = nodes.where(F.col("level") == base)
    return items.limit(0) if out is None else out


PATHS = "tree string, rank long, doc_id long, digest binary, altered binary, path binary, shape string"
_PATH_NAMES = [x.split()[0] for x in PATHS.split(", ")]
_SHAPES = "abcdefghi"  # place among the siblings, times ARITY, plus their number less one


def _attach(base: int):
    """A block's nodes of all levels -> each node of level ``base`` with the siblings on its path through the block."""

    def run(batches):
        for t in in_groups(batches, "block"):
            level, lo, hi, digests = t["level"].to_numpy(), t["lo"].to_numpy(), t["hi"].to_numpy(), t["digest"].to_pylist()
            cuts = np.searchsorted(level, np.arange(base, base + BAND + 2))
            steps = [(cuts[k], cuts[k + 1]) for k in range(BAND + 1) if cuts[k + 1] > cuts[k]]
            above_path, above_shape = [b""] * (steps[-1][1] - steps[-1][0]), [""] * (steps[-1][1] - steps[-1][0])
            for (i, j), (p, q) in zip(reversed(steps[:-1]), reversed(steps[1:]), strict=True):
                # the ancestor is the node that contains the interval
                parent = np.searchsorted(lo[p:q], lo[i:j], "right") - 1
                if (parent < 0).any() or (hi[i:j] > hi[p:q][parent]).any():
                    raise ValueError(f"a node of tree {t['tree'][0]} has no parent")
                # siblings cover the parent's interval less the node's own
                start, stop = np.searchsorted(lo[i:j], lo[p:q][parent]), np.searchsorted(hi[i:j], hi[p:q][parent], "right")
                paths, shapes = [], []
                for k, (a, b, up) in enumerate(zip(start.tolist(), stop.tolist(), parent.tolist(), strict=True)):
                    paths.append(b"".join([*digests[i + a : i + k], *digests[i + k + 1 : i + b]]) + above_path[up])
                    shapes.append(_SHAPES[(k - a) * ARITY + b - a - 1] + above_shape[up])
                above_path, above_shape = paths, shapes
            m = steps[0][1]
            rank = lo[:m] // ARITY**base
            yield pa.RecordBatch.from_arrays([*(c.slice(0, m).combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (t["tree"], pa.array(rank), t["doc_id"], t["digest"], t["altered"])),
                                              pa.array(above_path, pa.binary()), pa.array(above_shape, pa.string())], names=_PATH_NAMES)

    return run


def attach(bottom: DataFrame, nodes: DataFrame, trees: DataFrame, most: int) -> DataFrame:
    """``bottom`` (tree, n, level, lo, hi, digest, doc_id, altered) with path and shape up to the root of all.

    ``trees`` has, for each tree, ``n, subroot`` and the ``path, shape`` above its root.
    """
    bands = 1
    while BLOCK**bands < most:
        bands += 1
    last = F.lit(1)
    for b in range(1, bands):
        last = F.when(F.col("n") > F.lit(BLOCK**b), F.lit(b + 1)).otherwise(last)
    tops = trees.select("tree", F.lit(0).cast("long").alias("above"), "subroot", F.col("path").alias("rest"), F.col("shape").alias("rest_shape"), last.alias("bands"))
    whole = [*_NODE_NAMES, "doc_id", "altered"]
    inner = nodes.select(*_NODE_NAMES, F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("altered"))
    above = None
    for b in range(bands - 1, -1, -1):
        ends = tops.where(F.col("bands") == b + 1).drop("bands")
        above = ends if above is None else above.unionByName(ends)
        base = b * BAND
        items = bottom.select(*whole) if b == 0 else inner.where(F.col("level") == base)
        rows = items.unionByName(inner.where((F.col("level") > base) & (F.col("level") <= base + BAND)))
        if b:  # trees that end below this band have no items in it
            rows = rows.where(F.col("n") > F.lit(BLOCK**b))
        found = _in_blocks(rows, base).select("block", *whole).mapInArrow(_attach(base), PATHS)
        found = found.withColumn("above", F.floor(F.col("rank") / F.lit(BLOCK)).cast("long"))
        if b == 0:  # one row per block: to all tasks only where they are few
            above = sized_broadcast(above, ABOVE_ROWS)
        found = found.join(above, ["tree", "above"]).withColumns({"path": F.concat("path", "rest"), "shape": F.concat("shape", "rest_shape")})
        if b == 0:
            return found.drop("above", "rest", "rest_shape")
        above = stored(found.select("tree", F.col("rank").alias("above"), "subroot", F.col("path").alias("rest"), F.col("shape").alias("rest_shape")), "above")


@dataclass
class Manifest:
    """Leaves (tree, n, level, lo, hi, digest, doc_id, altered), nodes of the sources' trees and of the tree above them, and the root (hex)."""

    leaves: DataFrame
    nodes: DataFrame
    upper: DataFrame
    upper_nodes: DataFrame
    trees: DataFrame
    root: str | None


def _bottom(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"level": F.lit(0), "lo": F.col("rank"), "hi": F.col("rank") + 1}).drop("rank")


def _roots(bottom: DataFrame, nodes: DataFrame) -> DataFrame:
    every = bottom.select(*_NODE_NAMES).unionByName(nodes.select(*_NODE_NAMES))
    return every.where((F.col("lo") == 0) & (F.col("hi") == F.col("n"))).select("tree", "n", "digest")


def build_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, altered: dict[str, Column] | None = None) -> Manifest:
    rows, trees = ranked(leaves(docs, fields, altered), ["doc_id", "digest", "apart"])
    bottom = stored(_bottom(rows.drop("apart")), "bottom")
    nodes = grow(bottom, trees.agg(F.max("n")).first()[0] or 0)
    roots = stored(_roots(bottom, nodes), "roots")
    above = roots.select(F.lit(ROOT_TREE).alias("tree"), F.col("tree").alias("name"), "digest")
    upper, top = ranked(above, ["name"])
    upper = stored(_bottom(upper), "upper")
    upper_nodes = grow(upper, (top.first() or ("", 0))[1])
    root = _roots(upper, upper_nodes).first()
    return Manifest(bottom, nodes, upper, upper_nodes, roots, bytes(root.digest).hex() if root else None)


def proofs(m: Manifest) -> DataFrame:
    """``doc_id, digest, altered, subroot, path, shape`` for every leaf.

    ``path`` holds the siblings' digests, level by level up to the root, left to right; a letter of ``shape`` a level tells
    how many there are and which place is the node's own.
    """
    empty = F.lit(b"")
    whole = m.upper.agg(F.count(F.lit(1)).alias("n")).select(F.lit(ROOT_TREE).alias("tree"), "n", empty.alias("subroot"), empty.alias("path"), F.lit("").alias("shape"))
    names = m.upper.select(F.col("lo").alias("rank"), "name")
    bottom = m.upper.withColumns({"doc_id": F.col("lo"), "altered": F.lit(None).cast("binary")})
    tops = attach(bottom, m.upper_nodes, whole, m.upper.count()).select("rank", "path", "shape").join(names, "rank")
    trees = m.trees.withColumnRenamed("digest", "subroot").join(tops.withColumnRenamed("name", "tree"), "tree").select("tree", "n", "subroot", "path", "shape")
    trees = stored(trees, "tree-tops")
    most = trees.agg(F.max("n")).first()[0] or 0
    return attach(m.leaves, m.nodes, trees, most).select("doc_id", "digest", "altered", "subroot", "path", "shape")


CHECKED = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def fold(start: bytes, path: bytes, shape: str) -> str:
    """The root (hex) that a leaf digest (hex) and the siblings (hex) on its path lead to."""
    at = 0
    for s in shape:
        place, others = divmod(_SHAPES.index(s), ARITY)
        mid, end = at + 64 * place, at + 64 * others
        start = hashlib.sha256(path[at:mid] + start + path[mid:end]).hexdigest().encode()
        at = end
    return start.decode()


def checked(found: DataFrame) -> DataFrame:
    """Proof digests, and the root recomputed from each leaf, the altered one if there is one, and its original siblings."""

    def run(batches):
        for b in batches:
            out = []
            for doc_id, digest, altered, subroot, path, shape in zip(*(c.to_pylist() for c in b.columns), strict=True):
                path = binascii.hexlify(path)
                out.append((doc_id, digest.hex(), subroot.hex(), hashlib.sha256(path).hexdigest(), fold(binascii.hexlify(altered or digest), path, shape)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names=[x.split()[0] for x in CHECKED.split(", ")])

    return found.select("doc_id", "digest", "altered", "subroot", "path", "shape").mapInArrow(run, CHECKED)


ORACLE = r"""
WITH RECURSIVE
bits(i, k, v) AS (
  SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), v >> 1) ELSE v >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL),
crc(doc_id, s, pos, v) AS (
  SELECT doc_id, s, 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL SELECT doc_id, s, pos + 1, xor(t[(xor(v, CAST(ascii(substr(s, pos + 1, 1)) AS BIGINT)) & 255) + 1], v >> 8) FROM crc, tab WHERE pos < length(s)),
tampered AS (SELECT doc_id FROM crc WHERE pos = length(s) AND xor(v, CAST(4294967295 AS BIGINT)) % 2 = 0),
fields AS (
  SELECT d.doc_id, coalesce('s' || source, '-') AS tree, row_number() OVER () AS id,
    CASE WHEN d.doc_id IS NULL THEN '-' ELSE strlen(CAST(d.doc_id AS VARCHAR)) || ':' || CAST(d.doc_id AS VARCHAR) END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
    || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR) END AS head,
    text, CASE WHEN t.doc_id IS NULL THEN text ELSE replace(text, chr(10), '') END AS other
  FROM documents d LEFT JOIN tampered t ON d.doc_id = t.doc_id),
leaves AS (
  SELECT id, doc_id, tree, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(head || CASE WHEN other IS NULL THEN '-' ELSE strlen(other) || ':' || other END) AS altered FROM fields),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS rank FROM leaves),
low(tree, level, idx, d) AS (
  SELECT tree, 0, rank, leaf FROM ranked
  UNION ALL SELECT tree, level + 1, idx // 3, sha256(string_agg(d, '' ORDER BY idx))
    FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS m FROM low) WHERE m > 1 GROUP BY tree, level, idx // 3),
subroots AS (SELECT tree, arg_max(d, level) AS subroot, CAST(max(level) AS BIGINT) AS height FROM low GROUP BY tree),
high(level, idx, d) AS (
  SELECT 0, row_number() OVER (ORDER BY tree) - 1, subroot FROM subroots
  UNION ALL SELECT level + 1, idx // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS m FROM high) WHERE m > 1 GROUP BY level, idx // 3),
tops AS (SELECT tree, subroot, height, row_number() OVER (ORDER BY tree) - 1 AS place FROM subroots),
root AS (SELECT arg_max(d, level) AS root, CAST(max(level) AS BIGINT) AS height FROM high),
siblings AS (
  SELECT r.id, 0 AS part, l.level, l.idx, l.d FROM ranked r JOIN tops t ON r.tree = t.tree JOIN low l
    ON l.tree = r.tree AND l.level < t.height AND l.idx // 3 = r.rank // CAST(3 ** (l.level + 1) AS BIGINT) AND l.idx <> r.rank // CAST(3 ** l.level AS BIGINT)
  UNION ALL
  SELECT r.id, 1, h.level, h.idx, h.d FROM ranked r JOIN tops t ON r.tree = t.tree JOIN high h
    ON h.level < (SELECT height FROM root) AND h.idx // 3 = t.place // CAST(3 ** (h.level + 1) AS BIGINT) AND h.idx <> t.place // CAST(3 ** h.level AS BIGINT)),
paths AS (SELECT id, sha256(string_agg(d, '' ORDER BY part, level, idx)) AS proof FROM siblings GROUP BY id),
fold_low(id, tree, level, own, c) AS (
  SELECT id, tree, 0, rank, altered FROM ranked
  UNION ALL SELECT f.id, f.tree, f.level + 1, f.own // 3, sha256(string_agg(CASE WHEN l.idx = f.own THEN f.c ELSE l.d END, '' ORDER BY l.idx))
    FROM fold_low f JOIN tops t ON f.tree = t.tree AND f.level < t.height JOIN low l ON l.tree = f.tree AND l.level = f.level AND l.idx // 3 = f.own // 3
    GROUP BY f.id, f.tree, f.level, f.own),
fold_high(id, level, own, c) AS (
  SELECT f.id, 0, t.place, f.c FROM fold_low f JOIN tops t ON f.tree = t.tree AND f.level = t.height
  UNION ALL SELECT f.id, f.level + 1, f.own // 3, sha256(string_agg(CASE WHEN h.idx = f.own THEN f.c ELSE h.d END, '' ORDER BY h.idx))
    FROM fold_high f JOIN high h ON h.level = f.level AND f.level < (SELECT height FROM root) AND h.idx // 3 = f.own // 3 GROUP BY f.id, f.level, f.own)
SELECT r.doc_id, r.leaf, t.subroot, x.root, coalesce(p.proof, sha256('')) AS proof_sha256, f.c AS folded_root, f.c = x.root AS verified
FROM ranked r JOIN tops t ON r.tree = t.tree CROSS JOIN root x JOIN fold_high f ON f.id = r.id AND f.level = x.height LEFT JOIN paths p ON p.id = r.id
"""
