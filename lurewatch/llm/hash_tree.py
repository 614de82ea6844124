"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard, each by weighted hash draws.

At each level every child draws ``ln(u) / weight`` with ``u`` hashed from the document id and the child's name; the
largest draw wins.  A child's draw depends on its own weight only, so a changed weight moves rows only into (weight up)
or out of (weight down) that child, and nothing moves among the others: movement stays in subtrees whose weights change.
An interior node's weight is set by its owner, not summed from its children.  A shard added under a region of its own
therefore takes rows only into itself.

The tree is a small table ``(region, rack, shard, region_weight, rack_weight, shard_weight)``; its literal form has one
entry per node.  Everything runs in JVM expressions.  The position in a shard is a two-level prefix sum: rows get a hash
bucket within their shard, bucket counts are summed up in order, rows are numbered inside their bucket.

Edge cases: a null text has size 1 and checksum 0; a null doc_id is hashed as its own value; repeated rows get the same
shard and different slots; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lurewatch.llm.common import stored

Tree = list[tuple[str, float, list[tuple[str, float, list[tuple[int, float]]]]]]
BUCKET_ROWS = 5_000
SHARDS, PER_RACK, PER_REGION = 8, 2, 4


def layout(shards: int, base: int = SHARDS) -> Tree:
    """Shards 0 to base-1 in racks of two and regions of four, all of weight 1 per shard; each further shard opens a region of its own."""
    tree: Tree = []
    for r in range(0, min(shards, base), PER_REGION):
        own = range(r, min(r + PER_REGION, shards, base))
        racks = [(f"r{r // PER_REGION}k{k}", float(len(s)), [(x, 1.0) for x in s]) for k in range(0, len(own), PER_RACK) if (s := own[k : k + PER_RACK])]
        tree.append((f"r{r // PER_REGION}", float(len(own)), racks))
    return tree + [(f"new{s}", 1.0, [(f"new{s}k0", 1.0, [(s, 1.0)])]) for s in range(base, shards)]


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + F.lit(1.0)) / F.lit(float(2**53 + 1))
    return F.log(u) / F.lit(weight)


def _descend(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the largest draw (ties: the first)."""
    if len(children) == 1:
        return children[0][2]
    draws = F.array(*[F.struct(_draw(key, n, w).alias("d"), F.lit(-i).alias("i")) for i, (n, w, _) in enumerate(children)])
    best = F.array_max(draws)
    return F.element_at(F.transform(F.array(best["i"]), lambda i: _pick(i, children)), 1)


def _pick(i: Column, children: list[tuple[str, float, Column]]) -> Column:
    out = F.when(i == 0, children[0][2])
    for k, c in enumerate(children[1:], 1):
        out = out.when(i == -k, c[2])
    return out


def tree_shard(key: Column, tree: Tree) -> Column:
    """The shard of a key: draws are made only in the chosen subtree."""
    positive = lambda kids: [c for c in kids if c[1] > 0]
    regions = []
    for region, rw, racks in positive(tree):
        inner = [(rack, kw, _descend(key, [(f"s{s}", sw, F.lit(s)) for s, sw in positive(shards)])) for rack, kw, shards in positive(racks)]
        regions.append((region, rw, _descend(key, inner)))
    return _descend(key, regions)


def shard_documents(docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row; law ``key``."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    grown_shard = tree_shard(key, grown) if grown is not None else F.lit(None).cast("int")
    rows = stored(rows.withColumns({"shard": tree_shard(key, tree).cast("int"), "grown_shard": grown_shard.cast("int")}), "sharded")
    parts = max(1, -(-rows.count() // bucket_rows))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(parts)))
    sums = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = sums.select("shard", "bucket", (F.sum("c").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("c")).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    out = rows.withColumn("r", within).join(before, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("r") - 1).cast("long").alias("slot"), "grown_shard")
