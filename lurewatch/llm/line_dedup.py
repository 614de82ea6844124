"""Line dedup across documents, in DataFrame operations only.

Lines are exploded as normalised keys with their positions and hashed (128 bits); a key of at least ``MIN_CHARS`` code
points that at least ``MIN_DOCS`` documents hold is kept only in the largest doc_id holding it.  The narrow table of
hashes is written once; counting documents per hash combines before each shuffle, so a line that a third of all documents
hold costs one row per task.  The positions that a text loses come back as one array of integers per text (named by
doc_id and text hash), and its other lines are put together again by position, in time linear in its lines.  Texts stay
where they are while the array table is within ``BROADCAST_BYTES``; beyond that they are shuffled to it once.

Edge cases: null and empty texts are one empty line; rows with the same doc_id are one document for counting and lose
the same lines, whatever their texts; null doc_ids count as one document, below all others; a document may become empty,
with an empty text; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import BLANKS, LOWER, UPPER, small_batches, stored
from lurewatch.session import sized_broadcast

MIN_CHARS, MIN_DOCS, BROADCAST_BYTES = 20, 3, 32 << 20
_NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    return F.trim(F.translate(line, UPPER, LOWER), F.lit(BLANKS))


def _hash(key: Column) -> Column:
    return F.unhex(F.md5(key.cast("binary")))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text",
                broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with its columns, the text without repeated lines, and ``__n_lines`` and ``__n_dropped``."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    ids, same = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)), F.xxhash64(text)
    lines = docs.select(ids.alias("d"), same.alias("t"), F.posexplode(F.transform(F.split(text, "\n"), line_key)).alias("pos", "key"))
    held = stored(lines.where(F.char_length("key") >= min_chars).select("d", "t", "pos", _hash(F.col("key")).alias("h")), "line-hashes")
    common = held.groupBy("h", "d").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("keeper")).where(F.col("n") >= min_docs)
    common = stored(common.select("h", "keeper"), "common-lines")
    drops = held.join(sized_broadcast(common, 200_000), "h").where("d < keeper").groupBy("d", "t").agg(F.collect_set("pos").alias("__drops"))
    drops = stored(drops.select(F.col("d").alias("__d"), F.col("t").alias("__t"), "__drops"), "drops")
    size = drops.agg(F.sum(F.size("__drops") * 4 + 24)).first()[0] or 0
    rows = docs.join(F.broadcast(drops) if size <= broadcast_bytes else drops, (ids == F.col("__d")) & (same == F.col("__t")), "left")
    # a generated row is a barrier: the text is split once, not again for every position
    rows = rows.withColumn("__l", F.explode(F.array(F.struct(F.when(F.col("__drops").isNotNull(), F.split(text, "\n")).alias("lines")))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__l.lines") - 1), F.col("__drops"))
    kept = F.array_join(F.transform(kept, lambda i: F.col("__l.lines")[i]), "\n")
    n_lines = (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    rows = rows.withColumn("__kept", F.when(F.col("__drops").isNull(), text).otherwise(kept))
    return rows.select(*[F.col("__kept").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
                       n_lines.alias("__n_lines"), F.coalesce(F.size("__drops"), F.lit(0)).cast("long").alias("__n_dropped"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, line, pos, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.doc_id, l.line, l.pos, c.keeper IS NOT NULL AND l.doc_id <> c.keeper AS dropped FROM lines l LEFT JOIN common c ON l.key = c.key AND length(l.key) >= 20)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
