"""Exact top-k search by inner product with a three-phase uniform threshold (after Cao and Wang 2004).

A vector is cut into ``SEGMENTS`` parts; a score is the sum of the parts' partial scores.

1. Each task gathers, for each query and part, its rows with the highest partial scores; only these get whole scores.  The
   k-th highest whole score of all gathered rows is a safe cutoff ``t`` of the query: at least k rows reach it.
2. The cutoffs go to all tasks.  A row that reaches ``t`` has a partial score of at least ``t / SEGMENTS`` in some part;
   each task collects those entries.  A part of a row whose length times that of the query's part is below
   ``t / SEGMENTS`` cannot be such an entry and is not scored.
3. The missing partial scores of the collected entries are computed and added; rows that reach ``t`` are ranked.

Queries go in blocks against slices of all rows: a row of the join is one block and one slice, both of bounded size, and
both are dealt by a hash of (block, slice), so neither a common vector nor many queries make a large task.  Vectors are
scaled to integers; scores are exact (double arithmetic below 2**50, arbitrary precision integers beyond).

Edge cases: vectors that are null or hold null or non-finite components, and rows without id, take no part; vectors of
another dimension than the query's have no score; rows with the query's own id are its own, repeated query rows ask once, other repeated rows count each; ties go to the smaller id;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lurewatch.llm.common import stored

SCALE, K, SEGMENTS = 1024, 10, 4
QUERY_BLOCK, ROW_SLICE, STEP = 1024, 8192, 1024


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, dim, v`` of the rows that take part; v holds floor(scale * x) as doubles."""
    x = F.col("x")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = rows.where(F.coalesce(good, F.lit(False)))
    # multiplied and floored in double: floor() of Spark would return a long
    v = F.transform(x, lambda e: F.rint(e * scale) - F.when(F.rint(e * scale) > e * scale, F.lit(1.0)).otherwise(F.lit(0.0)))
    return rows.select("vec_id", F.size("x").alias("dim"), v.alias("v"))


def _fits(q: np.ndarray, r: np.ndarray) -> bool:
    """Whether every sum of products is exact in doubles."""
    return bool(q.shape[1] * np.abs(q).max(initial=0) * np.abs(r).max(initial=0) < 2.0**50)


def _scores(q: np.ndarray, r: np.ndarray, small: bool | None = None) -> np.ndarray:
    if _fits(q, r) if small is None else small:
        return q @ r.T
    whole = lambda a: np.array([[int(e) for e in row] for row in a], dtype=object).reshape(a.shape)
    return whole(q).dot(whole(r).T)


def _pair_scores(q: np.ndarray, r: np.ndarray, i: np.ndarray, j: np.ndarray, small: bool) -> np.ndarray:
    """Scores of the pairs (query i, row j) alone, in blocks, so memory stays bounded."""
    if not small:
        return np.array([sum(int(x) * int(y) for x, y in zip(q[a], r[b], strict=True)) for a, b in zip(i, j, strict=True)], dtype=object)
    step = max(1, 1_000_000 // max(1, q.shape[1]))
    return np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", q[i[a : a + step]], r[j[a : a + step]]) for a in range(0, len(i), step)]])


def _rounded_down(reach: np.ndarray, every: np.ndarray) -> np.ndarray:
    """A little below what a part must reach, so rounding loses no entry; without a cutoff, below everything."""
    return np.where(every, -np.inf, reach - np.abs(reach) * 1e-9 - 1.0)


def _within_reach(q: np.ndarray, r: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Queries and rows whose lengths allow an entry (a product is at most the product of both lengths)."""
    with np.errstate(over="ignore", invalid="ignore"):
        ql, rl = np.linalg.norm(q, axis=1), np.linalg.norm(r, axis=1)
        return ~(ql * rl.max(initial=0) * (1 + 1e-9) < reach), ~(rl * ql.max(initial=0) * (1 + 1e-9) < reach.min(initial=np.inf))


def _as_double(scores: np.ndarray) -> np.ndarray:
    """Scores for choosing candidates: whole numbers beyond a double's range are cut to that of a long."""
    return scores if scores.dtype != object else np.array([_longs(row) for row in scores], np.float64).reshape(scores.shape)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to smaller ids."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    return np.lexsort((ids, -scores))[:k]


def _longs(scores: np.ndarray) -> list[int]:
    """Scores as longs; those beyond the range of a long become its end."""
    return [max(-(2**63), min(2**63 - 1, int(s))) for s in scores]


def _matrix(col: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate(col.to_list()).reshape(len(col), dim) if dim else np.zeros((len(col), 0))


RESULT = "query_id long, vec_id long, score long"


def _gather(k: int, segments: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            dim = int(rows["dim"].iloc[0])
            q, r, ids = _matrix(queries["v"], dim), _matrix(rows["v"], dim), rows["vec_id"].to_numpy()
            cuts = np.linspace(0, dim, segments + 1).astype(int)
            for at in range(0, len(q), STEP // 4):
                part = q[at : at + STEP // 4]
                own = queries["vec_id"].to_numpy()[at : at + STEP // 4]
                n = min(k + 1, len(ids))  # one more, as the query's own row may be among them
                chosen = [np.argpartition(-_as_double(_scores(part[:, a:b], r[:, a:b])), n - 1, axis=1)[:, :n] for a, b in zip(cuts, cuts[1:], strict=False)]
                for i, qid in enumerate(own):
                    c = np.unique(np.concatenate([x[i] for x in chosen]))
                    c = c[ids[c] != qid]
                    total = _scores(part[i : i + 1], r[c])[0]  # whole scores of the chosen rows only
                    best = _best(total, ids[c], k)
                    out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[c[best]], "score": _longs(total[best])}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return run


def _collect(k: int, segments: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            dim = int(rows["dim"].iloc[0])
            q, r, ids, own = _matrix(queries["v"], dim), _matrix(rows["v"], dim), rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            cutoff, every = queries["cutoff"].to_numpy(), queries["every"].to_numpy(bool)
            small = _fits(q, r)
            cuts = np.linspace(0, dim, segments + 1).astype(int)
            parts = list(zip(cuts, cuts[1:], strict=False))
            reach = _rounded_down(cutoff / segments, every)
            for at in range(0, len(ids), STEP):
                some = r[at : at + STEP]
                sent = np.repeat(every[:, None], len(some), axis=1)
                total = np.zeros(sent.shape, float if small else object)
                scored = []
                for a, b in parts:
                    asks, near = _within_reach(q[:, a:b], some[:, a:b], reach)
                    scored.append((asks, near))
                    partial = _scores(q[asks, a:b], some[near, a:b], small)
                    total[np.ix_(asks, near)] += partial
                    sent[np.ix_(asks, near)] |= (partial * segments >= cutoff[asks][:, None]).astype(bool)
                i, j = np.nonzero(sent)
                total = total[i, j]
                for (a, b), (asks, near) in zip(parts, scored, strict=True):
                    missing = np.flatnonzero(~(asks[i] & near[j]))
                    total[missing] += _pair_scores(q[:, a:b], some[:, a:b], i[missing], j[missing], small)
                ok = (every[i] | (total >= cutoff[i]).astype(bool)) & (ids[at + j] != own[i])
                out.append(pd.DataFrame({"query_id": own[i[ok]], "vec_id": ids[at + j[ok]], "score": _longs(total[ok])}))
        both = pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        both = both.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return both.groupby("query_id").head(k)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, segments: int = SEGMENTS, query_block: int = QUERY_BLOCK, row_slice: int = ROW_SLICE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows of ``vectors`` for each row of ``queries`` (both as integer_vectors gives)."""
    vectors = stored(vectors, "vectors")
    queries = stored(queries.groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.dim", "q.v"), "queries")
    slices = max(1, -(-vectors.count() // row_slice))
    blocks = max(1, -(-queries.count() // query_block))
    by_id = F.xxhash64("vec_id")
    right = vectors.withColumn("slice", F.pmod(by_id, F.lit(slices)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    keys = ["dim", "block", "slice"]

    def run(q: DataFrame, fn) -> DataFrame:
        return q.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(fn, RESULT)

    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    gathered = stored(ranked(run(left, _gather(k, segments))), "gathered")
    cutoff = gathered.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("cutoff"))
    # fewer than k rows in all, or scores beyond a long: no cutoff, everything counts
    left = left.join(cutoff, left.vec_id == cutoff.query_id, "left").drop("query_id")
    left = left.withColumn("every", F.coalesce(F.col("cutoff") <= -(2**62), F.lit(True))).withColumn("cutoff", F.coalesce("cutoff", F.lit(0)))
    return ranked(run(left, _collect(k, segments))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
