"""Exact top-k by columnar branch and bound.

Vectors lie in blocks by dimension: row d of a block holds component d of all its vectors. For a block of queries the inner products are
summed over one group of dimensions after the other. After each group, what the rest can still add is at most the product of the two
remaining norms; candidates whose bound stays under the query's k-th score are dropped and the survivors compacted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from veil.llm.common import query, stored, table

BLOCK_NUMBERS = 1 << 20
QUERIES_AT_ONCE = 1024
STEP = 16
EXACT = float(1 << 53)


def usable(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): components floor(scale * x) as long; null vectors and those with null or non-finite components are left out.

    An empty vector takes part with score 0; a shorter one counts as zero where it ends. Values beyond a long saturate.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & finite & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def stacked(column: pd.Series, dims: int) -> np.ndarray:
    """Vertical layout: an array of dims x rows."""
    out = np.zeros((dims, len(column)), np.int64)
    for i, v in enumerate(column):
        out[:len(v), i] = v
    return out


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))[:k]]


def search(query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query_id, vec_ids, scores) of each query's best k of the block; ``floors`` are scores that k other rows are known to reach."""
    dims = len(data)
    reach = np.abs(queries).max(initial=0) * float(np.abs(data).max(initial=0)) * dims
    if reach >= EXACT:  # too large for exact doubles: whole products in integers
        for n, q in enumerate(query_ids):
            rows = np.flatnonzero(ids != q)
            score = (queries[:, n:n + 1] * data[:, rows]).sum(axis=0)
            top = best(ids[rows], score, k)
            yield q, ids[rows][top], score[top]
        return
    queries, data = queries.astype(np.float64), data.astype(np.float64)
    # Dimensions of much mass first, so that little remains for the bounds.
    order = np.argsort(-(data * data).sum(axis=1), kind="stable")
    queries, data = queries[order], data[order]
    rest_d = np.sqrt(np.cumsum((data * data)[::-1], axis=0)[::-1])
    rest_q = np.sqrt(np.cumsum((queries * queries)[::-1], axis=0)[::-1])
    first = queries[:STEP].T @ data[:STEP]
    for n, q in enumerate(query_ids):
        part, alive, floor = first[n], None, floors[n]
        for at in range(STEP, dims, STEP):
            tail = rest_d[at] if alive is None else rest_d[at, alive]
            spread = rest_q[at, n] * tail * (1 + 1e-9)
            if len(part) > k:  # k rows reach at least their lower bounds
                low = part - spread
                floor = max(floor, np.partition(low, len(low) - k - 1)[len(low) - k - 1] if len(low) > k + 1 else floor)
            keep = np.flatnonzero(part + spread >= floor)
            alive = keep if alive is None else alive[keep]
            part = part[keep] + queries[at:at + STEP, n] @ data[at:at + STEP, alive]
        alive = np.arange(len(ids)) if alive is None else alive
        own = ids[alive] != q
        rows, score = alive[own], part[own]
        top = best(ids[rows], score, k)
        top = top[score[top] >= floors[n]]
        yield q, ids[rows][top], score[top].astype(np.int64)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose vec_id is divisible by ``every``, itself left out.

    Rows and queries meet as blocks: each data block of ``BLOCK_NUMBERS`` numbers meets each query block of ``QUERIES_AT_ONCE`` once, so a task holds
    one pair of blocks whatever the table's size. A first pass over one data block gives every query a floor for all others. Repeated
    vec_ids are rows of their own, left out as candidates of the query with their id; fewer than k candidates give fewer rows.
    """
    rows = stored(usable(vectors), "vectors")
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q")).first()
    dims = max(1, shape["dims"] or 0)
    data_blocks, query_blocks = (max(1, -(-(n or 0) // size)) for n, size in ((shape["n"], max(256, BLOCK_NUMBERS // dims)), (shape["q"], QUERIES_AT_ONCE)))
    data = rows.withColumn("b", F.floor(F.rand(1) * data_blocks).cast("long"))
    asked = stored(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).withColumn("g", F.floor(F.rand(2) * query_blocks).cast("long")), "queries")

    def block(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            found = search(left["vec_id"].to_numpy(), stacked(left["v"], dims), left["floor"].fillna(-np.inf).to_numpy(np.float64),
                           right["vec_id"].to_numpy(), stacked(right["v"], dims), k)
            out = [pd.DataFrame({"query_id": q, "vec_id": i, "score": s}) for q, i, s in found]
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    def met(queries: DataFrame, part: DataFrame, first: int, last: int) -> DataFrame:
        each = queries.withColumn("b", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
        dealt = part.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
        return each.groupBy("g", "b").cogroup(dealt.groupBy("g", "b")).applyInPandas(block, "query_id long, vec_id long, score long")

    none = asked.withColumn("floor", F.lit(None).cast("double"))
    stored_data = stored(data, "blocks")
    start = stored(met(none, stored_data.where("b = 0"), 0, 0), "first")
    found = start
    if data_blocks > 1:
        floor = start.groupBy("query_id").agg(F.min("score").cast("double").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k)
        known = asked.join(floor.select(F.col("query_id").alias("vec_id"), "floor"), "vec_id", "left")
        found = start.unionByName(met(known, stored_data.where("b > 0"), 1, data_blocks - 1))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum([z[1] * z[2] for z in list_zip(q.v, c.v, true)]), 0)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op3_exact_top_k", _SQL)
def op3_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best inner products of every 20th vector."""
    return top_k(table(spark, folder, "embeddings"))
