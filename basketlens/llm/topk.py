"""Exact top-k search by block-at-a-time pruning over integer vectors.

Vectors are cut into blocks of consecutive ids. A block keeps, for each dimension, the largest and the
smallest component. For a query, the sum over dimensions of the larger of query times largest and query
times smallest is a bound on every score in the block. Blocks are taken in the order of their bounds and
scored through their forward index (the block as a matrix), until the bounds fall below the
query's kth score. Ties of score go to the smaller id, so blocks whose bound equals the kth score are scored.

Groups of ``QUERIES`` queries meet each range of ``BLOCKS`` blocks once, in tasks of their own; the k best of
each range are merged by query. Nothing is left out, and memory is that of one range and one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.tables import stored

BLOCK = 128
#: Vectors of a range, and queries of a group.
RANGE = 4096
QUERIES = 1024
#: Scores of less than this are exact in doubles.
EXACT = 2.0**53


def integer_vectors(frame: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, without vectors that are null or hold null or non-finite ones."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        frame.where(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.col(vec_id).isNotNull())
        .select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))
    )


def best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple]:
    """query number, vec_id, score of the k best of a range for each query, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    first = np.arange(0, len(ids), BLOCK)
    high, low = np.maximum.reduceat(vectors, first), np.minimum.reduceat(vectors, first)
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
    kind = np.float64 if most < EXACT else object
    queries, vectors, high, low = (x.astype(kind) for x in (queries, vectors, high, low))
    up, down = np.where(queries > 0, queries, 0), np.where(queries < 0, queries, 0)
    bounds = up @ high.T + down @ low.T
    for i, query in enumerate(queries):
        kept_scores, kept_ids = np.zeros(0, dtype=kind), np.zeros(0, dtype=np.int64)
        for b in np.argsort(-bounds[i], kind="stable"):
            if len(kept_ids) == k and bounds[i, b] < kept_scores[-1]:
                break
            here = slice(first[b], first[b] + BLOCK)
            scores, found = vectors[here] @ query, ids[here]
            other = found != query_ids[i]
            if len(kept_ids) == k:
                other &= scores >= kept_scores[-1]
            scores = np.concatenate((kept_scores, scores[other]))
            found = np.concatenate((kept_ids, found[other]))
            top = np.lexsort((found, -scores))[:k]
            kept_scores, kept_ids = scores[top], found[top]
        yield from ((i, int(v), int(s)) for v, s in zip(kept_ids, kept_scores, strict=True))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all vectors but its own id.

    Both frames have vec_id and v (whole numbers). Fewer vectors give fewer rows. Vectors are compared with
    queries of the same length only. Repeated ids are rows of their own: a repeated query gives its
    rows once (they are equal if the vectors are), a repeated vector may be found repeatedly.
    """
    n = vectors.count()
    ranges, groups = max(1, -(-n // RANGE)), max(1, -(-queries.count() // QUERIES))
    # Consecutive ids: ranges by quantile bounds would need a sort; equal shares of hashed id blocks do as well.
    of_range = F.pmod(F.xxhash64(F.floor(F.col("vec_id") / BLOCK)), F.lit(ranges)).cast("int")
    asked = queries.select("vec_id", "v").distinct().select(
        F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("g"), F.size("v").alias("d"), "vec_id", "v", F.lit(True).alias("asks")
    )
    held = vectors.select(of_range.alias("r"), F.size("v").alias("d"), "vec_id", "v", F.lit(False).alias("asks"))
    cells = asked.select(F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("r"), "*").unionByName(
        held.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "*")
    )

    def search(cell: pd.DataFrame) -> pd.DataFrame:
        asks = cell["asks"].to_numpy(dtype=bool)
        q, v = cell[asks], cell[~asks]
        rows: list[tuple] = []
        if len(q) and len(v):
            ids = q["vec_id"].to_numpy()
            matrix = [np.stack(x["v"].to_numpy()).astype(np.int64) for x in (q, v)]
            rows = [(ids[i], f, s) for i, f, s in best(matrix[0], ids, matrix[1], v["vec_id"].to_numpy(), k)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = cells.groupBy("r", "g", "d").applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_table(frame: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """``top_k`` of the rows whose vec_id is divisible by ``every``, against all rows."""
    whole = stored(integer_vectors(frame))
    return top_k(whole.where(F.col("vec_id") % every == 0), whole, k)
