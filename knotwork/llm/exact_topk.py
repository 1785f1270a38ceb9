"""Exact top-k search by inner product: columnar branch and bound.

Vectors are dealt into cells: query group g of G times candidate group h of H, by a hash of vec_id. A cell holds at most about
QUERIES_A_CELL queries and CANDIDATES_A_CELL candidates, whatever the table's size, and yields k rows a query; a window with a group
limit merges them. Copying each side to the other's groups is what any exact search of a query set against all rows needs; nothing
is broadcast and no cell grows with the data.

Inside a cell candidates lie in vertical layout (dimension by candidate). For each query the partial products are accumulated
DIMS_A_BLOCK dimensions at a time; after every block the candidates whose partial score plus remaining mass (the product of the norms
of what is left, by Cauchy-Schwarz) stays below the k-th best known score are dropped and the survivors compacted. One cell a query
group is searched first, and the k-th best score there is where all other cells begin, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, table

K = 5
QUERY_EVERY = 50
SCALE = 256.0
QUERIES_A_CELL = 2048
CANDIDATES_A_CELL = 4096
DIMS_A_BLOCK = 8


def exact_scores(query: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Integer inner products, as long as they fit, otherwise the nearest long."""
    if float(np.abs(query).max(initial=0)) * float(np.abs(columns).max(initial=0)) * max(len(query), 1) < 2.0**62:
        return query @ columns
    sums = [sum(x * y for x, y in zip(query.tolist(), column, strict=True)) for column in columns.T.tolist()]
    return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in sums], dtype=np.int64)


def search_cell(query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int) -> pd.DataFrame:
    """The k best candidates of each query. queries: query by dimension; columns: dimension by candidate; both 64-bit integers.

    floors: a score that k other candidates are known to reach, or -inf. Candidates are ordered by id; ties go to the smaller id. A
    candidate with the query's own id is left out. Bounds are in floating point and allow for its rounding; the scores of what is left
    are computed in integers wherever a sum may pass 2 ** 53.
    """
    dims, n = columns.shape
    edges = list(range(0, dims, DIMS_A_BLOCK)) or [0]
    blocks = [(a, min(a + DIMS_A_BLOCK, dims)) for a in edges]
    reals = columns.astype(np.float64)
    squares = np.stack([np.einsum("ij,ij->j", reals[a:b], reals[a:b]) for a, b in blocks]) if n else np.zeros((len(blocks), 0))
    rest = np.sqrt(np.concatenate([np.cumsum(squares[::-1], axis=0)[::-1][1:], np.zeros((1, n))]))
    norms = np.sqrt(squares.sum(axis=0))
    found = [(np.zeros(0, dtype=np.int64),) * 3]
    for query_id, whole_query, floor in zip(query_ids, queries, floors, strict=True):
        query = whole_query.astype(np.float64)
        norm = float(np.sqrt(query @ query))
        left = [float(np.sqrt(query[b:] @ query[b:])) for _, b in blocks]
        known = floor > -np.inf  # then bounds of this cell's own would seldom be better
        # what is left: candidates, their columns from dimension ``base`` on, rounding error and remaining masses
        who, here, base, error, masses = np.arange(n), reals, 0, norms * (norm * 1e-12), rest
        partial = np.where(ids == query_id, -np.inf, 0.0)
        for j, (a, b) in enumerate(blocks):
            partial = partial + query[a:b] @ here[a - base : b - base]
            slack = left[j] * masses[j] + error
            if len(who) > k and (not known or b == dims):
                # the k-th best lower bound is no higher than the k-th best score
                floor = max(floor, np.partition(partial - slack, len(who) - k)[len(who) - k])
                if len(who) > 4 * k and b < dims and not j % 3:
                    some = np.argpartition(partial, len(who) - k)[-k:]
                    floor = max(floor, (partial[some] + query[b:] @ here[b - base :, some] - error[some]).min())
            keep = partial + slack >= floor - 1e-6
            # copying pays when less than half is left
            if b == dims or 2 * np.count_nonzero(keep) < len(keep):
                who, partial, error, masses = who[keep], partial[keep], error[keep], masses[:, keep]
                here, base = here[b - base :, keep], b
        who, partial = who[partial > -np.inf], partial[partial > -np.inf]
        exact = norm * norms[who].max(initial=0) < 2.0**52
        scores = np.rint(partial).astype(np.int64) if exact else exact_scores(whole_query, columns[:, who])
        order = np.lexsort((ids[who], ~scores))[:k]  # ~x is -x - 1, which every long has
        found.append((np.full(len(order), query_id, dtype=np.int64), ids[who][order], scores[order]))
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True))).astype("int64")


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v (whole numbers): the rows that take part."""
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE))
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), whole.alias("v"))


def top_k(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query with all other rows.

    Components x become floor(256 x). Rows whose key is null, or whose vector is null or holds null or non-finite components, take no
    part. Only vectors of the query's own length are compared. Rows that share the query's key are the query's own; other repeated
    rows all compete, ties going to the smaller key. Scores are exact wherever they fit a long; beyond, they are the nearest long.
    Other columns are left out; an empty table gives no rows.
    """
    rows = usable(vectors, key, vector)
    asked = rows.where(F.pmod("vec_id", F.lit(query_every)) == 0)
    n, n_asked = rows.count(), asked.count()
    down, across = max(1, -(-n // CANDIDATES_A_CELL)), max(1, -(-n_asked // QUERIES_A_CELL))
    spread = F.xxhash64("vec_id", F.lit("cell"))
    dims = F.size("v").alias("dims")
    right = rows.select(dims, F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("g"), F.pmod(spread, F.lit(down)).cast("int").alias("h"), "vec_id", "v")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def cell(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or candidates.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        candidates = candidates.sort_values("vec_id", kind="stable")
        width = len(queries["v"].iloc[0])
        q = np.array(queries["v"].tolist(), dtype=np.int64).reshape(len(queries), width)
        c = np.ascontiguousarray(np.array(candidates["v"].tolist(), dtype=np.int64).reshape(len(candidates), width).T)
        floors = queries["floor"].fillna(-np.inf).to_numpy(dtype=np.float64)
        return search_cell(queries["vec_id"].to_numpy(), q, floors, candidates["vec_id"].to_numpy(), c, k)

    def searched(queries: DataFrame, cells: list[int]) -> DataFrame:
        """The k best of each query in the cells of these candidates."""
        left = queries.select(dims, F.pmod(spread, F.lit(across)).cast("int").alias("g"), F.explode(F.array(*[F.lit(h) for h in cells]) if len(cells) == 1 else F.sequence(F.lit(cells[0]), F.lit(cells[-1]))).alias("h"), "vec_id", "v", "floor")
        keys = ("dims", "g", "h")
        some = right if len(cells) == down else right.where(F.col("h").between(cells[0], cells[-1]))
        best = left.groupBy(*keys).cogroup(some.groupBy(*keys)).applyInPandas(cell, "query_id long, vec_id long, score long")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    queries = asked.dropDuplicates().withColumn("floor", F.lit(None).cast("double"))
    if down > 1:
        # the first cell is searched first: what it holds is a bound for all others, so they prune from their first block on
        scratch = Scratch(vectors.sparkSession, "exact-topk")
        first = scratch.save(searched(queries, [0]))
        known = first.where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").cast("double").alias("bound"))
        queries = queries.join(known, F.col("vec_id") == F.col("of"), "left").select("vec_id", "v", (F.col("bound") - F.abs("bound") * 1e-12).alias("floor"))
        queries = scratch.save(queries)
        rest = searched(queries, list(range(1, down))).drop("rank").unionByName(first.drop("rank"))
        best = rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    else:
        best = searched(queries, [0])
    return best.select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP6_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % {QUERY_EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
