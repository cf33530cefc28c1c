"""Vector search and statistics (V01-V11) on an embedding table.

No (query, vector) pair is ever a row.  A search deals the vectors into parts of at most
``PART_ROWS`` and the queries into blocks of at most ``QUERY_ROWS``; every part meets every block of
its group in one run of a sorted partition, where the part is held as a matrix and
the queries pass by: one matrix product, ``argpartition`` for the k best, whose scores are then
summed in column order so that equal vectors tie exactly.  A task hands on k rows per query;
``row_number`` over the query merges them.  Nothing is collected, and the number of queries is
not limited.  The stored inverted-file index is ``operators.ivf``, which
searches by the same blocks with the cell as the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmill.functions import vectors as vx
from textmill.functions.sqltext import SPARK
from textmill.session import written

#: Vectors one task holds as a matrix, and queries that pass by it.
PART_ROWS = 1 << 16
QUERY_ROWS = 1 << 16
#: Scores held at once.
SCORES = 1 << 22


def dot(a: str, b: str) -> Column:
    return F.expr(vx.dot(SPARK, a, b))


def l2_normalise(c: str) -> Column:
    return F.expr(vx.l2_normalise(SPARK, c))


def knn_exact(vectors: DataFrame, query: list[float], k: int, id_col: str = "id",
              vec_col: str = "embedding") -> DataFrame:
    """One query vector -> top-k by inner product (ties by id); TakeOrderedAndProject."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("__q", q).select(F.col(id_col), dot(vec_col, "__q").alias("score"))
    top = scored.orderBy(F.desc("score"), F.col(id_col)).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), F.col(id_col))))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as float64 rows; vectors of different lengths are an error."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(flat) // max(len(column), 1)
    lens = np.diff(column.offsets.to_numpy())
    if (lens != width).any():
        raise ValueError(f"vectors of {lens.min()} and {lens.max()} components")
    return flat.reshape(len(column), width)


def best_pairs(queries: np.ndarray, vectors: np.ndarray, order: np.ndarray, k: int, l2: bool):
    """(query, vector, score) of the ``k`` best of each query by inner product, or by least squared
    distance with its negative as the score; ties by ``order``, the rank of each vector's id."""
    n = len(vectors)
    rough = queries @ vectors.T
    if l2:
        rough = 2 * rough - np.einsum("ij,ij->i", vectors, vectors)
    least = np.partition(rough, n - k, axis=1)[:, n - k] if k < n else rough.min(axis=1)
    # The product may round equal vectors apart: take what is as good but for that, and score it exactly.
    size = 1 + np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * vectors.shape[1]
    q, v = np.nonzero(rough >= (least - 1e-9 * size)[:, None])
    score = np.zeros(len(q))
    for at in range(0, len(q), SCORES):
        part = slice(at, at + SCORES)
        for d in range(vectors.shape[1]):
            x, y = queries[q[part], d], vectors[v[part], d]
            score[part] += -((x - y) ** 2) if l2 else x * y
    best = np.lexsort((order[v], -score, q))
    first = np.searchsorted(q[best], np.arange(len(queries)))
    best = best[np.arange(len(best)) - first[q[best]] < k]
    return q[best], v[best], score[best]


def _scorer(k: int, l2: bool):
    """Over rows sorted by (grp, part, block, side): the part's vectors first, then its queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids, vectors, order = None, [], None, None, None
        for b in batches:
            side = np.stack([b.column(i).to_numpy() for i in range(4)])
            starts = np.flatnonzero(np.append(True, (side[:, 1:] != side[:, :-1]).any(axis=0))) if b.num_rows else []
            for s, e in zip(starts, [*starts[1:], b.num_rows], strict=True):
                rows, now = b.slice(s, e - s), tuple(side[:3, s])
                if rows.column(6).null_count:
                    rows = rows.filter(rows.column(6).is_valid())
                if now != key:
                    key, held, vectors = now, [], None
                if side[3, s] == 0:
                    held.append((rows.column(4), matrix(rows.column(6))))
                    continue
                if vectors is None and held:
                    ids = pa.concat_arrays([i for i, _ in held])
                    vectors = np.concatenate([m for _, m in held])
                    order = np.empty(len(ids), np.int64)
                    order[np.argsort(np.array(ids.to_pylist()), kind="stable")] = np.arange(len(ids))
                    held = []
                if vectors is not None and len(vectors):
                    yield from _scored(rows, ids, vectors, order, k, l2)

    return run


def _scored(rows, ids, vectors, order, k, l2):
    queries = matrix(rows.column(6))
    step = max(1, SCORES // len(vectors))
    for at in range(0, len(queries), step):
        q, v, score = best_pairs(queries[at:at + step], vectors, order, k, l2)
        yield pa.RecordBatch.from_arrays(
            [rows.column(5).take(pa.array(q + at)), ids.take(pa.array(v)), pa.array(score)], ["query_id", "id", "score"])


def blocked_topk(vectors: DataFrame, queries: DataFrame, k: int, parts: Column, blocks: Column,
                 l2: bool = False) -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` best vectors (grp, id, vec) of each query (grp, query_id,
    vec) within its groups; a query may be in many.  ``parts`` and ``blocks`` say into how many a
    group's vectors and queries are dealt."""
    kinds = {d.schema["vec"].dataType for d in (vectors, queries)}
    vec = F.col("vec") if len(kinds) == 1 else F.col("vec").cast("array<double>")
    id_type, q_type = vectors.schema["id"].dataType, queries.schema["query_id"].dataType

    def dealt(key: str, n: Column) -> Column:
        return F.pmod(F.xxhash64(key), n).cast("int")

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n.cast("int") - 1))

    # null vectors are left out by the scorer: a filter here would compute an expensive vector twice
    v = vectors.withColumn("part", dealt("id", parts)).withColumn("block", every(blocks))
    q = queries.withColumn("block", dealt("query_id", blocks)).withColumn("part", every(parts))
    keys = [F.col("grp").cast("long").alias("grp"), F.col("part").cast("long").alias("part"), F.col("block").cast("long").alias("block")]
    v = v.select(*keys, F.lit(0).cast("long").alias("side"), "id", F.lit(None).cast(q_type).alias("query_id"), vec.alias("vec"))
    q = q.select(*keys, F.lit(1).cast("long").alias("side"), F.lit(None).cast(id_type).alias("id"), "query_id", vec.alias("vec"))
    met = v.unionByName(q).repartition("grp", "part", "block").sortWithinPartitions("grp", "part", "block", "side")
    found = met.mapInArrow(_scorer(k, l2), f"query_id {q_type.simpleString()}, id {id_type.simpleString()}, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.col("id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def deals(n: int, rows: int, cores: int = 1, least: int = 1024) -> int:
    """Into how many parts ``n`` rows go: at most ``rows`` each, and one a core if they have ``least``."""
    return max(1, -(-n // rows), min(cores, n // least))


def knn_batch(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int,
              id_col: str = "id", vec_col: str = "embedding", qid_col: str = "query_id",
              qvec_col: str = "embedding") -> DataFrame:
    """The ``k`` best vectors of each query by inner product, with score and rank (ties by id)."""
    sides = vectors.select(F.lit(0).alias("side")).unionAll(queries.select(F.lit(1).alias("side")))
    n = {r.side: r["count"] for r in sides.groupBy("side").count().toLocalIterator()}
    parts = deals(n.get(0, 0), PART_ROWS, spark.sparkContext.defaultParallelism)
    blocks = deals(n.get(1, 0), QUERY_ROWS)
    v = vectors.select(F.lit(0).alias("grp"), F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    q = queries.select(F.lit(0).alias("grp"), F.col(qid_col).alias("query_id"), F.col(qvec_col).alias("vec"))
    return blocked_topk(v, q, k, F.lit(parts), F.lit(blocks)) \
        .withColumnRenamed("query_id", qid_col).withColumnRenamed("id", id_col)


# --- statistics (V09-V11) -------------------------------------------------------------------------
def seeded_sample(df: DataFrame, m: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """M rows without replacement, repeatable under any partitioning."""
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    top = df.withColumn("_k", key).orderBy("_k", id_col).limit(m)  # TakeOrderedAndProject: m rows
    return top.withColumn("sample_rank", F.row_number().over(W.orderBy("_k", id_col))).drop("_k")


def vector_mean(df: DataFrame, vec_col: str = "embedding", by: list[str] | None = None) -> DataFrame:
    """Element-wise mean as (by..., pos, mean); vectors are summed as they are (MLlib's
    summarizer, partial in every task), never a row per component."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    by = by or []
    rows = df.filter(F.col(vec_col).isNotNull()).select(*by, array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v"))
    mean = rows.groupBy(*by).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return mean.select(*by, F.posexplode(vector_to_array("_m")).alias("pos", "mean"))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: its count, mean and centred cross products, batches merged pairwise."""
    n, mean, cross = 0, None, None
    for b in batches:
        x = matrix(b.column(0))
        if len(x):
            m = x.mean(axis=0)
            here = (len(x), m, (x - m).T @ (x - m))
            n, mean, cross = here if mean is None else merged_moments((n, mean, cross), here)
    if n:
        yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean.tolist()], "cross": [cross.ravel().tolist()]})


def merged_moments(a: tuple, b: tuple) -> tuple:
    """Moments of two sets from those of each, without loss for a mean far from zero."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def moments(df: DataFrame, vec_col: str = "embedding", fan_in: int = 16) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and centred cross products of all vectors.  Each task folds its batches, then
    ``fan_in`` results at a time are merged until one is left, so no task sees more than that many."""
    schema = "n long, mean array<double>, cross array<double>"

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        found = None
        for n, mean, cross in zip(pdf["n"], pdf["mean"], pdf["cross"], strict=True):
            here = (n, np.asarray(mean), np.asarray(cross).reshape(len(mean), len(mean)))
            found = here if found is None else merged_moments(found, here)
        return pd.DataFrame({"n": [found[0]], "mean": [found[1].tolist()], "cross": [found[2].ravel().tolist()]})

    level = df.select(vec_col).filter(F.col(vec_col).isNotNull()).mapInArrow(_moments, schema)
    level = written(level.withColumn("at", F.spark_partition_id().cast("long")), "moments")
    left = 1 + (level.agg(F.max("at")).first()[0] or 0)
    while left > 1:
        left = -(-left // fan_in)
        level = level.groupBy(F.floor(F.col("at") / fan_in).alias("at")).applyInPandas(
            lambda key, pdf: merge(pdf).assign(at=key[0]), schema + ", at long")
    row = level.first()
    if row is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    return row.n, np.array(row["mean"]), np.array(row.cross).reshape(len(row["mean"]), -1)


def covariance(spark: SparkSession, df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Sample covariance matrix as (i, j, cov): D x D rows."""
    n, _, cross = moments(df, vec_col)
    rows = [(i, j, float(c) / (n - 1) if n > 1 else None) for (i, j), c in np.ndenumerate(cross)]
    return spark.createDataFrame(rows, "i int, j int, cov double")


def principal_axes(df: DataFrame, k: int = 2, vec_col: str = "embedding") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes as rows, variances): the ``k`` directions of greatest variance, each signed so that
    its largest absolute entry is positive."""
    n, mean, cross = moments(df, vec_col)
    values, vectors = np.linalg.eigh(cross / max(n - 1, 1))
    axes = vectors[:, ::-1].T[:k]
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)]) if len(axes) else np.zeros(0)
    return mean, axes * signs[:, None], values[::-1][:k]


def pca_2d(df: DataFrame, vec_col: str = "embedding", id_col: str = "id") -> DataFrame:
    """The centred vectors on their two principal axes; projected in the JVM."""
    mean, axes, _ = principal_axes(df, 2, vec_col)
    centred = F.zip_with(F.col(vec_col), F.array(*map(F.lit, mean.tolist())), lambda x, m: x.cast("double") - m)

    def along(axis: np.ndarray) -> Column:
        parts = F.zip_with("_c", F.array(*map(F.lit, axis.tolist())), lambda x, a: x * a)
        return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)

    return df.select(id_col, centred.alias("_c")).select(id_col, along(axes[0]).alias("x"), along(axes[1]).alias("y"))
