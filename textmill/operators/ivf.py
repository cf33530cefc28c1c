"""A stored inverted-file index (V03-V06): vectors laid out by cell beside versioned centroids.

Layout of an index folder::

    version=1/vectors/cell=0/...   one folder a cell; appends add files to it
    version=1/schema/...           no rows: types of id and embedding, so that no vector file is read for them
    version=1/centroids/...        (cell, centroid), written last: a version counts when it is there
    version=2/...                  after ``recluster``

A vector's cell is its nearest centroid.  ``append`` writes the vectors whose id is not there yet and
rewrites nothing.  ``search`` ranks the centroids for each query, keeps the nearest ``nprobe``
cells, and reads only the folders of cells that some query probes; queries meet the vectors cell by
cell, large cells in parts (``vector.blocked_topk``).  The number of cells is a parameter of the
index: it bounds the centroids that a task holds and the list of cells that the scan is cut to.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.operators import vector as vec

#: Centroids compared with a batch of vectors at once.
CENTROIDS = 4096


def sample_centroids(vectors: DataFrame, n_cells: int, seed: int = 42, id_col: str = "id",
                     vec_col: str = "embedding") -> DataFrame:
    """(cell, centroid): a seeded sample of the vectors (V09 order), reproducible in SQL."""
    some = vectors.filter(F.col(vec_col).isNotNull())
    return vec.seeded_sample(some, n_cells, seed, id_col).select(
        (F.col("sample_rank") - 1).cast("int").alias("cell"), F.col(vec_col).cast("array<double>").alias("centroid"))


def kmeans_centroids(vectors: DataFrame, n_cells: int, seed: int = 42, vec_col: str = "embedding",
                     max_iter: int = 20) -> DataFrame:
    """(cell, centroid) by distributed k-means (MLlib)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    feats = vectors.filter(F.col(vec_col).isNotNull()) \
        .select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter).fit(feats)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cell int, centroid array<double>")


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The row of the nearest centroid of each vector; of equal centroids the first."""
    _, first, code = np.unique(centroids, axis=0, return_index=True, return_inverse=True)
    best, found = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    for at in range(0, len(centroids), CENTROIDS):
        c = centroids[at:at + CENTROIDS]
        gap = np.einsum("ij,ij->i", c, c) - 2 * (x @ c.T)
        near = gap.argmin(axis=1)
        gap = gap[np.arange(len(x)), near]
        found[gap < best] = near[gap < best] + at
        best = np.minimum(best, gap)
    return first[code.ravel()[found]]


def assign_cells(spark: SparkSession, vectors: DataFrame, centroids: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """``vectors`` with the int column ``cell``; null vectors have none and are left out."""
    rows = sorted(centroids.collect(), key=lambda r: r.cell)
    cells = np.array([r.cell for r in rows], np.int32)
    held = spark.sparkContext.broadcast(np.array([r.centroid for r in rows], np.float64))
    at = vectors.columns.index(vec_col)

    def run(batches):
        for b in batches:
            found = cells[nearest(vec.matrix(b.column(at)), held.value)] if b.num_rows else cells[:0]
            yield b.append_column("cell", pa.array(found, pa.int32()))

    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType())])
    return vectors.filter(F.col(vec_col).isNotNull()).mapInArrow(run, schema)


class IvfIndex:
    """An index folder; its latest complete version, or the one given."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path
        self.version = version or max(self._versions(), default=0)
        if not self.version:
            raise ValueError(f"{path}: no index")

    @classmethod
    def build(cls, spark: SparkSession, path: str, vectors: DataFrame, centroids: DataFrame) -> IvfIndex:
        """Writes ``vectors`` (id, embedding) as a new version with these centroids (cell, centroid)."""
        versions = cls._found(spark, path)
        return cls._write(spark, path, max(versions, default=0) + 1, vectors, centroids)

    @classmethod
    def _write(cls, spark, path, version, vectors, centroids) -> IvfIndex:
        base = f"{path}/version={version}"
        vectors.select("id", "embedding").limit(0).write.parquet(f"{base}/schema")
        cls._add(spark, f"{base}/vectors", vectors, centroids)
        centroids.write.parquet(f"{base}/centroids")
        return cls(spark, path, version)

    @staticmethod
    def _add(spark, folder, vectors, centroids) -> None:
        found = assign_cells(spark, vectors.select("id", "embedding"), centroids)
        # Rebalancing splits a large cell over several writers and joins small ones in one.
        found.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(folder)

    @staticmethod
    def _found(spark: SparkSession, path: str) -> list[int]:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/centroids/_SUCCESS")
        found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
        return [int(f.getPath().getParent().getParent().getName().split("=")[1]) for f in found or []]

    def _versions(self) -> list[int]:
        return self._found(self.spark, self.path)

    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={self.version}/centroids")

    def vectors(self, cells: list[int] | None = None) -> DataFrame:
        """(id, embedding, cell) of all cells, or of those listed: no other folder is read."""
        base = f"{self.path}/version={self.version}"
        schema = self.spark.read.parquet(f"{base}/schema").schema.add("cell", T.IntegerType())
        rows = self.spark.read.schema(schema).parquet(f"{base}/vectors")
        return rows if cells is None else rows.filter(F.col("cell").isin(cells))

    def append(self, batch: DataFrame) -> None:
        """Adds the vectors (id, embedding) of ids that are not in the index; of an id that
        the batch repeats, the least vector.  Only the ids of the index are read."""
        new = batch.filter(F.col("embedding").isNotNull()).groupBy("id").agg(F.min("embedding").alias("embedding")) \
            .join(self.vectors().select("id"), "id", "left_anti")
        self._add(self.spark, f"{self.path}/version={self.version}/vectors", new, self.centroids())

    def recluster(self, centroids: DataFrame) -> IvfIndex:
        """A new version of the same vectors with other centroids; the old one stays as it is."""
        return self.build(self.spark, self.path, self.vectors().drop("cell"), centroids)

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """(query_id, vec, cell): each query (query_id, embedding) with its ``nprobe`` nearest cells."""
        c = self.centroids().select(F.lit(0).alias("grp"), F.col("cell").alias("id"), F.col("centroid").alias("vec"))
        q = queries.select(F.lit(0).alias("grp"), "query_id", F.col("embedding").alias("vec"))
        parts, blocks = (vec.deals(d.count(), n) for d, n in ((c, vec.PART_ROWS), (q, vec.QUERY_ROWS)))
        near = vec.blocked_topk(c, q, nprobe, F.lit(parts), F.lit(blocks), l2=True)
        return near.select("query_id", F.col("id").alias("cell")).join(q.select("query_id", "vec"), "query_id")

    def search(self, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        """(query_id, id, score, rank) of the ``k`` best vectors in the probed cells of each query
        (query_id, embedding; ids differ).  With ``nprobe`` the number of cells this is exact."""
        probes = self.probes(queries, nprobe)
        wanted = [r.cell for r in probes.select("cell").distinct().toLocalIterator()]
        rows = self.vectors(wanted)
        # At most one row a cell: how many parts its vectors and blocks its queries make.
        sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / vec.PART_ROWS).alias("parts")).join(
            probes.groupBy("cell").agg(F.ceil(F.count("*") / vec.QUERY_ROWS).alias("blocks")), "cell")
        v = rows.join(F.broadcast(sizes), "cell").select(F.col("cell").alias("grp"), "id", F.col("embedding").alias("vec"), "parts", "blocks")
        q = probes.join(F.broadcast(sizes), "cell").select(F.col("cell").alias("grp"), "query_id", "vec", "parts", "blocks")
        return vec.blocked_topk(v, q, k, F.col("parts"), F.col("blocks"))

    def stats(self) -> DataFrame:
        """Vectors of each cell, of the index, and their dimension."""
        per = self.vectors().groupBy("cell").agg(F.count("*").alias("n_vectors"), F.max(F.size("embedding")).alias("_dim"))
        whole = W.partitionBy()  # one row a cell
        return per.withColumn("total_vectors", F.sum("n_vectors").over(whole)) \
            .withColumn("dimension", F.max("_dim").over(whole)).drop("_dim")


def recall(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Per query of ``exact`` (query_id, id), the share of its rows that ``found`` has."""
    hits = found.select("query_id", "id", F.lit(1).alias("hit"))
    return exact.select("query_id", "id").join(hits, ["query_id", "id"], "left") \
        .groupBy("query_id").agg((F.count("hit") / k).alias("recall"))
