"""Embedding near-duplicates: random-hyperplane signs in several tables, exact verification.

Vectors of one label meet where all signs of a table agree: ``BITS`` of them, and one more each time
the largest label doubles, so that a bucket holds no more vectors by chance as labels grow.  Two vectors at the
threshold cosine agree on a sign with probability 1 - angle / pi, so the number of tables
follows from the share of links that may be missed (``MISS``).  Inside a bucket the cosine
is taken in double precision by matrix products over blocks of rows; a pair is counted only
in the first table that holds it.  Large buckets are dealt as pairs of blocks, no pair ever
becomes a row: a block gives each vector's number of links and the links that join two
components inside the block.

Null, zero and zero-norm vectors, vectors with a null or non-finite component and vectors
with a null label link with nothing; so do vectors of unequal length.  A row without id has
no component; rows that share an id are one vector each for the counts and one node for the
components.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import textops
from textmill.llm.graph import cells, components, stored

#: Signs of a table for labels of up to ``LABEL_ROWS`` vectors.
BITS = 12
LABEL_ROWS = 1 << 17
MISS = 1e-3
BLOCK = 1024
SEED = 11


def table_count(cosine: float, bits: int = BITS, miss: float = MISS) -> int:
    """Tables needed so that a pair at the threshold is missed with probability ``miss`` at most."""
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


def planes(dim: int, tables: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """The hyperplanes of every table; each dimension has its own, whatever the task."""
    rng = np.random.Generator(np.random.PCG64([seed, dim]))
    return rng.standard_normal((dim, tables * bits))


def _signed(tables: int, bits: int):
    """One row per usable vector: its unit vector as doubles and its signature per table."""
    weights = (1 << np.arange(bits)).astype(np.int64)

    def run(batches):
        cache: dict[int, np.ndarray] = {}
        for b in batches:
            ids, vectors, labels = b.column(0), b.column(1), b.column(2)
            rows = {}
            for i, v in enumerate(vectors):
                if not v.is_valid or not labels[i].is_valid:
                    continue
                values = v.values
                if values is None or not len(values) or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                top = np.abs(x).max()
                if not np.isfinite(x).all() or top == 0:
                    continue
                rows.setdefault(len(x), []).append((i, x / top))
            for dim, found in rows.items():
                m = np.stack([x for _, x in found])
                m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
                if dim not in cache:
                    cache[dim] = planes(dim, tables, bits)
                signs = ((m @ cache[dim]) >= 0).reshape(len(m), tables, bits)
                sig = (signs * weights).sum(axis=2).astype(np.int64)
                at = pa.array([i for i, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at).cast(pa.int64()), labels.take(at).cast(pa.string()), pa.array([dim] * len(m), pa.int32()),
                     b.column(3).take(at), pa.array([r.tobytes() for r in m], pa.binary()),
                     pa.array(list(sig), pa.list_(pa.int64()))],
                    ["vec_id", "label", "dim", "row", "unit", "signs"])

    return run


def _block_pairs(cosine: float):
    """Runs of one cell.  Counts every pair of the cell's two blocks (or inside its one
    block) that reaches the cosine and first meets in this table."""

    def run(batches):
        for t in textops.sorted_runs(batches, ["table", "sign", "label", "dim", "cell"]):
            table = t.column("table")[0].as_py()
            home = t.column("home").to_numpy()
            unit = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(t.num_rows, -1)
            signs = np.array(t.column("signs").to_pylist(), np.int64)[:, :table]
            ids, rows = t.column("vec_id").to_pylist(), t.column("row").to_pylist()
            blocks = np.unique(home)
            left = np.flatnonzero(home == blocks[0])
            right = np.flatnonzero(home == blocks[-1])
            counts = np.zeros(t.num_rows, np.int64)
            forest, links = textops.Forest(t.num_rows), []
            for at in range(0, len(left), 256):
                part = left[at:at + 256]
                close = unit[part] @ unit[right].T >= cosine
                if len(blocks) == 1:
                    close &= right[None, :] > part[:, None]
                a, b = np.nonzero(close)
                a, b = part[a], right[b]
                if table:
                    new = np.ones(len(a), bool)
                    for k in range(0, len(a), 1 << 16):
                        s = slice(k, k + (1 << 16))
                        new[s] = ~(signs[a[s]] == signs[b[s]]).any(axis=1)
                    a, b = a[new], b[new]
                counts += np.bincount(a, minlength=t.num_rows) + np.bincount(b, minlength=t.num_rows)
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    if forest.join(x, y):
                        links.append((ids[x], ids[y]))
            hit = np.flatnonzero(counts).tolist()
            if hit:
                n = len(hit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows[i] for i in hit] + [None] * len(links), pa.int64()),
                     pa.array(counts[hit].tolist() + [None] * len(links), pa.int64()),
                     pa.array([None] * n + [x for x, _ in links], pa.int64()),
                     pa.array([None] * n + [y for _, y in links], pa.int64())], ["row", "n", "a", "b"])

    return run


def near_duplicates(spark: SparkSession, vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``."""
    rows = stored(spark, vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"),
                                        F.col(label_col).alias("label"), F.monotonically_increasing_id().alias("row")), "vectors")
    largest = rows.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits = BITS + max(0, math.ceil(math.log2(largest / LABEL_ROWS)))
    tables = table_count(cosine, bits)
    signed = stored(spark, rows.select("vec_id", "embedding", "label", "row").mapInArrow(
        _signed(tables, bits), "vec_id long, label string, dim int, row long, unit binary, signs array<long>"), "signed")
    dealt = signed.select("row", "label", "dim", F.posexplode("signs").alias("table", "sign"))
    dealt = cells(dealt, ["table", "sign", "label", "dim"], "row", BLOCK)
    order = ["table", "sign", "label", "dim", "cell"]
    found = stored(spark, dealt.join(signed.select("row", "vec_id", "unit", "signs"), "row")
                   .repartition(*order).sortWithinPartitions(*order)
                   .mapInArrow(_block_pairs(cosine), "row long, n long, a long, b long"), "pairs")
    roots = components(spark, found.filter("a is not null").select("a", "b"))
    counts = found.filter("row is not null").groupBy("row").agg(F.sum("n").alias("n_links"))
    return rows.select("row", "vec_id").join(counts, "row", "left") \
        .join(roots.select(F.col("node").alias("vec_id"), "root"), "vec_id", "left") \
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                F.coalesce("root", "vec_id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
