"""Embedding job (E01-E07): latest content per key, partition-wise encoding,
normalisation and a keyed upsert without a table format.

The encoder is a plug-in: any object with ``encode(texts) -> ndarray`` and a
``name``.  It is created once per Python worker (cached in a module global,
like a model loaded per executor) and fed Arrow batches, ``batch_size`` texts
at a time.  The default ``HashingEncoder`` is the same feature-hashing rule as
the JVM expression in ``functions.vectors`` so both paths give equal vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import vectors as vx
from textmill.functions.text import TOKEN_RE
from textmill.session import scratch_path

DEFAULT_MODEL = "hashing-md5-64"


class _Buckets(dict):
    """word -> buckets of its tokens, bounded like the reference's per-process token caches.  White space ends
    every token, so a text's tokens are those of its words."""

    size, longest = 200_000, 64

    def __init__(self, dim: int):
        import regex

        self.dim = dim
        self.tok = regex.compile(TOKEN_RE)

    def __missing__(self, word: str) -> list[int]:
        # letters and digits alone are one token
        toks = [word] if word.isascii() and word.isalnum() else self.tok.findall(word)
        b = [int.from_bytes(hashlib.md5(t.encode("utf-8")).digest()[:4]) % self.dim for t in toks]
        if len(self) < self.size and len(word) <= self.longest:
            self[word] = b
        return b


class HashingEncoder:
    """Bag of tokens hashed into ``dim`` buckets (md5 prefix), L2-normalised."""

    def __init__(self, dim: int = vx.DIM):
        self.dim = dim
        self.name = f"hashing-md5-{dim}"
        self._buckets = _Buckets(dim)

    def encode(self, texts: list[str]) -> np.ndarray:
        found: list[int] = []
        ends = [0]
        for t in texts:
            found.extend(chain.from_iterable(map(self._buckets.__getitem__, (t or "").split())))
            ends.append(len(found))
        at = np.repeat(np.arange(len(texts)) * self.dim, np.diff(ends)) + np.array(found, np.int64)
        out = np.bincount(at, minlength=len(texts) * self.dim).reshape(len(texts), self.dim).astype(np.float64)
        n = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


_ENCODER_CACHE: dict = {}


def _encoder(key: str, factory: Callable[[], object]):
    if key not in _ENCODER_CACHE:
        _ENCODER_CACHE[key] = factory()
    return _ENCODER_CACHE[key]


def latest_content(df: DataFrame, key: str = "vector_id", ts: str = "created_at") -> DataFrame:
    """One row per key, the newest by ``ts`` (ties: larger content, for determinism)."""
    g = df.groupBy(key).agg(F.max_by(F.struct("content"), F.struct(ts, "content")).alias("_r"))
    return g.select(key, F.coalesce(F.col("_r.content"), F.lit("")).alias("content"))


def encode(df: DataFrame, text_col: str = "content", key: str = "vector_id",
           factory: Callable[[], object] = HashingEncoder, batch_size: int = 64,
           keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, embedding array<float>, model_name`` via ``mapInArrow``.

    Only the key and text cross into Python (column pruning stops at the
    Python boundary, so project first)."""
    src = df.select(F.col(key).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *keep)  # P05

    # the same code and arguments give the same encoder in a reused worker, others another
    identity = hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(identity, factory)
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(1).to_pylist()
            mat = np.vstack([enc.encode(texts[i:i + batch_size]) for i in range(0, len(texts), batch_size)]).astype(np.float32)
            ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * mat.shape[1], pa.int32())
            cols = [b.column(0), pa.ListArray.from_arrays(ends, pa.array(mat.reshape(-1))), pa.array([enc.name] * len(texts))]
            yield pa.RecordBatch.from_arrays([*cols, *b.columns[2:]], ["k", "embedding", "model_name", *keep])

    key_type = df.schema[key].dataType.simpleString()
    extra = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in keep)
    out = src.mapInArrow(run, f"k {key_type}, embedding array<float>, model_name string{extra}")
    return out.withColumnRenamed("k", key)


def assert_unique(df: DataFrame, key: str) -> None:
    """A merge source must hold one row per key (a real MERGE fails otherwise)."""
    dup = df.groupBy(key).count().filter(F.col("count") > 1).limit(1).count()
    if dup:
        raise ValueError(f"upsert source has duplicate {key} values")


def upsert(target: DataFrame | None, source: DataFrame, key: str = "vector_id") -> DataFrame:
    """When matched update all columns, when not matched insert; untouched rows kept.
    Adds ``_action`` (inserted / updated / kept) for E05.  One shuffle join on the key."""
    assert_unique(source, key)
    cols = source.columns
    if target is None:
        return source.withColumn("_action", F.lit("inserted"))
    s = source.select(*[F.col(c).alias("s_" + c) for c in cols], F.lit(True).alias("_in_s"))
    t = target.select(*[F.col(c).alias("t_" + c) for c in cols], F.lit(True).alias("_in_t"))
    j = t.join(s, F.col("t_" + key) == F.col("s_" + key), "full")
    action = (F.when(F.col("_in_s") & F.col("_in_t"), "updated")
              .when(F.col("_in_s"), "inserted").otherwise("kept"))
    return j.select(*[F.when(F.col("_in_s").isNotNull(), F.col("s_" + c)).otherwise(F.col("t_" + c)).alias(c)
                      for c in cols], action.alias("_action"))


def upsert_table(spark: SparkSession, path: str, source: DataFrame, key: str = "vector_id") -> dict:
    """Upsert into a Parquet table partitioned by a hash bucket of the key: only the
    buckets the source touches are read, merged and rewritten (dynamic overwrite), and their
    number follows the table's size (``operators.buckets``).  ``source`` is computed once."""
    from pyspark.sql import Observation

    from textmill.operators import buckets as bk
    from textmill.operators.ingest import read_existing

    held = scratch_path(spark, "upsert")
    source.write.parquet(held)
    source = spark.read.schema(source.schema).parquet(held)
    count = bk.prepared(spark, path, "_bucket", key, bk.path_bytes(spark, held), lambda rows: rows.dropDuplicates([key]))
    existing = read_existing(spark, path)
    if existing is not None:
        # one row a bucket at most, which bounds the broadcast
        touched = source.select(bk.bucket_of(key, count).alias("_bucket")).filter("_bucket >= 0").distinct()
        existing = existing.join(F.broadcast(touched), "_bucket", "left_semi").drop("_bucket")
    obs = Observation("upsert")
    merged = upsert(existing, source, key)
    merged = merged.observe(obs, *[F.count(F.when(F.col("_action") == a, 1)).alias(a)
                                   for a in ("inserted", "updated", "kept")])
    bk.write_buckets(merged.drop("_action"), path, "_bucket", key, count)
    return obs.get
