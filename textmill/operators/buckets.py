"""Parquet tables partitioned by a hash bucket of their key, whose bucket count grows with them.

The count is a power of two, chosen from the table's size and kept beside the table, a folder for
each step (``<path>_buckets/step=N``), so that no step is overwritten.  Doubling it splits each bucket b in
b and b + count; no row goes elsewhere.  A growth is announced (both counts are in the step)
before the table is rewritten and closed after it; one that was broken off is done again, and
rows that it left in two buckets are reduced by the caller's rule.

Writers are rebalanced by Spark: a large bucket has as many as its size asks for, small
ones share one, and only buckets that have rows are overwritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parquet bytes of a bucket above which the count doubles, and the least count.
BUCKET_BYTES = 1 << 30
LEAST_BUCKETS = 8


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def path_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def wanted(n_bytes: int) -> int:
    """The least power of two that keeps buckets under ``BUCKET_BYTES``."""
    count = LEAST_BUCKETS
    while count * BUCKET_BYTES < n_bytes:
        count *= 2
    return count


def _steps(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, f"{path}_buckets/step=*/_SUCCESS")
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in fs.globStatus(p) or [])


def counts(spark: SparkSession, path: str) -> list[int]:
    """The count in use; two while a growth is under way or was broken off; none for a new table."""
    steps = _steps(spark, path)
    return list(spark.read.parquet(f"{path}_buckets/step={steps[-1]}").first().counts) if steps else []


def _record(spark: SparkSession, path: str, found: list[int]) -> None:
    step = max(_steps(spark, path), default=0) + 1
    spark.createDataFrame([(found,)], "counts array<int>").write.mode("overwrite").parquet(f"{path}_buckets/step={step}")


def write_buckets(rows: DataFrame, path: str, column: str, key: str, buckets: int) -> None:
    """Overwrites the buckets that ``rows`` fall into, and no others."""
    rows.withColumn(column, bucket_of(key, buckets)).hint("rebalance", column).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(column).parquet(path)


def prepared(spark: SparkSession, path: str, column: str, key: str, more_bytes: int, reduce: Callable[[DataFrame], DataFrame],
             least: int = 0) -> int:
    """The bucket count for a write of ``more_bytes`` more, after growing the table if it needs that.

    ``reduce`` keeps one of the rows that a broken growth left twice.  A table without a
    record was written with some other count and is laid out anew."""
    known = counts(spark, path)
    count = max(wanted(path_bytes(spark, path) + more_bytes), least, *known, LEAST_BUCKETS)
    if known == [count]:
        return count
    if path_exists(spark, path) and path_bytes(spark, path):
        _record(spark, path, sorted({*known, count}))
        _lay_out(spark, path, column, key, count, reduce if len(known) != 1 else lambda rows: rows)
    _record(spark, path, [count])
    return count


def _lay_out(spark: SparkSession, path: str, column: str, key: str, count: int, reduce) -> None:
    table = spark.read.option("mergeSchema", "true").parquet(path)
    old = {r[0] for r in table.select(column).distinct().toLocalIterator()}  # folder names
    write_buckets(reduce(table.drop(column)), path, column, key, count)
    new = {r[0] for r in spark.read.parquet(path).filter(F.col(column) == bucket_of(key, count)).select(column)
           .distinct().toLocalIterator()}
    fs, _ = _fs(spark, path)
    for gone in old - new:  # every row of these is in another bucket now
        fs.delete(_fs(spark, f"{path}/{column}={gone}")[1], True)
