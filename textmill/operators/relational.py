"""Relational building blocks Spark has no single operator for.

* ``asof_join`` — latest right row at or before each left row, skew-safe: the
  heavy window runs per (key, time bucket); only one summary row per
  (key, bucket) goes through the per-key carry-forward window.
* ``interval_join`` — equi key plus |dt| <= width, via time buckets on both
  sides so a hot key is spread across buckets and the fan-out stays bounded.
* ``top_k_per_group`` — ``row_number() <= k`` (Spark plans a partial
  WindowGroupLimit before the shuffle).
* ``keyed_row_number``, ``keyed_lead``, ``exact_quantiles`` — numbering, the next row and order
  statistics per key by range-partitioned slices, so that a key with a large share of the rows spans
  many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmill.session import written


def _micros(ts: str) -> Column:
    """Microseconds since the epoch for TIMESTAMP or TIMESTAMP_NTZ (read as UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _bucket(micros: Column, seconds: int) -> Column:
    return F.floor(micros / F.lit(seconds * 1_000_000)).cast("long")


def asof_join(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str,
              right_cols: list[str], left_order: str, right_order: str,
              bucket_seconds: int = 86_400) -> DataFrame:
    """Left outer as-of join: for each left row the right row with the greatest
    ``right_ts <= left_ts`` in the same ``by`` group (ties: greatest ``right_order``)."""
    lb = left.withColumn("_b", _bucket(_micros(left_ts), bucket_seconds))
    rb = right.withColumn("_b", _bucket(_micros(right_ts), bucket_seconds))
    payload = [right_ts, right_order] + [c for c in right_cols if c not in (right_ts, right_order)]
    # 1) inside each (key, bucket): union and carry the last right row forward.
    tagged = lb.select(by, "_b", F.col(left_ts).alias("_t"), F.lit(1).alias("_side"),
                       F.struct(*[F.col(c) for c in left.columns]).alias("_l"),
                       F.lit(None).cast(rb.select(F.struct(*payload)).schema[0].dataType).alias("_r")) \
        .unionByName(rb.select(by, "_b", F.col(right_ts).alias("_t"), F.lit(0).alias("_side"),
                               F.lit(None).cast(lb.select(F.struct(*[F.col(c) for c in left.columns]))
                                                .schema[0].dataType).alias("_l"),
                               F.struct(*payload).alias("_r")))
    w = W.partitionBy(by, "_b").orderBy("_t", "_side", F.col("_r." + right_order)) \
        .rowsBetween(W.unboundedPreceding, 0)
    within = tagged.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).filter(F.col("_side") == 1)
    # 2) one summary row per (key, bucket) holding its last right row; for each
    #    bucket with left rows, the latest summary of a strictly earlier bucket.
    summary = rb.groupBy(by, "_b").agg(
        F.max_by(F.struct(*payload), F.struct(right_ts, right_order)).alias("_last"))
    left_buckets = lb.select(by, "_b").distinct()
    both = left_buckets.select(by, "_b", F.lit(None).cast(summary.schema["_last"].dataType).alias("_last"),
                               F.lit(0).alias("_k")) \
        .unionByName(summary.select(by, "_b", "_last", F.lit(1).alias("_k")))
    wk = W.partitionBy(by).orderBy("_b", "_k").rowsBetween(W.unboundedPreceding, 0)
    gap = both.withColumn("_gap", F.last("_last", ignorenulls=True).over(wk)) \
        .filter(F.col("_k") == 0).select(by, "_b", "_gap")
    out = within.join(gap, [by, "_b"], "left").withColumn("_m", F.coalesce("_m", "_gap"))
    return out.select(*[F.col("_l." + c).alias(c) for c in left.columns],
                      *[F.col("_m." + c).alias(c) for c in right_cols])


def interval_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                  left_ts: str, right_ts: str, seconds: int, how: str = "inner",
                  extra: Column | None = None) -> DataFrame:
    """Pairs with equal keys and |left_ts - right_ts| <= seconds.

    Each right row is copied into the (at most 3) time buckets its window
    touches, and the join key is (key, bucket), so a pair meets exactly once
    and a hot key spreads over its buckets instead of one task.
    """
    width = seconds * 1_000_000
    lb = left.withColumn("_lb", _bucket(_micros(left_ts), seconds))
    lo = _bucket(_micros(right_ts) - width, seconds)
    hi = _bucket(_micros(right_ts) + width, seconds)
    rb = right.withColumn("_rb", F.explode(F.sequence(lo, hi)))
    cond = ((F.col(left_key) == F.col(right_key)) & (F.col("_lb") == F.col("_rb"))
            & (F.abs(_micros(left_ts) - _micros(right_ts)) <= width))
    if extra is not None:
        cond = cond & extra
    return lb.join(rb, cond, how).drop("_lb", "_rb")


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def global_row_number(spark, df: DataFrame, order_col: str, n_parts: int | None = None) -> DataFrame:
    """Contiguous 1-based ``row_number`` in ``order_col`` order without a single-task window.

    Range-partition and sort, read each row's in-partition position from
    ``monotonically_increasing_id`` (partition id in the upper bits), cut the
    lineage with a written table so positions are fixed, then add the
    per-partition offsets (one small row per partition, broadcast)."""
    n = n_parts or spark.sparkContext.defaultParallelism
    ranged = written(df.repartitionByRange(n, order_col).sortWithinPartitions(order_col)
                     .withColumn("_m", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_pid", F.shiftright("_m", 33)) \
        .withColumn("_ln", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    counts = ranged.groupBy("_pid").agg(F.count("*").alias("_n"))
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_pid", "_off")
    return ranged.join(F.broadcast(offs), "_pid") \
        .withColumn("row_number", F.col("_off") + F.col("_ln")).drop("_m", "_pid", "_ln", "_off")


def keyed_row_number(spark, df: DataFrame, keys: list[str], order: list[str],
                     n_parts: int | None = None, name: str = "row_number") -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without putting a hot
    key into one task.

    Rows are range-partitioned on (keys, order), so a key holding a third of the
    data spans many partitions; each row's position inside its (key, partition)
    slice comes from ``monotonically_increasing_id`` (lineage cut with a written
    table so ids are stable), and the slice offsets come from a small table of
    one row per (key, partition).  Ties in ``order`` are numbered arbitrarily, as
    with ``row_number``."""
    n = n_parts or spark.sparkContext.defaultParallelism
    ranged = written(df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
                     .withColumn("_m", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_pid", F.shiftright("_m", 33))
    slices = ranged.groupBy(*keys, "_pid").agg(F.min("_m").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    out = ranged.join(slices.select(*keys, "_pid", "_m0", "_off"), [*keys, "_pid"])
    return out.withColumn(name, (F.col("_off") + F.col("_m") - F.col("_m0") + 1).cast("int")) \
        .drop("_m", "_pid", "_m0", "_off")


def keyed_lead(df: DataFrame, keys: list[str], order: list[str], value: str, name: str,
               n_parts: int | None = None) -> DataFrame:
    """``lead(value) over (partition by keys order by order)`` without a hot key in one task.

    Rows are range-partitioned on (keys, order), so a key spans as many slices as its rows
    fill.  Inside a slice the next row is near; the last row of a slice takes the first value of
    the key's next slice, from a table of one row a slice."""
    n = n_parts or df.sparkSession.sparkContext.defaultParallelism
    ranged = written(df.repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id()))
    place = W.partitionBy(*keys, "_slice").orderBy(*order)
    inside = ranged.withColumn(name, F.lead(value).over(place)).withColumn("_left", F.lead(F.lit(1)).over(place))
    first = ranged.groupBy(*keys, "_slice").agg(F.min_by(value, F.struct(*order)).alias("_first"))
    carried = first.withColumn("_carry", F.lead("_first").over(W.partitionBy(*keys).orderBy("_slice")))
    joined = inside.join(carried.drop("_first"), [*keys, "_slice"])
    return joined.withColumn(name, F.when(F.col("_left").isNull(), F.col("_carry")).otherwise(F.col(name))) \
        .select(*df.columns, name)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], n_parts: int | None = None) -> DataFrame:
    """(keys..., prob, quantile): continuous quantiles (linear between the two nearest ranks) of the
    non-null values of each key, by rank selection.

    Equal values are counted together, the counts range-partitioned on (keys, value), and the slices'
    sums say in which slice each wanted rank lies; only those slices are looked through.  No
    task holds the values of a key."""
    n = n_parts or df.sparkSession.sparkContext.defaultParallelism
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")) \
        .agg(F.count("*").alias("_n"))
    ranged = written(counted.repartitionByRange(n, *keys, "_v").withColumn("_slice", F.spark_partition_id()))
    # one row a key and slice
    per_key = W.partitionBy(*keys)
    slices = ranged.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_n"))
    slices = slices.withColumn("_all", F.sum("_n").over(per_key)).withColumn(
        "_before", F.coalesce(F.sum("_n").over(per_key.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    at = F.col("prob") * (F.col("_all") - 1)
    wanted = slices.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs]))) \
        .withColumn("_part", at - F.floor(at)) \
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at))))) \
        .filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n"))) \
        .withColumn("_high", F.col("_rank") > at)
    wanted = wanted.select(*keys, "_slice", "prob", "_part", "_high", (F.col("_rank") - F.col("_before")).alias("_local"))
    upto = F.sum("_n").over(W.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    looked = ranged.join(wanted.select(*keys, "_slice").distinct(), [*keys, "_slice"], "left_semi").withColumn("_upto", upto)
    hit = looked.join(wanted, [*keys, "_slice"]).filter((F.col("_upto") > F.col("_local"))
                                                        & (F.col("_upto") - F.col("_n") <= F.col("_local")))
    low, high = (F.max(F.when(F.col("_high") == h, F.col("_v"))) for h in (False, True))
    return hit.groupBy(*keys, "prob").agg(low.alias("_lo"), high.alias("_hi"), F.max("_part").alias("_part")) \
        .select(*keys, "prob", (F.col("_lo") + F.coalesce((F.col("_hi") - F.col("_lo")) * F.col("_part"), F.lit(0.0))).alias("quantile"))
