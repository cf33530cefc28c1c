"""Sharding over fixed virtual slots.

A record's id decides its virtual slot (of ``SLOTS``) for ever.  Bytes and rows are summed
per slot, and a versioned slot-to-shard map, a small written table, says where each slot
lives.  Rebalancing edits the map and writes the next version; records are never hashed
anew.  The law of the query is ``bytes``: shards hold nearly equal sizes.

Sizes are UTF-8 bytes of the text plus 16.  A null text has size 16 and a null crc; a null
id hashes like any other value; repeated rows share a slot and get places of their own;
extra columns are ignored; an empty table gives an empty result and an even map.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmill.llm.graph import stored

SLOTS = 8192
ROW_BYTES = 16
MAP_SCHEMA = "version int, virtual_slot int, shard int"


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every record."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_loads(records: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows): at most one row per slot, summed before the shuffle."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(loads: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Largest slot first, each to the shard that holds least; empty slots follow evenly."""
    heap = [(0, 0, s) for s in range(shards)]
    placed = {}
    for slot in sorted(range(slots), key=lambda v: (-loads.get(v, 0), v)):
        held, count, shard = heapq.heappop(heap)
        placed[slot] = shard
        heapq.heappush(heap, (held + loads.get(slot, 0), count + 1, shard))
    return placed


def rebalanced(current: dict[int, int], loads: dict[int, int], shards: int) -> dict[int, int]:
    """The map edited for ``shards`` shards (more, fewer or as many as before): slots of
    shards that are gone move first, then slots leave the fullest shard for the emptiest
    as long as a move narrows the gap between the two.  No other slot changes its shard."""
    edited = dict(current)
    held = [0] * shards
    members: list[list[int]] = [[] for _ in range(shards)]
    homeless = []
    for slot, shard in sorted(current.items()):
        if shard < shards:
            held[shard] += loads.get(slot, 0)
            members[shard].append(slot)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda v: (-loads.get(v, 0), v)):
        to = min(range(shards), key=lambda s: (held[s], s))
        edited[slot] = to
        held[to] += loads.get(slot, 0)
        members[to].append(slot)
    for _ in range(len(current)):
        top = max(range(shards), key=lambda s: (held[s], -s))
        low = min(range(shards), key=lambda s: (held[s], s))
        gap = held[top] - held[low]
        moves = [v for v in members[top] if 0 < loads.get(v, 0) < gap]
        if not moves:
            break
        slot = min(moves, key=lambda v: (abs(2 * loads[v] - gap), v))
        members[top].remove(slot)
        members[low].append(slot)
        held[top] -= loads[slot]
        held[low] += loads[slot]
        edited[slot] = low
    return edited


def write_map(spark: SparkSession, path: str, version: int, placed: dict[int, int]) -> None:
    """Adds one version of the map to the table at ``path``; earlier versions stay."""
    rows = [(version, slot, shard) for slot, shard in sorted(placed.items())]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(virtual_slot, shard) of one version, the latest unless named."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.filter(F.col("version") == version).select("virtual_slot", "shard")


def load_dict(loads: DataFrame) -> dict[int, int]:
    """Bytes per slot on the driver: at most as many entries as there are slots."""
    return {r.virtual_slot: r.bytes for r in loads.collect()}


def sharded(spark: SparkSession, records: DataFrame, placed: DataFrame, loads: DataFrame) -> DataFrame:
    """Records with their shard and ``slot``, the place in the shard, gapless from 0.  A
    shard's places are dealt by virtual slot, so no task holds more than one slot's rows:
    the slot's first place comes from the sums, the rest from a number inside the slot."""
    shard_order = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.join(loads, "virtual_slot") \
        .withColumn("_start", F.coalesce(F.sum("rows").over(shard_order), F.lit(0))) \
        .select("virtual_slot", "shard", "_start")
    inside = W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return records.withColumn("_at", F.row_number().over(inside) - 1).join(starts, "virtual_slot") \
        .withColumn("slot", (F.col("_start") + F.col("_at")).cast("long")).drop("_start", "_at")


def shard_by_bytes(spark: SparkSession, docs: DataFrame, shards: int, map_path: str, id_col: str = "doc_id",
                   text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot).  Without a map at ``map_path``
    the first version is made; with one, it is edited for today's sizes and stored as the
    next version."""
    records = stored(spark, with_slots(docs, id_col, text_col, slots), "records")
    loads = stored(spark, slot_loads(records), "loads")
    weights = load_dict(loads)
    version, current = latest_map(spark, map_path)
    placed = rebalanced(current, weights, shards) if current else first_map(weights, shards, slots)
    if placed != current:
        write_map(spark, map_path, version + 1, placed)
    return sharded(spark, records, read_map(spark, map_path), loads)


def latest_map(spark: SparkSession, map_path: str) -> tuple[int, dict[int, int]]:
    """(version, slot-to-shard) of the latest version; (0, nothing) if none was written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(map_path)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return 0, {}
    table = spark.read.parquet(map_path)
    version = table.agg(F.max("version")).first()[0]
    return version, {r.virtual_slot: r.shard for r in read_map(spark, map_path, version).collect()}
