"""Structured Streaming over the chunk staging folder (ST1, ST2).

ST1 replaces re-globbing every staged file on each run: a file-source stream
picks up only new chunk files and each micro-batch is ingested with the same
batch code (``foreachBatch``), in its two steps: every micro-batch is checked
and written to a journal beside the table, and the journal is merged into the
table once, when the stream has drained what is there (``availableNow``).  So a
row is merged once however many micro-batches there are, where a merge a
micro-batch would rewrite the whole table each time.  The ingest is
order-independent (dedup by run timestamp), so any split of files into
micro-batches gives the same table.  The stream's checkpoint makes a restart
resume after the last committed batch; what a broken run left in the journal
is merged by the next, and merging it twice changes nothing.

ST2 drops re-staged duplicates of a chunk hash by keyed streaming state (RocksDB, spilled to
disk), so that a micro-batch looks up its own hashes only, however many came before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators import ingest as ing
from textmill.operators.buckets import path_exists, remove


def chunk_stream(spark: SparkSession, staging: str, files_per_batch: int = 1) -> DataFrame:
    return (spark.readStream.schema(ing.CHUNK_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
            .option("recursiveFileLookup", "true").json(staging))


def stream_ingest(spark: SparkSession, staging: str, table_path: str, checkpoint: str,
                  clock=None, files_per_batch: int = 1) -> None:
    """ST1: ingest every staged file exactly once into the metadata table."""
    journal = ing.journal_path(table_path)

    def batch(df: DataFrame, epoch_id: int) -> None:
        ing.taken_in(spark, df, f"{journal}/epoch={epoch_id}", f"{ing.rejects_path(table_path)}/batch={epoch_id}")

    _merge_journal(spark, journal, table_path, clock)  # left by a broken run
    q = (chunk_stream(spark, staging, files_per_batch).writeStream.foreachBatch(batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    _merge_journal(spark, journal, table_path, clock)


def _merge_journal(spark: SparkSession, journal: str, table_path: str, clock) -> None:
    if path_exists(spark, journal):
        ing.merged_in(spark, journal, table_path, clock)
        remove(spark, journal)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that a stream checkpoint belongs to, kept inside it and lost with it."""
    path = f"{checkpoint}/textmill-run"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        spark.createDataFrame([(uuid.uuid4().hex,)], "run string").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).first().run


def stream_dedup(spark: SparkSession, staging: str, out_path: str, checkpoint: str, files_per_batch: int = 1) -> None:
    """ST2: one row per chunk hash, however the files fall into micro-batches and however late
    they come.  A null hash is filled with the computed one.

    Each batch has a folder of its run and number, so that a repeated batch replaces itself.  If
    the stream checkpoint is lost while the output stays, the state is gone too: a new run begins, and
    what earlier runs have written is left out by an anti-join with their hashes."""
    run = _run_of(spark, checkpoint)
    if not path_exists(spark, f"{out_path}/run={run}"):
        spark.createDataFrame([], ing.CHUNK_SCHEMA).write.parquet(f"{out_path}/run={run}/epoch=-1")
    others = F.col("run") != run
    lost = not spark.read.parquet(out_path).filter(others).isEmpty()

    def batch(df: DataFrame, epoch_id: int) -> None:
        if lost:
            seen = spark.read.parquet(out_path).filter(others).select("chunk_hash")
            df = df.join(seen, "chunk_hash", "left_anti").select(*df.columns)
        df.write.mode("overwrite").parquet(f"{out_path}/run={run}/epoch={epoch_id}")

    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        rows = chunk_stream(spark, staging, files_per_batch)
        rows = ing.filled(rows).dropDuplicates(["chunk_hash"])
        q = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STATE_STORE, before)
    q.awaitTermination()
