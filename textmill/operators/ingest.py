"""Versioned chunk-metadata ingest (M01-M11) with partition-wise overwrite.

Plan shape for one batch::

    incoming -> checked (M01), written once: rejects | good rows
    good rows + rows of the impacted buckets (M03-M05, dynamic partition pruning) by name (M06)
        -> keys, hashes, recency and locators only: latest per hash (M07), latest per position (M08)
        -> content picked at its place by bitmaps of the winners -> vector_id, created_at (M09, P06) -> curated columns (P01)
        -> write partitionBy(doc_bucket), dynamic overwrite (S06), writers rebalanced

A row's locator is its file and place in it, so ranking moves no content, and content moves
to its bucket once it has won.  Ranking aggregates with partial maxima, so a document that
holds a third of all rows is combined in every task before the shuffle.  Stage counts (M10) are
observed while the rows pass.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.operators import buckets as bk
from textmill.operators.chunk import chunk_hash as chunk_hash_col
from textmill.session import scratch_path

# The chunk schema and the two run_id formats of the reference.
CHUNK_SCHEMA = T.StructType([
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("chunk_id", T.IntegerType(), False),
    T.StructField("pdf_path", T.StringType(), False),
    T.StructField("page_no", T.IntegerType(), True),
    T.StructField("content", T.StringType(), False),
    T.StructField("chunk_hash", T.StringType(), True),
    T.StructField("run_id", T.StringType(), True),
])
#: Rows that were checked and written.
TAKEN_SCHEMA = T.StructType([T.StructField(f.name, f.dataType) for f in CHUNK_SCHEMA.fields]
                            + [T.StructField("reject_reason", T.StringType())])
RUN_ID_FORMATS = ("yyyyMMdd'T'HHmmss'Z'", "yyyy-MM-dd HH:mm:ss.SSS")
METADATA_COLUMNS = ["vector_id", "doc_id", "chunk_id", "pdf_path", "page_no", "content",
                    "chunk_hash", "created_at", "run_id"]
REQUIRED = ["doc_id", "chunk_id", "pdf_path", "content"]


def run_ts(col: str = "run_id", formats=RUN_ID_FORMATS) -> Column:
    """The first format that parses; garbage and null give null (never an ANSI error)."""
    return F.coalesce(*[F.try_to_timestamp(F.col(col), F.lit(f)) for f in formats])


def validate(df: DataFrame) -> DataFrame:
    """Add ``reject_reason`` (null for good rows) naming the first null required field."""
    reason = None
    for c in reversed(REQUIRED):
        reason = F.when(F.col(c).isNull(), F.lit(f"null {c}")).otherwise(
            reason if reason is not None else F.lit(None).cast("string"))
    return df.withColumn("reject_reason", reason)


def checked(df: DataFrame) -> DataFrame:
    """The rows in the chunk schema with their ``reject_reason``: the first value that does not
    fit its type, else the first null required field, else null."""
    unfit = [F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), f"bad {f.name}")
             for f in CHUNK_SCHEMA.fields if f.name in df.columns]
    kept = df.withColumn("_unfit", F.coalesce(*unfit, F.lit(None).cast("string")))
    rows = kept.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns
                         else F.lit(None).cast(f.dataType).alias(f.name) for f in CHUNK_SCHEMA.fields], "_unfit")
    return validate(rows).withColumn("reject_reason", F.coalesce("_unfit", "reject_reason")).drop("_unfit")


def dedup_key(df: DataFrame) -> Column:
    """Hash key for M07: the stored hash, else the computed one (never one shared null group)."""
    return F.coalesce(F.col("chunk_hash"),
                      chunk_hash_col(F.col("doc_id"), F.col("page_no"), F.col("chunk_id"), F.col("content")))


def filled(df: DataFrame) -> DataFrame:
    """Rows whose stored hash is null get the computed one, so that ids do not depend on who wrote them."""
    return df.withColumn("chunk_hash", dedup_key(df))


def _recency() -> Column:
    """Order key: run_ts desc nulls last, run_id desc nulls last, then chunk_hash, pdf_path, place."""
    return F.struct(F.col("run_ts").isNotNull().alias("_t"), F.col("run_ts"), F.col("run_id").isNotNull().alias("_i"),
                    F.col("run_id"), F.col("chunk_hash"), F.coalesce(F.col("pdf_path"), F.lit("")).alias("_p"), "_file", "_at")


def at_rest(df: DataFrame) -> DataFrame:
    """The rows of a DataFrame that reads files, with their locator: the file's hash and the row's place."""
    return df.select("*", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))


def staged(spark: SparkSession, df: DataFrame, name: str = "staged") -> DataFrame:
    """``df`` written once under the shared scratch folder and read back with locators."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return at_rest(spark.read.schema(df.schema).parquet(path))


def _unobserved(rows: DataFrame, name: str) -> DataFrame:
    return rows


def latest_hashes(rows: DataFrame) -> DataFrame:
    """M07 on located rows: the locator and key columns of the most recent row of each (doc_id, hash)."""
    thin = rows.select("doc_id", "page_no", "chunk_id", _recency().alias("_rank"))
    best = thin.groupBy("doc_id", F.col("_rank.chunk_hash").alias("chunk_hash")) \
        .agg(F.max(F.struct("_rank", "page_no", "chunk_id")).alias("_r"))
    return best.select("doc_id", "_r.page_no", "_r.chunk_id", "_r._rank")


def latest_positions(hashes: DataFrame) -> DataFrame:
    """M08 on the result of ``latest_hashes``: the most recent of each (doc_id, page_no, chunk_id)."""
    return hashes.groupBy("doc_id", "page_no", "chunk_id").agg(F.max("_rank").alias("_rank"))


def fetched(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """The located rows that won, with all their columns; winners are hashed, so content is not sorted."""
    places = winners.select("_rank._file", "_rank._at").hint("shuffle_hash")
    return rows.join(places, ["_file", "_at"], "left_semi")


#: A bitmap marks 32,768 places in 4 KB; up to this many bytes of them are broadcast.
BITMAP_BYTES, MOST_BITMAP_BYTES = 4096, 256 << 20


def picked(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """``fetched`` for a batch that is run: the places that won, a bit a row in bitmaps by file, are written and go
    to the files, so that content is not shuffled to be picked.  Too many bitmaps to broadcast are joined."""
    at = F.col("_rank._at") + 1
    marks = winners.groupBy(F.col("_rank._file").alias("_file"), F.bitmap_bucket_number(at).alias("_block")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    path = scratch_path(marks.sparkSession, "places")
    marks.write.parquet(path)
    marks = marks.sparkSession.read.schema(marks.schema).parquet(path)
    if marks.count() * BITMAP_BYTES <= MOST_BITMAP_BYTES:
        marks = F.broadcast(marks)
    place = F.bitmap_bit_position(F.col("_at") + 1)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    won = byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(_at + 1) % 8 as int))")) != 0
    return rows.withColumn("_block", F.bitmap_bucket_number(F.col("_at") + 1)).join(marks, ["_file", "_block"]) \
        .filter(won).select(*rows.columns)


def _located(df: DataFrame) -> DataFrame:
    rows = df if "_file" in df.columns else staged(df.sparkSession, df)
    return filled(rows)


def dedup_hash_latest(df: DataFrame) -> DataFrame:
    """The most recent row of each (doc_id, hash), with its locator; rows without one are written first."""
    rows = _located(df)
    return fetched(rows, latest_hashes(rows))


def latest_per_position(df: DataFrame) -> DataFrame:
    """The most recent row of each (doc_id, page_no, chunk_id)."""
    rows = _located(df)
    thin = rows.select("doc_id", "page_no", "chunk_id", _recency().alias("_rank"))
    return fetched(rows, latest_positions(thin)).drop("_file", "_at")


def newest(rows: DataFrame, observe=_unobserved, fetch=fetched) -> DataFrame:
    """M07 + M08: of located rows, the most recent per position among the most recent of each hash."""
    hashes = observe(latest_hashes(observe(rows, "combined")), "after_dedup")
    return fetch(rows, observe(latest_positions(hashes), "written")).drop("_file", "_at")


def vector_id(doc_id="doc_id", page_no="page_no", chunk_id="chunk_id", chunk_hash="chunk_hash") -> Column:
    """xxhash64 over the position and hash, as a string (ints cast explicitly)."""
    return F.xxhash64(F.col(doc_id), F.col(page_no).cast("int"), F.col(chunk_id).cast("int"),
                      F.coalesce(F.col(chunk_hash), F.lit(""))).cast("string")


def vector_id_sha(doc_id="doc_id", page_no="page_no", chunk_id="chunk_id", chunk_hash="chunk_hash") -> Column:
    """Portable variant of M09 (checkable in any engine): sha256 of the same fields."""
    return F.sha2(F.concat_ws("|", F.col(doc_id), F.coalesce(F.col(page_no).cast("string"), F.lit("")),
                              F.col(chunk_id).cast("string"), F.coalesce(F.col(chunk_hash), F.lit(""))), 256)


def read_existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The metadata table with schema merge; ``None`` when it does not exist yet."""
    if not bk.path_exists(spark, path):
        return None
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:  # an empty folder: no table yet
        if "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def align_existing(existing: DataFrame) -> DataFrame:
    """Bring an older table to the chunk columns plus run_ts (null when run_id is absent);
    locators stay."""
    if "run_id" not in existing.columns:
        existing = existing.withColumn("run_id", F.lit(None).cast("string"))
    return _typed(existing)


def _typed(df: DataFrame) -> DataFrame:
    """The chunk columns, the parsed run time, and locators where there are any."""
    cols = [F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns
            else F.lit(None).cast(f.dataType).alias(f.name) for f in CHUNK_SCHEMA.fields]
    return df.select(*cols, *[c for c in ("_file", "_at") if c in df.columns]).withColumn("run_ts", run_ts())


def doc_bucket(buckets: int, doc_id: str = "doc_id") -> Column:
    """Storage partition of a document: a hash bucket, so the table has a bounded
    number of folders however many documents it holds."""
    return bk.bucket_of(doc_id, buckets)


def combine(spark: SparkSession, incoming: DataFrame, existing: DataFrame | None, buckets: int | None = None) -> DataFrame:
    """Impacted rows of the existing table ∪ incoming (by name), null hashes filled.

    With ``buckets`` the existing side is cut to the impacted *buckets* (the
    storage partitions that will be rewritten): the semi-join on the partition
    column lets Spark prune partitions at run time (DPP)."""
    inc = _typed(incoming)
    if existing is None:
        return filled(inc)
    if buckets and "doc_bucket" in existing.columns:
        # one row a bucket at most, which bounds the broadcast; Spark prunes at run time by a side
        # that a comparison filters
        impacted = inc.select(doc_bucket(buckets).alias("doc_bucket")).filter("doc_bucket >= 0").distinct()
        old = align_existing(existing.join(F.broadcast(impacted), "doc_bucket", "left_semi"))
    else:
        old = align_existing(existing).join(inc.select("doc_id").distinct(), "doc_id", "left_semi")
    return filled(old.unionByName(inc, allowMissingColumns=True))


def finalize(latest: DataFrame, clock: Column | None = None) -> DataFrame:
    """M09 + P06 + P01: ids, timestamp, curated column order."""
    clock = clock if clock is not None else F.current_timestamp()
    return latest.withColumn("vector_id", vector_id()).withColumn("created_at", clock) \
        .select(*METADATA_COLUMNS)


def plan_ingest(spark: SparkSession, incoming: DataFrame, existing: DataFrame | None,
                clock: Column | None = None, observe=_unobserved,
                replace_document: bool = False, buckets: int | None = None, fetch=fetched) -> DataFrame:
    """The batch's rows to write (valid incoming only).  With ``replace_document`` the
    incoming batch replaces each impacted document outright (no stale tail chunks).
    ``observe(rows, name)`` may count the rows of a stage as they pass.  ``incoming`` is written once
    unless its rows have locators."""
    if "_file" not in incoming.columns:
        incoming = staged(spark, checked(incoming), "incoming").filter("reject_reason is null")
    if existing is not None:
        existing = at_rest(existing)
        if replace_document:
            # impacted documents are replaced outright; their bucket-mates are rewritten unchanged
            existing = existing.join(incoming.select("doc_id").distinct(), "doc_id", "left_anti")
            if not buckets:
                existing = None
    out = finalize(newest(combine(spark, incoming, existing, buckets), observe, fetch), clock)
    return out.withColumn("doc_bucket", doc_bucket(buckets)) if buckets else out


def _one_a_position(table: DataFrame) -> DataFrame:
    """Of rows that a broken growth left in two buckets, one; content of equal rows is equal."""
    return table.dropDuplicates(["doc_id", "page_no", "chunk_id"])


def ingest(spark: SparkSession, incoming: DataFrame, metadata_path: str,
           clock: Column | None = None, replace_document: bool = False,
           buckets: int | str | None = "auto", batch_id: str | None = None) -> dict:
    """Run one batch and overwrite only the impacted storage partitions.

    The table is partitioned by a hash bucket of doc_id, as many as its size asks for
    (``operators.buckets``; an integer is the least count); ``buckets=None`` reproduces the
    reference layout, one folder per doc_id.  The incoming batch is read once and written to the
    scratch folder, from where everything else reads it.

    Rows that cannot be ingested go with their reason to ``rejects_path``, in a folder
    of this batch (a repeated ``batch_id`` replaces its own).  Returns the counts
    incoming, rejected, combined, after_dedup and written."""
    path = scratch_path(spark, "incoming")
    found = taken_in(spark, incoming, path, f"{rejects_path(metadata_path)}/batch={batch_id or uuid.uuid4().hex}")
    return found | merged_in(spark, path, metadata_path, clock, replace_document, buckets)


def taken_in(spark: SparkSession, incoming: DataFrame, path: str, rejects: str) -> dict:
    """M01 of a batch: its checked rows written to ``path``, those that cannot be ingested to ``rejects`` too."""
    seen = Observation("ingest_incoming")
    rows = checked(incoming).observe(seen, F.count(F.lit(1)).alias("incoming"), F.count("reject_reason").alias("rejected"))
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    spark.read.schema(TAKEN_SCHEMA).parquet(path).filter("reject_reason is not null").write.mode("overwrite").parquet(rejects)
    return dict(seen.get)


def merged_in(spark: SparkSession, path: str, metadata_path: str, clock: Column | None = None,
              replace_document: bool = False, buckets: int | str | None = "auto") -> dict:
    """M03-M11 of the batch, or of the folders of several, that ``taken_in`` wrote to ``path``."""
    rows = at_rest(spark.read.schema(TAKEN_SCHEMA).option("recursiveFileLookup", "true").parquet(path))
    counts = []

    def observe(stage: DataFrame, name: str) -> DataFrame:
        counts.append(Observation("ingest_" + name))
        return stage.observe(counts[-1], F.count(F.lit(1)).alias(name))

    if buckets:
        buckets = bk.prepared(spark, metadata_path, "doc_bucket", "doc_id", bk.path_bytes(spark, path), _one_a_position,
                              0 if buckets == "auto" else buckets)
    to_write = plan_ingest(spark, rows.filter("reject_reason is null"), read_existing(spark, metadata_path), clock,
                           observe, replace_document, buckets, picked)
    if buckets:
        bk.write_buckets(to_write.drop("doc_bucket"), metadata_path, "doc_bucket", "doc_id", buckets)
    else:
        to_write.hint("rebalance", "doc_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("doc_id").parquet(metadata_path)
    found = {}
    for o in counts:
        found |= o.get
    return found


def journal_path(metadata_path: str) -> str:
    """Batches taken in but not merged yet, beside the table."""
    return metadata_path.rstrip("/") + "_journal"


def rejects_path(metadata_path: str) -> str:
    """Beside the table, so that reading the table does not meet them."""
    return metadata_path.rstrip("/") + "_rejects"


def write_chunks_json(df: DataFrame, path: str) -> None:
    """One folder per run (``run=<id>``) of JSON lines.  The rows keep their run_id, so
    a reader that ignores folder names, as the stream does, has it too."""
    df.withColumn("run", F.col("run_id")).write.mode("append").partitionBy("run").json(path)


def read_chunks_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """All staged chunk files under ``path`` with the fixed schema (no inference).
    ``multiline`` reads files that hold one JSON array each, as the staged files do."""
    reader = spark.read.schema(CHUNK_SCHEMA).option("multiLine", multiline).option("recursiveFileLookup", "true")
    df = reader.json(path)
    return df
