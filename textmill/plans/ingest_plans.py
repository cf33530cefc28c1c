"""Versioned metadata ingest queries.

Two chunk versions are derived from ``documents`` the same way in Spark and in
the oracle: pages (S02) cut into fixed token pieces.  Version 1 (the existing
table, run ``20260101T000000Z``) uses 60-token pieces for every document.
Version 2 (the incoming batch, run ``2026-02-01 00:00:00.000``, the second
run_id format) re-ingests documents with ``doc_id % 4 = 0``: 70-token pieces
when ``doc_id % 8 = 0`` (changed content, fewer chunks, so stale tail
positions), identical 60-token pieces otherwise (duplicate hashes).  Some
incoming rows carry a null hash, null page or null path to exercise M01/M07.
"""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from textmill.functions import text as tx
from textmill.functions.sqltext import DUCK, SPARK
from textmill.operators import chunk as ch
from textmill.operators import ingest as ing
from textmill.plans.chunk_plans import PATH_SQL, _duck_doc_id, duck_explode
from textmill.plans.registry import register
from textmill.session import read_table, read_text_table, scratch_path

RUN_A = "20260101T000000Z"
RUN_B = "2026-02-01 00:00:00.000"
CLOCK = "2026-03-01 00:00:00"


def _pieces_sql(d, text, n):
    return d.transform(tx.token_split(d, tx.tokens(d, text), str(n)), "pc_", d.join("pc_"))


def _spark_version(spark, sf, version):
    docs = read_text_table(spark, sf, "documents")
    path = F.expr(PATH_SQL.replace("varchar", "string"))
    if version == 2:
        docs = docs.filter(F.col("doc_id") % 4 == 0)
    base = docs.select(F.col("doc_id").alias("doc_num"), ch.doc_id_from_path(path).alias("doc_id"),
                       path.alias("pdf_path"), "text")
    pages = ch.explode_pages(base, "text", keep=("doc_num", "doc_id", "pdf_path"))
    size = F.when((F.col("doc_num") % 8 == 0) & F.lit(version == 2), 70).otherwise(60)
    p70 = F.expr(_pieces_sql(SPARK, "content", 70))
    p60 = F.expr(_pieces_sql(SPARK, "content", 60))
    pieces = pages.select("doc_num", "doc_id", "pdf_path", "page_no",
                          F.when(size == 70, p70).otherwise(p60).alias("c"))
    rows = ch.posexplode_keep(pieces, ["doc_num", "doc_id", "pdf_path", "page_no"], F.col("c"), "pos", "content") \
        .withColumn("chunk_id", (F.col("pos") + 1).cast("int"))
    rows = rows.withColumn("chunk_hash", ch.chunk_hash(F.col("doc_id"), F.col("page_no"),
                                                       F.col("chunk_id"), F.col("content")))
    if version == 2:
        rows = rows.withColumn("chunk_hash", F.when((F.col("chunk_id") == 2) & (F.col("doc_num") % 16 == 0),
                                                    F.lit(None)).otherwise(F.col("chunk_hash"))) \
            .withColumn("pdf_path", F.when((F.col("chunk_id") == 1) & (F.col("doc_num") % 40 == 12),
                                           F.lit(None)).otherwise(F.col("pdf_path")))
    run = RUN_A if version == 1 else RUN_B
    return rows.select("doc_id", "chunk_id", "pdf_path", "page_no", "content", "chunk_hash",
                       F.lit(run).alias("run_id"))


def _duck_version(version):
    d = DUCK
    where = "WHERE doc_id % 4 = 0" if version == 2 else ""
    size70 = "doc_num % 8 = 0" if version == 2 else "false"
    base = (f"(SELECT doc_id AS doc_num, {_duck_doc_id(PATH_SQL)} AS doc_id, {PATH_SQL} AS pdf_path, text "
            f"FROM documents {where})")
    pages = duck_explode(base, "doc_num, doc_id, pdf_path", __import__("textmill.operators.chunk", fromlist=["x"])
                         .pages_sql(d, "text"), "page_no", "content")
    pieces = (f"(SELECT doc_num, doc_id, pdf_path, page_no, CASE WHEN {size70} THEN {_pieces_sql(d, 'content', 70)} "
              f"ELSE {_pieces_sql(d, 'content', 60)} END AS c FROM {pages})")
    rows = duck_explode(pieces, "doc_num, doc_id, pdf_path, page_no", "c", "chunk_id", "content")
    hsh = ("sha256(doc_id || '::' || coalesce(cast(page_no AS VARCHAR), 'None') || '::' || "
           "cast(chunk_id AS VARCHAR) || '::' || content)")
    if version == 2:
        hsh = f"CASE WHEN chunk_id = 2 AND doc_num % 16 = 0 THEN NULL ELSE {hsh} END"
        path = "CASE WHEN chunk_id = 1 AND doc_num % 40 = 12 THEN NULL ELSE pdf_path END"
    else:
        path = "pdf_path"
    run = RUN_A if version == 1 else RUN_B
    return (f"(SELECT doc_id, chunk_id, {path} AS pdf_path, page_no, content, {hsh} AS chunk_hash, "
            f"'{run}' AS run_id FROM {rows})")


V1_D, V2_D = _duck_version(1), _duck_version(2)

DUCK_RUN_TS = ("coalesce(try_strptime(run_id, '%Y%m%dT%H%M%SZ'), "
               "try_strptime(run_id, '%Y-%m-%d %H:%M:%S.%g'))")
DUCK_REASON = ("CASE WHEN doc_id IS NULL THEN 'null doc_id' WHEN chunk_id IS NULL THEN 'null chunk_id' "
               "WHEN pdf_path IS NULL THEN 'null pdf_path' WHEN content IS NULL THEN 'null content' END")
DUCK_GOOD_V2 = f"(SELECT * FROM {V2_D} WHERE {DUCK_REASON} IS NULL)"
DUCK_HKEY = ("coalesce(chunk_hash, sha256(doc_id || '::' || coalesce(cast(page_no AS VARCHAR), 'None') || '::' || "
             "cast(chunk_id AS VARCHAR) || '::' || content))")
DUCK_ORDER = ("run_ts DESC NULLS LAST, run_id DESC NULLS LAST, chunk_hash DESC, "
              "coalesce(pdf_path, '') DESC")
#: Null hashes are filled with the computed one.
DUCK_COMBINED = f"""(SELECT * REPLACE ({DUCK_HKEY} AS chunk_hash) FROM (
  SELECT *, {DUCK_RUN_TS} AS run_ts FROM {V1_D} WHERE doc_id IN (SELECT doc_id FROM {DUCK_GOOD_V2})
  UNION ALL BY NAME
  SELECT *, {DUCK_RUN_TS} AS run_ts FROM {DUCK_GOOD_V2}))"""
DUCK_DEDUP = f"""(SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_hash ORDER BY {DUCK_ORDER}) AS rn
  FROM {DUCK_COMBINED}) WHERE rn = 1)"""
DUCK_LATEST = f"""(SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, chunk_id ORDER BY {DUCK_ORDER}) AS rn
  FROM {DUCK_DEDUP}) WHERE rn = 1)"""


def _v1(spark, sf):
    return _spark_version(spark, sf, 1)


def _v2(spark, sf):
    return _spark_version(spark, sf, 2)


def _good_v2(spark, sf):
    return ing.validate(_v2(spark, sf)).filter(F.col("reject_reason").isNull()).drop("reject_reason")


def _combined(spark, sf):
    return ing.combine(spark, _good_v2(spark, sf), _v1(spark, sf))


@register("validate_chunks", oracle=f"""
  SELECT doc_id, page_no, chunk_id, {DUCK_REASON} AS reject_reason FROM {V2_D}""")
def validate_chunks(spark, sf):
    return ing.validate(_v2(spark, sf)).select("doc_id", "page_no", "chunk_id", "reject_reason")


@register("parse_run_ts", oracle=f"""
  SELECT event_id, run_id, {DUCK_RUN_TS} AS run_ts FROM (
    SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'garbage-' || event_id
                          WHEN event_id % 101 = 0 THEN NULL
                          WHEN event_id % 2 = 0 THEN strftime(ts, '%Y%m%dT%H%M%SZ')
                          ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%g') END AS run_id FROM events)""")
def parse_run_ts(spark, sf):
    ev = read_table(spark, sf, "events")
    rid = (F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("garbage-"), F.col("event_id").cast("string")))
           .when(F.col("event_id") % 101 == 0, F.lit(None))
           .when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
           .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")))
    return ev.select("event_id", rid.alias("run_id")).withColumn("run_ts", ing.run_ts())


@register("impacted_docs", oracle=f"SELECT DISTINCT doc_id FROM {DUCK_GOOD_V2}")
def impacted_docs(spark, sf):
    return _good_v2(spark, sf).select("doc_id").distinct()


@register("filter_impacted", oracle=f"""
  SELECT doc_id, count(*) AS n_existing FROM {V1_D}
  WHERE doc_id IN (SELECT doc_id FROM {DUCK_GOOD_V2}) GROUP BY doc_id""")
def filter_impacted(spark, sf):
    keys = _good_v2(spark, sf).select("doc_id").distinct()
    old = _v1(spark, sf).join(keys, "doc_id", "left_semi")
    return old.groupBy("doc_id").agg(F.count("*").alias("n_existing"))


@register("align_schema", oracle=f"""
  SELECT doc_id, page_no, chunk_id, NULL::VARCHAR AS run_id, cast(NULL AS TIMESTAMP) AS run_ts FROM {V1_D}""")
def align_schema(spark, sf):
    old = _v1(spark, sf).drop("run_id")  # an older table written before run_id existed
    return ing.align_existing(old).select("doc_id", "page_no", "chunk_id", "run_id", "run_ts")


@register("union_by_name", oracle=f"""
  SELECT doc_id, page_no, chunk_id, run_id, run_ts, chunk_hash FROM {DUCK_COMBINED}""")
def union_by_name(spark, sf):
    return _combined(spark, sf).select("doc_id", "page_no", "chunk_id", "run_id", "run_ts", "chunk_hash")


@register("dedup_hash_latest", oracle=f"SELECT doc_id, page_no, chunk_id, chunk_hash, run_id FROM {DUCK_DEDUP}")
def dedup_hash_latest(spark, sf):
    return ing.dedup_hash_latest(_combined(spark, sf)).select("doc_id", "page_no", "chunk_id", "chunk_hash", "run_id")


@register("latest_per_position", oracle=f"SELECT doc_id, page_no, chunk_id, chunk_hash, run_id, content FROM {DUCK_LATEST}")
def latest_per_position(spark, sf):
    return ing.newest(ing.staged(spark, _combined(spark, sf))).select("doc_id", "page_no", "chunk_id", "chunk_hash", "run_id", "content")


@register("vector_id")
def vector_id_q(spark, sf):
    """xxhash64 has no DuckDB twin: rows only (the sha2 variant is checked by value)."""
    return _v1(spark, sf).select("doc_id", "page_no", "chunk_id", ing.vector_id().alias("vector_id"))


@register("vector_id_unique", oracle=f"""
  SELECT count(*) AS n_rows, count(DISTINCT (doc_id, page_no, chunk_id, chunk_hash)) AS n_ids,
         count(*) = count(DISTINCT (doc_id, page_no, chunk_id)) AS one_a_position FROM {V1_D}""")
def vector_id_unique(spark, sf):
    """As many ids as rows and as positions."""
    v = _v1(spark, sf).select("doc_id", "page_no", "chunk_id", ing.vector_id().alias("vector_id"))
    return v.agg(F.count("*").alias("n_rows"), F.count_distinct("vector_id").alias("n_ids"),
                 (F.count("*") == F.count_distinct("doc_id", "page_no", "chunk_id")).alias("one_a_position"))


@register("vector_id_sha", oracle=f"""
  SELECT doc_id, page_no, chunk_id,
         sha256(concat_ws('|', doc_id, coalesce(cast(page_no AS VARCHAR), ''), cast(chunk_id AS VARCHAR),
                          coalesce(chunk_hash, ''))) AS vector_id FROM {V1_D}""")
def vector_id_sha(spark, sf):
    return _v1(spark, sf).select("doc_id", "page_no", "chunk_id", ing.vector_id_sha().alias("vector_id"))


@register("ingest_counts", oracle=f"""
  SELECT (SELECT count(*) FROM {V2_D}) AS incoming,
         (SELECT count(*) FROM {DUCK_GOOD_V2}) AS valid,
         (SELECT count(*) FROM {DUCK_COMBINED}) AS combined,
         (SELECT count(*) FROM {DUCK_DEDUP}) AS after_dedup,
         (SELECT count(*) FROM {DUCK_LATEST}) AS latest,
         (SELECT count(DISTINCT doc_id) FROM {DUCK_GOOD_V2}) AS impacted""")
def ingest_counts(spark, sf):
    """Both versions are written once; the stage counts are observed in one pass over keys and hashes."""
    v2 = ing.staged(spark, ing.checked(_v2(spark, sf)))
    rows = ing.combine(spark, v2.filter("reject_reason is null"), ing.staged(spark, _v1(spark, sf)))
    seen = {k: Observation(k) for k in ("combined", "after_dedup")}

    def observe(stage, name):
        return stage.observe(seen[name], F.count(F.lit(1)).alias("n")) if name in seen else stage

    hashes = observe(ing.latest_hashes(observe(rows, "combined")), "after_dedup")
    latest = ing.latest_positions(hashes).count()
    found = v2.agg(F.count(F.lit(1)).alias("incoming"), F.count(F.when(F.col("reject_reason").isNull(), 1)).alias("valid"),
                   F.count_distinct(F.when(F.col("reject_reason").isNull(), F.col("doc_id"))).alias("impacted"))
    return found.select("incoming", "valid", F.lit(seen["combined"].get["n"]).alias("combined"),
                        F.lit(seen["after_dedup"].get["n"]).alias("after_dedup"), F.lit(latest).alias("latest"), "impacted")


JOB_INGEST_D = f"""
  SELECT doc_id, page_no, chunk_id, pdf_path, content, chunk_hash, run_id FROM {DUCK_LATEST}
  UNION ALL
  SELECT doc_id, page_no, chunk_id, pdf_path, content, chunk_hash, run_id FROM {V1_D}
  WHERE doc_id NOT IN (SELECT doc_id FROM {DUCK_GOOD_V2})"""


def _run_two_batches(spark, sf, replace_document=False):
    path = scratch_path(spark, "metadata") + "/table"
    clock = F.lit(CLOCK).cast("timestamp")
    ing.ingest(spark, _v1(spark, sf), path, clock)
    ing.ingest(spark, _v2(spark, sf), path, clock, replace_document=replace_document)
    return spark.read.parquet(path)


@register("job_ingest", oracle=JOB_INGEST_D)
def job_ingest(spark, sf):
    """Batch 1 creates the table, batch 2 overwrites only its documents' partitions."""
    t = _run_two_batches(spark, sf)
    return t.select("doc_id", "page_no", "chunk_id", "pdf_path", "content", "chunk_hash", "run_id")


@register("sink_dynamic_overwrite", oracle=f"""
  SELECT doc_id, count(*) AS n_rows, max(run_id) AS run_id FROM ({JOB_INGEST_D}) GROUP BY doc_id""")
def sink_dynamic_overwrite(spark, sf):
    """Per partition after the second batch — untouched documents keep run 1."""
    t = _run_two_batches(spark, sf)
    return t.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.max("run_id").alias("run_id"))


@register("src_merge_schema", oracle=f"""
  SELECT doc_id, page_no, chunk_id, run_id, NULL::VARCHAR AS lang FROM {V1_D}
  UNION ALL
  SELECT doc_id, page_no, chunk_id, run_id, 'x' AS lang FROM {V2_D}""")
def src_merge_schema(spark, sf):
    """Two files with different columns read as one table (mergeSchema)."""
    path = scratch_path(spark, "merge")
    _v1(spark, sf).select("doc_id", "page_no", "chunk_id", "run_id").write.parquet(path + "/part=1")
    _v2(spark, sf).select("doc_id", "page_no", "chunk_id", "run_id", F.lit("x").alias("lang")) \
        .write.parquet(path + "/part=2")
    return spark.read.option("mergeSchema", "true").parquet(path).drop("part")


@register("src_chunk_json", oracle=f"SELECT * FROM {V1_D} UNION ALL SELECT * FROM {V2_D}")
def src_chunk_json(spark, sf):
    """Staged chunk JSON of two runs read back with the fixed schema."""
    path = scratch_path(spark, "staging")
    ing.write_chunks_json(_v1(spark, sf), path)
    ing.write_chunks_json(_v2(spark, sf), path)
    return ing.read_chunks_json(spark, path).select(*ing.CHUNK_SCHEMA.fieldNames())


@register("sink_chunk_json_roundtrip", oracle=f"""
  SELECT run_id, count(*) AS n_rows, count(DISTINCT chunk_hash) AS n_hashes FROM
  (SELECT * FROM {V1_D} UNION ALL SELECT * FROM {V2_D}) GROUP BY run_id""")
def sink_chunk_json_roundtrip(spark, sf):
    """One folder per run; counts per run after the round trip."""
    path = scratch_path(spark, "staging")
    ing.write_chunks_json(_v1(spark, sf), path)
    ing.write_chunks_json(_v2(spark, sf), path)
    back = ing.read_chunks_json(spark, path)
    return back.groupBy("run_id").agg(F.count("*").alias("n_rows"),
                                      F.count_distinct("chunk_hash").alias("n_hashes"))


@register("sink_truncate", oracle=f"""
  SELECT column_index - 1 AS pos, column_name AS name, data_type AS type, n_rows
  FROM (SELECT unnest(['vector_id', 'doc_id', 'chunk_id', 'pdf_path', 'page_no', 'content', 'chunk_hash', 'created_at', 'run_id'])
          AS column_name, generate_subscripts(range(9), 1) AS column_index,
          unnest(['string', 'string', 'int', 'string', 'int', 'string', 'string', 'timestamp', 'string']) AS data_type),
       (SELECT count(*) FILTER (chunk_id < 0) AS n_rows FROM {V1_D})""")
def sink_truncate(spark, sf):
    """Overwrite with zero rows keeps the columns and their types, as the files have them."""
    path = scratch_path(spark, "trunc")
    t = ing.finalize(_v1(spark, sf).withColumn("run_ts", ing.run_ts()), F.lit(CLOCK).cast("timestamp"))
    t.write.mode("overwrite").parquet(path)
    t.limit(0).write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    cols = [F.struct(F.lit(i).cast("long").alias("pos"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"))
            for i, f in enumerate(back.schema.fields)]
    return back.agg(F.count("*").alias("n_rows")).select("n_rows", F.explode(F.array(*cols)).alias("c")).select("c.*", "n_rows")


@register("proj_curated", oracle=f"""
  SELECT doc_id, chunk_id, pdf_path, page_no, content, chunk_hash, TIMESTAMP '{CLOCK}' AS created_at, run_id
  FROM {V1_D}""")
def proj_curated(spark, sf):
    t = ing.finalize(_v1(spark, sf).withColumn("run_ts", ing.run_ts()), F.lit(CLOCK).cast("timestamp"))
    return t.drop("vector_id")


@register("fill_null_text", oracle=f"""
  SELECT doc_id, page_no, chunk_id, coalesce(CASE WHEN chunk_id % 5 = 0 THEN NULL ELSE content END, '') AS content
  FROM {V1_D}""")
def fill_null_text(spark, sf):
    v = _v1(spark, sf)
    nulled = F.when(F.col("chunk_id") % 5 == 0, F.lit(None)).otherwise(F.col("content"))
    return v.select("doc_id", "page_no", "chunk_id", F.coalesce(nulled, F.lit("")).alias("content"))


@register("filter_blank", oracle=f"""
  SELECT doc_id, sent_no, sentence FROM {duck_explode(
      "documents", "doc_id", f"string_split(text, '.')", "sent_no", "sentence")}
  WHERE {tx.strip(DUCK, 'sentence')} <> ''""")
def filter_blank(spark, sf):
    d = read_table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", r"\.", -1)).alias("pos", "sentence"))
    return d.filter(F.expr(tx.strip(SPARK, "sentence")) != "") \
        .select("doc_id", (F.col("pos") + 1).cast("int").alias("sent_no"), "sentence")


@register("stamp_run", oracle=f"""
  SELECT strftime(TIMESTAMP '{CLOCK}', '%Y%m%dT%H%M%SZ') AS run_id, TIMESTAMP '{CLOCK}' AS created_at,
         count(*) AS n_docs FROM documents""")
def stamp_run(spark, sf):
    """P06 with the clock as a parameter (repeatable)."""
    clock = F.lit(CLOCK).cast("timestamp")
    d = read_table(spark, sf, "documents")
    return d.agg(F.count("*").alias("n_docs")).select(
        F.date_format(clock, "yyyyMMdd'T'HHmmss'Z'").alias("run_id"), clock.alias("created_at"), "n_docs")
