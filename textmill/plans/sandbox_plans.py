"""Files, CSV, the SQL tools' sandbox and the staging streams
(S01, S08-S14, A12, B28, ST1, ST2)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textmill.operators import ingest as ing
from textmill.plans import ingest_plans as ip
from textmill.plans.registry import register
from textmill.session import read_table, scratch_path
from textmill.sources import documents as docs
from textmill.sources import files as fs
from textmill.streaming import staging as st


#: Small, so that the files of these queries have many ranges.
SPLIT_BYTES = 1 << 18
_SOURCE_RE = "source=([^/]+)"


def _text_files(spark, sf):
    path = scratch_path(spark, "docs")
    read_table(spark, sf, "documents").select("source", "text").write.partitionBy("source").text(path)
    return path


@register("src_binary_docs", oracle="""
  SELECT source, cast(sum(strlen(text) + 1) AS BIGINT) AS total_bytes,
         cast(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_newlines
  FROM documents GROUP BY source""")
def src_binary_docs(spark, sf):
    """Documents written as text files (one folder per source), read back by byte ranges."""
    b = docs.read_splits(spark, _text_files(spark, sf), "*.txt", SPLIT_BYTES)
    return b.groupBy(F.regexp_extract("path", _SOURCE_RE, 1).alias("source")).agg(F.sum(F.col("end") - F.col("start")).alias("total_bytes"),
                                                  F.sum("newlines").alias("n_newlines"))


@register("src_binary_pieces", oracle="""
  SELECT source, cast(sum(strlen(text) + 1) AS BIGINT) AS total_bytes, cast(sum(strlen(text) + 1) AS BIGINT) AS file_bytes
  FROM documents GROUP BY source""")
def src_binary_pieces(spark, sf):
    """S01 as bytes: every file in rows of bounded size, which add up to its length."""
    b = docs.read_pieces(spark, _text_files(spark, sf), "*.txt", 1 << 16, SPLIT_BYTES)
    per = b.groupBy("path").agg(F.sum(F.length("data")).alias("n"), F.max("length").alias("length"))
    return per.groupBy(F.regexp_extract("path", _SOURCE_RE, 1).alias("source")).agg(F.sum("n").alias("total_bytes"), F.sum("length").alias("file_bytes"))


@register("page_extract_binary", oracle="""
  SELECT source, count(*) AS n_lines FROM (
    SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY source""")
def page_extract_binary(spark, sf):
    """S02 on text files of any size: pages streamed from every byte range; lines per source."""
    pages = docs.read_pages(spark, _text_files(spark, sf), "*.txt", lines_per_page=4, split_bytes=SPLIT_BYTES)
    return pages.groupBy(F.regexp_extract("path", _SOURCE_RE, 1).alias("source")).agg(F.sum(F.size(F.split("content", "\n", -1))).cast("long").alias("n_lines"))


def _orders_csv(spark, sf):
    path = scratch_path(spark, "csv")
    read_table(spark, sf, "orders").write.option("header", True).csv(path)
    return path


@register("src_csv_infer", oracle="""
  SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first_date
  FROM orders GROUP BY o_orderpriority""")
def src_csv_infer(spark, sf):
    df = fs.read_csv(spark, _orders_csv(spark, sf), view="data")
    return df.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"),
                                             F.min(F.col("o_orderdate").cast("timestamp_ntz")).alias("first_date"))


@register("view_sql", oracle="""
  SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY o_orderstatus""")
def view_sql(spark, sf):
    read_table(spark, sf, "orders").createOrReplaceTempView("data")
    return spark.sql("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers FROM data GROUP BY o_orderstatus")


@register("guarded_select", oracle="""
  SELECT o_orderstatus, n, total, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS total_rows,
         (SELECT count(DISTINCT o_orderstatus) FROM orders) > 50 AS truncated
  FROM (SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus)""")
def guarded_select(spark, sf):
    """A12 + S14: read-only SQL over the CSV view, previewed (50 rows, total, truncated)."""
    fs.read_csv(spark, _orders_csv(spark, sf), view="data")
    df = fs.query_source(spark, "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total "
                                "FROM data GROUP BY o_orderstatus")
    return fs.preview(df, ["o_orderstatus"])


@register("preview_50", oracle="""
  SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice, (SELECT count(*) FROM orders) AS total_rows,
         (SELECT count(*) FROM orders) > 50 AS truncated
  FROM orders ORDER BY o_orderkey LIMIT 50""")
def preview_50(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))
    return fs.preview(o, ["o_orderkey"])


_TYPE_D = ("CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' "
           "WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END")


@register("schema_inspect", oracle=f"""
  SELECT table_name AS "table", cast(ordinal_position AS INTEGER) AS pos, column_name AS "column", {_TYPE_D} AS type,
         CASE table_name WHEN 'orders' THEN (SELECT count(*) FROM orders) ELSE (SELECT count(*) FROM lineitem) END AS n_rows
  FROM information_schema.columns WHERE table_name IN ('orders', 'lineitem')""")
def schema_inspect(spark, sf):
    a = fs.schema_table(spark, read_table(spark, sf, "orders"), "orders")
    b = fs.schema_table(spark, read_table(spark, sf, "lineitem"), "lineitem")
    return a.unionByName(b)


@register("sandbox_ctas", oracle="""
  SELECT 'orders' AS table_name, count(*) AS n_rows FROM orders
  UNION ALL SELECT 'lineitem_r', count(*) FROM lineitem WHERE l_returnflag = 'R'""")
def sandbox_ctas(spark, sf):
    """Load-if-absent into the session database; the second load of a name is a no-op."""
    sb = fs.Sandbox(spark, uuid.uuid4().hex[:12])
    try:
        o = read_table(spark, sf, "orders")
        n1 = sb.load("orders", o)
        n2 = sb.load("orders", o.limit(0))  # exists already: no-op, still the full table
        assert n1 == n2
        read_table(spark, sf, "lineitem").createOrReplaceTempView("sandbox_lineitem")
        sb.sql("CREATE TABLE lineitem_r AS SELECT * FROM sandbox_lineitem WHERE l_returnflag = 'R'")
        n3 = spark.table(sb.table("lineitem_r")).count()
        return spark.createDataFrame([("orders", n1), ("lineitem_r", n3)], "table_name string, n_rows long")
    finally:
        sb.drop()


@register("sandbox_list", oracle="""
  SELECT table_name FROM information_schema.tables WHERE table_name IN ('orders', 'customer')""")
def sandbox_list(spark, sf):
    """The session's tables."""
    sb = fs.Sandbox(spark, uuid.uuid4().hex[:12])
    try:
        sb.load("orders", read_table(spark, sf, "orders"))
        sb.load("customer", read_table(spark, sf, "customer"))
        rows = [tuple(r) for r in sb.tables().collect()]
        return spark.createDataFrame(rows, "table_name string")
    finally:
        sb.drop()


@register("sandbox_cleanup", oracle="""
  SELECT true AS named_by_session, count(*) AS n_rows, cast(1 AS BIGINT) AS tables_before, cast(0 AS BIGINT) AS databases_after
  FROM orders""")
def sandbox_cleanup(spark, sf):
    """Dropping the session database removes its tables."""
    sb = fs.Sandbox(spark, uuid.uuid4().hex[:12])
    n = sb.load("orders", read_table(spark, sf, "orders"))
    before = sb.tables().count()
    sb.drop()
    after = spark.sql("SHOW DATABASES").filter(F.col("namespace") == sb.db).count()
    return spark.createDataFrame([(sb.db.startswith("session_"), n, before, after)],
                                 "named_by_session boolean, n_rows long, tables_before long, databases_after long")


@register("sandbox_dml", oracle="""
  WITH v2 AS (SELECT * FROM orders UNION ALL
              SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
              FROM orders WHERE o_orderpriority = '1-URGENT'),
       v3 AS (SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
                     o_totalprice, o_orderdate, o_orderpriority FROM v2),
       v4 AS (SELECT * FROM v3 WHERE o_orderpriority <> '5-LOW')
  SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM v4 GROUP BY o_orderstatus""")
def sandbox_dml(spark, sf):
    """INSERT, UPDATE, DELETE in the sandbox, each a new table version."""
    sb = fs.Sandbox(spark, uuid.uuid4().hex[:12])
    try:
        sb.load("orders", read_table(spark, sf, "orders"))
        t = spark.table(sb.table("orders"))
        ins = t.filter(F.col("o_orderpriority") == "1-URGENT").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000)
        v2 = sb.save_version("orders", t.unionByName(ins))
        t2 = spark.table(v2)
        v3 = sb.save_version("orders", t2.withColumn(
            "o_orderstatus", F.when(F.col("o_totalprice") > 300000, "X").otherwise(F.col("o_orderstatus"))))
        v4 = sb.save_version("orders", spark.table(v3).filter(F.col("o_orderpriority") != "5-LOW"))
        rows = spark.table(v4).groupBy("o_orderstatus").agg(
            F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).collect()
        return spark.createDataFrame([tuple(r) for r in rows], "o_orderstatus string, n long, total double")
    finally:
        sb.drop()


def _stage(spark, sf):
    staging = scratch_path(spark, "staging")
    ing.write_chunks_json(ip._v1(spark, sf), staging)
    ing.write_chunks_json(ip._v2(spark, sf), staging)
    return staging


@register("stream_ingest", oracle=ip.JOB_INGEST_D)
def stream_ingest(spark, sf):
    """ST1: the staging folder drained by a file stream with foreachBatch(ingest)."""
    staging = _stage(spark, sf)
    table = scratch_path(spark, "metadata") + "/table"
    st.stream_ingest(spark, staging, table, scratch_path(spark, "ckpt"), F.lit(ip.CLOCK).cast("timestamp"),
                     files_per_batch=4)
    t = spark.read.parquet(table)
    return t.select("doc_id", "page_no", "chunk_id", "pdf_path", "content", "chunk_hash", "run_id")


@register("stream_dedup", oracle=f"""
  SELECT DISTINCT doc_id, page_no, chunk_id, {ip.DUCK_HKEY} AS chunk_hash FROM
  (SELECT * FROM {ip.V1_D} UNION ALL SELECT * FROM {ip.V2_D})""")
def stream_dedup(spark, sf):
    """ST2: re-staged chunks dropped by hash, chunks without one by their computed hash."""
    staging = _stage(spark, sf)
    out = scratch_path(spark, "dedup") + "/out"
    st.stream_dedup(spark, staging, out, scratch_path(spark, "ckpt"), files_per_batch=4)
    return spark.read.parquet(out).select("doc_id", "page_no", "chunk_id", "chunk_hash")
