"""Embedding and vector-search queries.

Chunk contents come from the derived chunk versions of ``ingest_plans``;
query texts from ``benchmark``; the vector store from ``embeddings``.  The
default encoder hashes tokens into 64 buckets, the width of the driver's
``embeddings`` table, so benchmark texts can be searched against it.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmill.functions import vectors as vx
from textmill.functions.sqltext import DUCK, SPARK
from textmill.operators import embed as em
from textmill.operators import ingest as ing
from textmill.operators import ivf
from textmill.operators import vector as vec
from textmill.plans import ingest_plans as ip
from textmill.plans.chunk_plans import duck_explode
from textmill.plans.registry import register
from textmill.session import read_table, scratch_path, written

CLOCK_A = "2026-01-01 00:00:00"
CLOCK_B = "2026-02-01 00:00:00"
K = 3
N_CELLS = 8


def _x(s):
    return F.expr(s)


# --- chunk metadata with portable vector ids ------------------------------------------------
def _meta(spark, sf, version):
    v = ip._v1(spark, sf) if version == 1 else ip._good_v2(spark, sf)
    clock = CLOCK_A if version == 1 else CLOCK_B
    return v.select(ing.vector_id_sha().alias("vector_id"), "doc_id", "page_no", "chunk_id", "content",
                    F.lit(clock).cast("timestamp").alias("created_at"))


_VID_D = ("sha256(concat_ws('|', doc_id, coalesce(cast(page_no AS VARCHAR), ''), cast(chunk_id AS VARCHAR), "
          "coalesce(chunk_hash, '')))")
META1_D = f"(SELECT {_VID_D} AS vector_id, doc_id, page_no, chunk_id, content, TIMESTAMP '{CLOCK_A}' AS created_at FROM {ip.V1_D})"
META2_D = f"(SELECT {_VID_D} AS vector_id, doc_id, page_no, chunk_id, content, TIMESTAMP '{CLOCK_B}' AS created_at FROM {ip.DUCK_GOOD_V2})"
#: The newest content of each vector.
E01_SQL = "SELECT vector_id, max_by(content, created_at) AS content FROM {src} GROUP BY vector_id"


@register("latest_content_sql", oracle=E01_SQL.format(src=f"(SELECT * FROM {META1_D} UNION ALL SELECT * FROM {META2_D})"))
def latest_content_sql(spark, sf):
    _meta(spark, sf, 1).unionByName(_meta(spark, sf, 2)).createOrReplaceTempView("metadata_latest_src")
    return spark.sql(E01_SQL.format(src="metadata_latest_src"))


EMB4_D = vx.as_float_rounded(DUCK, vx.hashing_embedding(DUCK, "content"))


@register("embed_hashing", oracle=f"SELECT vector_id, {EMB4_D} AS embedding FROM {META1_D}")
def embed_hashing(spark, sf):
    m = _meta(spark, sf, 1)
    return m.select("vector_id", _x(vx.as_float_rounded(SPARK, vx.hashing_embedding(SPARK, "content"))).alias("embedding"))


@register("embed_pandas", oracle=f"SELECT vector_id, {EMB4_D} AS embedding, 'hashing-md5-64' AS model_name FROM {META1_D}")
def embed_pandas(spark, sf):
    """E02 through the plug-in path (Arrow batches, encoder once per worker, 64 per call)."""
    e = em.encode(_meta(spark, sf, 1))
    return e.select("vector_id", _x(vx.as_float_rounded(SPARK, "embedding")).alias("embedding"),
                    "model_name")


@register("l2_normalise", oracle=f"""
  SELECT vec_id, {vx.as_float_rounded(DUCK, vx.l2_normalise(DUCK, 'v'))} AS unit
  FROM (SELECT vec_id, list_transform(embedding, lambda x: cast(x AS DOUBLE) * cast(vec_id % 5 AS DOUBLE)) AS v
        FROM embeddings)""")
def l2_normalise(spark, sf):
    e = read_table(spark, sf, "embeddings").select(
        "vec_id", _x("transform(embedding, x -> cast(x as double) * cast(vec_id % 5 as double))").alias("v"))
    return e.select("vec_id", _x(vx.as_float_rounded(SPARK, vx.l2_normalise(SPARK, "v"))).alias("unit"))


# --- upsert ------------------------------------------------------------------------------------
def _store(spark, sf, version):
    """Embedding rows of one version: E01 latest content -> hashing embedding (JVM path)."""
    m = _meta(spark, sf, version)
    latest = em.latest_content(m)
    clock = CLOCK_A if version == 1 else CLOCK_B
    return latest.select("vector_id", _x(vx.hashing_embedding(SPARK, "content")).cast("array<float>").alias("embedding"),
                         F.lit(em.DEFAULT_MODEL).alias("model_name"),
                         F.lit(clock).cast("timestamp").alias("created_at"))


_SRC2_D = f"(SELECT DISTINCT vector_id FROM {META2_D})"
_TGT1_D = f"(SELECT DISTINCT vector_id FROM {META1_D})"
UPSERT_D = f"""
  SELECT coalesce(s.vector_id, t.vector_id) AS vector_id,
         CASE WHEN s.vector_id IS NOT NULL THEN TIMESTAMP '{CLOCK_B}' ELSE TIMESTAMP '{CLOCK_A}' END AS created_at,
         CASE WHEN s.vector_id IS NOT NULL AND t.vector_id IS NOT NULL THEN 'updated'
              WHEN s.vector_id IS NOT NULL THEN 'inserted' ELSE 'kept' END AS action
  FROM {_TGT1_D} t FULL OUTER JOIN {_SRC2_D} s ON t.vector_id = s.vector_id"""


@register("upsert_merge", oracle=UPSERT_D)
def upsert_merge(spark, sf):
    merged = em.upsert(_store(spark, sf, 1), _store(spark, sf, 2))
    return merged.select("vector_id", "created_at", F.col("_action").alias("action"))


@register("upsert_counts", oracle=f"SELECT action, count(*) AS n FROM ({UPSERT_D}) GROUP BY action")
def upsert_counts(spark, sf):
    merged = em.upsert(_store(spark, sf, 1), _store(spark, sf, 2))
    return merged.groupBy(F.col("_action").alias("action")).agg(F.count("*").alias("n"))


@register("mean_pool", oracle=f"""
  SELECT label, pos, round(avg(cast(x AS DOUBLE)), 6) AS mean
  FROM {duck_explode('embeddings', 'label', 'embedding', 'pos', 'x')} GROUP BY label, pos""")
def mean_pool(spark, sf):
    e = read_table(spark, sf, "embeddings")
    m = vec.vector_mean(e, by=["label"])
    return m.select("label", (F.col("pos") + 1).cast("int").alias("pos"), F.round("mean", 6).alias("mean"))


@register("job_embed", oracle=f"""
  SELECT u.vector_id, u.created_at, 'hashing-md5-64' AS model_name,
         {vx.as_float_rounded(DUCK, vx.hashing_embedding(DUCK, 'c.content'))} AS embedding
  FROM ({UPSERT_D}) u JOIN (SELECT DISTINCT vector_id, content FROM {META2_D}
                            UNION SELECT DISTINCT vector_id, content FROM {META1_D}
                              WHERE vector_id NOT IN (SELECT vector_id FROM {META2_D})) c
    ON u.vector_id = c.vector_id""")
def job_embed(spark, sf):
    """Metadata -> latest content -> Arrow encoder -> upsert into a bucketed table (twice)."""
    path = scratch_path(spark, "embeddings") + "/table"
    for version, clock in ((1, CLOCK_A), (2, CLOCK_B)):
        latest = em.latest_content(_meta(spark, sf, version))
        em.upsert_table(spark, path, em.encode(latest).withColumn("created_at", F.lit(clock).cast("timestamp")))
    t = spark.read.parquet(path)  # S07 read-back
    return t.select("vector_id", "created_at", "model_name",
                    _x(vx.as_float_rounded(SPARK, "embedding")).alias("embedding"))


@register("src_embeddings", oracle="SELECT vec_id, label, len(embedding) AS dim FROM embeddings")
def src_embeddings(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.size("embedding").alias("dim"))


# --- search -------------------------------------------------------------------------------------
def _dot_d(a, b):
    return vx.dot(DUCK, a, b)


@register("knn_exact", oracle=f"""
  SELECT cast(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, round(score, 6) AS score
  FROM (SELECT e.vec_id, {_dot_d('e.embedding', 'q.embedding')} AS score
        FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q)
  ORDER BY score DESC, vec_id LIMIT 5""")
def knn_exact(spark, sf):
    e = read_table(spark, sf, "embeddings")
    q = e.orderBy("vec_id").select("embedding").first()[0]  # the one query vector (1 row)
    top = vec.knn_exact(e, list(q), 5, id_col="vec_id")
    return top.select(F.col("rank").cast("int").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


def _queries(spark, sf):
    b = read_table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), _x(vx.hashing_embedding(SPARK, "text")).alias("embedding"))


Q_D = f"(SELECT item_id, {vx.hashing_embedding(DUCK, 'text')} AS q FROM benchmark)"
KNN_BATCH_D = f"""
  SELECT item_id, cast(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM (
    SELECT item_id, vec_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, vec_id) AS rank
    FROM (SELECT b.item_id, e.vec_id, {_dot_d('e.embedding', 'b.q')} AS score FROM {Q_D} b, embeddings e))
  WHERE rank <= {K}"""


def _knn_out(df):
    return df.select(F.col("query_id").alias("item_id"), F.col("rank").cast("int").alias("rank"), "vec_id",
                     F.round("score", 6).alias("score"))


@register("knn_batch", oracle=KNN_BATCH_D)
def knn_batch(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return _knn_out(vec.knn_batch(spark, e, _queries(spark, sf), K, id_col="vec_id"))


def _index(spark, sf, rows=None):
    """A stored index of the embeddings (or of ``rows``), centroids by the seeded sample."""
    e = read_table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    c = ivf.sample_centroids(e, N_CELLS)
    return ivf.IvfIndex.build(spark, scratch_path(spark, "ivf"), e if rows is None else e.filter(rows), c)


@register("knn_ivf", oracle=KNN_BATCH_D)
def knn_ivf(spark, sf):
    """V03 probing every cell: must equal the exact search."""
    return _knn_out(_index(spark, sf).search(_queries(spark, sf), K, N_CELLS).withColumnRenamed("id", "vec_id"))


SAMPLE_D = """(SELECT vec_id, embedding, cast(row_number() OVER (ORDER BY md5(cast(vec_id AS VARCHAR) || ':42'), vec_id) AS INTEGER) AS sample_rank
               FROM embeddings ORDER BY md5(cast(vec_id AS VARCHAR) || ':42'), vec_id LIMIT {m})"""
CELLS_D = f"""(SELECT vec_id, cast(cell AS INTEGER) AS cell FROM (
    SELECT e.vec_id, c.sample_rank - 1 AS cell,
           row_number() OVER (PARTITION BY e.vec_id ORDER BY
             list_reduce(list_transform(list_zip(e.embedding, c.embedding),
                         lambda p_: (cast(p_[1] AS DOUBLE) - cast(p_[2] AS DOUBLE)) ^ 2), lambda s_, v_: s_ + v_, 0::DOUBLE),
             c.sample_rank) AS rn
    FROM embeddings e, {SAMPLE_D.format(m=N_CELLS)} c) WHERE rn = 1)"""


NPROBE = 2
#: The cells of each query and the best vectors in them, centroid ranks by squared distance.
PROBES_D = f"""(SELECT item_id, q, cell FROM (
    SELECT b.item_id, b.q, c.sample_rank - 1 AS cell, row_number() OVER (PARTITION BY b.item_id ORDER BY
             list_reduce(list_transform(list_zip(b.q, c.embedding),
                         lambda p_: (cast(p_[1] AS DOUBLE) - cast(p_[2] AS DOUBLE)) ^ 2), lambda s_, v_: s_ + v_, 0::DOUBLE),
             c.sample_rank) AS near
    FROM {Q_D} b, {SAMPLE_D.format(m=N_CELLS)} c) WHERE near <= {NPROBE})"""
KNN_IVF_D = f"""
  SELECT item_id, cast(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM (
    SELECT item_id, vec_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, vec_id) AS rank
    FROM (SELECT p.item_id, e.vec_id, {_dot_d('e.embedding', 'p.q')} AS score
          FROM {PROBES_D} p JOIN {CELLS_D} c ON p.cell = c.cell JOIN embeddings e ON e.vec_id = c.vec_id))
  WHERE rank <= {K}"""


@register("knn_ivf_approx", oracle=KNN_IVF_D)
def knn_ivf_approx(spark, sf):
    """V03 with 2 probes: only the folders of probed cells are read."""
    return _knn_out(_index(spark, sf).search(_queries(spark, sf), K, NPROBE).withColumnRenamed("id", "vec_id"))


@register("knn_recall", oracle=f"""
  SELECT x.item_id, count(a.vec_id) / {K}.0::DOUBLE AS recall
  FROM ({KNN_BATCH_D}) x LEFT JOIN ({KNN_IVF_D}) a ON a.item_id = x.item_id AND a.vec_id = x.vec_id GROUP BY x.item_id""")
def knn_recall(spark, sf):
    """Per query, share of the exact top-k found by the 2-probe IVF search."""
    q = _queries(spark, sf)
    exact = vec.knn_batch(spark, read_table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id"), q, K)
    found = _index(spark, sf).search(q, K, NPROBE)
    return ivf.recall(exact, found, K).select(F.col("query_id").alias("item_id"), "recall")


@register("index_append", oracle=f"SELECT vec_id, cell FROM {CELLS_D}")
def index_append(spark, sf):
    """A stored index of the even ids, to which the whole table is appended (ids present are skipped)."""
    idx = _index(spark, sf, F.col("id") % 2 == 0)
    idx.append(read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    return idx.vectors().select(F.col("id").alias("vec_id"), "cell")


@register("index_stats", oracle=f"""
  SELECT cell, count(*) AS n_vectors, cast(sum(count(*)) OVER () AS BIGINT) AS total_vectors, 64 AS dimension
  FROM {CELLS_D} GROUP BY cell""")
def index_stats(spark, sf):
    return _index(spark, sf).stats().select("cell", "n_vectors", "total_vectors", F.col("dimension").cast("int"))


# --- retrieval ---------------------------------------------------------------------------------------
RETR_D = f"""
  SELECT item_id, cast(rank AS INTEGER) AS rank, vector_id, round(score, 6) AS score, content FROM (
    SELECT item_id, vector_id, score, content,
           row_number() OVER (PARTITION BY item_id ORDER BY score DESC, vector_id) AS rank
    FROM (SELECT b.item_id, s.vector_id, s.content, {_dot_d('s.e', 'b.q')} AS score
          FROM {Q_D} b, (SELECT vector_id, content, {vx.hashing_embedding(DUCK, 'content')} AS e FROM {META1_D}) s))
  WHERE rank <= 2"""


def _retrieve(spark, sf):
    m = _meta(spark, sf, 1)
    # the chunk store is encoded once through the encoder plug-in and written: the search and
    # the content lookup both read it
    store = written(em.encode(m, keep=("content",)), "store")
    q = em.encode(read_table(spark, sf, "benchmark"), text_col="text", key="item_id") \
        .select(F.col("item_id").alias("query_id"), "embedding")
    top = vec.knn_batch(spark, store.select("vector_id", "embedding"), q, 2, id_col="vector_id")
    # P03 fixed: ids carry their rank; contents joined back by key, order kept
    return top.join(store.select("vector_id", "content"), "vector_id")


@register("retrieve_context", oracle=RETR_D)
def retrieve_context(spark, sf):
    r = _retrieve(spark, sf)
    return r.select(F.col("query_id").alias("item_id"), F.col("rank").cast("int").alias("rank"), "vector_id",
                    F.round("score", 6).alias("score"), "content")


@register("context_prompt", oracle=f"""
  SELECT b.item_id, 'Question: ' || b.text || chr(10) || 'Context:' || chr(10) ||
         coalesce(string_agg('[' || r.rank || '] ' || r.content, chr(10) ORDER BY r.rank), '') AS prompt
  FROM benchmark b LEFT JOIN ({RETR_D}) r ON b.item_id = r.item_id GROUP BY b.item_id, b.text""")
def context_prompt(spark, sf):
    r = _retrieve(spark, sf).select(F.col("query_id").alias("item_id"), "rank", "content")
    b = read_table(spark, sf, "benchmark")
    g = r.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("ctx"))
    parts = F.transform("ctx", lambda c: F.concat(F.lit("["), c["rank"].cast("string"), F.lit("] "), c["content"]))
    return b.join(g, "item_id", "left").select(  # a question without hits has an empty context
        "item_id", F.concat(F.lit("Question: "), F.col("text"), F.lit("\nContext:\n"),
                            F.coalesce(F.array_join(parts, "\n"), F.lit(""))).alias("prompt"))


# --- statistics ---------------------------------------------------------------------------------------
@register("sample_seeded", oracle=f"SELECT sample_rank, vec_id FROM {SAMPLE_D.format(m=10)}")
def sample_seeded(spark, sf):
    return vec.seeded_sample(read_table(spark, sf, "embeddings"), 10, id_col="vec_id") \
        .select(F.col("sample_rank").cast("int").alias("sample_rank"), "vec_id")


@register("vector_mean", oracle=f"""
  SELECT pos, round(avg(cast(x AS DOUBLE)), 6) AS mean
  FROM {duck_explode('embeddings', 'vec_id', 'embedding', 'pos', 'x')} GROUP BY pos""")
def vector_mean(spark, sf):
    m = vec.vector_mean(read_table(spark, sf, "embeddings"))
    return m.select((F.col("pos") + 1).cast("int").alias("pos"), F.round("mean", 6).alias("mean"))


def _squarings(times: int) -> str:
    """Recursive CTE text: the covariance squared ``times`` times, scaled by its trace each time,
    of which every column lies along the greatest axis."""
    steps = ", ".join(
        f"m{i + 1} AS MATERIALIZED (SELECT a.i, b.j, sum(a.c * b.c) / (SELECT sum(c * c) FROM m{i}) AS c FROM m{i} a JOIN m{i} b ON a.j = b.i GROUP BY 1, 2)"
        for i in range(times))
    return steps


def _axis_d(cov: str, times: int = 14) -> str:
    """The unit axis of greatest variance of ``cov`` (i, j, c), signed by its largest entry: (i, a)."""
    return f"""(WITH m0 AS (SELECT i, j, c FROM {cov}), {_squarings(times)},
      col AS (SELECT i, c FROM m{times} WHERE j = (SELECT i FROM m{times} WHERE i = j ORDER BY c DESC, i LIMIT 1))
      SELECT i, c / (SELECT sqrt(sum(c * c)) FROM col) * (SELECT sign(c) FROM col ORDER BY abs(c) DESC LIMIT 1) AS a FROM col)"""


_X_D = duck_explode("embeddings", "vec_id", "list_transform(embedding, lambda v_: cast(v_ AS DOUBLE))", "i", "x")
PCA_D = f"""
  WITH x AS MATERIALIZED (SELECT vec_id, i, v.x - avg(v.x) OVER (PARTITION BY i) AS x FROM {_X_D} v),
  cov AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) AS c FROM x a JOIN x b USING (vec_id) GROUP BY 1, 2),
  p1 AS MATERIALIZED (SELECT * FROM {_axis_d('cov')}),
  cov2 AS MATERIALIZED (SELECT cov.i, j, c - (SELECT sum(u.a * c * w.a) FROM cov JOIN p1 u USING (i) JOIN p1 w ON w.i = j) * u.a * w.a AS c
           FROM cov JOIN p1 u USING (i) JOIN p1 w ON w.i = j),
  p2 AS MATERIALIZED (SELECT * FROM {_axis_d('cov2')})
  SELECT vec_id, round(sum(x * p1.a), 4) + 0 AS x, round(sum(x * p2.a), 4) + 0 AS y
  FROM x JOIN p1 USING (i) JOIN p2 USING (i) GROUP BY vec_id"""


@register("pca_2d", oracle=PCA_D)
def pca_2d(spark, sf):
    """Vectors on the two axes of greatest variance."""
    p = vec.pca_2d(read_table(spark, sf, "embeddings"), id_col="vec_id")
    return p.select("vec_id", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


@register("pca_cov", oracle=f"""
  SELECT a.pos - 1 AS i, b.pos - 1 AS j, round(covar_samp(cast(a.x AS DOUBLE), cast(b.x AS DOUBLE)), 6) + 0 AS cov
  FROM {duck_explode('embeddings', 'vec_id', 'embedding', 'pos', 'x')} a
  JOIN {duck_explode('embeddings', 'vec_id', 'embedding', 'pos', 'x')} b ON a.vec_id = b.vec_id
  GROUP BY a.pos, b.pos""")
def pca_cov(spark, sf):
    c = vec.covariance(spark, read_table(spark, sf, "embeddings"))
    return c.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), (F.round("cov", 6) + 0.0).alias("cov"))


@register("batch_assign", oracle="""
  SELECT vec_id, cast((row_number() OVER (ORDER BY vec_id) - 1) // 5 AS BIGINT) AS batch_no FROM embeddings""")
def batch_assign(spark, sf):
    """Feed batches of 5 in id order, numbered without a single-partition window."""
    from textmill.operators.relational import global_row_number

    e = read_table(spark, sf, "embeddings").select("vec_id")
    r = global_row_number(spark, e, "vec_id")
    return r.select("vec_id", F.floor((F.col("row_number") - 1) / 5).cast("long").alias("batch_no"))
