"""Vector top-k against numpy, IVF at full probe, the upsert, and the driver contract."""

import numpy as np
from pyspark.sql import functions as F

from textmill.operators import embed as em
from textmill.operators import ivf
from textmill.operators import vector as vec


def test_knn_batch_ties_zero_vector_and_k_over_rows(spark):
    vecs = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [0.6, 0.8])]
    qs = [(10, [1.0, 0.0]), (11, [0.0, 0.0])]
    v = spark.createDataFrame(vecs, "id long, embedding array<float>")
    q = spark.createDataFrame(qs, "query_id long, embedding array<double>")
    got = {}
    for r in vec.knn_batch(spark, v, q, 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    assert [i for _, i in sorted(got[10])] == [1, 2, 5, 3, 4]       # ties by id, all 5 rows (k > rows)
    assert [i for _, i in sorted(got[11])] == [1, 2, 3, 4, 5]       # zero query: all scores 0


def _random(spark, n, dim, seed=1, m=5):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    v = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "id long, embedding array<double>")
    q = spark.createDataFrame([(100 + i, x[i].tolist()) for i in range(m)], "query_id long, embedding array<double>")
    return x, v, q


def _found(df):
    return sorted((r.query_id, r["rank"], r.id) for r in df.collect())


def _plain(x, ids, m, k):
    out = []
    for i in range(m):
        best = sorted(ids, key=lambda j: (-(x[i] @ x[j]), j))[:k]
        out += [(100 + i, r + 1, j) for r, j in enumerate(best)]
    return sorted(out)


def test_topk_in_many_parts_and_blocks(spark, monkeypatch):
    x, v, q = _random(spark, 300, 8, m=40)
    want = _plain(x, range(300), 40, 7)
    assert _found(vec.knn_batch(spark, v, q, 7)) == want
    monkeypatch.setattr(vec, "PART_ROWS", 29)
    monkeypatch.setattr(vec, "QUERY_ROWS", 6)
    assert _found(vec.knn_batch(spark, v, q, 7)) == want
    some = v.withColumn("id", F.concat(F.lit("é"), F.format_string("%04d", "id")))
    assert [(a, b, int(c[1:])) for a, b, c in _found(vec.knn_batch(spark, some, q, 7))] == want


def test_topk_of_equal_vectors_null_vectors_and_empty_tables(spark):
    same = spark.createDataFrame([(i, [0.1, 0.7, 0.3]) for i in range(500)] + [(-1, None)], "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [0.3, 0.2, 0.9]), (2, [0.0, 0.0, 0.0]), (3, None)], "query_id long, embedding array<double>")
    assert _found(vec.knn_batch(spark, same, q, 3)) == [(j, r, r - 1) for j in (1, 2) for r in (1, 2, 3)]
    assert vec.knn_batch(spark, same.limit(0), q, 3).collect() == []
    assert vec.knn_batch(spark, same, q.limit(0), 3).collect() == []


def test_stored_index_reads_probed_cells_only(spark, tmp_path):
    import glob

    x, v, q = _random(spark, 300, 8)
    idx = ivf.IvfIndex.build(spark, f"{tmp_path}/i", v, ivf.sample_centroids(v, 6))
    assert _found(idx.search(q, 4, 6)) == _plain(x, range(300), 5, 4)
    one = q.filter("query_id = 100")
    cells = {r.cell for r in idx.probes(one, 2).collect()}
    assert len(cells) == 2
    held = [r.id for r in idx.vectors(sorted(cells)).collect()]
    want = _plain(x, held, 1, 4)
    for f in glob.glob(f"{tmp_path}/i/version=1/vectors/cell=*/*.parquet"):
        if int(f.split("cell=")[1].split("/")[0]) not in cells:
            with open(f, "wb") as out:
                out.write(b"not to be read")
    assert _found(idx.search(one, 4, 2)) == want


def test_append_writes_new_rows_only_and_reclustering_is_a_new_version(spark, tmp_path):
    import glob
    import os

    x, v, q = _random(spark, 300, 8)
    path = f"{tmp_path}/i"
    idx = ivf.IvfIndex.build(spark, path, v.filter("id % 2 = 0"), ivf.sample_centroids(v, 6))
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/version=1/vectors/cell=*/*.parquet")}
    assert _found(idx.search(q, 4, 6)) == _plain(x, range(0, 300, 2), 5, 4)
    idx.append(v.unionByName(v.filter("id < 9")))
    assert all(os.path.getmtime(f) == t for f, t in before.items())
    rows = idx.vectors().collect()
    assert sorted(r.id for r in rows) == list(range(300))
    c = np.array([r.centroid for r in sorted(idx.centroids().collect())])
    assert all(r.cell == ((x[r.id] - c) ** 2).sum(axis=1).argmin() for r in rows)
    assert _found(ivf.IvfIndex(spark, path).search(q, 4, 6)) == _plain(x, range(300), 5, 4)
    idx.append(v)
    assert ivf.IvfIndex(spark, path).vectors().count() == 300
    again = idx.recluster(ivf.kmeans_centroids(v, 3))
    assert again.version == 2 and ivf.IvfIndex(spark, path).version == 2
    assert _found(again.search(q, 4, 3)) == _found(idx.search(q, 4, 6)) == _plain(x, range(300), 5, 4)
    stats = again.stats().collect()
    assert sum(r.n_vectors for r in stats) == 300 and {(r.total_vectors, r.dimension) for r in stats} == {(300, 8)}


def test_a_large_cell_is_searched_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vec, "PART_ROWS", 20)
    monkeypatch.setattr(vec, "QUERY_ROWS", 2)
    x, v, q = _random(spark, 200, 4)
    centre = spark.createDataFrame([(0, [0.0] * 4), (1, [9.0] * 4)], "cell int, centroid array<double>")
    idx = ivf.IvfIndex.build(spark, f"{tmp_path}/i", v, centre)
    assert _found(idx.search(q, 5, 2)) == _found(idx.search(q, 5, 1)) == _plain(x, range(200), 5, 5)


def test_moments_far_from_zero_and_principal_axes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)) * [5.0, 1.0, 0.1] + 1e6
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>").repartition(40)
    n, mean, cross = vec.moments(v, fan_in=3)
    y = x - x.mean(axis=0)
    assert n == 400 and np.allclose(mean, x.mean(axis=0), rtol=1e-14)
    assert np.allclose(cross, y.T @ y, rtol=1e-6, atol=1e-4)
    _, axes, variances = vec.principal_axes(v)
    assert np.allclose(axes @ axes.T, np.eye(2), atol=1e-12)
    assert np.allclose(variances, np.linalg.eigvalsh(np.cov(x.T))[::-1][:2], rtol=1e-6)
    p = {r.id: (r.x, r.y) for r in vec.pca_2d(v).collect()}
    got = np.array([p[i] for i in range(400)])
    assert np.allclose(np.cov(got.T), np.diag(variances), atol=1e-4)


def test_encoders_of_a_worker_are_told_apart(spark):
    df = spark.createDataFrame([("1", "some words")], "vector_id string, content string")
    sizes = [len(em.encode(df, factory=lambda d=d: em.HashingEncoder(d)).first().embedding) for d in (8, 16, 8, 32)]
    assert sizes == [8, 16, 8, 32]


def test_upsert_actions_and_duplicate_source(spark):
    import pytest

    t = spark.createDataFrame([("a", 1), ("b", 2)], "vector_id string, x int")
    s = spark.createDataFrame([("b", 20), ("c", 30)], "vector_id string, x int")
    got = {r.vector_id: (r.x, r._action) for r in em.upsert(t, s).collect()}
    assert got == {"a": (1, "kept"), "b": (20, "updated"), "c": (30, "inserted")}
    with pytest.raises(ValueError):
        em.upsert(t, s.unionByName(s))


def test_hashing_encoder_paths_agree(spark):
    from textmill.functions import vectors as vx
    from textmill.functions.sqltext import SPARK

    df = spark.createDataFrame([("1", "Hello world, hello!"), ("2", ""), ("3", "Ünïcode text")], "vector_id string, content string")
    jvm = {r.vector_id: r.e for r in df.select("vector_id", F.expr(vx.hashing_embedding(SPARK, "content")).alias("e")).collect()}
    py = {r.vector_id: r.embedding for r in em.encode(df).collect()}
    for k in jvm:
        assert np.allclose(np.asarray(jvm[k], dtype=np.float32), np.asarray(py[k]), atol=1e-7)
    assert all(x == 0 for x in py["2"])


def test_entry_contract(spark):
    import __spark_entry__ as e

    qs, os_ = e.queries(), e.oracle_sql()
    assert set(os_) <= set(qs) and len(qs) >= 140
    df = e.entry(spark)
    assert df.count() > 0 and "chunk_hash" in df.columns


def test_hashing_column_counts_buckets_in_one_pass(spark):
    """Every width against md5 by Python; the column hashes each token once and scans no text once a bucket."""
    import hashlib

    import regex

    from textmill.functions import vectors as vx
    from textmill.functions.sqltext import SPARK
    from textmill.functions.text import TOKEN_RE

    texts = ["", "a", "a a b", "Ünï-cödé_a,b x1 x2!", " ".join(f"w{i}" for i in range(300)), "q q q . . ,", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for dim in (1, 7, 8, 32, 60, 64):
        sql = vx.hashing_counts(SPARK, "t", dim)
        assert sql.count("md5(") == 1 and ("replace(" not in sql)
        for r in df.select("t", F.expr(sql).alias("v")).collect():
            if r.t is not None:
                want = [0.0] * dim
                for k in regex.findall(TOKEN_RE, r.t):
                    want[int(hashlib.md5(k.encode()).hexdigest()[:8], 16) % dim] += 1
                assert list(r.v) == want, (dim, r.t)
            else:
                assert r.v is None


def test_encoder_keeps_buckets_of_words_within_its_bounds():
    enc = em.HashingEncoder(16)
    enc._buckets.size = 3
    long = "x-" * 100
    texts = ["a b\x1cc　d-e a", "", None, long, "e d"]
    got = enc.encode(texts)
    assert len(enc._buckets) == 3 and long not in enc._buckets
    fresh = em.HashingEncoder(16)
    assert (got == np.vstack([fresh.encode([t]) for t in texts])).all() and not got[1:3].any()
    assert enc.encode([]).shape == (0, 16)


def test_encoded_rows_cross_as_arrow_batches(spark, capsys):
    df = spark.createDataFrame([(1, "a b", 5), (2, None, None)], "vector_id int, content string, extra int")
    e = em.encode(df, keep=("extra",))
    e.explain()
    assert "MapInArrow" in capsys.readouterr().out
    assert {r.vector_id: (r.extra, any(r.embedding), r.model_name) for r in e.collect()} == {
        1: (5, True, "hashing-md5-64"), 2: (None, False, "hashing-md5-64")}
