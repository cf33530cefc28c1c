"""Session helpers.

Everything that changes results is pinned here once: UTC session time zone,
ANSI mode on (so casts that should fail do fail; parsers use ``try_*``), AQE on.
A cluster supplies its own ``spark.checkpoint.dir``; we only fill it in when
it is unset (local tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every query relies on for identical results across runs.
_RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Execution defaults; a cluster deployment overrides these in its own conf.
_EXEC_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "textmill") -> SparkSession:
    """Return (or build) the session with the result-affecting settings pinned."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in {**_EXEC_CONF, **_RESULT_CONF}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the result-affecting settings to an existing session (e.g. the driver's)."""
    for k, v in _RESULT_CONF.items():
        spark.conf.set(k, v)
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``textmill`` importable in the Python workers (Arrow batch functions are
    pickled by reference to their module): zip the package once per SparkContext and
    hand it to ``addPyFile``, which distributes it with the job."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="textmill-py-"), "textmill.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and scratch tables.

    On a cluster this is ``spark.checkpoint.dir`` from the session (a shared
    file system).  Only when it is unset and the session is local, as in
    tests, a fresh temporary folder is created and registered.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="textmill-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
        spark.sparkContext.setCheckpointDir(current)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, not yet existing path under the shared checkpoint folder for a written table.
    Which file system a folder without a scheme lies on is the cluster's to say."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    base = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    if not base.startswith("file:"):
        return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    base = "/" + base[len("file:"):].lstrip("/")
    os.makedirs(base, exist_ok=True)
    return os.path.join(tempfile.mkdtemp(prefix=f"{name}-", dir=base), "d")


def written(df, name: str = "written"):
    """``df`` written once as Parquet under the shared folder and read back.  It cuts lineage as
    ``checkpoint()`` does, which computes the rows a second time to write them."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(table_path(sf_dir, name))


def _path_bytes(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())


def spread(spark: SparkSession, df, input_bytes: int, bytes_per_task: int = 32 << 20):
    """Give CPU-heavy row-local work (text folds, regexes) every core when the input is
    too small to be split that many ways by the scan (a single row group becomes one
    task).  Large inputs already scan as many splits as there are row groups, so they
    are left alone: the round-robin shuffle only happens when it is cheap."""
    cores = spark.sparkContext.defaultParallelism
    if input_bytes < cores * bytes_per_task:
        return df.repartition(cores)
    return df


def read_text_table(spark: SparkSession, sf_dir: str, name: str):
    """``read_table`` for the text tables whose per-row work dominates (documents, pages)."""
    path = table_path(sf_dir, name)
    return spread(spark, spark.read.parquet(path), _path_bytes(spark, path))
