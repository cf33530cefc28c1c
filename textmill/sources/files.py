"""File sources and the session sandbox.

* ``binary_documents`` — a folder of documents as (path, modificationTime,
  length, content) with Spark's ``binaryFile`` source, for files that fit in a row; the page
  extractor is a plug-in run with ``mapInPandas`` (default: UTF-8 text, pages of N lines).
  ``sources.documents`` reads files of any size.
* ``read_csv`` — header + sniffed types, registered as the view ``data``.
* ``Sandbox`` — one Spark database per session, stored under the shared
  scratch folder; load-if-absent, list, DML as new table versions, drop.
* ``query_source`` — read-only SQL over a view, screened before it runs:
  only SELECT / WITH / EXPLAIN, a length limit, and a check of the plan's root
  (EXPLAIN never executes) that refuses commands; results are previewed capped.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.operators.logs import INNER_WRITE_RE, QUOTED_RE, READ_ONLY_KEYWORDS, SANDBOX_SQL_MAX, SOURCE_SQL_MAX
from textmill.session import scratch_path

PREVIEW_ROWS = 50


def binary_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Every file under ``path`` matching ``glob`` (recursively)."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true").load(path))


def text_pages(lines_per_page: int = 4) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Default extractor plug-in: decode UTF-8 and cut every ``lines_per_page`` lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                lines = bytes(content).decode("utf-8", errors="replace").split("\n")
                for at in range(0, len(lines), 1000 * lines_per_page):
                    some = range(at, min(at + 1000 * lines_per_page, len(lines)), lines_per_page)
                    yield pd.DataFrame([(path, i // lines_per_page + 1, "\n".join(lines[i:i + lines_per_page])) for i in some],
                                       columns=["path", "page_no", "content"])

    return run


def extract_pages(files: DataFrame, extractor=None) -> DataFrame:
    """S02 for binary files: (path, page_no, content) with a pluggable extractor."""
    fn = extractor or text_pages()
    return files.select("path", "content").mapInPandas(fn, "path string, page_no int, content string")


def read_csv(spark: SparkSession, path: str, view: str = "data") -> DataFrame:
    """S08 + S09: header, sniffed types, and the view name the SQL tool uses."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    df.createOrReplaceTempView(view)
    return df


def schema_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """(table, pos, column, type) plus total rows, as one small DataFrame."""
    n = df.count()
    rows = [(name, i + 1, f.name, f.dataType.simpleString(), n) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table string, pos int, column string, type string, n_rows long")


def preview(df: DataFrame, order: list, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` rows in a stated order, with the total row count and a truncated flag.

    The rows are computed once: every task counts its own and passes on its first ``n`` (as
    TakeOrderedAndProject would), and the counts meet those in the result.  A query without
    rows gives one row of nulls with a total of 0, so that it can be told from a failure."""
    spark = df.sparkSession
    seen = Observation("preview_" + uuid.uuid4().hex)
    head = df.observe(seen, F.count(F.lit(1)).alias("n")).orderBy(*order).limit(n)
    rows = head.collect()  # n rows at most
    total = seen.get["n"]
    shape = T.StructType([*[T.StructField(f.name, f.dataType) for f in df.schema.fields],
                          T.StructField("total_rows", T.LongType()), T.StructField("truncated", T.BooleanType())])
    out = [(*r, total, total > n) for r in rows] or [(*[None] * len(df.columns), 0, False)]
    return spark.createDataFrame(out, shape)


#: First words refused in a sandbox: they leave its database or its tables.
SANDBOX_REFUSED = ("use", "set", "reset", "add", "load")


class GuardError(ValueError):
    pass


def screen(sql: str, max_len: int) -> None:
    """One read-only statement: comments, literals and quoted names do not count as words."""
    if len(sql) > max_len:
        raise GuardError(f"query longer than {max_len} characters")
    statements = [x.strip() for x in _words(sql).split(";") if x.strip()]
    if not statements:
        raise GuardError("empty query")
    if len(statements) > 1:
        raise GuardError("one statement only")
    first = re.match(r"[\s(]*([A-Za-z]*)", statements[0]).group(1)
    if first.lower() not in READ_ONLY_KEYWORDS:
        raise GuardError(f"only SELECT / WITH / EXPLAIN allowed, got {first or statements[0][:10]!r}")
    if re.search(INNER_WRITE_RE, statements[0]):
        raise GuardError("statement would modify data")


def _words(sql: str) -> str:
    return re.sub(QUOTED_RE, " ", sql)


def query_source(spark: SparkSession, sql: str, max_len: int = SOURCE_SQL_MAX) -> DataFrame:
    """Read-only SQL.  What the screen lets through is explained, which never runs it; a
    plan whose root is a command, or that cannot be made, refuses the query."""
    screen(sql, max_len)
    sql = re.sub(r"[\s;]+$", "", sql)
    try:
        if not re.match(r"(?i)explain\b", _words(sql).strip()):
            plan = spark.sql("EXPLAIN " + sql).first()[0]
            root = plan.split("== Physical Plan ==", 1)[-1].strip()
            if re.match(r"(?i)error occurred|execute |command|appenddata|overwrite|create|drop|delete|update|merge|replace", root):
                raise GuardError("statement would modify data")
        return spark.sql(sql)
    except PySparkException as e:
        raise GuardError(f"query refused: {str(e).splitlines()[0][:300]}") from None


class Sandbox:
    """A per-session database in the shared scratch folder."""

    def __init__(self, spark: SparkSession, session_id: str):
        self.spark = spark
        self.db = "session_" + re.sub(r"[^A-Za-z0-9_]", "_", session_id)
        self.location = scratch_path(spark, self.db)
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.db} LOCATION '{self.location}'")

    def table(self, name: str) -> str:
        return f"{self.db}.{name}"

    def load(self, name: str, df: DataFrame) -> int:
        """Copy a source in unless the table exists (a second load is a no-op); row count."""
        if not self.spark.catalog.tableExists(self.table(name)):
            df.write.format("parquet").saveAsTable(self.table(name))
        return self.spark.table(self.table(name)).count()

    def tables(self) -> DataFrame:
        """S11."""
        return self.spark.sql(f"SHOW TABLES IN {self.db}").filter(~F.col("isTemporary")) \
            .select(F.col("tableName").alias("table_name"))

    def sql(self, sql: str) -> DataFrame:
        """Any SQL inside the sandbox, length-capped.  Plain names are the sandbox's own; other
        databases cannot be created, changed, switched to or written, nor other sessions read."""
        if len(sql) > SANDBOX_SQL_MAX:
            raise GuardError(f"query longer than {SANDBOX_SQL_MAX} characters")
        words = re.sub(QUOTED_RE.rpartition("|")[0], " ", sql).replace("`", "").lower()
        first = (re.match(r"[\s(]*([a-z]*)", words) or [""])[1]
        if first in SANDBOX_REFUSED or re.search(r"\b(create|drop|alter)\s+(database|schema|namespace|catalog)\b", words):
            raise GuardError("the sandbox has one database")
        if re.search(r"\blocation\s", words) or re.search(r"\b(parquet|csv|json|orc|text|avro|binaryfile)\s*\.", words):
            raise GuardError("the sandbox has no paths")
        foreign = {q for q in re.findall(r"\b(session_\w+)\s*\.", words) if q != self.db.lower()}
        target = re.search(r"\b(?:table|view|into|overwrite|update|delete\s+from)\s+(?:table\s+)?"
                           r"(?:if\s+(?:not\s+)?exists\s+)?(\w+)\s*\.", words)
        if target and target[1] != self.db.lower():
            foreign.add(target[1])
        if foreign:
            raise GuardError(f"outside the sandbox: {', '.join(sorted(foreign))}")
        before = self.spark.catalog.currentDatabase()
        self.spark.catalog.setCurrentDatabase(self.db)
        try:
            return self.spark.sql(sql)
        finally:
            self.spark.catalog.setCurrentDatabase(before)

    def save_version(self, name: str, df: DataFrame) -> str:
        """DML lands as a new table version (name_vN), never an in-place rewrite of
        the table being read."""
        existing = {r.tableName for r in self.spark.sql(f"SHOW TABLES IN {self.db}").collect()}
        v = 2
        while f"{name}_v{v}" in existing:
            v += 1
        target = self.table(f"{name}_v{v}")
        df.write.format("parquet").saveAsTable(target)
        return target

    def drop(self) -> None:
        """S12."""
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.db} CASCADE")
