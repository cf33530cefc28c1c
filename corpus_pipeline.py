"""The corpus pipeline: quality rules, toxicity, line dedup, n-gram Jaccard join, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs.  All stages but the last return the columns of
documents; labels are read from ``sf_dir``.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from textmill.llm.graph import stored  # noqa: E402
from textmill.llm.jaccard import jaccard_groups  # noqa: E402
from textmill.llm.line_dedup import without_duplicate_lines  # noqa: E402
from textmill.llm.packing import pack_documents  # noqa: E402
from textmill.llm.quality import quality_verdicts  # noqa: E402
from textmill.llm.toxicity import toxicity_scores, trained  # noqa: E402
from textmill.session import configure, read_table  # noqa: E402

TOXIC_SCORE = 0.3


def _plain(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with columns c0, c1, ... in place of its own names, which may be any, and the
    names of its doc_id and text among these."""
    at = {n: f"c{i}" for i, n in enumerate(docs.columns)}
    return docs.toDF(*at.values()), at["doc_id"], at["text"]


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from rows of ``_plain``, under their own names."""
    return rows.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the isolation forest keep.  The verdict is each row's own,
    whatever other rows share its id.  Null and empty texts go."""
    configure(spark)
    rows, doc_id, text = _plain(docs)
    labels = read_table(spark, sf_dir, "labels")
    return _named(quality_verdicts(spark, rows, labels, doc_id, text, keep=rows.columns).filter("kept"), docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxic threshold; each row is scored for itself.  Without
    labelled rows of both classes nothing goes."""
    configure(spark)
    rows, doc_id, text = _plain(docs)
    model = trained(spark, rows, read_table(spark, sf_dir, "labels"), doc_id, text)
    scored = toxicity_scores(spark, rows, model, doc_id, text, keep=rows.columns)
    return _named(scored.filter(F.col("score") < TOXIC_SCORE), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; n_chars follows the text, and a
    document of which no word is left goes.  Null and empty texts and rows without id stay."""
    configure(spark)
    rows, doc_id, text = _plain(docs)
    out = without_duplicate_lines(spark, rows, 95, doc_id, text)
    emptied = (F.col("n_removed") > 0) & ~F.col(text).rlike(r"[^\x20\x09-\x0D]")
    out = out.filter(~F.coalesce(emptied, F.lit(False)))
    size = f"c{docs.columns.index('n_chars')}"
    changed = F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col(size))
    return _named(out.withColumn(size, changed.cast(rows.schema[size].dataType)), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents, the one of least id: five-word
    shingles, a Jaccard similarity of 0.8.  Of rows with equal id and text one stays; texts
    without words and rows without id are linked with nothing."""
    configure(spark)
    rows, doc_id, text = _plain(docs)
    # 128 bits of the id and the text name a row; only these meet the verdicts
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (doc_id, text)]
    marks = [F.col(c).isNull().cast("string") for c in (doc_id, text)]
    rows = rows.withColumn("row", F.md5(F.concat_ws("|", *marks, *known)))
    groups = jaccard_groups(spark, rows, doc_id, text, width=5, percent=80, row_col="row")
    first = groups.filter("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    kept = first.select("first.row").unionByName(groups.filter("root is null").select("row")).distinct()
    return _named(rows.join(kept, "row", "left_semi").dropDuplicates(["row"]), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: the pieces of every document and their places; null
    and empty texts are one piece, the end id."""
    configure(spark)
    return pack_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("toxicity", toxicity), ("line dedup", lines),
          ("n-gram Jaccard join", near_copies), ("best-fit packing", packing)]

#: No SQL for forests, dictionaries and SimHash; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    configure(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
