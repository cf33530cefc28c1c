"""Text cleaning (T01-T15) as DataFrame transforms.

``clean_text`` is the exact reference behaviour: a row-local fold over each
block's lines (no shuffle; pages clean in parallel).  ``merge_soft_wraps_window``
is the set-based form (lag + gaps-and-islands) over exploded lines; it compares
neighbouring *lines* where the reference compares the *accumulated buffer*, so
the two differ after a lone bullet / number / enumerator (see tests).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmill.functions import text as tx
from textmill.functions.sqltext import SPARK, Dialect


def _e(sql: str) -> Column:
    return F.expr(sql)


def clean_text(c: str) -> Column:
    return _e(tx.clean_text(SPARK, c))


def pre_clean(c: str) -> Column:
    return _e(tx.pre_clean(SPARK, c))


def heading_rule(c: str) -> Column:
    return _e(tx.heading_rule(SPARK, c))


def should_merge(prev: str, nxt: str) -> Column:
    return _e(tx.should_merge(SPARK, prev, nxt))


def pdfize(d: Dialect, s: str) -> str:
    """Derive PDF-extraction artefacts from plain text (used by the cleaning queries,
    identically in Spark and in the oracle): soft wraps after commas, hyphen breaks
    inside long words, blank lines after sentence-final lines, trailing spaces, CRLF."""
    x = d.rx_replace(s, r", ", ",\n")
    x = d.rx_replace(x, r"(\p{L}{4})(\p{L}{5,})", "$1-\n$2")
    x = d.rx_replace(x, r"([.!?])\n", "$1\n\n\n")
    x = d.rx_replace(x, r"\n", "  \n")
    return d.rx_replace(x, r"\n", "\r\n")


def explode_lines(df: DataFrame, text_col: str, keep=("doc_id",)) -> DataFrame:
    from textmill.operators.chunk import posexplode_keep

    return posexplode_keep(df, keep, _e(tx.lines(SPARK, text_col)), "pos", "line") \
        .select(*keep, (F.col("pos") + 1).cast("int").alias("line_no"), "line")


def merge_soft_wraps_window(lines: DataFrame, keys: list[str]) -> DataFrame:
    """T13 set-based: lines(keys..., line_no, line) -> paragraphs(keys..., para_no, text)."""
    w = W.partitionBy(*keys).orderBy("line_no")
    cur = F.col("_s")
    # should_merge in its two halves, a fact of each line alone, so that every rule runs once a line
    plain = _e(f"_s <> '' and {tx.stripped_heading_rule(SPARK, '_s')} is null and not {tx.is_bullet(SPARK, '_s')} "
               f"and not {tx.is_table(SPARK, '_s')}")
    facts = lines.withColumn("_s", _e(tx.strip(SPARK, "line"))).withColumn("_plain", plain) \
        .select(*keys, "line_no", "_s", (F.col("_plain") & ~_e(SPARK.rx_like("_s", tx.SENTENCE_END_RE))).alias("_open"),
                (F.col("_plain") & ~_e(SPARK.rx_like("_s", tx.LABEL_START_RE))).alias("_joins"))
    flagged = facts.withColumn("_prev", F.lag("_open").over(w)) \
        .withColumn("_brk", F.when(F.col("_prev").isNull(), True)
                    .otherwise(~(F.col("_prev") & F.col("_joins"))).cast("int")) \
        .withColumn("_para", F.sum("_brk").over(w.rowsBetween(W.unboundedPreceding, 0))) \
        .filter(cur != "")
    grouped = flagged.groupBy(*keys, "_para").agg(
        F.array_sort(F.collect_list(F.struct("line_no", cur.alias("s")))).alias("_l"))
    out = grouped.select(*keys, "_para", _e(tx.collapse_spaces(SPARK, "array_join(_l.s, ' ')")).alias("text"))
    wp = W.partitionBy(*keys).orderBy("_para")
    return out.withColumn("para_no", F.row_number().over(wp).cast("int")).drop("_para")
