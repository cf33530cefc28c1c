"""Cleaning queries (T01-T15) over ``documents``.

The driver's texts have single newlines only, so each query first derives the
artefact it needs (CRLF, trailing spaces, hyphen breaks, blank lines, soft
wraps) with the same regex rewrite in Spark and in the oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import text as tx
from textmill.functions.sqltext import DUCK, SPARK
from textmill.operators import clean as cl
from textmill.operators.chunk import posexplode_keep
from textmill.plans.chunk_plans import duck_explode
from textmill.plans.registry import register
from textmill.session import read_table, read_text_table


def _docs(spark, sf):
    return read_text_table(spark, sf, "documents")


def _x(sql):
    return F.expr(sql)


RAW_S = cl.pdfize(SPARK, "text")
RAW_D = cl.pdfize(DUCK, "text")


@register("clean_newlines", oracle=f"""
  SELECT doc_id, {tx.norm_newlines(DUCK, "replace(text, chr(10), chr(13) || chr(10))")} = text AS restored,
         length({tx.norm_newlines(DUCK, RAW_D)}) AS n_chars FROM documents""")
def clean_newlines(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id",
                    (_x(tx.norm_newlines(SPARK, "replace(text, '\\n', '\\r\\n')")) == F.col("text")).alias("restored"),
                    F.length(_x(tx.norm_newlines(SPARK, RAW_S))).alias("n_chars"))


@register("clean_trailing", oracle=f"""
  SELECT doc_id, {tx.strip_trailing(DUCK, "replace(text, chr(10), ' ' || chr(9) || ' ' || chr(10))")} = text AS restored,
         md5({tx.strip_trailing(DUCK, tx.norm_newlines(DUCK, RAW_D))}) AS md5_out FROM documents""")
def clean_trailing(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id",
                    (_x(tx.strip_trailing(SPARK, "replace(text, '\\n', ' \\t \\n')")) == F.col("text")).alias("restored"),
                    F.md5(_x(tx.strip_trailing(SPARK, tx.norm_newlines(SPARK, RAW_S)))).alias("md5_out"))


_HY_S = SPARK.rx_replace("text", r"(\p{L}{4})(\p{L}{5,})", "$1-\n$2")
_HY_D = DUCK.rx_replace("text", r"(\p{L}{4})(\p{L}{5,})", "$1-\n$2")


@register("clean_dehyphen", oracle=f"""
  SELECT doc_id, {tx.dehyphenate(DUCK, _HY_D)} = text AS restored,
         length({_HY_D}) - length({tx.dehyphenate(DUCK, _HY_D)}) AS removed_chars,
         md5({tx.dehyphenate(DUCK, "text || ' a-' || chr(10) || 'b-' || chr(10) || chr(10) || ' c'")}) AS chain_md5
  FROM documents""")
def clean_dehyphen(spark, sf):
    d = _docs(spark, sf)
    chain = "concat(text, ' a-\\n', 'b-\\n\\n c')"
    return d.select("doc_id", (_x(tx.dehyphenate(SPARK, _HY_S)) == F.col("text")).alias("restored"),
                    (F.length(_x(_HY_S)) - F.length(_x(tx.dehyphenate(SPARK, _HY_S)))).alias("removed_chars"),
                    F.md5(_x(tx.dehyphenate(SPARK, chain))).alias("chain_md5"))


@register("clean_blanklines", oracle=f"""
  SELECT doc_id, md5(p) AS md5_out, len(string_split(p, chr(10) || chr(10))) AS n_parts
  FROM (SELECT doc_id, {tx.pre_clean(DUCK, RAW_D)} AS p FROM documents)""")
def clean_blanklines(spark, sf):
    d = _docs(spark, sf).select("doc_id", _x(tx.pre_clean(SPARK, RAW_S)).alias("p"))
    return d.select("doc_id", F.md5("p").alias("md5_out"), F.size(F.split("p", "\n\n")).alias("n_parts"))


@register("block_explode", oracle=f"""
  SELECT doc_id, block_no, length(block) AS n_chars, md5(block) AS md5_block
  FROM {duck_explode("documents", "doc_id", tx.blocks(DUCK, tx.pre_clean(DUCK, RAW_D)), "block_no", "block")}""")
def block_explode(spark, sf):
    d = posexplode_keep(_docs(spark, sf), ["doc_id"], _x(tx.blocks(SPARK, tx.pre_clean(SPARK, RAW_S))), "pos", "block")
    return d.select("doc_id", (F.col("pos") + 1).cast("int").alias("block_no"),
                    F.length("block").alias("n_chars"), F.md5("block").alias("md5_block"))


# --- line probes: every document line, and all its text again in short lines that trigger each rule ---
#: The whole line in consecutive parts of at most 60 characters.
PARTS_RE = "(?s).{1,60}"


#: No ASCII letter or space.  Java takes 15 times longer for the negated class than for its ranges.
NOT_ALPHA_JAVA = r"[\x00-\x1F!-@\[-`{-\x{10FFFF}]"


def _variants(d):
    cast = (lambda s: f"cast({s} as string)") if d.spark else (lambda s: f"cast({s} as varchar)")
    return {
        "part": "part",
        "bullet": "concat('- ', part)",
        "enum": "concat(substr('abcIVX', cast(part_no % 6 AS INT) + 1, 1), ') ', part)",
        # ASCII only: Spark upper-cases 'ß' to 'SS', DuckDB to 'ẞ'.
        "caps": f"upper({d.rx_replace('part', NOT_ALPHA_JAVA if d.spark else '[^A-Za-z ]', '')})",
        "numbered": f"concat({cast('line_no')}, '.', {cast('doc_id % 7')}, ' ', part, if(part_no % 3 = 0, ' and then some more', ''))",
        "table": "replace(part, ' ', '    ')",
        "code": "concat('    ', part)",
        "colon": "concat(part, ':')",
        "label": "concat('Note: ', part)",
        "lone_bullet": "if(part_no % 2 = 0, '-', concat(part_no, '.'))",
    }


def _probe_spark(spark, sf):
    """Lines are cut once: part 0 is the whole line, each other part gives a row a variant."""
    lines = cl.explode_lines(_docs(spark, sf), "text")
    parts = posexplode_keep(lines, ["doc_id", "line_no"], _x(f"concat(array(line), {SPARK.rx_all('line', PARTS_RE)})"), "part_no", "part")
    short = ", ".join(f"struct('{k}' AS variant, {e} AS line)" for k, e in _variants(SPARK).items())
    return parts.select("doc_id", "line_no", "part_no",
                        _x(f"inline(if(part_no = 0, array(struct('plain' AS variant, part AS line)), array({short})))"))


def _probe_duck():
    lines = duck_explode("documents", "doc_id", tx.lines(DUCK, "text"), "line_no", "line")
    parts = duck_explode(lines, "doc_id, line_no", DUCK.rx_all("line", PARTS_RE), "part_no", "part")
    short = " UNION ALL ".join(f"SELECT doc_id, line_no, part_no, '{k}' AS variant, {e} AS line FROM {parts}"
                               for k, e in _variants(DUCK).items())
    return f"(SELECT doc_id, line_no, 0 AS part_no, 'plain' AS variant, line FROM {lines} UNION ALL {short})"


PROBE_D = _probe_duck()


def _probe_query(name, spark_sql, duck_expr):
    """``spark_sql`` is over the line and over ``s``, the line stripped once."""
    col = name.split("line_")[1]

    @register(name, oracle=f"SELECT doc_id, line_no, part_no, variant, {duck_expr} AS {col} FROM {PROBE_D}")
    def q(spark, sf):
        p = _probe_spark(spark, sf).withColumn("s", _x(tx.strip(SPARK, "line")))
        return p.select("doc_id", "line_no", "part_no", "variant", F.expr(spark_sql).alias(col))
    q.__name__ = name
    return q


_probe_query("line_is_bullet", tx.is_bullet(SPARK, "s"), tx.is_bullet(DUCK, tx.strip(DUCK, "line")))
_probe_query("line_is_caps", tx.is_all_caps(SPARK, "s"), tx.is_all_caps(DUCK, tx.strip(DUCK, "line")))
_probe_query("line_is_numbered", tx.is_numbered(SPARK, "s"), tx.is_numbered(DUCK, tx.strip(DUCK, "line")))
_probe_query("line_title_ratio", f"round({tx.title_ratio(SPARK, 's')}, 6)",
             f"round({tx.title_ratio(DUCK, tx.strip(DUCK, 'line'))}, 6)")
_probe_query("line_is_heading", tx.stripped_heading_rule(SPARK, "s"), tx.heading_rule(DUCK, "line"))
_probe_query("line_is_table", tx.is_table(SPARK, "line"), tx.is_table(DUCK, "line"))


# --- T12 / T13 on the derived raw text -------------------------------------------------------
_PRE_LINES_D = duck_explode(
    duck_explode("documents", "doc_id", tx.blocks(DUCK, tx.pre_clean(DUCK, RAW_D)), "block_no", "block"),
    "doc_id, block_no", tx.lines(DUCK, "block"), "line_no", "line")


def _pre_lines(spark, sf):
    b = posexplode_keep(_docs(spark, sf), ["doc_id"], _x(tx.blocks(SPARK, tx.pre_clean(SPARK, RAW_S))), "pos", "block")
    b = b.select("doc_id", (F.col("pos") + 1).cast("int").alias("block_no"), "block")
    return cl.explode_lines(b, "block", keep=("doc_id", "block_no"))


@register("line_should_merge", oracle=f"""
  SELECT doc_id, block_no, line_no, {tx.should_merge(DUCK, 'prev', 'line')} AS merge_with_prev
  FROM (SELECT doc_id, block_no, line_no, line,
               lag(line) OVER (PARTITION BY doc_id, block_no ORDER BY line_no) AS prev FROM {_PRE_LINES_D})
  WHERE prev IS NOT NULL""")
def line_should_merge(spark, sf):
    from pyspark.sql import Window as W

    ln = _pre_lines(spark, sf)
    w = W.partitionBy("doc_id", "block_no").orderBy("line_no")
    return ln.withColumn("prev", F.lag("line").over(w)).filter(F.col("prev").isNotNull()) \
        .select("doc_id", "block_no", "line_no", cl.should_merge("prev", "line").alias("merge_with_prev"))


@register("merge_soft_wraps", oracle=f"""
  SELECT doc_id, block_no, cast(row_number() OVER (PARTITION BY doc_id, block_no ORDER BY para) AS INTEGER) AS para_no,
         {tx.collapse_spaces(DUCK, "string_agg(s, ' ' ORDER BY line_no)")} AS text
  FROM (SELECT doc_id, block_no, line_no, {tx.strip(DUCK, 'line')} AS s,
               sum(brk) OVER (PARTITION BY doc_id, block_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS para
        FROM (SELECT *, CASE WHEN prev IS NULL THEN 1
                             WHEN {tx.should_merge(DUCK, 'prev', 'line')} THEN 0 ELSE 1 END AS brk
              FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id, block_no ORDER BY line_no) AS prev
                    FROM {_PRE_LINES_D})))
  WHERE s <> ''
  GROUP BY doc_id, block_no, para""")
def merge_soft_wraps(spark, sf):
    return cl.merge_soft_wraps_window(_pre_lines(spark, sf), ["doc_id", "block_no"])


@register("clean_spaces", oracle=f"""
  SELECT doc_id, {tx.collapse_spaces(DUCK, "replace(text, ' ', ' ' || chr(9) || '  ')")} =
                 {tx.collapse_spaces(DUCK, 'text')} AS restored,
         length({tx.collapse_spaces(DUCK, "'  ' || text || ' ' || chr(9)")}) AS n_chars FROM documents""")
def clean_spaces(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id",
                    (_x(tx.collapse_spaces(SPARK, "replace(text, ' ', ' \\t  ')")) ==
                     _x(tx.collapse_spaces(SPARK, "text"))).alias("restored"),
                    F.length(_x(tx.collapse_spaces(SPARK, "concat('  ', text, ' \\t')"))).alias("n_chars"))


@register("clean_text", oracle=f"""
  SELECT doc_id, c AS cleaned, length(c) AS n_chars, len(string_split(c, chr(10) || chr(10))) AS n_blocks
  FROM (SELECT doc_id, {tx.clean_text(DUCK, RAW_D)} AS c FROM documents)""")
def clean_text_q(spark, sf):
    d = _docs(spark, sf).select("doc_id", _x(tx.clean_text(SPARK, RAW_S)).alias("c"))
    return d.select("doc_id", F.col("c").alias("cleaned"), F.length("c").alias("n_chars"),
                    F.size(F.split("c", "\n\n")).alias("n_blocks"))
