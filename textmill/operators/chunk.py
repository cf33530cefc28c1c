"""Pages, sentences, tokens and chunk rows (S02, C01-C11) as DataFrame transforms.

All of these are narrow (row-local) transformations: a page is split, cleaned,
segmented and packed inside one row with built-in higher-order functions, so
the plan is scan -> project/generate with no shuffle, and pages of one
document spread over any number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import packer
from textmill.functions import text as tx
from textmill.functions.sqltext import SPARK, Dialect

LINES_PER_PAGE = 4


def _e(sql: str) -> Column:
    return F.expr(sql)


def posexplode_keep(df: DataFrame, keep, arr: Column | str, pos: str = "pos", val: str = "val") -> DataFrame:
    """``posexplode`` without the ``size(arr) > 0`` filter Spark infers for an inner
    generator: that filter is pushed below the projection and would evaluate an
    expensive array expression (a fold) twice.  The outer form plus a filter on the
    generated position keeps one evaluation and drops the empty-array row."""
    return df.select(*keep, F.posexplode_outer(arr).alias(pos, val)).filter(F.col(pos).isNotNull())


# --- S02 -----------------------------------------------------------------------------------
def pages_sql(d: Dialect, text: str, lines_per_page: int = LINES_PER_PAGE) -> str:
    """Stand-in page extractor for text documents: every ``lines_per_page`` lines form a page."""
    k = d.idiv(f"{d.size('ln__')} + {lines_per_page - 1}", str(lines_per_page))
    body = d.join(d.slice("ln__", f"i * {lines_per_page} + 1", str(lines_per_page)),
                  "'\\n'" if d.spark else "chr(10)")
    return d.let(tx.lines(d, text), "ln__", d.transform(d.seq("0", f"{k} - 1"), "i", body))


def explode_pages(df: DataFrame, text_col: str = "text", keep=("doc_id",),
                  lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """One row per page with a 1-based ``page_no`` (narrow: generate, no shuffle)."""
    return posexplode_keep(df, keep, _e(pages_sql(SPARK, text_col, lines_per_page)), "pos", "content") \
        .select(*keep, (F.col("pos") + 1).cast("int").alias("page_no"), "content")


# --- C01-C04 ------------------------------------------------------------------------------
def sentences(c: str) -> Column:
    return _e(tx.sentences(SPARK, c))


def tokens(c: str) -> Column:
    return _e(tx.tokens(SPARK, c))


def token_count(c: str) -> Column:
    return F.size(tokens(c))


def explode_sentences(df: DataFrame, text_col: str, keep=("doc_id",)) -> DataFrame:
    return posexplode_keep(df, keep, sentences(text_col), "pos", "sentence") \
        .select(*keep, (F.col("pos") + 1).cast("int").alias("sent_no"), "sentence")


def token_tail(toks: str, n: int) -> Column:
    return _e(tx.token_tail(SPARK, toks, str(n)))


def token_split(toks: str, n: int) -> Column:
    return _e(tx.token_split(SPARK, toks, str(n)))


# --- C05 / C06 ------------------------------------------------------------------------------
def overlap_of(sents: str, **kw) -> Column:
    """C05 on a whole sentence list treated as one finished chunk -> seed text ('' if none)."""
    d = SPARK
    structs = packer.sentence_structs(d, sents)
    tok = d.reduce(d.transform(structs, "q_", d.size("q_.toks")), "0", "a_", "b_", "a_ + b_")
    ov = kw.get("ov", tx.OVERLAP_TOKENS)
    mn = kw.get("mn", tx.MIN_OVERLAP_TOKENS)
    seed = packer.overlap(d, "cs_", "tk_", ov, mn)
    return _e(d.let(structs, "cs_", d.let(tok, "tk_", f"coalesce(try_element_at({seed}, 1).t, '')")))


def pack_sentences(sents: str, **kw) -> Column:
    """array<string> of sentences -> array<string> of chunk texts."""
    d = SPARK
    clean = d.filter(d.transform(sents, "u_", tx.strip(d, "u_")), "u_", "u_ <> ''")
    return _e(packer.pack_spark(clean, **kw))


# --- C07-C09 ----------------------------------------------------------------------------------
def doc_id_from_path(path: Column) -> Column:
    """C07: "doc_" + first 16 hex of sha256(lower(posix path))."""
    posix = F.regexp_replace(path, r"\\", "/")
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.lower(posix), 256), 1, 16))


def chunk_hash(doc_id: Column, page_no: Column, chunk_id: Column, content: Column) -> Column:
    """sha256 of doc::page::chunk::content; a null page prints as 'None' like the reference."""
    page = F.coalesce(page_no.cast("string"), F.lit("None"))
    return F.sha2(F.concat_ws("::", doc_id, page, chunk_id.cast("string"), content), 256)


def chunk_rows(df: DataFrame, chunks_col: str, run_id: Column, path_col: str = "pdf_path") -> DataFrame:
    """One row per chunk, ``chunk_id`` 1-based within the page, hash and run id attached."""
    out = posexplode_keep(df, ["doc_id", path_col, "page_no"], F.col(chunks_col), "pos", "content")
    return out.select(
        "doc_id",
        (F.col("pos") + 1).cast("int").alias("chunk_id"),
        F.col(path_col).alias("pdf_path"),
        F.col("page_no").cast("int").alias("page_no"),
        "content",
        chunk_hash(F.col("doc_id"), F.col("page_no"), F.col("pos") + 1, F.col("content")).alias("chunk_hash"),
        run_id.alias("run_id"),
    )


# --- C10 ------------------------------------------------------------------------------------
def flat_chunk_job(pages: DataFrame, run_id: Column, **kw) -> DataFrame:
    """pages(doc_id, pdf_path, page_no, content) -> clean -> sentences -> pack -> chunk rows."""
    packed = pages.select(
        "doc_id", "pdf_path", "page_no",
        pack_sentences(tx.sentences(SPARK, tx.clean_text(SPARK, "content")), **kw).alias("chunks"))
    return chunk_rows(packed, "chunks", run_id)


# --- C11 ------------------------------------------------------------------------------------
def fixed_windows_sql(d: Dialect, toks: str, size: int, overlap: int) -> str:
    """Token windows of ``size`` starting every ``size - overlap`` tokens; the last window
    is the one reaching the end."""
    step = size - overlap
    n = d.size("fw__")
    k = f"greatest({d.idiv(f'{n} - {overlap} + {step} - 1', str(step))}, if({n} > 0, 1, 0))"
    return d.let(toks, "fw__", d.transform(d.seq("0", f"{k} - 1"), "i",
                                           d.join(d.slice("fw__", f"i * {step} + 1", str(size)))))


def fixed_windows(toks: str, size: int, overlap: int) -> Column:
    return _e(fixed_windows_sql(SPARK, toks, size, overlap))
