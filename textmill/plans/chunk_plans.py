"""Pages, sentences, tokens and flat chunks over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import packer
from textmill.functions import text as tx
from textmill.functions.sqltext import DUCK, SPARK
from textmill.operators import chunk as ch
from textmill.plans.registry import register
from textmill.session import read_table, read_text_table

FIXED_RUN_ID = "20260101T000000Z"

# A document's stand-in file path (mixed case, so doc_id's lower() matters).
PATH_SQL = "concat('Docs/', source, '/Doc_', cast(doc_id as varchar), '.PDF')"


def _docs(spark, sf):
    return read_text_table(spark, sf, "documents")


def _pages(spark, sf):
    docs = _docs(spark, sf).select(
        ch.doc_id_from_path(F.expr(PATH_SQL.replace("varchar", "string"))).alias("doc_id"),
        F.expr(PATH_SQL.replace("varchar", "string")).alias("pdf_path"), "text")
    return ch.explode_pages(docs, "text", keep=("doc_id", "pdf_path"))


def duck_explode(src: str, cols: str, arr: str, pos: str = "pos", val: str = "val") -> str:
    """DuckDB posexplode: rows of ``cols`` + 1-based ``pos`` + element ``val``."""
    return (f"(SELECT {cols}, cast(generate_subscripts(a__, 1) AS INTEGER) AS {pos}, unnest(a__) AS {val} "
            f"FROM (SELECT {cols}, {arr} AS a__ FROM {src}))")


def _duck_doc_id(path: str) -> str:
    return f"'doc_' || substr(sha256(lower(replace({path}, '\\', '/'))), 1, 16)"


DUCK_PAGES = f"""
  SELECT doc_id, pdf_path, page_no, content FROM {duck_explode(
      f"(SELECT {_duck_doc_id(PATH_SQL)} AS doc_id, {PATH_SQL} AS pdf_path, text FROM documents)",
      "doc_id, pdf_path", ch.pages_sql(DUCK, 'text'), "page_no", "content")}
"""


@register("page_explode", oracle=f"SELECT doc_id, page_no, length(content) AS n_chars, md5(content) AS content_md5 FROM ({DUCK_PAGES})")
def page_explode(spark, sf):
    p = _pages(spark, sf)
    return p.select("doc_id", "page_no", F.length("content").alias("n_chars"),
                    F.md5("content").alias("content_md5"))


DUCK_SENTS = f"""
  SELECT doc_id, sent_no, sentence FROM {duck_explode("documents", "doc_id", tx.sentences(DUCK, 'text'), "sent_no", "sentence")}
"""


@register("sentence_explode", oracle=DUCK_SENTS)
def sentence_explode(spark, sf):
    return ch.explode_sentences(_docs(spark, sf), "text")


@register("token_count", oracle=f"""
  SELECT doc_id, lang, len({tx.tokens(DUCK, 'text')}) AS n_tokens,
         len(regexp_extract_all(text, '\\S+')) AS n_words
  FROM documents""")
def token_count(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", "lang", ch.token_count("text").alias("n_tokens"),
                    F.size(F.regexp_extract_all("text", F.lit(r"\S+"), 0)).alias("n_words"))


@register("token_tail", oracle=f"""
  SELECT doc_id, {tx.token_tail(DUCK, 't', '12')} AS tail12, {tx.token_tail(DUCK, 't', '0')} AS tail0,
         {tx.token_tail(DUCK, 't', '100000')} = array_to_string(t, ' ') AS tail_all
  FROM (SELECT doc_id, {tx.tokens(DUCK, 'text')} AS t FROM documents)""")
def token_tail(spark, sf):
    d = _docs(spark, sf).select("doc_id", ch.tokens("text").alias("t"))
    return d.select("doc_id", ch.token_tail("t", 12).alias("tail12"), ch.token_tail("t", 0).alias("tail0"),
                    (ch.token_tail("t", 100000) == F.array_join("t", " ")).alias("tail_all"))


@register("token_split", oracle=f"""
  SELECT doc_id, piece_no, array_to_string(p, ' ') AS piece, len(p) AS n_tokens
  FROM {duck_explode("documents", "doc_id", tx.token_split(DUCK, tx.tokens(DUCK, 'text'), '50'), "piece_no", "p")}""")
def token_split(spark, sf):
    d = _docs(spark, sf).select("doc_id", ch.tokens("text").alias("t"))
    return ch.posexplode_keep(d, ["doc_id"], ch.token_split("t", 50), "pos", "p") \
        .select("doc_id", (F.col("pos") + 1).cast("int").alias("piece_no"),
                F.array_join("p", " ").alias("piece"), F.size("p").alias("n_tokens"))


def _duck_overlap(sents: str) -> str:
    d = DUCK
    structs = packer.sentence_structs(d, sents)
    tok = d.reduce(d.transform(structs, "q_", d.size("q_.toks")), "0", "a_", "b_", "a_ + b_")
    seed = packer.overlap(d, "cs_", "tk_", tx.OVERLAP_TOKENS, tx.MIN_OVERLAP_TOKENS)
    return d.let(structs, "cs_", d.let(tok, "tk_", f"coalesce(({seed})[1].t, '')"))


@register("chunk_overlap", oracle=f"""
  SELECT doc_id, ov AS overlap_text, len({tx.tokens(DUCK, 'ov')}) AS overlap_tokens
  FROM (SELECT doc_id, {_duck_overlap(tx.sentences(DUCK, 'text'))} AS ov FROM documents)""")
def chunk_overlap(spark, sf):
    d = _docs(spark, sf).select("doc_id", ch.sentences("text").alias("s"))
    return d.select("doc_id", ch.overlap_of("s").alias("overlap_text")) \
        .select("doc_id", "overlap_text", ch.token_count("overlap_text").alias("overlap_tokens"))


def _duck_pack(sents: str) -> str:
    d = DUCK
    clean = d.filter(d.transform(sents, "u_", tx.strip(d, "u_")), "u_", "u_ <> ''")
    return packer.pack(d, packer.sentence_structs(d, clean))


# --- the packer once more, for the oracle: one sentence of every page per round of a recursive CTE ---
def _flushed(src: str, when: str) -> str:
    """``src`` (..., cur, tok, emitted) with the buffer emitted and reseeded where ``when``: the overlap is
    the longest run of last sentences within the budget, by prefix sums, with some tokens of the last
    sentence where that run is short."""
    sums = "list_transform(range(1, len(cur) + 1), lambda j: list_sum(list_transform(list_reverse(cur)[1:j], lambda c: len(c.k))))"
    src = f"SELECT *, {when} AS go, {sums} AS sums FROM ({src})"
    src = f"SELECT *, len(list_filter(sums, lambda v: v <= {tx.OVERLAP_TOKENS})) AS m FROM ({src})"
    src = f"SELECT *, coalesce(sums[m], 0) AS s, cur[len(cur) - m + 1:] AS kept FROM ({src})"
    src = f"""SELECT *, array_to_string(list_transform(kept, lambda c: c.t), ' ') AS kt, flatten(list_transform(kept, lambda c: c.k)) AS kk,
        CASE WHEN s >= {tx.MIN_OVERLAP_TOKENS} THEN []
             ELSE list_reverse(list_reverse(cur[-1].k)[1:least({tx.MIN_OVERLAP_TOKENS} - s, {tx.OVERLAP_TOKENS})::BIGINT]) END AS tail FROM ({src})"""
    src = f"SELECT *, trim(kt || ' ' || array_to_string(tail, ' ')) AS st, list_concat(kk, tail) AS sk FROM ({src})"
    none = f"(tok < {tx.MIN_OVERLAP_TOKENS} OR st = '' OR len(sk) >= tok)"
    src = f"""SELECT * REPLACE (
        CASE WHEN NOT go THEN cur WHEN {none} THEN [] ELSE [{{'t': st, 'k': sk}}] END AS cur,
        CASE WHEN NOT go THEN tok WHEN {none} THEN 0 ELSE len(sk) END AS tok,
        CASE WHEN go THEN list_append(emitted, trim(array_to_string(list_transform(cur, lambda c: c.t), ' '))) ELSE emitted END AS emitted)
      FROM ({src})"""
    return f"SELECT * EXCLUDE (go, sums, m, s, kept, kt, kk, tail, st, sk) FROM ({src})"


def _duck_packed_rows(src: str) -> str:
    """``src`` (pid, s: list of sentences) -> (pid, chunk_no, content), without the packer's fold."""
    most, tail, least = tx.MAX_TOKENS, tx.OVERLAP_TOKENS, tx.MIN_OVERLAP_TOKENS
    step = """SELECT st.pid, x.i, cur, tok, []::VARCHAR[] AS emitted, x.t AS xt, x.k AS xk, len(x.k) AS n
      FROM st JOIN sent x ON x.pid = st.pid AND x.i = st.i + 1"""
    step = _flushed(step, f"(n > {most} OR tok + n > {most}) AND len(cur) > 0")
    step = _flushed(step, f"n <= {most} AND tok + n > {most} AND len(cur) > 0")
    parts = f"list_transform(range(0, (n - 1) // {most} + 1), lambda p: xk[p * {most} + 1:p * {most} + {most}])"
    step = f"SELECT *, {parts} AS parts FROM ({step})"
    step = f"SELECT *, list_reverse(list_reverse(parts[-1])[1:{tail}]) AS rest FROM ({step})"
    step = f"""SELECT * EXCLUDE (parts, rest) REPLACE (
        CASE WHEN n > {most} THEN list_concat(emitted, list_transform(parts, lambda p: array_to_string(p, ' '))) ELSE emitted END AS emitted,
        CASE WHEN n <= {most} THEN list_append(cur, {{'t': xt, 'k': xk}})
             WHEN len(rest) >= {least} THEN [{{'t': array_to_string(rest, ' '), 'k': rest}}] ELSE [] END AS cur,
        CASE WHEN n <= {most} THEN tok + n WHEN len(rest) >= {least} THEN len(rest) ELSE 0 END AS tok) FROM ({step})"""
    step = _flushed(step, f"n <= {most} AND tok >= {tx.TARGET_TOKENS}")
    return f"""(WITH RECURSIVE src AS MATERIALIZED (SELECT pid, s FROM {src}),
    sent AS MATERIALIZED (SELECT pid, i, t, {tx.tokens(DUCK, 't')} AS k FROM {duck_explode('src', 'pid', 's', 'i', 't')}),
    st AS (SELECT pid, 0 AS i, []::STRUCT(t VARCHAR, k VARCHAR[])[] AS cur, 0::BIGINT AS tok, []::VARCHAR[] AS emitted FROM src
      UNION ALL SELECT pid, i, cur, tok, emitted FROM ({step})),
    ends AS (SELECT pid, max(i) AS i FROM st GROUP BY pid),
    chunks AS (SELECT pid, i, generate_subscripts(emitted, 1) AS j, unnest(emitted) AS content FROM st
      UNION ALL SELECT st.pid, st.i + 1, 1, trim(array_to_string(list_transform(cur, lambda c: c.t), ' '))
      FROM st JOIN ends USING (pid, i) WHERE len(cur) > 0)
    SELECT pid, cast(row_number() OVER (PARTITION BY pid ORDER BY i, j) AS INTEGER) AS chunk_no, content FROM chunks)"""


def _duck_sentence_list(text: str) -> str:
    return f"list_filter(list_transform({tx.sentences(DUCK, text)}, lambda u_: {tx.strip(DUCK, 'u_')}), lambda u_: u_ <> '')"


_DOC_SENTENCES_D = f"(SELECT doc_id AS pid, {_duck_sentence_list('text')} AS s FROM documents)"


@register("chunk_pack", oracle=f"""
  SELECT pid AS doc_id, chunk_no, content, len({tx.tokens(DUCK, 'content')}) AS n_tokens FROM {_duck_packed_rows(_DOC_SENTENCES_D)}""")
def chunk_pack(spark, sf):
    d = _docs(spark, sf).select("doc_id", ch.sentences("text").alias("s"))
    return ch.posexplode_keep(d, ["doc_id"], ch.pack_sentences("s"), "pos", "content") \
        .select("doc_id", (F.col("pos") + 1).cast("int").alias("chunk_no"), "content",
                ch.token_count("content").alias("n_tokens"))


@register("doc_id_hash", oracle=f"""
  SELECT DISTINCT {PATH_SQL} AS pdf_path, {_duck_doc_id(PATH_SQL)} AS doc_id FROM documents""")
def doc_id_hash(spark, sf):
    p = F.expr(PATH_SQL.replace("varchar", "string"))
    return _docs(spark, sf).select(p.alias("pdf_path"), ch.doc_id_from_path(p).alias("doc_id")).distinct()


def _duck_chunk_rows(chunks_sql: str, run_id: str = FIXED_RUN_ID) -> str:
    """``chunks_sql`` yields (doc_id, pdf_path, page_no, c array) -> chunk rows."""
    return f"""
  SELECT doc_id, chunk_id, pdf_path, page_no, content,
         sha256(doc_id || '::' || coalesce(cast(page_no AS VARCHAR), 'None') || '::' ||
                cast(chunk_id AS VARCHAR) || '::' || content) AS chunk_hash,
         '{run_id}' AS run_id
  FROM {duck_explode(f"({chunks_sql})", "doc_id, pdf_path, page_no", "c", "chunk_id", "content")}"""


def _duck_page_chunk_rows(text: str, run_id: str = FIXED_RUN_ID) -> str:
    """Chunk rows of every page, its sentences taken from ``text`` and packed by the recursive CTE."""
    sents = f"(SELECT doc_id || '#' || page_no AS pid, {_duck_sentence_list(text)} AS s FROM ({DUCK_PAGES}))"
    return f"""
  SELECT p.doc_id, chunk_no AS chunk_id, pdf_path, page_no, c.content,
         sha256(p.doc_id || '::' || coalesce(cast(page_no AS VARCHAR), 'None') || '::' || cast(chunk_no AS VARCHAR) || '::' || c.content)
           AS chunk_hash, '{run_id}' AS run_id
  FROM {_duck_packed_rows(sents)} c JOIN ({DUCK_PAGES}) p ON c.pid = p.doc_id || '#' || p.page_no"""


# C08/C09 on the plain (uncleaned) pages: sentences packed per page.
_DUCK_PAGE_CHUNKS = _duck_chunk_rows(
    f"SELECT doc_id, pdf_path, page_no, {_duck_pack(tx.sentences(DUCK, 'content'))} AS c FROM ({DUCK_PAGES})")


def _page_chunks(spark, sf):
    p = _pages(spark, sf)
    packed = p.select("doc_id", "pdf_path", "page_no", ch.pack_sentences(tx.sentences(SPARK, "content")).alias("chunks"))
    return ch.chunk_rows(packed, "chunks", F.lit(FIXED_RUN_ID))


@register("chunk_hash", oracle=f"SELECT doc_id, page_no, chunk_id, chunk_hash FROM ({_DUCK_PAGE_CHUNKS})")
def chunk_hash_q(spark, sf):
    return _page_chunks(spark, sf).select("doc_id", "page_no", "chunk_id", "chunk_hash")


@register("chunk_rows", oracle=_duck_page_chunk_rows("content"))
def chunk_rows_q(spark, sf):
    return _page_chunks(spark, sf)


JOB_FLAT_DUCK = _duck_page_chunk_rows(tx.clean_text(DUCK, "content"))


@register("job_flat_chunks", oracle=JOB_FLAT_DUCK)
def job_flat_chunks(spark, sf):
    return ch.flat_chunk_job(_pages(spark, sf), F.lit(FIXED_RUN_ID))


@register("chunk_fixed", oracle=f"""
  SELECT doc_id, window_no, content
  FROM {duck_explode("documents", "doc_id", ch.fixed_windows_sql(DUCK, tx.tokens(DUCK, 'text'), 100, 20), "window_no", "content")}""")
def chunk_fixed(spark, sf):
    d = _docs(spark, sf).select("doc_id", ch.tokens("text").alias("t"))
    return ch.posexplode_keep(d, ["doc_id"], ch.fixed_windows("t", 100, 20), "pos", "content") \
        .select("doc_id", (F.col("pos") + 1).cast("int").alias("window_no"), "content")


@register("lang_chunk_summary", oracle=f"""
  SELECT lang, count(*) AS n_docs, cast(sum(len(s)) AS BIGINT) AS n_sentences, cast(sum(len(t)) AS BIGINT) AS n_tokens,
         cast(sum(len(p)) AS BIGINT) AS n_pieces, count(DISTINCT sha256(text)) AS n_distinct_text
  FROM (SELECT lang, text, {tx.sentences(DUCK, 'text')} AS s, {tx.tokens(DUCK, 'text')} AS t,
               {tx.token_split(DUCK, tx.tokens(DUCK, 'text'), '380')} AS p FROM documents)
  GROUP BY lang""")
def lang_chunk_summary(spark, sf):
    """The minimum slice: sentences, tokens, token pieces and a content hash per language."""
    d = _docs(spark, sf).select("lang", "text", ch.sentences("text").alias("s"), ch.tokens("text").alias("t"))
    d = d.select("lang", "text", "s", "t", ch.token_split("t", 380).alias("p"))
    return d.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum(F.size("s")).alias("n_sentences"),
        F.sum(F.size("t")).alias("n_tokens"), F.sum(F.size("p")).alias("n_pieces"),
        F.count_distinct(F.sha2("text", 256)).alias("n_distinct_text"))
