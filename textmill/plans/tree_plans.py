"""Heading tree and structure-aware chunking queries (D01-D12) over ``pages``.

Spark cuts spans by splitting marked text and builds the tree in the linear pass of
``operators.tree``; the oracle derives spans from tokens with windows over the open tags, parents
with one window per (size, bold) level (previous-greater element) and paths with a recursive CTE.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import packer
from textmill.functions import text as tx
from textmill.functions.sqltext import DUCK
from textmill.operators import tree as tr
from textmill.plans.chunk_plans import FIXED_RUN_ID, duck_explode
from textmill.plans.registry import register
from textmill.session import read_text_table

LEVELS = [(s, b) for s in (10.0, 12.0, 14.0, 16.0, 18.0) for b in (0, 1)]


def _documents(spark, sf, keep=()):
    return tr.documents(read_text_table(spark, sf, "pages"), keep=keep)


def _spans(spark, sf):
    return tr.span_rows(_documents(spark, sf))


# --- oracle pieces ------------------------------------------------------------------------------
def _whole(pattern: str) -> str:
    """A pattern with flags in front, for a whole token."""
    return DUCK.lit("(?i)^" + pattern.removeprefix("(?i)") + "$")


_TOKENS_D = duck_explode(
    f"""(SELECT page_id AS doc, regexp_extract_all(regexp_replace(regexp_replace(
           translate(coalesce(html, ''), chr(1) || chr(2) || chr(3) || chr(4), ''), {DUCK.lit(tr.UNREAD_RE)}, '', 'g'),
         {DUCK.lit(tr.FRONT_RE)}, '\\1'), {DUCK.lit(tr.TAG_RE + '|[^<]+|<')}) AS toks FROM pages)""", "doc", "toks", "pos", "tok")
#: Every token with the block and boldness it opens (a closing block opens plain text), and its text.
_OPENED_D = f"""(SELECT doc, pos, CASE WHEN regexp_matches(tok, {_whole(tr.tag_re(tr.BLOCK_TAGS))})
         THEN if(starts_with(tok, '</'), '{tr.PLAIN_TAG}', lower(regexp_extract(tok, '^<([A-Za-z0-9]+)', 1))) END AS block,
       CASE WHEN regexp_matches(tok, {_whole(tr.tag_re(tr.BLOCK_TAGS))}) THEN 0
            WHEN regexp_matches(tok, {_whole(tr.tag_re(tr.BOLD_TAGS))}) THEN if(starts_with(tok, '</'), 0, 1) END AS strong,
       CASE WHEN regexp_matches(tok, {_whole(tr.BREAK_RE)}) THEN ' '
            WHEN regexp_matches(tok, {DUCK.lit('^' + tr.TAG_RE + '$')}) THEN '' ELSE tok END AS shown
  FROM {_TOKENS_D})"""
_RUNS_OF_TEXT_D = f"""(SELECT doc, run, any_value(block) AS block, any_value(strong) AS strong, string_agg(shown, '' ORDER BY pos) AS raw
  FROM (SELECT doc, pos, shown, last_value(block IGNORE NULLS) OVER w AS block, last_value(strong IGNORE NULLS) OVER w AS strong,
               count(strong) OVER w AS run
        FROM {_OPENED_D} WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING))
  GROUP BY doc, run)"""
_ITEMS_D = f"""(SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY run) - 1 AS span_idx, text,
       CASE WHEN strong = 1 AND NOT regexp_matches(coalesce(block, ''), '^h[1-6]$') THEN 'b' ELSE coalesce(block, '{tr.PLAIN_TAG}') END AS tag
  FROM (SELECT *, {tx.strip(DUCK, tr.decoded(DUCK, 'raw'))} AS text FROM {_RUNS_OF_TEXT_D}) WHERE text <> '')"""
SPANS_D = f"""(SELECT doc, span_idx, cast(span_idx // {tr.SPANS_PER_PAGE} + 1 AS INTEGER) AS page, tag, text,
       cast({tr.span_size_sql('tag', 'text', DUCK)} AS DOUBLE) AS size, {tr.span_font_sql('tag', DUCK)} AS font,
       CASE WHEN {tr.span_font_sql('tag', DUCK)} = 'Sans-Bold' THEN 1 ELSE 0 END AS bold FROM {_ITEMS_D})"""


def _prev_greater_cols():
    cols, cases = [], []
    for i, (s, b) in enumerate(LEVELS):
        cols.append(f"max(CASE WHEN span_idx >= 1 AND (size > {s} OR (size = {s} AND bold > {b})) THEN span_idx END) "
                    f"OVER (PARTITION BY doc ORDER BY span_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g{i}")
        cases.append(f"WHEN size = {s} AND bold = {b} THEN g{i}")
    return ", ".join(cols), " ".join(cases)


_COLS, _CASES = _prev_greater_cols()
PARENT_D = f"""(SELECT doc, span_idx, page, tag, text, size, font, bold,
       CASE WHEN span_idx = 0 THEN NULL WHEN size >= root_size THEN 0
            ELSE coalesce(CASE {_CASES} END, 0) END AS parent_idx
  FROM (SELECT *, first_value(size) OVER (PARTITION BY doc ORDER BY span_idx) AS root_size, {_COLS}
        FROM {SPANS_D}))"""
TREE_D = f"""(WITH RECURSIVE p AS (SELECT * FROM {PARENT_D}),
  t(doc, span_idx, depth, path) AS (
    SELECT doc, span_idx, 0, text || '->' FROM p WHERE span_idx = 0
    UNION ALL
    SELECT c.doc, c.span_idx, t.depth + 1, t.path || c.text || '->' FROM p c JOIN t
      ON c.doc = t.doc AND c.parent_idx = t.span_idx)
  SELECT p.*, t.depth, t.path,
         (SELECT count(*) FROM p k WHERE k.doc = p.doc AND k.parent_idx = p.span_idx) AS out_degree
  FROM p JOIN t USING (doc, span_idx))"""
TREEC_D = f"""(SELECT x.*, CASE WHEN out_degree > 0 THEN 1 ELSE 0 END AS has_children,
       CASE WHEN EXISTS (SELECT 1 FROM {TREE_D} g WHERE g.doc = x.doc AND g.parent_idx = x.span_idx
                         AND g.out_degree > 0) THEN 1 ELSE 0 END AS splittable
  FROM {TREE_D} x)"""


@register("span_extract", oracle=f"SELECT doc, span_idx, page, tag, text, size FROM {SPANS_D}")
def span_extract(spark, sf):
    return _spans(spark, sf).select("doc", "span_idx", "page", "tag", "text", "size")


@register("span_bold", oracle=f"SELECT doc, span_idx, font, bold FROM {SPANS_D}")
def span_bold(spark, sf):
    return _spans(spark, sf).select("doc", "span_idx", "font", "bold")


@register("tree_parent", oracle=f"SELECT doc, span_idx, parent_idx FROM {PARENT_D}")
def tree_parent(spark, sf):
    return _spans(spark, sf).select("doc", "span_idx", "parent_idx")


@register("breadcrumb", oracle=f"SELECT doc, span_idx, depth, path FROM {TREE_D}")
def breadcrumb(spark, sf):
    return tr.span_rows(tr.paths(_documents(spark, sf))).select("doc", "span_idx", "depth", "path")


@register("tree_edges", oracle=f"""
  SELECT doc, parent_idx, span_idx AS child_idx, has_children AS flag FROM {TREEC_D} WHERE parent_idx IS NOT NULL""")
def tree_edges(spark, sf):
    return tr.edges(_spans(spark, sf))


@register("tree_stats", oracle=f"SELECT doc, span_idx, size, depth, out_degree, splittable FROM {TREEC_D}")
def tree_stats(spark, sf):
    return _spans(spark, sf).select("doc", "span_idx", "size", "depth", "out_degree", "splittable")


@register("internal_paths", oracle=f"SELECT doc, span_idx, path FROM {TREEC_D} WHERE splittable = 1 AND parent_idx IS NOT NULL")
def internal_paths(spark, sf):
    return tr.internal_paths(tr.span_rows(tr.paths(_documents(spark, sf))))


RUNS_D = f"""(SELECT r.doc, r.root_idx, r.run_start, r.text, h.path, h.page,
        CASE WHEN g.text IS NULL THEN h.text ELSE g.text || '->' || h.text END AS section
  FROM (SELECT doc, parent_idx AS root_idx, min(span_idx) AS run_start,
               string_agg(text, ' ' ORDER BY span_idx) AS text
        FROM (SELECT *, sum(has_children) OVER (PARTITION BY doc, parent_idx ORDER BY span_idx
                                                ROWS UNBOUNDED PRECEDING) AS run
              FROM {TREEC_D} WHERE parent_idx IS NOT NULL)
        WHERE has_children = 0 GROUP BY doc, parent_idx, run) r
  JOIN {TREEC_D} h ON h.doc = r.doc AND h.span_idx = r.root_idx
  LEFT JOIN {TREEC_D} g ON g.doc = h.doc AND g.span_idx = h.parent_idx)"""


@register("section_runs", oracle=f"SELECT doc, root_idx, run_start, text FROM {RUNS_D}")
def section_runs(spark, sf):
    return tr.section_runs(_documents(spark, sf)).select("doc", "root_idx", "run_start", "text")


@register("section_prefix", oracle=f"SELECT doc, root_idx, run_start, section, path FROM {RUNS_D}")
def section_prefix(spark, sf):
    return tr.section_runs(tr.paths(_documents(spark, sf))).select("doc", "root_idx", "run_start", "section", "path")


def _duck_section_pack():
    d = DUCK
    one = d.arr(packer._sent(d, "text", tx.tokens(d, "text")))
    return packer.pack(d, d.filter(one, "q_", "len(q_.toks) > 0"))


PARTS_D = f"""(SELECT doc, page, run_start, part, '[Section: ' || section || '] ' || body AS content
  FROM {duck_explode(f"(SELECT doc, page, run_start, section, {_duck_section_pack()} AS c FROM {RUNS_D})",
                     "doc, page, run_start, section", "c", "part", "body")})"""
SECTION_ROWS_D = f"""(SELECT doc, cast(page AS INTEGER) AS page_no,
       cast(row_number() OVER (PARTITION BY doc, page ORDER BY run_start, part) AS INTEGER) AS chunk_id,
       run_start, content FROM {PARTS_D})"""


@register("section_chunk_rows", oracle=f"SELECT doc, page_no, chunk_id, run_start FROM {SECTION_ROWS_D}")
def section_chunk_rows(spark, sf):
    rows = _job(spark, sf, with_doc=True)
    return rows.select("doc", "page_no", "chunk_id", "run_start")


_URL_D = "(SELECT page_id AS doc, url FROM pages)"
JOB_D = f"""
  SELECT doc_id, chunk_id, pdf_path, page_no, content,
         sha256(doc_id || '::' || cast(page_no AS VARCHAR) || '::' || cast(chunk_id AS VARCHAR) || '::' || content) AS chunk_hash,
         '{FIXED_RUN_ID}' AS run_id
  FROM (SELECT 'doc_' || substr(sha256(lower(replace(u.url, '\\', '/'))), 1, 16) AS doc_id, s.chunk_id,
               u.url AS pdf_path, s.page_no, s.content
        FROM {SECTION_ROWS_D} s JOIN {_URL_D} u ON s.doc = u.doc)"""


def _job(spark, sf, with_doc=False):
    runs = tr.section_runs(_documents(spark, sf, keep=("url",)), keep=("url",))
    out = tr.section_chunks(runs, F.lit(FIXED_RUN_ID), F.col("url"), keep_doc=with_doc)
    return out


@register("job_section_chunks", oracle=JOB_D)
def job_section_chunks(spark, sf):
    return _job(spark, sf)


@register("hash_distinct_check", oracle=f"""
  SELECT count(*) AS n_rows, count(DISTINCT chunk_hash) AS n_distinct_hashes FROM ({JOB_D})""")
def hash_distinct_check(spark, sf):
    j = _job(spark, sf)
    return j.agg(F.count("*").alias("n_rows"), F.count_distinct("chunk_hash").alias("n_distinct_hashes"))
