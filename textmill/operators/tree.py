"""Heading tree and structure-aware chunking.

A document stays in one row until its chunks leave it: spans are cut from the markup with
built-in functions (D01), a linear pass over their sizes gives the tree (D03), and runs,
prefixes and breadcrumbs (D04-D09) are read off the same arrays.  So a document is scanned
once, and only the numbering of its chunks (D12) shuffles.

* Spans: markup that shows no text (``UNREAD_RE``) and what comes before the first h1
  (``FRONT_RE``) are left out; every block tag, opening or closing, begins a new span, and so does a bold tag inside a block; other tags are dropped
  and their text read on; character references are decoded.  A block tag ends boldness.
* parent(n) = 0 when size(n) >= size(root); otherwise the nearest earlier span p >= 1 with
  (size, bold)(p) > (size, bold)(n), else 0: the previous greater element, kept on a stack of
  strictly falling ranks.  Only sizes and boldness go to Python, and only integers return.
* tree preorder equals span order, so a section run (D05), consecutive childless children of
  one node, is a slice of the spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmill.functions import packer
from textmill.functions import text as tx
from textmill.functions.sqltext import SPARK, Dialect

# Fixed values of the span rule used on HTML pages (stand-in for PDF spans and font sizes).
BLOCK_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "ul", "ol", "dl", "dt", "dd", "div", "nav", "article", "section",
              "header", "footer", "aside", "main", "table", "tr", "td", "th", "blockquote", "pre", "form", "body", "html")
BOLD_TAGS = ("b", "strong")
UNREAD_RE = (r"(?is)<!--.*?-->|<head\b.*?</head\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
             r"|<title\b.*?</title\s*>")
#: An outline begins at the first h1, where there is one: what comes before it (navigation,
#: advertisements) belongs to no section.
FRONT_RE = r"(?is)^.*?(<h1\b)"
#: A tag ends at the first >, and holds no < (nor a mark, see below).
IN_TAG = r"[^<>\x01-\x04]*"
BREAK_RE = rf"(?i)<br\b{IN_TAG}>"
TAG_RE = rf"</?[A-Za-z!]{IN_TAG}>"
#: The tag of text that follows a closing block tag, or none.
PLAIN_TAG = "p"
SPANS_PER_PAGE = 8
#: Character references that are decoded, besides decimal ones; the ampersand goes last.
REFERENCES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", "\u00a0"), ("copy", "©"), ("reg", "®"),
              ("trade", "™"), ("middot", "·"), ("bull", "•"), ("hellip", "…"), ("ndash", "–"), ("mdash", "—"), ("lsquo", "‘"),
              ("rsquo", "’"), ("ldquo", "“"), ("rdquo", "”"), ("laquo", "«"), ("raquo", "»"), ("sect", "§"), ("para", "¶"),
              ("deg", "°"), ("plusmn", "±"), ("times", "×"), ("frac12", "½"), ("euro", "€"), ("pound", "£"), ("shy", "\u00ad"),
              ("amp", "&"))

# Marks inside the text while it is cut; pages that hold these characters lose them first.
_BLOCK, _NAMED, _BOLD, _LIGHT = "\u0001", "\u0002", "\u0003", "\u0004"


def tag_re(tags: tuple[str, ...]) -> str:
    """Any opening or closing tag of ``tags``: (slash, name)."""
    return rf"(?i)<(/?)({'|'.join(tags)})(?:\s{IN_TAG})?/?>"


def decoded(d: Dialect, s: str) -> str:
    """``s`` with its character references read: ``REFERENCES``, and decimal ones of a character
    beyond U+001F; others stay as they are."""
    number = "cast(regexp_extract(r_, '[0-9]+') AS BIGINT)" if not d.spark else "cast(regexp_extract(r_, '[0-9]+', 0) as bigint)"
    char = (f"decode(unhex(lpad(hex({number}), 8, '0')), 'UTF-32')" if d.spark else f"chr(cast({number} AS INTEGER))")
    legal = f"({number} between 32 and 55295 or {number} between 57344 and 1114111)"
    refs = d.rx_all("d_", "&#[0-9]{1,7};")
    refs = f"array_distinct({refs})" if d.spark else f"list_distinct({refs})"
    text = d.reduce(refs, "d_", "t_", "r_", f"if({legal}, replace(t_, r_, {char}), t_)")
    for name, char in REFERENCES:
        text = f"replace({text}, '&{name};', {d.lit(char)})"
    return d.let(s, "d_", f"if(instr(d_, '&') > 0, {text}, d_)")


def span_size_sql(tag: str, text: str, d=SPARK) -> str:
    """Font size from tag and text: h1 18; h2 to h6 16; b 14 bold; li 10; of the others 16 where the
    md5 starts with 0, else 14 where short (< 40 chars, no final period), else 12."""
    return (f"CASE WHEN {tag} = 'h1' THEN 18.0 WHEN {d.rx_like(tag, '^h[2-6]$')} THEN 16.0 WHEN {tag} = 'b' THEN 14.0 "
            f"WHEN {tag} = 'li' THEN 10.0 WHEN substr(md5({text}), 1, 1) = '0' THEN 16.0 "
            f"WHEN length({text}) < 40 AND NOT {d.rx_like(text, '[.]$')} THEN 14.0 ELSE 12.0 END")


def span_font_sql(tag: str, d=SPARK) -> str:
    return f"CASE WHEN {tag} = 'b' OR {d.rx_like(tag, '^h[1-6]$')} THEN 'Sans-Bold' ELSE 'Sans' END"


def _marked(html: str) -> str:
    """The text of a page with a mark at each block and bold tag, other markup gone."""
    d = SPARK
    x = f"translate(coalesce({html}, ''), '{_BLOCK}{_NAMED}{_BOLD}{_LIGHT}', '')"
    x = d.rx_replace(d.rx_replace(x, UNREAD_RE, ""), FRONT_RE, "$1")
    x = d.rx_replace(x, tag_re(BLOCK_TAGS), f"{_BLOCK}$1$2{_NAMED}")
    x = d.rx_replace(x, BREAK_RE, " ")
    bold = "|".join(BOLD_TAGS)
    x = d.rx_replace(x, rf"(?i)<(?:{bold})(?:\s{IN_TAG})?/?>", _BOLD)
    x = d.rx_replace(x, rf"(?i)</(?:{bold})(?:\s{IN_TAG})?/?>", _BOLD + _LIGHT)
    return decoded(d, d.rx_replace(x, TAG_RE, ""))


def spans_array(html: str) -> Column:
    """Ordered non-blank spans of a page as array<struct<idx, page, tag, text, size, font, bold>>."""
    d = SPARK
    name = f"if(instr(b_, '{_NAMED}') > 0, lower(substring_index(b_, '{_NAMED}', 1)), '{PLAIN_TAG}')"
    name = d.let(name, "n_", f"if(startswith(n_, '/'), '{PLAIN_TAG}', n_)")
    body = f"split(if(instr(b_, '{_NAMED}') > 0, substr(b_, instr(b_, '{_NAMED}') + 1), b_), '{_BOLD}')"
    light = f"(i_ = 0 or startswith(p_, '{_LIGHT}') or t_ rlike '^h[1-6]$')"
    piece = (f"named_struct('tag', if({light}, t_, 'b'), "
             f"'text', {d.trim(f'if(i_ > 0 and startswith(p_, {d.lit(_LIGHT)}), substr(p_, 2), p_)')})")
    pieces = d.let(name, "t_", f"transform({body}, (p_, i_) -> {piece})")
    kept = f"filter(flatten(transform(split({_marked(html)}, '{_BLOCK}'), b_ -> {pieces})), s_ -> s_.text <> '')"
    out = (f"named_struct('idx', i_, 'page', cast(i_ div {SPANS_PER_PAGE} + 1 as int), 'tag', s_.tag, "
           f"'text', s_.text, 'size', cast({span_size_sql('s_.tag', 's_.text')} as double), "
           f"'font', {span_font_sql('s_.tag')}, "
           f"'bold', cast(lower({span_font_sql('s_.tag')}) like '%bold%' as int))")
    return F.expr(f"transform({kept}, (s_, i_) -> {out})")


# ---- the tree --------------------------------------------------------------------------

def outline(sizes: list[float], bolds: list[int]) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """(parent, depth, children, splittable, run) of each span of one document.

    ``splittable`` says whether some child has children; ``run`` is, at the first of consecutive
    childless children, how many they are, else 0.  The root's parent is -1.  Linear: each span is put on
    the stack once."""
    n = len(sizes)
    parent, depth, children = [-1] * n, [0] * n, [0] * n
    splittable, run, open_run = [0] * n, [0] * n, [-1] * n
    stack: list[tuple[float, int, int]] = []
    for i in range(1, n):
        rank = (sizes[i], bolds[i])
        while stack and stack[-1][:2] <= rank:
            stack.pop()
        p = 0 if not stack or sizes[i] >= sizes[0] else stack[-1][2]
        stack.append((*rank, i))
        parent[i], depth[i] = p, depth[p] + 1
        children[p] += 1
    for i in range(1, n):
        p = parent[i]
        if children[i]:
            splittable[p], open_run[p] = 1, -1
        elif open_run[p] < 0:
            open_run[p], run[i] = i, 1
        else:
            run[open_run[p]] += 1
    return parent, depth, children, splittable, run


def chains(parent: list[int]) -> list[list[int]]:
    """The spans from the root to each span, itself included."""
    out: list[list[int]] = []
    for i, p in enumerate(parent):
        out.append([*(out[p] if p >= 0 else []), i])
    return out


def _rows_of(column: pa.Array) -> tuple[list, np.ndarray]:
    offs = column.offsets.to_numpy()
    return column.flatten().to_pylist(), offs - offs[0]


def _outlines(sizes: pa.Array, bolds: pa.Array) -> pa.Array:
    flat, offs = _rows_of(sizes)
    bold, _ = _rows_of(bolds)
    found: list[list[int]] = [[] for _ in range(5)]
    for s, e in zip(offs.tolist(), offs.tolist()[1:], strict=False):
        for held, new in zip(found, outline(flat[s:e], bold[s:e]), strict=True):
            held.extend(new)
    at = pa.array(offs, pa.int32())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in found],
                                      names=["parent", "depth", "children", "splittable", "run"])


def _chains(parents: pa.Array) -> pa.Array:
    flat, offs = _rows_of(parents)
    out = [c for s, e in zip(offs.tolist(), offs.tolist()[1:], strict=False) for c in chains(flat[s:e])]
    ends = np.concatenate([[0], np.cumsum([len(c) for c in out])]) if out else np.zeros(1)
    inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for c in out for x in c], pa.int32()))
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), inner)


_TREE = ("struct<parent:array<int>,depth:array<int>,children:array<int>,splittable:array<int>,run:array<int>>")


def outline_col(spans: str) -> Column:
    """D03-D05 for a column of spans: a struct of arrays aligned with it."""
    return F.arrow_udf(_outlines, _TREE)(F.expr(f"{spans}.size"), F.expr(f"{spans}.bold"))


def chains_col(parents: str) -> Column:
    return F.arrow_udf(_chains, "array<array<int>>")(F.col(parents))


def documents(pages: DataFrame, doc_col: str = "page_id", html_col: str = "html", keep=()) -> DataFrame:
    """One row a page: (doc, keep..., spans, tree)."""
    spans = pages.select(F.col(doc_col).alias("doc"), *keep, spans_array(html_col).alias("spans"))
    return spans.withColumn("tree", outline_col("spans"))


def paths(docs: DataFrame) -> DataFrame:
    """Adds ``path``, the breadcrumb of each span."""
    text = "array_join(transform(c_, a_ -> spans[a_].text), '->')"
    return docs.withColumn("_chain", chains_col("tree.parent")) \
        .withColumn("path", F.expr(f"transform(_chain, c_ -> concat({text}, '->'))")).drop("_chain")


def span_rows(docs: DataFrame) -> DataFrame:
    """Spans with tree columns: (doc, span_idx, page, tag, text, size, font, bold, parent_idx, depth,
    out_degree, has_children, splittable), and path where ``docs`` has it."""
    from textmill.operators.chunk import posexplode_keep

    path = [F.col("path")] if "path" in docs.columns else []
    cols = ["parent", "depth", "children", "splittable"]
    z = posexplode_keep(docs, ["doc"], F.arrays_zip("spans", *[F.col(f"tree.{c}").alias(c) for c in cols], *path), "_p", "z")
    return z.select("doc", F.col("z.spans.idx").alias("span_idx"), *[F.col(f"z.spans.{c}").alias(c) for c in
                                                                     ("page", "tag", "text", "size", "font", "bold")],
                    F.expr("nullif(z.parent, -1)").alias("parent_idx"), F.col("z.depth").alias("depth"),
                    F.col("z.children").alias("out_degree"), (F.col("z.children") > 0).cast("int").alias("has_children"),
                    F.col("z.splittable").alias("splittable"), *([F.col("z.path").alias("path")] if path else []))


def edges(spans: DataFrame) -> DataFrame:
    """Parent -> child edges with flag = child has children."""
    return spans.filter(F.col("parent_idx").isNotNull()).select(
        "doc", "parent_idx", F.col("span_idx").alias("child_idx"), F.col("has_children").alias("flag"))


def section_runs(docs: DataFrame, keep=()) -> DataFrame:
    """D05 + D07: runs of consecutive childless children of one node, with their section prefix.

    Output: (doc, keep..., root_idx, run_start, text, section, page, path where ``docs`` has it)."""
    from textmill.operators.chunk import posexplode_keep

    path = ", 'path', path[tree.parent[i_]]" if "path" in docs.columns else ""
    above = "tree.parent[tree.parent[i_]]"
    head = "spans[tree.parent[i_]].text"
    run = (f"named_struct('root_idx', tree.parent[i_], 'run_start', i_, "
           f"'text', array_join(transform(slice(spans, i_ + 1, tree.run[i_]), s_ -> s_.text), ' '), "
           f"'section', if({above} < 0, {head}, concat(spans[greatest({above}, 0)].text, '->', {head})), "
           f"'page', spans[tree.parent[i_]].page{path})")
    starts = "filter(transform(tree.run, (r_, i_) -> if(r_ > 0, i_, -1)), i_ -> i_ >= 0)"
    z = posexplode_keep(docs, ["doc", *keep], F.expr(f"transform({starts}, i_ -> {run})"), "_p", "z")
    return z.select("doc", *keep, *[f"z.{c}" for c in ("root_idx", "run_start", "text", "section", "page")],
                    *(["z.path"] if path else []))


def internal_paths(spans: DataFrame) -> DataFrame:
    """Non-root nodes with at least one child that itself has children."""
    return spans.filter((F.col("splittable") == 1) & F.col("parent_idx").isNotNull()) \
        .select("doc", "span_idx", "path")


def section_chunks(runs: DataFrame, run_id: Column, path_col: Column, keep_doc: bool = False) -> DataFrame:
    """D12 + D08: each run packed as one sentence, prefixed, numbered per (doc, page)."""
    d = SPARK
    one = d.arr(packer._sent(d, "text", tx.tokens(d, "text")))
    packed = runs.withColumn("_c", F.expr(packer.pack(d, f"filter({one}, q_ -> size(q_.toks) > 0)")))
    from textmill.operators.chunk import posexplode_keep

    keep = ["doc", "page", "run_start", "section"] + (["url"] if "url" in runs.columns else [])
    parts = posexplode_keep(packed, keep, F.col("_c"), "part", "body")
    parts = parts.withColumn("content", F.concat(F.lit("[Section: "), F.col("section"), F.lit("] "), F.col("body")))
    w = W.partitionBy("doc", "page").orderBy("run_start", "part")
    out = parts.withColumn("chunk_id", F.row_number().over(w).cast("int"))
    from textmill.operators.chunk import chunk_hash, doc_id_from_path

    out = out.withColumn("pdf_path", path_col).withColumn("doc_id", doc_id_from_path(F.col("pdf_path")))
    extra = ["doc", "run_start"] if keep_doc else []
    return out.select(*extra, "doc_id", "chunk_id", "pdf_path", F.col("page").cast("int").alias("page_no"), "content",
                      chunk_hash(F.col("doc_id"), F.col("page"), F.col("chunk_id"), F.col("content")).alias("chunk_hash"),
                      run_id.alias("run_id"))
