"""Text column functions, rendered for Spark (``F.expr``) or DuckDB (oracle).

Every function takes a ``Dialect`` and SQL fragments and returns a SQL
fragment, so the same rule runs in Catalyst and in the oracle.  Regexes use
explicit Unicode classes (``[\\p{L}\\p{N}_]`` for a word character) because
Java's ``\\w`` is ASCII unless ``(?U)`` is set and DuckDB's is always ASCII.
White space is the class ``WS`` for the same reason.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.sqltext import SPARK, WS_BODY, WS_JAVA, Dialect

# ---------------------------------------------------------------------------
# These patterns and thresholds must equal the reference's
# cleaning and chunking rules for results to match.
#   white space: what str.isspace() holds (sqltext.WS_BODY)
#   bullets / enumerators: - * • ● ◦ , "1." "1)", "a." "a)", roman "IV." then whitespace
#   all-caps heading: ^\s*[A-Z0-9][A-Z0-9 \-–—,:;()/]{3,}\s*$
#   numbered heading: ^\s*\d+(\.\d+)*\s+.+$ and at most 80 characters
#   title-like line: 1 to 10 words, at most 80 characters, no final '.',
#       capitalised words / words with a letter >= 0.6
#   table or code line: a pipe, or \S\s{3,}\S, or 4+ leading spaces
#   merge stop: previous ends [.!?]\s*$ ; next starts ^[A-Z][A-Za-z0-9 _-]{0,25}:\s+
#   de-hyphenate: word-char '-' whitespace* newline whitespace* word-char
#   chunk budget: target 280, max 380, overlap 60, min overlap 20 tokens
# ---------------------------------------------------------------------------
WS, NOT_WS = f"[{WS_BODY}]", f"[^{WS_BODY}]"
BULLET_RE = rf"^{WS}*([-*•●◦]|[0-9]+[.)]|[A-Za-z][.)]|[IVXLCDM]+[.)]){WS}+"
ALL_CAPS_RE = rf"^{WS}*[A-Z0-9][A-Z0-9 \-–—,:;()/]{{3,}}{WS}*$"
NUMBERED_RE = rf"^{WS}*[0-9]+(\.[0-9]+)*{WS}+[^\n]+$"
NUMBERED_MAX_LEN = 80
TITLE_MAX_WORDS = 10
TITLE_MAX_LEN = 80
TITLE_RATIO = 0.6
TABLE_GAP_RE = rf"{NOT_WS}{WS}{{3,}}{NOT_WS}"
CODE_INDENT_RE = rf"^{WS}{{4,}}{NOT_WS}"
SENTENCE_END_RE = rf"[.!?]{WS}*$"
LABEL_START_RE = rf"^[A-Z][A-Za-z0-9 _-]{{0,25}}:{WS}+"
TARGET_TOKENS, MAX_TOKENS, OVERLAP_TOKENS, MIN_OVERLAP_TOKENS = 280, 380, 60, 20

WORD = r"[\p{L}\p{N}_]"
LETTER, UPPER = r"\p{L}", r"\p{Lu}"
# Default tokenizer: a run of word characters, or any one other non-space character.
TOKEN_RE = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WS_BODY}]"
# Sentence boundary: after . ! ? and whitespace, or at a newline.
SENT_MARK = "\u0001"


# --- small string helpers -------------------------------------------------------
def strip(d: Dialect, s: str) -> str:
    """Python ``str.strip()``: trim all white space, not only spaces."""
    return d.trim(s)


def rstrip(d: Dialect, s: str) -> str:
    return d.trim(s, "trailing")


def collapse_spaces(d: Dialect, s: str) -> str:
    """Runs of spaces/tabs -> one space, then strip."""
    return strip(d, d.rx_replace(s, r"[ \t]+", " "))


def length(d: Dialect, s: str) -> str:
    return f"length({s})"


# --- T06-T11 line predicates (input: any line; they strip first where the rule does) ------
def is_bullet(d: Dialect, s: str) -> str:
    return d.rx_like(s, BULLET_RE)


def is_all_caps(d: Dialect, s: str) -> str:
    return d.rx_like(s, ALL_CAPS_RE)


def is_numbered(d: Dialect, s: str) -> str:
    return f"({d.rx_like(s, NUMBERED_RE)} and {length(d, s)} <= {NUMBERED_MAX_LEN})"


def title_ratio(d: Dialect, s: str) -> str:
    """Capitalised words / words containing a letter (null when no word has a letter).  Spark counts
    matches, an upper-case letter at a word's start and a letter with the rest of its word, which
    builds no array and runs no lambda a word."""
    if d.spark:
        n_cap = f"regexp_count({s}, {SPARK.lit(rf'{UPPER}(?<![^{WS_JAVA}]{UPPER})')})"
        n_alpha = f"regexp_count({s}, {SPARK.lit(rf'{LETTER}[^{WS_JAVA}]*+')})"
        return f"cast({n_cap} as double) / nullif({n_alpha}, 0)"
    words = f"string_split_regex({s}, {d.lit(WS + '+')})"
    cap = d.transform(words, "w_", f"if({d.rx_like('w_', r'^\p{Lu}')}, 1, 0)")
    alpha = d.transform(words, "w_", f"if({d.rx_like('w_', r'\p{L}')}, 1, 0)")
    n_cap = d.reduce(cap, "0", "ta_", "tx_", "ta_ + tx_")
    n_alpha = d.reduce(alpha, "0", "ta_", "tx_", "ta_ + tx_")
    return f"if({n_alpha} = 0, null, cast({n_cap} as double) / {n_alpha})"


def n_words(d: Dialect, s: str) -> str:
    return f"regexp_count({s}, {d.rx(NOT_WS + '+')})" if d.spark else d.size(d.rx_all(s, NOT_WS + "+"))


def is_title_like(d: Dialect, s: str) -> str:
    nw = n_words(d, s)
    return (f"({nw} between 1 and {TITLE_MAX_WORDS} and {length(d, s)} <= {TITLE_MAX_LEN} "
            f"and not {d.rx_like(s, r'[.]$')} and coalesce({title_ratio(d, s)} >= {TITLE_RATIO}, false))")


def heading_rule(d: Dialect, line: str) -> str:
    """T10 as a label: which rule marks the (stripped) line as a heading, or null."""
    return stripped_heading_rule(d, strip(d, line))


def stripped_heading_rule(d: Dialect, s: str) -> str:
    """``heading_rule`` on a line that was stripped before, so that a column strips it once."""
    if d.spark:  # length guards before the regexes, words by counting matches
        return (f"case when {s} = '' then null when endswith({s}, ':') then 'colon' when {is_bullet(d, s)} then 'bullet' "
                f"when {is_all_caps(d, s)} then 'caps' "
                f"when length({s}) <= {NUMBERED_MAX_LEN} and {d.rx_like(s, NUMBERED_RE)} then 'numbered' "
                f"when {_title_line(s)} then 'title' end")
    return (f"case when {s} = '' then null "
            f"when {d.rx_like(s, ':$')} then 'colon' "
            f"when {is_bullet(d, s)} then 'bullet' "
            f"when {is_all_caps(d, s)} then 'caps' "
            f"when {is_numbered(d, s)} then 'numbered' "
            f"when {is_title_like(d, s)} then 'title' end")


def is_heading(d: Dialect, line: str) -> str:
    return f"({heading_rule(d, line)} is not null)"


def is_table(d: Dialect, line: str) -> str:
    """T11 on the line as given (only trailing newlines removed)."""
    s = d.rx_replace(line, r"\n+$", "")
    if d.spark:  # a line without newlines is taken as it is
        s = f"if(instr({line}, '\\n') = 0, {line}, {s})"
    return (f"(instr({s}, '|') > 0 or {d.rx_like(s, TABLE_GAP_RE)} "
            f"or {d.rx_like(s, CODE_INDENT_RE)})")


def protected(d: Dialect, cur: str) -> str:
    """A stripped line that always stands alone: heading, bullet, table/code."""
    return f"({is_heading(d, cur)} or {is_bullet(d, cur)} or {is_table(d, cur)})"


def should_merge(d: Dialect, prev: str, nxt: str) -> str:
    """Join ``nxt`` onto ``prev`` with a space (soft wrap)?"""
    p, n = strip(d, prev), strip(d, nxt)
    return (f"({p} <> '' and {n} <> '' "
            f"and not ({is_heading(d, p)} or {is_heading(d, n)}) "
            f"and not ({is_bullet(d, n)} or {is_bullet(d, p)}) "
            f"and not ({is_table(d, p)} or {is_table(d, n)}) "
            f"and not {d.rx_like(p, SENTENCE_END_RE)} "
            f"and not {d.rx_like(n, LABEL_START_RE)})")


# --- T01-T05 text rewrites ----------------------------------------------------------
def norm_newlines(d: Dialect, s: str) -> str:
    return d.rx_replace(s, r"\r\n?", "\n")


def strip_trailing(d: Dialect, s: str) -> str:
    return d.rx_replace(s, r"[ \t]+\n", "\n")


def dehyphenate(d: Dialect, s: str) -> str:
    """T03.  Spark uses the lookaround form; DuckDB (no lookbehind) consumes the
    neighbours, which needs a second pass for chains such as ``a-\\nb-\\nc``."""
    if d.spark:  # the hyphen first: a lookbehind alone would be tried at every character
        return d.rx_replace(s, rf"-(?<={WORD}-){WS}*\n{WS}*(?={WORD})", "")
    once = d.rx_replace(s, rf"({WORD})-{WS}*\n{WS}*({WORD})", "$1$2")
    return d.rx_replace(once, rf"({WORD})-{WS}*\n{WS}*({WORD})", "$1$2")


def collapse_blank_lines(d: Dialect, s: str) -> str:
    return d.rx_replace(s, r"\n{3,}", "\n\n")


def pre_clean(d: Dialect, s: str) -> str:
    """T01-T04 in the reference order."""
    return collapse_blank_lines(d, dehyphenate(d, strip_trailing(d, norm_newlines(d, s))))


def blocks(d: Dialect, s: str) -> str:
    """Blocks split on blank lines, blank blocks dropped (array)."""
    parts = f"split({s}, '\\n\\n')" if d.spark else f"string_split({s}, chr(10) || chr(10))"
    return d.filter(parts, "b", f"{strip(d, 'b')} <> ''")


def lines(d: Dialect, s: str) -> str:
    return f"split({s}, '\\n')" if d.spark else f"string_split({s}, chr(10))"


# --- T13 fold: merge soft wraps of one block exactly as the reference loop -------------
def _endswith(d: Dialect, s: str, suffix: str) -> str:
    return f"endswith({s}, '{suffix}')" if d.spark else f"ends_with({s}, '{suffix}')"


def _heading_stripped(d: Dialect, s: str) -> str:
    """T10 on an already stripped, non-empty string; cheap anchored tests first and the
    length guards before the word-level ones (a long buffer is never numbered/title)."""
    return (f"({_endswith(d, s, ':')} or {is_bullet(d, s)} or {is_all_caps(d, s)} "
            f"or ({length(d, s)} <= {NUMBERED_MAX_LEN} and {d.rx_like(s, NUMBERED_RE)}) "
            f"or ({length(d, s)} <= {TITLE_MAX_LEN} and {is_title_like(d, s)}))")


def _line_attrs(d: Dialect, line: str) -> str:
    """Per-line facts computed once, outside the fold: stripped text, heading, bullet,
    table, label start and sentence end."""
    c = "c__"
    head = f"({c} <> '' and {_heading_stripped(d, c)})"
    body = d.struct(s=c, head=head, bul=is_bullet(d, c), tab=is_table(d, c),
                    lab=d.rx_like(c, LABEL_START_RE), sent=d.rx_like(c, r"[.!?]$"))
    return d.let(strip(d, rstrip(d, line)), c, body)


def merge_block(d: Dialect, block: str) -> str:
    """Fold over the block's lines with state (out, buf, bsent).

    The merge test compares the *accumulated buffer* with the next line, as the
    reference does; the window form in ``operators.clean`` compares neighbouring
    lines and differs after a lone bullet / number / enumerator.  A buffer is
    built from stripped, non-table lines joined by one space, so it is never a
    table line itself, and it ends the way its last line ends (``bsent``); only
    the heading and bullet tests must look at the buffer text.
    """
    empty_out = d.empty("string", "VARCHAR")
    null_s = "cast(null as string)" if d.spark else "cast(null as varchar)"
    st = lambda out, buf, sent="false": d.struct(out=out, buf=buf, bsent=sent)
    x = "x__"
    prot = f"({x}.head or {x}.bul or {x}.tab)"
    fresh = (f"case when {x}.s = '' then {st('a.out', null_s)} "
             f"when {prot} then {st(d.append('a.out', collapse_spaces(d, f'{x}.s')), null_s)} "
             f"else {st('a.out', f'{x}.s', f'{x}.sent')} end")
    fresh_after = (f"case when {prot} then {st(d.append('o2__', collapse_spaces(d, f'{x}.s')), null_s)} "
                   f"else {st('o2__', f'{x}.s', f'{x}.sent')} end")
    merge = (f"(not {x}.head and not {x}.bul and not {x}.tab and not a.bsent and not {x}.lab "
             f"and not {_heading_stripped(d, 'a.buf')} and not {is_bullet(d, 'a.buf')})")
    body = (f"case when a.buf is null then {fresh} "
            f"when {x}.s = '' then {st(d.append('a.out', collapse_spaces(d, 'a.buf')), null_s)} "
            f"when {merge} then {st('a.out', f'concat(a.buf, {chr(39)} {chr(39)}, {x}.s)', f'{x}.sent')} "
            f"else {d.let(d.append('a.out', collapse_spaces(d, 'a.buf')), 'o2__', fresh_after)} end")
    attrs = d.transform(lines(d, block), "l", _line_attrs(d, "l"))
    folded = d.reduce(attrs, st(empty_out, null_s), "a", x, body)
    final = d.let(folded, "f__", f"if(f__.buf is null, f__.out, {d.append('f__.out', collapse_spaces(d, 'f__.buf'))})")
    return strip(d, d.join(final, "'\\n'" if d.spark else "chr(10)"))


# --- T13 for Spark: break marks in one pass, then one cut and join ---------------------------
# A paragraph is decided by what its lines add up to, never by its text: of the heading tests
# on the accumulated text only three can hold where no line of it is a heading itself -
#   a lone enumerator or bullet and more text is a bullet;
#   a lone number and more text, 80 characters in all, is a numbered heading;
#   lines of capitals and marks, too short or begun by a mark, add up to a line of capitals
# (a title needs a line that is title-like already).  Each closes the paragraph.
LONE_ENUM_RE = r"^([-*•●◦]|[0-9]+[.)]|[A-Za-z][.)]|[IVXLCDM]+[.)])$"
LONE_NUMBER_RE = r"^[0-9]+(\.[0-9]+)*$"
CAPS_LINE_RE = r"^[A-Z0-9 \-–—,:;()/]+$"
CAPS_LEAST = 4
FOLD_LINES = 256


def _title_line(s: str) -> str:
    """T09/T10 on a stripped line (Spark): words by counting matches, not by a lambda a word."""
    ws = WS_JAVA
    count = lambda p: f"regexp_count({s}, {SPARK.lit(p)})"
    return (f"(length({s}) <= {TITLE_MAX_LEN} and not endswith({s}, '.') and {SPARK.rx_like(s, chr(92) + 'p{Lu}')} "
            f"and {count(f'[^{ws}]+')} <= {TITLE_MAX_WORDS} "
            f"and cast({count(rf'{UPPER}(?<![^{ws}]{UPPER})')} as double) / "
            f"{count(rf'{LETTER}[^{ws}]*+')} >= {TITLE_RATIO})")


def _line_fact(c: str) -> str:
    """What a stripped line is, as one number: -1 empty before stripping, 0 blank, else bits -
    1 any line, 2 stands alone, 4 never joins the line before it, 8 ends a sentence,
    16 lone enumerator, 32 lone number, 64 capitals and marks only, 128 begins with one of A-Z0-9."""
    d = SPARK
    stands = (f"(endswith({c}, ':') or {is_bullet(d, c)} or {is_all_caps(d, c)} "
              f"or (length({c}) <= {NUMBERED_MAX_LEN} and {d.rx_like(c, NUMBERED_RE)}) or {_title_line(c)} "
              f"or instr({c}, '|') > 0 or {d.rx_like(c, TABLE_GAP_RE)})")
    # only short lines of few kinds of characters can be special
    special = (f"if({d.rx_like(c, '^[A-Z0-9 ' + chr(92) + '-–—,:;()/*•●◦.a-z]{1,2}$|' + '^[A-Z0-9 .' + chr(92) + '-–—,:;()/]+$')}, "
               f"if({d.rx_like(c, LONE_ENUM_RE)}, 16, 0) + if({d.rx_like(c, LONE_NUMBER_RE)}, 32, 0) "
               f"+ if({d.rx_like(c, CAPS_LINE_RE)}, 64, 0) + if({d.rx_like(c, '^[A-Z0-9]')}, 128, 0), 0)")
    return (f"if({c} = '', 0, if({stands}, 3, 1 + if({d.rx_like(c, LABEL_START_RE)}, 4, 0) "
            f"+ if({d.rx_like(c, r'[.!?]$')}, 8, 0) + {special}))")


def _mark_step() -> str:
    """One line's mark and the state after it.  State: ``q`` 0 no open paragraph, 1 open, 2 open and
    might close early; ``n`` its length, ``f`` the bits of its lines that still matter, ``blk``
    whether an empty line went by, ``out`` the marks.  Marks: x no line, f first, b new block,
    n new line, s joined by a space."""
    joins = "(a.q > 0 and x.f & 6 = 0 and not a.blk)"
    n = "(a.n + 1 + x.n)"
    f = "if(a.f & 64 > 0 and x.f & 64 > 0, a.f, a.f & 48)"
    closed = (f"(a.f & 16 > 0 or (a.f & 32 > 0 and {n} <= {NUMBERED_MAX_LEN}) "
              f"or (a.f & 192 = 192 and x.f & 64 > 0 and {n} >= {CAPS_LEAST}))")
    after = (f"case when x.f & 8 > 0 then 0 when a.q = 1 then 1 when {closed} then 0 "
             f"when a.f & 192 = 192 and x.f & 64 > 0 then 2 else 1 end")
    begun = "case when x.f & 10 > 0 then 0 when x.f & 48 > 0 or x.f & 192 = 192 then 2 else 1 end"
    state = lambda q, n, f, blk, mark: (f"named_struct('q', {q}, 'n', {n}, 'f', {f}, 'blk', {blk}, "  # noqa: E731
                                        f"'had', a.had or {mark} <> 'x', 'out', concat(a.out, {mark}))")
    new = "if(a.had, if(a.blk, 'b', 'n'), 'f')"
    return (f"case when x.f <= 0 then {state('0', '0', '0', 'a.blk or x.f < 0', chr(39) + 'x' + chr(39))} "
            f"when {joins} then {state(after, n, f, 'false', chr(39) + 's' + chr(39))} "
            f"else {state(begun, 'x.n', 'x.f', 'false', new)} end")


def merged_lines(s: str) -> str:
    """T05 + T13 + T14 on pre-cleaned text (Spark): blocks stay apart by an empty line, soft-wrapped lines join.

    The marks are gathered ``FOLD_LINES`` lines at a time, so that a text of many lines is not
    copied line by line; lines and marks are then joined once."""
    facts = (f"transform(ln__, l -> element_at(transform(array({SPARK.trim('l')}), c -> "
             f"named_struct('f', if(l = '', -1, {_line_fact('c')}), 'n', length(c))), 1))")
    chunks = (f"transform(sequence(0, (size(fa__) - 1) div {FOLD_LINES}), "
              f"i -> slice(fa__, i * {FOLD_LINES} + 1, {FOLD_LINES}))")
    init = "named_struct('q', 0, 'n', 0, 'f', 0, 'blk', false, 'had', false, 'out', '')"
    fresh = "named_struct('q', o.q, 'n', o.n, 'f', o.f, 'blk', o.blk, 'had', o.had, 'out', '')"
    inner = (f"aggregate(ch, {fresh}, (a, x) -> {_mark_step()}, "
             f"a -> named_struct('q', a.q, 'n', a.n, 'f', a.f, 'blk', a.blk, 'had', a.had, 'out', concat(o.out, a.out)))")
    marks = f"aggregate({chunks}, {init}, (o, ch) -> {inner}, o -> split(o.out, ''))"
    joined = (f"array_join(zip_with(ln__, {SPARK.let(facts, 'fa__', marks)}, (l, m) -> case m when 's' then concat(' ', {SPARK.trim('l')}) "
              f"when 'n' then concat('\\n', {SPARK.trim('l')}) when 'b' then concat('\\n\\n', {SPARK.trim('l')}) "
              f"when 'f' then {SPARK.trim('l')} else '' end), '')")
    return f"regexp_replace({SPARK.let(lines(SPARK, s), 'ln__', joined)}, '[ \\t]+', ' ')"


def clean_text(d: Dialect, s: str) -> str:
    """Full clean; null or empty -> ''.  Spark marks breaks in one pass; the fold over the
    accumulated text, as the rule is stated, is what the oracle runs."""
    if d.spark:
        return d.let(s, "ct__", f"if(ct__ is null or ct__ = '', '', {merged_lines(pre_clean(d, 'ct__'))})")
    merged = d.transform(blocks(d, pre_clean(d, "ct__")), "b", merge_block(d, "b"))
    return d.let(s, "ct__", f"if(ct__ is null or ct__ = '', '', {d.join(merged, 'chr(10) || chr(10)')})")


# --- C01-C04 sentences and tokens ----------------------------------------------------------
def sentences(d: Dialect, s: str) -> str:
    """Rule segmenter -> array of stripped, non-blank sentences."""
    mark = "'\\u0001'" if d.spark else "chr(1)"
    marked = d.rx_replace(d.rx_replace(s, rf"([.!?]){WS}+", "$1" + SENT_MARK), r"\n", SENT_MARK)
    parts = f"split({marked}, {mark})" if d.spark else f"string_split({marked}, {mark})"
    trimmed = d.transform(parts, "x", strip(d, "x"))
    return d.filter(trimmed, "x", "x <> ''")


def tokens(d: Dialect, s: str) -> str:
    """C02 default tokenizer: array of tokens."""
    return d.rx_all(s, TOKEN_RE)


def token_tail(d: Dialect, toks: str, n: str) -> str:
    """The last n tokens as text ('' when n <= 0 or no tokens)."""
    return d.join(d.last_n(toks, n))


def token_split(d: Dialect, toks: str, n: str) -> str:
    """Pieces of at most n tokens (array of token arrays); [] when n <= 0."""
    k = f"{d.idiv(f'{d.size("tk__")} + ({n}) - 1', n)}"
    body = d.slice("tk__", f"i * ({n}) + 1", n)
    # the token array is bound once: inside a lambda Spark would re-tokenise per piece
    pieces = d.let(toks, "tk__", d.transform(d.seq('0', f'{k} - 1'), 'i', body))
    return f"if(({n}) <= 0, {d.empty('array<string>', 'VARCHAR[]')}, {pieces})"


# --- Spark Column wrappers ---------------------------------------------------------------------
def col_expr(fn, *args: str, **kw) -> Column:
    return F.expr(fn(SPARK, *args, **kw))


def clean_col(c: str) -> Column:
    return col_expr(clean_text, c)


def sentences_col(c: str) -> Column:
    return col_expr(sentences, c)


def tokens_col(c: str) -> Column:
    return col_expr(tokens, c)
