"""T01-T15 on hand-worked lines and texts, and by what cleaning keeps of documents."""

import re

from pyspark.sql import functions as F

from textmill.functions import text as tx
from textmill.functions.sqltext import SPARK
from textmill.operators import clean as cl

#: line, heading, table, bullet
LINES = [
    ("-", False, False, False), ("- item one", True, False, True), ("12", False, False, False),
    ("12 Overview", True, False, False), ("1.2 Scope of work", True, False, False), ("Note: x", False, False, False),
    ("NOTE: THIS", True, False, False), ("AB", True, False, False),
    ("One Two Three Four Five Six Seven Eight Nine Ten", True, False, False),
    ("One Two Three Four Five Six Seven Eight Nine Ten Eleven", False, False, False),
    ("7 " + "x" * 78, True, False, False), ("7 " + "x" * 79, False, False, False), ("Élan Über Ça", True, False, False),
    ("col a | col b", False, True, False), ("a    b", False, True, False), ("    code()", False, True, False),
    ("IV. Roman", True, False, True), ("a) first", True, False, True), ("ends with colon:", True, False, False),
    ("plain prose line that continues", False, False, False), ("", False, False, False),
]


def test_heading_table_bullet_rules(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LINES)], "i int, s string")
    out = df.select("i", "s", F.expr(tx.is_heading(SPARK, "s")).alias("h"), F.expr(tx.is_table(SPARK, "s")).alias("t"),
                    F.expr(tx.is_bullet(SPARK, tx.strip(SPARK, "s"))).alias("b")).orderBy("i").collect()
    assert [(r.s, r.h, r.t, r.b) for r in out] == LINES


#: text, cleaned
TEXTS = [
    ("a-\nb-\nc and more", "abc and more"),
    ("word-\n\nnext line here", "wordnext line here"),
    ("café-\nthèque fin.", "caféthèque fin."),
    ("This line wraps\ninto this one\nand this one.\nNew para starts\nhere",
     "This line wraps into this one and this one.\nNew para starts here"),
    # a lone bullet takes a line, then stops
    ("-\nfoo bar\nbaz qux continues", "- foo bar\nbaz qux continues"),
    # a lone number becomes a numbered heading
    ("12\nsome prose here\nmore prose", "12 some prose here\nmore prose"),
    ("Intro text\nNote: something\nmore", "Intro text\nNote: something more"),
    ("A | B\nc d\n\n\n\nNext   block\twith   tabs", "A | B\nc d\n\nNext block with tabs"),
    ("Title Case Heading\nbody text that wraps\nacross lines", "Title Case Heading\nbody text that wraps across lines"),
    ("\r\nline one  \r\nline two\t\r\n", "line one line two"),
    # white space beyond ASCII
    ("first line wraps\n\xa0\nsecond block", "first line wraps\nsecond block"),
    ("\u2003- item one\nplain text goes on", "- item one\nplain text goes on"),
    ("word-\xa0\n\u3000next part goes on", "wordnext part goes on"),
    ("kept block of words\n\n\xa0\x85\n\nother block of words", "kept block of words\n\nother block of words"),
    ("", ""),
]


def test_white_space_is_that_of_str(spark):
    import regex

    from textmill.operators import embed

    every = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c,) for c in every], "c string").select(
        "c", F.expr(tx.strip(SPARK, "c")).alias("s"), F.size(tx.tokens_col("c")).alias("n"))
    rows = df.collect()
    assert [r.c for r in rows if r.s == ""] == [c for c in every if c.isspace()]
    tokens = regex.compile(tx.TOKEN_RE)
    assert [r.c for r in rows if r.n != len(tokens.findall(r.c))] == [] and embed.TOKEN_RE == tx.TOKEN_RE


def test_full_clean_of_worked_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "i int, t string")
    out = df.select("i", "t", cl.clean_text("t").alias("c")).orderBy("i").collect()
    assert [(r.t, r.c) for r in out] == TEXTS


def test_clean_keeps_all_but_space_and_hyphens(spark):
    from tests_support import docs_sample

    df = spark.createDataFrame(docs_sample(spark, 60), "doc_id long, text string").select(
        "doc_id", F.expr(cl.pdfize(SPARK, "text")).alias("raw"))
    for r in df.select("raw", cl.clean_text("raw").alias("c")).collect():
        assert re.sub(r"[\s-]", "", r.c) == re.sub(r"[\s-]", "", r.raw)
        assert r.c == r.c.strip() and "  " not in r.c and "\n\n\n" not in r.c


def test_fold_and_window_part_after_lone_marker(spark):
    """The fold compares the accumulated buffer (reference); the window compares
    neighbouring lines.  After a lone number the two disagree."""
    text = "12\nsome prose here\nmore prose"
    df = spark.createDataFrame([(1, text)], "doc_id int, t string")
    fold = df.select(cl.clean_text("t").alias("c")).first().c
    lines = cl.explode_lines(df, "t")
    window = [r.text for r in cl.merge_soft_wraps_window(lines, ["doc_id"]).orderBy("para_no").collect()]
    assert fold == "12 some prose here\nmore prose"
    assert window == ["12 some prose here more prose"]


def test_marks_are_those_of_the_fold(spark):
    """Random lines of every kind the rules tell apart: the marks of one pass against the fold over
    the accumulated text, which DuckDB runs as the rule is stated."""
    import random

    import duckdb

    from textmill.functions.sqltext import DUCK

    rng = random.Random(5)
    kinds = ["-", "*", "1.", "a)", "IV.", "12", "1.2", "A", "AB", "B-", "(C", "X1", "AB CD", "plain words go on", "it ends here.",
             "Is it?", "Note: this", "Title Case Line", "a | b", "a    b", "- item", "12 Overview", "ends with:", "", "  ", "\xa0", "é è",
             "\u2003in dented", "x" * 79, "word " * 15, "Foo bar", "1,234", ". . .", "7", "A1 ", "\ttab\tline"]
    texts = ["\n".join(rng.choice(kinds) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    texts += ["\n".join(rng.choice(kinds) for _ in range(700)) for _ in range(5)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest($1) AS i, unnest($2) AS t", [list(range(len(texts))), texts])
    want = dict(con.execute(f"SELECT i, {tx.clean_text(DUCK, 't')} FROM t").fetchall())
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    got = {r.i: r.c for r in df.select("i", cl.clean_text("t").alias("c")).collect()}
    assert [texts[i] for i in got if got[i] != want[i]][:3] == [] and len(got) == len(texts)


def test_time_grows_with_the_lines_of_a_block(spark):
    import time

    def seconds(n):
        rows = [(i, "\n".join(f"line {j} of some words, which" for j in range(n))) for i in range(8)]
        df = spark.createDataFrame(rows, "i int, t string").coalesce(1).select(cl.clean_text("t"))
        best = []
        for _ in range(4):
            begun = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - begun)
        return min(best)

    seconds(2000)
    assert seconds(16000) <= 2.3 * seconds(8000)


def test_line_rules_on_odd_lines_are_those_of_words(spark):
    """Title ratio and heading label by counting matches, against words cut by Python."""
    lines = ["", " ", "Title Here Now", "title here Now", "  Ünter Den linden\t", "1234 5678", "x" * 90, "A " * 30, "A B.", "A:", "- a",
             "a) b", "IV. c", "ABC DEF", "3.1 Scope of it", "3 " + "y" * 90, "\u3000Ärger Über\u2003alles", "\U00010400bc Def", "aB cD", "\"Quoted Word\"", "É é"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)] + [(len(lines), None)], "i int, line string")
    got = {r.i: r for r in df.select("i", F.expr(tx.title_ratio(SPARK, "line")).alias("ratio"), cl.heading_rule("line").alias("rule"),
                                     F.expr(tx.n_words(SPARK, "line")).alias("n")).collect()}
    import unicodedata
    letter = lambda c: unicodedata.category(c).startswith("L")
    for i, x in enumerate(lines):
        words = [w for w in x.split() if any(map(letter, w))]
        want = sum(unicodedata.category(w[0]) == "Lu" for w in words) / len(words) if words else None
        assert (got[i].ratio, got[i].n) == (want, len(x.split())), x
    assert got[len(lines)].ratio is None and got[len(lines)].rule is None
    rules = {lines[i]: got[i].rule for i in range(len(lines))}
    assert [rules[x] for x in ("", " ", "Title Here Now", "title here Now", "A B.", "A:", "- a", "ABC DEF", "3.1 Scope of it", "aB cD")] == \
        [None, None, "title", None, None, "colon", "bullet", "caps", "numbered", None]
