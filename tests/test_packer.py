"""The array-fold packer on hand-worked lists and by its bounds."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from textmill.operators import chunk as ch

SMALL = dict(target=10, mx=15, ov=5, mn=3)


def _pack(spark, cases, **kw):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<string>")
    spark_kw = {"target": kw["target"], "mx": kw["mx"], "ov": kw["ov"], "mn": kw["mn"]}
    out = df.select("i", ch.pack_sentences("s", **spark_kw).alias("c")).orderBy("i").collect()
    return [list(r.c) for r in out]


def w(n, tag="w", begin=0):
    return " ".join(f"{tag}{k}" for k in range(begin, n))


def toks(s):
    return regex.findall(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]", s)


#: sentences, chunks of at most 15 tokens with a target of 10 and an overlap of 3 to 5
EDGE = [
    ([], []),
    (["   ", "", "x y."], ["x y."]),
    # longer than max: cut by tokens, the tail of 5 goes on alone
    ([w(40)], [w(15), w(30, begin=15), w(40, begin=30), w(40, begin=35)]),
    ([w(15)], [w(15), w(15, begin=12)]),
    # reaches the target at the last sentence, which is too long to repeat whole
    ([w(4), w(6, "b")], [w(4) + " " + w(6, "b"), "b3 b4 b5"]),
    ([w(2), w(3, "b")], ["w0 w1 b0 b1 b2"]),
    # overlap and next sentence exceed max: the overlap stands alone
    ([w(9), w(6, "b"), w(14, "c")], [w(9) + " " + w(6, "b"), "b3 b4 b5", w(14, "c"), "c11 c12 c13"]),
    ([w(3), w(3, "b"), w(3, "c"), w(3, "d"), w(3, "e"), w(40, "f"), w(2, "g")],
     [" ".join([w(3), w(3, "b"), w(3, "c"), w(3, "d")]), "d0 d1 d2 e0 e1 e2", w(15, "f"), w(30, "f", 15),
      w(40, "f", 30), w(40, "f", 35) + " g0 g1"]),
    (["Hello, world!", "Ünïcödé straße: ok.", "a_b c-d e.f"],
     ["Hello, world! Ünïcödé straße: ok.", "Ünïcödé straße: ok. a_b c-d e.f", "e . f"]),
]


def test_worked_lists(spark):
    for (case, want), got in zip(EDGE, _pack(spark, [c for c, _ in EDGE], **SMALL)):
        assert got == want, case


def test_tail_only_chunk_is_reproduced(spark):
    # a section longer than max is cut by tokens and leaves a tail-only last chunk
    got = _pack(spark, [[w(40)]], **SMALL)[0]
    assert len(got) == 4 and got[-1] in got[-2]


def test_chunks_respect_max_and_cover_every_token(spark):
    rnd = random.Random(3)
    cases = [[w(rnd.randint(1, 30), f"s{j}") for j in range(rnd.randint(1, 10))] for _ in range(30)]
    for case, g in zip(cases, _pack(spark, cases, **SMALL)):
        assert all(len(toks(c)) <= SMALL["mx"] for c in g)
        seen = {t for c in g for t in toks(c)}
        assert {t for s in case for t in toks(s)} <= seen


def test_default_budget_on_documents(spark):
    from tests_support import docs_sample

    rows = docs_sample(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string").select(
        "doc_id", ch.sentences("text").alias("s"))
    for r in df.select("s", ch.pack_sentences("s").alias("c")).collect():
        assert all(len(toks(c)) <= 380 for c in r.c)
        # every sentence that fits is whole in some chunk
        assert all(any(x in c for c in r.c) for x in r.s if len(toks(x)) <= 380)


def test_token_tail_and_split(spark):
    df = spark.createDataFrame([(1, "a b c d e")], "i int, t string").select(ch.tokens("t").alias("k"))
    r = df.select(ch.token_tail("k", 2).alias("t2"), ch.token_tail("k", 0).alias("t0"),
                  ch.token_tail("k", 9).alias("t9"), ch.token_split("k", 2).alias("p"),
                  ch.token_split("k", 0).alias("p0")).first()
    assert (r.t2, r.t0, r.t9) == ("d e", "", "a b c d e")
    assert [list(x) for x in r.p] == [["a", "b"], ["c", "d"], ["e"]] and list(r.p0) == []


@pytest.mark.parametrize("size,overlap", [(4, 1), (3, 0), (5, 2)])
def test_fixed_windows(spark, size, overlap):
    words = [f"w{i}" for i in range(11)]
    df = spark.createDataFrame([(words,)], "k array<string>")
    got = list(df.select(ch.fixed_windows("k", size, overlap).alias("w")).first().w)
    step = size - overlap
    exp, i = [], 0
    while True:
        exp.append(" ".join(words[i:i + size]))
        if i + size >= len(words):
            break
        i += step
    assert got == exp


@pytest.mark.parametrize("kw", [SMALL, dict(target=6, mx=6, ov=4, mn=0), dict(target=9, mx=12, ov=0, mn=0), dict(target=12, mx=8, ov=7, mn=5)])
def test_fold_over_numbers_is_the_rule_over_buffers(spark, kw):
    from textmill.functions import packer
    from textmill.functions.sqltext import SPARK

    rnd = random.Random(5)
    cases = [[" ".join(rnd.choice(["a", "b c", "d-e", "ü.", "x1_y", "!?"]) for _ in range(rnd.choice([1, 2, 3, 5, 9, 20])))
              for _ in range(rnd.randint(0, 14))] for _ in range(150)]
    df = spark.createDataFrame([(c,) for c in cases] + [(None,)], "s array<string>")
    whole = F.expr(packer.pack(SPARK, packer.sentence_structs(SPARK, "s"), **kw)).alias("whole")
    for r in df.select("s", whole, F.expr(packer.pack_spark("s", **kw)).alias("numbers")).collect():
        assert r.numbers == r.whole, r.s


def test_packing_takes_well_under_the_time_of_the_rule_over_buffers(spark):
    import time

    from textmill.functions import packer
    from textmill.functions.sqltext import SPARK

    rows = [(i, [f"sentence {j} of some words in text {i}, as they come" for j in range(400)]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, s array<string>").coalesce(1).cache()
    df.count()

    def seconds(column):
        best = []
        for _ in range(4):
            begun = time.perf_counter()
            df.select(column).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - begun)
        return min(best)

    whole = F.expr(packer.pack(SPARK, packer.sentence_structs(SPARK, "s")))
    assert seconds(ch.pack_sentences("s")) < 0.8 * seconds(whole)
    df.unpersist()
