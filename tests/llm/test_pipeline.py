"""The pipeline's stages over planted documents, and the registered queries."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import plain_groups, plain_lines, sentences

import __spark_entry__


def corpus(rng):
    clean = [" .\n".join(sentences(rng, 3, 40, 4000)) for _ in range(150)]
    toxic = []
    for t in [" .\n".join(sentences(rng, 3, 40, 4000)) for _ in range(60)]:
        w = t.split(" ")
        for _ in range(9):
            w[rng.randrange(len(w))] = rng.choice(["vilename", "foulword", "nastything"])
        toxic.append(" ".join(w))
    junk = [" ".join(f"$$%{x}##" for x in t.split()) for t in sentences(rng, 40, 90, 4000)]
    near = [clean[0].replace(clean[0].split()[5], "changed"), clean[1]]
    return clean + toxic + junk + near + ["too short", None, ""]


def test_stages(spark, tmp_path):
    texts = corpus(random.Random(21))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0 if 210 <= i < 250 else 1, 1 if 150 <= i < 210 else 0) for i in range(250)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
        kept[name] = {r.doc_id: r for r in docs.collect()}
    good = set(range(150))
    after = [set(x) for x in kept.values()]
    assert after[0] == good | set(range(150, 210)) | {250, 251}
    assert good <= after[1] | {0} and not after[1] & set(range(165, 210))
    lines_in = sorted(after[1])
    # the lines of a document that has a near copy stay with the first
    want = plain_lines([texts[i] for i in lines_in])
    for i, t in zip(lines_in, want, strict=True):
        if i in kept["line dedup"]:
            row = kept["line dedup"][i]
            assert row.text == t and row.n_chars == len(t)
        else:
            assert not t.split()
    left = sorted(after[2])
    groups = plain_groups([kept["line dedup"][i].text for i in left], 5, 80)
    assert after[3] == {i for k, i in enumerate(left) if groups[k][1] == k}
    assert set(kept["best-fit packing"]) == after[3]


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))


def test_pipeline_on_given_rows(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    total = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert out.count() > 0 and total.filter("n > 2048").count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, n_removed int, kept boolean, row int"


def tables(spark, tmp_path, texts, labels, ids=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", "s", len(t or ""), "x", 7, True, 1) for i, t in zip(ids, texts, strict=True)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_verdicts_are_each_rows_own(spark, tmp_path):
    """Rows that share an id, repeated rows, null ids and columns of clashing names."""
    texts = corpus(random.Random(21))
    good, toxic, junk = texts[0], texts[170], texts[220]
    labels = [(i, 0 if 210 <= i < 250 else 1, 1 if 150 <= i < 210 else 0) for i in range(250)]
    # ids without labels, so that these rows teach nothing
    extra = [(1005, junk), (1005, good), (1006, toxic), (1006, good), (None, good), (None, junk), (None, toxic), (1007, None), (1007, "")]
    docs = tables(spark, tmp_path, texts[:250] + [t for _, t in extra], labels, list(range(250)) + [i for i, _ in extra])
    kept = stage("quality rules")(spark, docs, str(tmp_path))
    assert kept.dtypes == docs.dtypes
    pairs = [(r.doc_id, r.text) for r in kept.collect()]
    assert (1005, junk) not in pairs and (None, junk) not in pairs and (1007, None) not in pairs and (1007, "") not in pairs
    assert (1005, good) in pairs and (None, good) in pairs and (1006, toxic) in pairs
    clean = stage("toxicity")(spark, docs, str(tmp_path))
    assert clean.dtypes == docs.dtypes
    pairs = [(r.doc_id, r.text) for r in clean.collect()]
    assert (1006, toxic) not in pairs and (None, toxic) not in pairs
    assert (1006, good) in pairs and (1005, good) in pairs and (None, good) in pairs and (1007, None) in pairs


def test_lines_with_clashing_columns(spark, tmp_path):
    line = "one line of words that comes again and again in texts"
    texts = [f"{line}\nand a line of its own here", line, "x\n\nsome other words that stay", None, "", "x\n" + line]
    docs = tables(spark, tmp_path, texts, [(0, 1, 0)], [0, 1, 2, 3, 4, None])
    out = {r.doc_id: r for r in stage("line dedup")(spark, docs, str(tmp_path)).collect()}
    assert set(out) == {0, 2, 3, 4, None} and out[0].n_removed == 7 and out[None].text == texts[5]
    assert out[3].text is None and out[4].text == "" and all(r.n_chars == len(r.text or "") for r in out.values())


def test_one_row_of_each_group_stays(spark, tmp_path):
    rng = random.Random(4)
    a, b, c = sentences(rng, 3, 60, 4000)
    near = a.replace(a.split()[30], "changed", 1)
    rows = [(3, a), (3, a), (1, near), (9, near), (5, b), (5, c), (5, c), (8, None), (8, ""), (8, ""), (2, "short text"),
            (4, "short text"), (None, a), (None, a), (None, b)]
    docs = tables(spark, tmp_path, [t for _, t in rows], [(0, 1, 0)], [i for i, _ in rows])
    out = stage("n-gram Jaccard join")(spark, docs, str(tmp_path))
    assert out.dtypes == docs.dtypes
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, near), (5, b), (5, c), (8, None), (8, ""), (2, "short text"), (None, a), (None, b)], key=str)


def test_stages_of_empty_tables(spark, tmp_path):
    docs = tables(spark, tmp_path, ["x"], [(0, 1, 0)]).limit(0)
    for name, run in corpus_pipeline.STAGES:
        out = run(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "best-fit packing" or out.dtypes == docs.dtypes)


def test_packing_of_empty_texts(spark, tmp_path):
    docs = tables(spark, tmp_path, [None, "", "a b"], [(0, 1, 0)])
    out = stage("best-fit packing")(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.length) for r in out) == [(0, 1), (1, 1), (2, 3)]
