"""Document sources by byte range, the preview, rank selection, the next row per key, and the stateful stream."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from textmill.operators import ingest as ing
from textmill.operators import relational as rel
from textmill.session import scratch_path
from textmill.sources import documents as docs
from textmill.sources import files as fs
from textmill.streaming import staging


def _write(folder, files):
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)


def _plain_pages(data, n):
    lines = data.split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    return [(i // n + 1, b"\n".join(lines[i:i + n]).decode("utf-8", "replace")) for i in range(0, len(lines), n)]


def test_pages_of_files_of_every_size_whatever_the_ranges(spark, tmp_path):
    rng = random.Random(3)
    files = {f"a/f{k}.txt": "\n".join("é" * rng.randrange(12) for _ in range(rng.randrange(60))).encode() for k in range(40)}
    files |= {"a/end.txt": b"x\ny\n", "a/one.txt": b"alone", "a/blank.txt": b"\n\n\n\n\n", "a/empty.txt": b"",
              "b/long.txt": b"q" * 5000 + b"\nshort\n" + b"r" * 3000, "b/bad.txt": b"\xff\xfe\nok",
              "b/skip.bin": b"no", "_hidden/x.txt": b"no", "b/.x.txt": b"no"}
    _write(tmp_path, files)
    want = {n: _plain_pages(d, 4) for n, d in files.items() if n.endswith(".txt") and "/." not in n and not n.startswith("_")}
    for split in (7, 64, 1 << 20):
        got = {}
        for r in docs.read_pages(spark, str(tmp_path), "*.txt", 4, split).collect():
            got.setdefault(os.path.relpath(r.path, tmp_path), []).append((r.page_no, r.content))
        assert {n: sorted(p) for n, p in got.items()} == {n: p for n, p in want.items() if p}


def test_pieces_add_up_and_small_files_share_a_task(spark, tmp_path):
    rng = random.Random(4)
    files = {f"f{k}": rng.randbytes(rng.choice([0, 1, 100, 5000])) for k in range(50)}
    _write(tmp_path, files)
    rows = docs.read_pieces(spark, str(tmp_path), "*", 64, 1000).collect()
    assert max(len(r.data) for r in rows) <= 64
    found = {}
    for r in sorted(rows, key=lambda r: (r.path, r.offset)):
        name = os.path.basename(r.path)
        assert r.offset == len(found.get(name, b"")) and r.length == len(files[name])
        found[name] = found.get(name, b"") + bytes(r.data)
    assert found == files
    ranges = docs.ranges_of(str(tmp_path), "*", 1 << 20)
    assert len(docs.packed(ranges, 1 << 20)) == 1
    assert max(len(p.ranges) for p in docs.packed(docs.ranges_of(str(tmp_path), "*", 1000), 1000)) > 1


def test_a_file_above_two_gib(spark, tmp_path):
    """Sparse, so that it costs no disk: its size passes what one row or array can hold."""
    size = (2 << 30) + 12345
    with open(tmp_path / "big.txt", "wb") as f:
        f.write(b"first\nsecond\n")
        f.truncate(size)
        f.seek(size)
        f.write(b"\nlast")
    splits = docs.read_splits(spark, str(tmp_path))
    total = splits.agg(F.sum(F.col("end") - F.col("start")), F.sum("newlines"), F.count("*")).first()
    assert tuple(total) == (size + 5, 3, -(-(size + 5) // docs.SPLIT_BYTES))
    with open(tmp_path / "big.txt", "rb") as f:
        last = docs.Range("", size + 5, size - 10, size + 5, 2)
        assert list(docs.pages(f, last, 1)) == [(4, "last")]


def test_preview_counts_in_one_pass_and_marks_no_rows(spark):
    df = spark.createDataFrame([(i, f"x{i}") for i in range(120)], "a int, b string")
    rows = fs.preview(df, ["a"], 50).collect()
    assert [r.a for r in rows] == list(range(50)) and {(r.total_rows, r.truncated) for r in rows} == {(120, True)}
    assert {(r.total_rows, r.truncated) for r in fs.preview(df.limit(3), ["a"], 50).collect()} == {(3, False)}
    assert [tuple(r) for r in fs.preview(df.filter("a < 0"), ["a"], 50).collect()] == [(None, None, 0, False)]


def test_quantiles_by_rank_selection(spark):
    rng = random.Random(6)
    rows = [(k, v) for k, n in (("hot", 3000), ("few", 5), ("one", 1), (None, 7)) for v in
            (rng.choice([rng.uniform(-9, 9), 1.5]) for _ in range(n))] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(13)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r.k, r.prob): r.quantile for r in rel.exact_quantiles(df, ["k"], "v", probs).filter("k is not null").collect()}
    for k in ("hot", "few", "one"):
        values = [v for x, v in rows if x == k]
        assert np.allclose([got[k, p] for p in probs], np.quantile(values, probs), atol=1e-12)
    assert len(got) == 15
    plan = rel.exact_quantiles(df, ["k"], "v", probs)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower()


def test_the_next_row_of_a_hot_key(spark):
    rng = random.Random(7)
    rows = [(i, 1 if i % 2 else rng.randrange(2, 40), rng.randrange(500)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, user int, ts int").repartition(9)
    got = {r.id: r.next_ts for r in rel.keyed_lead(df, ["user"], ["ts", "id"], "ts", "next_ts", n_parts=16).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    want = {a[0]: (b[2] if b and b[1] == a[1] else None) for a, b in zip(order, [*order[1:], None], strict=True)}
    assert got == want


def test_stream_dedup_survives_a_lost_checkpoint(spark):
    schema = ing.CHUNK_SCHEMA.simpleString().replace("struct<", "").rstrip(">")

    def stage_rows(hashes, run):
        ing.write_chunks_json(spark.createDataFrame([("d", 1, "/d", 1, f"text {h}", h, run) for h in hashes], schema), stage)

    stage, out = scratch_path(spark, "stage"), scratch_path(spark, "dedup") + "/out"
    stage_rows(["a", "b", "c"], "20260101T000000Z")
    staging.stream_dedup(spark, stage, out, scratch_path(spark, "ckpt"))
    stage_rows(["b", "c", "d"], "20260201T000000Z")
    # a new checkpoint folder stands for a lost one: all files are read again
    again = scratch_path(spark, "ckpt")
    staging.stream_dedup(spark, stage, out, again)
    assert sorted(r.chunk_hash for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d"]
    stage_rows(["a", "d", "e"], "20260301T000000Z")
    staging.stream_dedup(spark, stage, out, again)
    assert sorted(r.chunk_hash for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d", "e"]
