"""WARC archives, importance resampling and phrase mining against plain statements of their contracts."""

import base64
import collections
import hashlib
import json
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from textmill.llm import collocations, importance, warc
from textmill.session import configure, scratch_path

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "\n\n", "one", "one two", "\x1c a \x85 b", "é 日本 🎉", "a  b\t\tc   d", "x" * 5000,
       "tail \n", "\nhead", "Ab aB AB", "a.b,c;d:e!f?g"]


@pytest.fixture(scope="module")
def spark(spark):
    return configure(spark)


# ---- archives --------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def plain_records(pages, least=0):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages with different ids."""
    first = {}
    for i, _, h in sorted(pages, key=lambda p: p[0]):
        first.setdefault(h or "", i)
    out = []
    for i, _, h in pages:
        raw = (h or "").encode()
        own = len(raw) < least or first[h or ""] == i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit",
                    None if own else first[h or ""]))
    return sorted(out)


def read_plainly(folder):
    """The records of every archive of a folder by the format alone: dictionary frame, then a frame a record."""
    with open(f"{folder}/index.json") as f:
        index = json.load(f)
    for name, _ in index:
        with open(f"{folder}/{name}", "rb") as f:
            data = f.read()
        extra = {}
        if data[:4] == struct.pack("<I", 0x184D2A5D):
            n = struct.unpack("<I", data[4:8])[0]
            extra = {"dict_data": zstandard.ZstdCompressionDict(data[8:8 + n])}
            data = data[8 + n:]
        while data:
            frame = zstandard.ZstdDecompressor(**extra).decompressobj()
            yield bool(extra), frame.decompress(data)
            data = frame.unused_data


def some_pages(rng, n=300):
    body = [f"<p>{' '.join(rng.choice(['alpha', 'beta', 'gamma', 'delta']) for _ in range(40))} {k}</p>" for k in range(n // 3)]
    return [(i, f"http://h/{i}", rng.choice(body + [None, "", "é🎉"])) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("least", [0, 10])
def test_archives_round_trip(spark, least):
    pages = some_pages(random.Random(3))
    df = spark.createDataFrame(pages, PAGES).withColumn("size", F.lit("clash")).withColumn("first", F.lit(1))
    out = warc.archived(spark, df, min_bytes=least)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect())
    assert got == plain_records(pages, least)
    html = {i: (h or "").encode() for i, _, h in pages}
    for r in out.collect():
        assert r.url == f"http://h/{r.page_id}"
        assert r.payload == (None if r.record_type == "revisit" else html[r.page_id])


def test_archives_follow_the_format_and_roll_over(spark):
    pages = [(i, f"http://h/{i}", f"<p>{'word ' * (i % 50)} {i}</p>") for i in range(600)]
    path = scratch_path(spark, "warc")
    warc.archive_pages(spark, spark.createDataFrame(pages, PAGES).coalesce(1), path, archive_bytes=40_000)
    with open(f"{path}/index.json") as f:
        assert len(json.load(f)) > 3
    records = list(read_plainly(path))
    assert len(records) == 600 and sum(d for d, _ in records) > 500
    for _, r in records:
        head, rest = r.split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and fields["WARC-Type"] == "response"
        assert len(rest) == int(fields["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
    assert warc.read_archives(spark, path).count() == 600


def test_archives_are_read_in_blocks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "SPLIT_BYTES", 300)
    archive = warc._Archive(*warc._filesystem(f"{tmp_path}/a.warc.zst"), 3)
    bodies = [f"<p>{random.Random(i).random()}</p>".encode() for i in range(200)]
    for i, h in enumerate(bodies):
        archive.add(warc.pack_record(i, "http://x/", h, len(h), warc.payload_digest(h)))
    at = archive.close()
    assert len(at) > 10
    with open(f"{tmp_path}/a.warc.zst", "rb") as f:
        got = [warc.unpack_record(r)[3] for s, e in zip(at, at[1:], strict=False) for r in warc.read_frames(f, s, e)]
    assert got == bodies


def test_broken_payloads_are_errors():
    record = warc.pack_record(1, "u", b"abc", 3, warc.payload_digest(b"abc"))
    assert warc.unpack_record(record)[3] == b"abc"
    with pytest.raises(ValueError, match="digest"):
        warc.unpack_record(record.replace(b"abc\r\n", b"abd\r\n"))
    with pytest.raises(ValueError, match="broken"):
        warc.unpack_record(record[:-1])


def test_archives_of_odd_rows(spark):
    assert warc.archived(spark, spark.createDataFrame([], PAGES)).collect() == []
    rows = [(None, None, None), (5, "http://a b\r\nX: y", ""), (5, "http://b", "same"), (5, "http://a", "same"),
            (7, "u", "same"), (7, "u", "same"), (9, "long", "z" * 3_000_000), (None, "n", "same")]
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in
                  warc.archived(spark, spark.createDataFrame(rows, PAGES)).collect()), key=str)
    assert got == sorted([(None, "revisit", 5, 0), (5, "response", None, 0), (5, "revisit", 5, 4), (5, "response", None, 4),
                          (7, "revisit", 5, 4), (7, "revisit", 5, 4), (9, "response", None, 3_000_000),
                          (None, "revisit", 5, 4)], key=str)
    twice = warc.archived(spark, spark.createDataFrame([(1, "u", "x"), (1, "u", "x")], PAGES)).collect()
    assert [(r.record_type, r.refers_to) for r in twice] == [("response", None)] * 2


# ---- importance ------------------------------------------------------------------------

def test_span_crc32_is_crc32():
    rng = np.random.default_rng(5)
    buf = rng.integers(0, 256, 60000, dtype=np.uint8)
    lens = np.concatenate([rng.integers(1, 65, 200), rng.integers(60, 400, 200), [64, 65, 128, 129, 20000, 1, 4]])
    starts = rng.integers(0, 40000, len(lens))
    assert importance.span_crc32(buf, starts, lens).tolist() == \
        [zlib.crc32(buf[s:s + n].tobytes()) for s, n in zip(starts, lens, strict=True)]


def plain_sample(docs, target, lo, hi, percent):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = [word.findall((t or "").translate(LOWER)) for _, t in docs]

    def grams(ws):
        return [" ".join(ws[i:i + n]) for n in range(lo, hi + 1) for i in range(len(ws) - n + 1)]

    def bucket(g):
        return zlib.crc32(g.encode()) % 10000

    s = collections.Counter(bucket(g) for w in words for g in grams(w))
    t = collections.Counter(bucket(g) for x in target for g in grams(word.findall((x or "").translate(LOWER))))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
                     for b in map(bucket, grams(w)))
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(grams(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(able[:percent * len(able) // 100])}
    return sorted([*r, rank.get(r[0])] for r in out)


@pytest.mark.parametrize(("lo", "hi", "percent"), [(1, 1, 10), (1, 3, 35)])
def test_importance_sample_is_the_plain_one(spark, lo, hi, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [tuple(r) for r in docs.collect()] + [(10**6 + i, t) for i, t in enumerate([*ODD, "word " * 30, "y" * 3000 + " z"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("clash")).withColumn("n", F.lit(0))
    got = importance.importance_sample(spark, df, target, lo=lo, hi=hi, percent=percent)
    assert sorted(map(list, got.collect())) == plain_sample(rows, [r.text for r in target.collect()], lo, hi, percent)


def test_importance_sample_of_odd_tables(spark):
    shape = "doc_id long, text string"
    some = spark.createDataFrame([(None, "a " * 30), (1, "b " * 30), (1, "b " * 30), (2, None)], shape)
    none = spark.createDataFrame([], shape)
    assert importance.importance_sample(spark, none, some).collect() == []
    got = importance.importance_sample(spark, some, none, lo=1, hi=1, percent=100).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    assert [(r.n_features, r.weight, r["rank"]) for r in got if r.doc_id == 2] == [(0, 0, None)]


# ---- phrases ---------------------------------------------------------------------------

def plain_phrases(docs, top=4, least=30, best=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        name = "und" if lang is None else lang
        for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", p)
            n[name] += len(w)
            for k in range(1, top + 1):
                f.update((name, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = collections.Counter()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i:i + k]] = max(longer[lang, w[i:i + k]], a)
    rows = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        if 100 * longer[lang, w] >= 80 * a:
            continue
        score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                                    for k in range(1, len(w)))
        rows[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang in sorted(rows)
            for i, (s, a, p, x, y) in enumerate(sorted(rows[lang])[:best])]


@pytest.mark.parametrize(("top", "least", "best", "bits"), [(4, 30, 2000, 1 << 26), (3, 5, 50, 1 << 14), (5, 8, 2000, 1 << 10)])
def test_collocations_are_the_plain_ones(spark, top, least, best, bits, monkeypatch):
    # With few bits the map of pairs is nearly full: hardly a cut, and the same counts.
    monkeypatch.setattr(collocations.frequent_pairs, "__defaults__", (bits, 64))
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(None, t) for t in ODD] * 9 + [("", "New York! new york"), ("é", "\x1c x \x1c x")] * 20
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("f", F.lit("clash")).withColumn("n", F.lit(0))
    got = collocations.collocations(spark, df, top=top, least=least, best=best)
    assert sorted(map(tuple, got.collect())) == sorted(plain_phrases(rows, top, least, best))


def test_collocations_of_nothing(spark):
    shape = "lang string, text string"
    assert collocations.collocations(spark, spark.createDataFrame([], shape)).collect() == []
    assert collocations.collocations(spark, spark.createDataFrame([("en", None), (None, " . ")] * 40, shape)).collect() == []


def test_unary_paths_hold_every_run_once(spark):
    import pyarrow as pa

    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(9))) + rng.choice([". ", " "]) + passage for _ in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 50), pa.array(texts)], ["lang", "text"])
    (w, names), = collocations._slices(batch)
    first, last, runs, weight = collocations.unary_paths(w, 4)
    rows = collocations._path_rows(w, first, last, runs, weight, names).to_pylist()
    assert any(r["weight"] == 50 and r["runs"] >= 27 for r in rows)
    got = collections.Counter()
    for r in rows:
        words = r["path"].split(" ")
        for i in range(r["runs"]):
            got[tuple(words[i:i + 4])] += r["weight"]
    want = collections.Counter()
    for t in texts:
        for p in t.split("."):
            words = p.split()
            want.update(tuple(words[i:i + 4]) for i in range(len(words)))
    assert got == want
