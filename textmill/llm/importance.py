"""Importance resampling towards a target distribution, over hashed word n-grams.

Words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters.  Features are all
runs of ``lo`` to ``hi`` consecutive words joined by one space; a feature's bucket is the
crc32 of its UTF-8 bytes modulo ``buckets``.  A bucket's gain is the logarithm of its smoothed
share in the target texts over that in the documents, and a document's weight the sum of
the gains of its features.  Adding Gumbel noise drawn from the id and taking the highest
scores draws documents without replacement in proportion to exp(weight).

The crc32 of all features of a slice of texts comes from numpy at once.  A crc is linear over
GF(2), so it is a constant of the length, xor the contribution of each byte, which depends on
the byte and its distance from the end only.  Contributions are looked up in a table of
``SPAN`` positions and folded with ``bitwise_xor.reduceat``; a longer feature is folded
block by block, the register of one block entering the first four bytes of the next.

Scale: each task counts into one array of ``buckets`` entries and emits its non-zero ones; the
driver holds ``buckets`` gains.  The draw orders thin rows (no text) by range partitions, and a
row's rank is its place in its partition plus the sizes of those before, so nothing meets in one task.

Null and empty texts have no words: no features, weight 0, never drawn.  Repeated rows are scored and
ranked each for itself.  A null id counts as the text ``null`` in the noise and comes before others
in ties.  An empty table gives an empty result; empty target texts give gains from the
documents alone.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmill.llm.graph import stored
from textmill.llm.textops import Texts, slices

BUCKETS = 10000
MIN_WORDS = 20
SEED = 2024
#: Distances from the end that the table of contributions covers; longer features fold in blocks.
SPAN = 64

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---- crc32 by position tables ----------------------------------------------------------

def _byte_table() -> np.ndarray:
    """The register after one byte, from the reflected polynomial of crc32."""
    reg = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        reg = np.where(reg & 1, (reg >> 1) ^ np.uint32(0xEDB88320), reg >> 1)
    return reg


def _zero_byte(reg: np.ndarray) -> np.ndarray:
    """The register after a further byte of zero."""
    return (reg >> np.uint32(8)) ^ _BYTE_TABLE[reg & np.uint32(255)]


_BYTE_TABLE = _byte_table()


def _position_tables() -> tuple[np.ndarray, np.ndarray]:
    """(contribution of byte b at distance d from the end, at 256 * d + b; constant of a length)."""
    rows, ones = [_BYTE_TABLE], [np.full(1, 0xFFFFFFFF, np.uint32)]
    for _ in range(SPAN - 1):
        rows.append(_zero_byte(rows[-1]))
    for _ in range(SPAN):
        ones.append(_zero_byte(ones[-1]))
    return np.concatenate(rows), np.concatenate(ones)


_AT_DISTANCE, _OF_LENGTH = _position_tables()


def _gathered(starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of every byte of the spans, its distance from its span's end, first of each span)."""
    ends = np.cumsum(lens)
    firsts = ends - lens
    flat = np.arange(int(ends[-1]))
    return flat + np.repeat(starts - firsts, lens), np.repeat(ends - 1, lens) - flat, firsts


def span_crc32(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of every span of ``buf``; spans are not empty and may overlap."""
    out = np.zeros(len(starts), np.uint32)
    short = lens <= SPAN
    if short.any():
        at, distance, firsts = _gathered(starts[short], lens[short])
        parts = _AT_DISTANCE[distance * 256 + buf[at]]
        out[short] = np.bitwise_xor.reduceat(parts, firsts) ^ _OF_LENGTH[lens[short]]
    if not short.all():
        out[~short] = _blockwise(buf, starts[~short], lens[~short])
    return ~out


def _blockwise(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Registers of long spans: a first block of the division's rest, then whole blocks."""
    head = (lens - 1) % SPAN + 1
    at, distance, firsts = _gathered(starts, head)
    reg = np.bitwise_xor.reduceat(_AT_DISTANCE[distance * 256 + buf[at]], firsts) ^ _OF_LENGTH[head]
    at, left = starts + head, (lens - head) // SPAN
    live = np.arange(len(starts))
    steps = np.arange(SPAN)
    base = (SPAN - 1 - steps) * 256
    while len(live):
        live = live[left[live] > 0]
        for part in np.array_split(live, max(1, len(live) // 8192)):
            if len(part):
                block = buf[at[part][:, None] + steps]
                block[:, :4] ^= reg[part].astype("<u4").view(np.uint8).reshape(-1, 4)
                reg[part] = np.bitwise_xor.reduce(_AT_DISTANCE[base + block], axis=1)
        at[live] += SPAN
        left[live] -= 1
    return reg


# ---- features --------------------------------------------------------------------------

def _words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a slice joined by single spaces: (bytes, starts, lengths, words before each text)."""
    solid = _WORD[t.buf]
    edge = np.zeros(len(solid) + 1, bool)
    edge[1:-1] = ~solid[:-1]
    edge[t.offs] = True
    starts = np.flatnonzero(solid & edge[:-1])
    before = np.searchsorted(starts, t.offs)
    if not len(starts):
        return np.zeros(0, np.uint8), starts, starts, before
    body = _LOWER[t.buf[solid]]
    packed = (np.cumsum(solid) - 1)[starts]
    lens = np.diff(packed, append=len(body))
    joined = np.full(len(body) + len(starts), 32, np.uint8)
    joined[np.arange(len(body)) + np.repeat(np.arange(len(starts)), lens)] = body
    return joined, packed + np.arange(len(starts)), lens, before


def features(words: tuple, lo: int, hi: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets of the features, features before each text) for each number of words."""
    buf, starts, lens, before = words
    counts = np.diff(before)
    for width in range(lo, hi + 1):
        n = np.maximum(counts - width + 1, 0)
        ahead = np.concatenate([[0], np.cumsum(n)])
        if not ahead[-1]:
            yield np.zeros(0, np.int64), ahead
            continue
        first = np.repeat(before[:-1] - ahead[:-1], n) + np.arange(ahead[-1])
        last = first + width - 1
        crc = span_crc32(buf, starts[first], starts[last] + lens[last] - starts[first])
        yield (crc % np.uint32(buckets)).astype(np.int64), ahead


def _counting(lo: int, hi: int, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for t in slices(b.column(0)):
                for found, _ in features(_words(t), lo, hi, buckets):
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, lo: int, hi: int, buckets: int = BUCKETS) -> list[int]:
    """How many features of all texts (column ``text``) fall into each bucket."""
    found = texts.select("text").mapInArrow(_counting(lo, hi, buckets), "bucket long, n long")
    out = [0] * buckets
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n
    return out


def bucket_gains(target: Iterable[int], source: Iterable[int]) -> list[int]:
    """Thousandths of the log ratio of smoothed shares, target over source, floored."""
    target, source = list(target), list(source)
    t_all, s_all, n = sum(target), sum(source), len(source)
    return [math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n))))
            for t, s in zip(target, source, strict=True)]


def noise(seed: int, doc_id) -> int:
    """Thousandths of a standard Gumbel draw that depends on the seed and the id only."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scoring(lo: int, hi: int, gains: list[int], seed: int):
    buckets = len(gains)

    def run(batches):
        gain = np.array(gains, np.int64)
        for b in batches:
            n_words, n_features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for t in slices(b.column(1)):
                at = slice(t.first, t.first + t.n)
                words = _words(t)
                n_words[at] = np.diff(words[3])
                for found, ahead in features(words, lo, hi, buckets):
                    total = np.concatenate([[0], np.cumsum(gain[found])])
                    n_features[at] += np.diff(ahead)
                    weight[at] += total[ahead[1:]] - total[ahead[:-1]]
            drawn = np.array([noise(seed, i) for i in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x) for x in (n_words, n_features, weight, weight + drawn))],
                ["doc_id", "n_words", "n_features", "weight", "score"])

    return run


# ---- the draw --------------------------------------------------------------------------

def ranked(spark: SparkSession, df: DataFrame, *order) -> DataFrame:
    """``df`` with ``rank`` (long, from 1) in ``order``.  Rows are dealt into ranges and sorted
    there; the written table keeps each row's range and place, and the ranges' sizes (one
    row a range, which bounds the broadcast) give the rest."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order) \
        .withColumn("_at", F.monotonically_increasing_id())
    placed = stored(spark, placed, "ranked").withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_range", ahead.alias("_ahead"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(sizes), "_range") \
        .withColumn("rank", F.col("_ahead") + place + 1).drop("_at", "_range", "_ahead")


def importance_sample(spark: SparkSession, docs: DataFrame, target: DataFrame, *, lo: int = 1, hi: int = 2,
                      percent: int = 10, min_words: int = MIN_WORDS, buckets: int = BUCKETS,
                      seed: int = SEED) -> DataFrame:
    """Every document of ``docs`` (doc_id, text) as (doc_id, n_words, n_features, weight, score,
    rank): of the N documents with at least ``min_words`` words, the floor(``percent`` * N / 100) of
    highest score, ties to the smaller id, have a rank; the others null.  ``target`` has a
    column ``text``."""
    if not 1 <= lo <= hi:
        raise ValueError("features need 1 <= lo <= hi")
    docs = docs.select("doc_id", "text")
    gains = bucket_gains(bucket_counts(target, lo, hi, buckets), bucket_counts(docs, lo, hi, buckets))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.mapInArrow(_scoring(lo, hi, gains, seed),
                             f"doc_id {id_type}, n_words long, n_features long, weight long, score long")
    scored = stored(spark, scored, "scored")
    able = scored.filter(F.col("n_words") >= min_words)
    draw = percent * able.count() // 100
    placed = ranked(spark, able, F.desc("score"), F.asc("doc_id"))
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return drawn.unionByName(scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
