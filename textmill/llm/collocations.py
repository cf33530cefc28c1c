"""Phrase collocations by a weighted de Bruijn graph of words.

Texts (A-Z lower-cased) are split into pieces at ``PIECE_END`` characters, and pieces into words
at spaces and tabs.  Nodes are runs of ``top - 1`` words and edges runs of ``top``: an edge leads from
its first words to its last.  The last words of a piece have no further edge; they leave a
shorter run that marks the piece's end.  So every word occurrence begins exactly one run,
and only these are counted over the corpus: the occurrences of a shorter phrase are the flow
out of its node (the counts of the longer runs that begin with it) plus the pieces that end in it.

* Pairs of adjacent words are counted by hash first.  A pair in a phrase that counts has
  at least ``least`` occurrences, so a text may be cut between any other two words without losing
  a phrase; equal hashes only leave a cut out.  The pairs to keep go to the tasks as a bit map of
  hashes, of ``FILTER_BITS`` bits whatever the corpus, which by filling up leaves more to count
  and never a wrong count.
* A task builds the graph of a slice of text at a time and compacts its unary paths: where a
  node has one way in and one out, with equal weights, its edges are one row, the words
  of the path and its weight.  The rows are expanded to edges and summed over the corpus.
* Level by level, from ``top`` words down to one, runs of ``least`` occurrences or more are set aside
  under their own text while all flow on to their first words: one partial sum and
  shuffle a level, in which no key holds more than a row a task.
* Scores join the parts of each cut with the counts; a phrase is dropped by the greatest count of
  the longer ones around it.  All arithmetic is in integers, products in decimals.
* The best of a language are taken in salted groups first, then among those.

Null text counts as empty, null lang as ``und``; texts without words give nothing; repeated rows count
each for itself; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmill.llm.graph import stored
from textmill.llm.textops import Texts, as_long, mix, segment_hash, slices

#: Characters that end a piece, and those between its words.
PIECE_END = ".,;:!?\n\x0b\x0c\r"
WORD_GAP = " \t"

LEAST = 30
TOP = 4
BEST = 2000
FILTER_BITS = 1 << 26
#: Hashes a counting task holds before it hands their sums on.
HELD = 1 << 21
#: Bytes of text that make one graph before they go to the others.
SLICE = 4 << 20

_END = np.zeros(256, bool)
_END[[ord(c) for c in PIECE_END]] = True
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in WORD_GAP]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---- words and pieces ------------------------------------------------------------------

class Words:
    """The words of a slice of texts, joined by single spaces in ``buf``.

    ``starts`` and ``lens`` are bytes there, ``hashes`` the words', ``group`` the number of each word's
    language, and ``ends`` says whether a word is the last of its piece."""

    def __init__(self, t: Texts, languages: np.ndarray):
        end = _END[t.buf]
        solid = ~(end | _GAP[t.buf])
        edge = np.zeros(len(solid) + 1, bool)
        edge[1:-1] = ~solid[:-1]
        edge[t.offs] = True
        at = np.flatnonzero(solid & edge[:-1])
        self.n = len(at)
        if not self.n:
            return
        body = _LOWER[t.buf[solid]]
        packed = (np.cumsum(solid) - 1)[at]
        self.lens = np.diff(packed, append=len(body))
        text = np.searchsorted(t.offs, at, "right") - 1
        self.group = languages[text]
        self.hashes = mix(segment_hash(body, packed) + mix(self.group))
        piece = np.cumsum(end)[at]
        self.ends = np.ones(self.n, bool)
        self.ends[:-1] = (text[1:] != text[:-1]) | (piece[1:] != piece[:-1])
        self.starts = packed + np.arange(self.n)
        self.buf = np.full(len(body) + self.n, 32, np.uint8)
        self.buf[np.arange(len(body)) + np.repeat(np.arange(self.n), self.lens)] = body

    def pairs(self) -> np.ndarray:
        """A hash of each word and the next one."""
        return mix(mix(self.hashes[:-1]) + self.hashes[1:])

    def runs(self, width: int) -> list[np.ndarray]:
        """For 1 to ``width`` words, a number of the words from each word on; fewer where the piece
        ends, which the number tells.  Equal numbers are equal words of one language."""
        left, at = self.left(), np.arange(self.n)
        word = np.unique(self.hashes, return_inverse=True)[1] + 1
        out = [word]
        for i in range(1, width):
            ahead = np.where(left > i, word[np.minimum(at + i, self.n - 1)], 0)
            out.append(np.unique(out[-1] * (int(word.max()) + 1) + ahead, return_inverse=True)[1])
        return out

    def left(self) -> np.ndarray:
        """How many words of its piece begin at each word."""
        last = np.flatnonzero(self.ends)
        return last[np.searchsorted(last, np.arange(self.n))] - np.arange(self.n) + 1

    def cut(self, kept: np.ndarray) -> None:
        """Ends pieces between words whose pair is not in the bit map."""
        h = self.pairs() & np.uint64(len(kept) * 8 - 1)
        self.ends[:-1] |= (kept[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 0

    def phrases(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """The texts from words ``first`` to ``last``."""
        begin = self.starts[first]
        lens = self.starts[last] + self.lens[last] - begin
        offs = np.concatenate([[0], np.cumsum(lens)])
        flat = self.buf[np.arange(offs[-1]) + np.repeat(begin - offs[:-1], lens)]
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(flat))


def _languages(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = column.fill_null("und").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def _language_hash(names: list[str]) -> np.ndarray:
    """A number of each language that does not depend on the batch."""
    raw = [n.encode() or b"\0" for n in names]
    return np.array([segment_hash(np.frombuffer(r, np.uint8), np.zeros(1, np.int64))[0] for r in raw], np.uint64)


def _slices(b: pa.RecordBatch):
    codes, names = _languages(b.column(0))
    keys = _language_hash(names)
    for t in slices(b.column(1), SLICE):
        w = Words(t, keys[codes[t.first:t.first + t.n]])
        if w.n:
            yield w, names


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def _pair_counts(batches):
    held, sums, size = [], [], 0

    def out():
        keys, counts = _counted(np.concatenate(held), np.concatenate(sums))
        return pa.RecordBatch.from_arrays([pa.array(as_long(keys)), pa.array(counts)], ["pair", "n"])

    for b in batches:
        for w, _ in _slices(b):
            pairs = w.pairs()[~w.ends[:-1]]
            keys, counts = np.unique(pairs, return_counts=True)
            held.append(keys)
            sums.append(counts)
            size += len(keys)
            if size >= HELD:
                keys, counts = _counted(np.concatenate(held), np.concatenate(sums))
                held, sums, size = [keys], [counts], len(keys)
                if size >= HELD // 2:
                    yield out()
                    held, sums, size = [], [], 0
    if held:
        yield out()


def _bitmap(size: int):
    """One row for each block of cells in the partition: a bit map of ``size`` bits."""
    def run(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            block, cell = b.column(0).to_numpy(), b.column(1).to_numpy() % size
            for k in np.unique(block).tolist():
                bits = found.setdefault(k, np.zeros(size, bool))
                bits[cell[block == k]] = True
        for k, bits in found.items():
            packed = np.packbits(bits, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([packed])], ["block", "bits"])

    return run


def frequent_pairs(docs: DataFrame, least: int, bits: int = FILTER_BITS, blocks: int = 64) -> bytes:
    """A bit map of the hashes of all adjacent words with at least ``least`` occurrences: ``bits`` / 8 bytes."""
    size = bits // blocks
    pairs = docs.mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    cells = pairs.filter(F.col("n") >= least).select(F.col("pair").bitwiseAND(F.lit(bits - 1)).alias("cell")).distinct()
    cells = cells.select(F.floor(F.col("cell") / size).alias("block"), "cell").repartition(blocks, "block")
    out = bytearray(bits // 8)
    for r in cells.mapInArrow(_bitmap(size), "block long, bits binary").toLocalIterator():
        out[r.block * size // 8:(r.block + 1) * size // 8] = r.bits
    return bytes(out)


# ---- the graph -------------------------------------------------------------------------

def _firsts(codes: np.ndarray) -> np.ndarray:
    """Where each number comes first."""
    first = np.zeros(int(codes.max()) + 1, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first


def unary_paths(w: Words, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The graph of a slice as (first word, last word, runs, weight) of each of its compacted paths.

    Word i begins run i; runs i and i + 1 share the node of the ``top - 1`` words at i + 1.  The
    two belong to one path where both weigh as much as the node: nothing else enters or
    leaves it.  Each distinct run is in one path, at its first occurrence."""
    left = w.left()
    node, run = w.runs(top)[-2:]
    weight, node_weight = np.bincount(run)[run], np.bincount(node)[node]
    leads = np.zeros(w.n, bool)
    leads[_firsts(run)] = True
    joined = np.zeros(w.n, bool)
    joined[1:] = ~w.ends[:-1] & leads[:-1] & leads[1:] & (weight[:-1] == weight[1:]) & (weight[1:] == node_weight[1:])
    heads = np.flatnonzero(leads & ~joined)
    runs = np.diff(np.append(np.cumsum(leads)[heads] - 1, int(leads.sum())))
    tails = heads + runs - 1
    return heads, tails + np.minimum(left[tails], top) - 1, runs, weight[heads]


def _paths(top: int, kept: bytes):
    def run(batches):
        bitmap = np.frombuffer(kept, np.uint8)
        for b in batches:
            for w, names in _slices(b):
                w.cut(bitmap)
                first, last, runs, weight = unary_paths(w, top)
                yield _path_rows(w, first, last, runs, weight, names)

    return run


def _path_rows(w: Words, first, last, runs, weight, names: list[str]) -> pa.RecordBatch:
    keys = _language_hash(names)
    order = np.argsort(keys)
    lang = order[np.searchsorted(keys[order], w.group[first])]
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()).take(pa.array(lang)), w.phrases(first, last).cast(pa.string()),
         pa.array(runs, pa.int64()), pa.array(weight, pa.int64())], ["lang", "path", "runs", "weight"])


def _word_count(phrase: str) -> Column:
    return F.length(phrase) - F.length(F.translate(phrase, " ", "")) + 1


def phrase_counts(spark: SparkSession, docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, f) of every phrase of 1 to ``top`` words with at least ``least`` occurrences,
    and (lang, null, 0, n): the number of all word occurrences."""
    if top < 2:
        raise ValueError("phrases have two words or more")
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    kept = frequent_pairs(docs, least)
    paths = docs.mapInArrow(_paths(top, kept), "lang string, path string, runs long, weight long")
    # A path of r runs gives r edges; those behind the piece's last whole edge are shorter.
    edges = paths.select("lang", "weight", F.split("path", " ").alias("w"),
                         F.explode_outer(F.sequence(F.lit(1), F.col("runs").cast("int"))).alias("k"))
    level = edges.groupBy("lang", F.array_join(F.slice("w", F.col("k"), top), " ").alias("phrase"), F.lit(True).alias("flows")) \
        .agg(F.sum("weight").alias("f"))
    for words in range(top, 0, -1):
        # Runs of this many words are complete here: set aside if frequent, and handed to their first words.
        whole = F.col("flows") & (_word_count("phrase") == words) & (F.col("f") >= least)
        onward = F.substring_index("phrase", " ", words - 1) if words > 1 else F.lit(None).cast("string")
        parts = F.array(
            F.when(F.col("flows"), F.struct(onward.alias("phrase"), F.lit(True).alias("flows"))),
            F.when(whole | ~F.col("flows"), F.struct("phrase", F.lit(False).alias("flows"))))
        level = level.select("lang", "f", F.explode_outer(F.array_compact(parts)).alias("p")) \
            .groupBy("lang", F.col("p.phrase").alias("phrase"), F.col("p.flows").alias("flows")).agg(F.sum("f").alias("f"))
    return level.select("lang", "phrase", F.coalesce(_word_count("phrase"), F.lit(0)).cast("int").alias("words"), "f")


# ---- collocations ----------------------------------------------------------------------

def _joined(first: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.col("w"), first, n), " ")


def collocations(spark: SparkSession, docs: DataFrame, *, top: int = TOP, least: int = LEAST, best: int = BEST,
                 scale: int = 2000000, covered: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``best`` phrases of 2 to ``top`` words of each language.

    a is a phrase's count, l and r those of the two parts of the cut that scores least,
    score = floor(``scale`` * a / (l + r)).  Phrases inside a longer one that has at least ``covered`` percent of
    their count are dropped."""
    counts = stored(spark, phrase_counts(spark, docs, top, least), "phrases")
    totals = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    counts = counts.filter("words > 0")
    phrases = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    # The greatest count of a longer phrase around each phrase.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: _joined(i, n))))
    around = phrases.filter("words > 2").select("lang", F.explode(spans).alias("phrase"), "a") \
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = "decimal(20,0)"
    inside = F.lit(100).cast("decimal(3,0)") * F.col("longer").cast(wide) >= F.lit(covered).cast("decimal(3,0)") * F.col("a").cast(wide)
    left = phrases.join(around, ["lang", "phrase"], "left").filter(~F.coalesce(inside, F.lit(False)))

    # Every cut of what is left meets the counts of its two parts.
    cuts = left.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.lit(1), F.col("k")).alias("head"),
                       _joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    score = F.expr(f"cast({scale} as decimal(10,0)) * cast(a as {wide}) div (cast(l as {wide}) + cast(r as {wide}))")
    scored = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")) \
        .groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    scored = stored(spark, scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "scored")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(*order)
    some = scored.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= best)
    ranks = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)
    return ranks.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
