"""Quality rules: an isolation forest over rule statistics.

Each text gives counts (words, symbols, repeated lines and words, capitals, ...), each row a
vector of rates.  Trees split random samples of labelled good documents at random places;
what ends on short paths is unlike them.  The cut on the path score is calibrated on
every labelled row by a histogram of scores.

A null or empty text has no words, so the base rules reject it.  Rows without id are judged
like others; repeated rows get equal verdicts; an empty table gives an empty result, and
without labelled rows of both kinds only the base rules reject.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import textops
from textmill.llm.graph import least_hashes, stored

#: Labelled good documents that the forest is grown on, at most (those of least id hash).
FOREST_ROWS = 8192
TREES = 128
TREE_ROWS = 256
BINS = 512
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A cut may reject at most this share of the labelled good documents.
MAX_GOOD_LOST = 0.002

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_upper", "n_marks", "n_digits", "n_distinct", "n_chars", "n_wide"]
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?;:@^~_=+\\/{}[]()\"")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offs[1:]] - total[offs[:-1]]


def _repeats(hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Marks the members of each group whose hash occurs twice or more in it."""
    order = np.lexsort((hashes, group))
    h, g = hashes[order], group[order]
    same = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    out = np.zeros(len(h), bool)
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out[order] = twice
    return out


def _later_copies(hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Marks the members that equal an earlier one of their group."""
    order = np.lexsort((np.arange(len(hashes)), hashes, group))
    h, g = hashes[order], group[order]
    out = np.zeros(len(h), bool)
    out[order[1:]] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    return out


def counts_of(t: textops.Texts) -> np.ndarray:
    """The COUNTS of each text of a slice, one row per text."""
    buf, offs, n = t.buf, t.offs, t.n
    hashes, starts, before = t.words()
    n_words = np.diff(before)
    space = textops._SPACE[buf]
    head = (buf & 0xC0) != 0x80
    doc_of_word = np.repeat(np.arange(n), n_words)

    width = 3
    triple = np.zeros(n, np.int64)
    if len(hashes) >= width:
        first = np.arange(len(hashes) - width + 1)
        whole = doc_of_word[first] == doc_of_word[first + width - 1]
        first = first[whole]
        marks = textops.mix(hashes[first] * textops._MULT[0] + hashes[first + 1] * textops._MULT[1]
                            + hashes[first + 2] * textops._MULT[2])
        again = first[_repeats(marks, doc_of_word[first])]
        covered = np.zeros(len(hashes), bool)
        for i in range(width):
            covered[again + i] = True
        triple = np.bincount(doc_of_word[covered], minlength=n)
    distinct = n_words - np.bincount(doc_of_word[_later_copies(hashes, doc_of_word)], minlength=n) \
        if len(hashes) else n_words

    newline = buf == 10
    line_starts = np.concatenate([offs[:-1], np.flatnonzero(newline) + 1])
    # a text's own start and the bytes after its line breaks; a break at the end opens an empty line
    line_doc = np.concatenate([np.arange(n), np.searchsorted(offs, np.flatnonzero(newline), "right") - 1])
    order = np.lexsort((line_starts, line_doc))
    line_starts, line_doc = line_starts[order], line_doc[order]
    line_ends = np.append(line_starts[1:], len(buf))
    last = np.append(line_doc[1:] != line_doc[:-1], True)
    line_ends = np.where(last, offs[line_doc + 1], line_ends - 1)
    solid = np.concatenate([[0], np.cumsum(~space)])
    worded = solid[line_ends] > solid[line_starts]
    ls, le, ld = line_starts[worded], line_ends[worded], line_doc[worded]
    dup = np.zeros(n, np.int64)
    if len(ls):
        cover = np.zeros(len(buf) + 1, np.int64)
        np.add.at(cover, ls, 1)
        np.add.at(cover, le, -1)
        inside = np.cumsum(cover[:-1]) > 0
        packed = (np.cumsum(inside) - 1)[ls]
        line_hash = textops.segment_hash(buf[inside], packed)
        dup = np.bincount(ld[_later_copies(line_hash, ld)], minlength=n)

    return np.stack([
        n_words, _sums(~space & head, offs), _sums(_SYMBOL[buf], offs), dup, triple,
        np.bincount(ld, minlength=n), _sums(_UPPER[buf], offs), _sums(_MARK[buf], offs),
        _sums(_DIGIT[buf], offs), distinct, _sums(head, offs), _sums(buf >= 0xC0, offs)], axis=1)


def _stats(batches):
    for b in batches:
        rows = [counts_of(t) for t in textops.slices(b.column(1))]
        table = np.concatenate(rows) if rows else np.zeros((0, len(COUNTS)), np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(table[:, i].astype(np.int64)) for i in range(len(COUNTS))), *b.columns[2:]],
            ["doc_id", *COUNTS, *b.schema.names[2:]])


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep=()) -> DataFrame:
    """One row of COUNTS per row of ``docs``, with its columns ``keep``."""
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep) \
        .mapInArrow(_stats, STATS_SCHEMA + kept)


def rates(c: np.ndarray) -> np.ndarray:
    """The forest's features from a matrix of COUNTS: rates, free of the text's length."""
    words, chars = np.maximum(c[:, 0], 1.0), np.maximum(c[:, 1], 1.0)
    lines = np.maximum(c[:, 5], 1.0)
    return np.stack([
        c[:, 1] / words, np.sqrt(c[:, 2] / words), np.sqrt(c[:, 3] / lines), np.sqrt(c[:, 4] / words),
        c[:, 6] / chars, np.sqrt(c[:, 7] / words), np.sqrt(c[:, 8] / chars),
        np.log1p(c[:, 9]) / np.log1p(words)], axis=1)


class IsolationForest:
    """Random axis-parallel trees; ``score`` is 2^(-mean path / expected path), near 1 for
    rows that random splits set apart early, and also for rows outside a node's range."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = TREE_ROWS, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        sample = min(sample, len(rows))
        self.depth = int(np.ceil(np.log2(max(sample, 2)))) * 4
        self.norm = self._expected(np.array([max(sample, 2)]))[0]
        self.trees = [self._grow(rows[rng.choice(len(rows), sample, replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def _expected(n: np.ndarray) -> np.ndarray:
        n = np.maximum(n, 1).astype(float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))

    def _grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, cut, low, high, size = [], [], [], [], []
        todo = [(rows, 0, -1, False)]
        while todo:
            part, depth, parent, right = todo.pop()
            me = len(feature)
            if parent >= 0:
                (high if right else low)[parent] = me
            # Splits reach past the data's range, so that rows outside it part early.
            span_lo, span_hi = part.min(0), part.max(0)
            margin = 1.5 * (span_hi - span_lo) + 0.1
            if len(part) <= 1 or depth >= self.depth:
                f, c = -1, 0.0
            else:
                f = int(rng.integers(part.shape[1]))
                c = float(rng.uniform(span_lo[f] - margin[f], span_hi[f] + margin[f]))
            feature.append(f)
            cut.append(c)
            low.append(me)
            high.append(me)
            size.append(len(part))
            if f >= 0:
                left = part[:, f] < c
                for side, rows_in in ((False, part[left]), (True, part[~left])):
                    if len(rows_in):
                        todo.append((rows_in, depth + 1, me, side))
                    else:
                        (high if side else low)[me] = -2
        return tuple(np.array(x) for x in (feature, cut, low, high, size))

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, cut, low, high, size in self.trees:
            at = np.zeros(len(rows), np.int64)
            path = np.zeros(len(rows))
            live = np.arange(len(rows))
            while len(live):
                node = at[live]
                f = feature[node]
                leaf = f < 0
                done = live[leaf]
                path[done] += self._expected(size[node[leaf]])
                live, node, f = live[~leaf], node[~leaf], f[~leaf]
                step = np.where(rows[live, f] < cut[node], low[node], high[node])
                path[live] += 1
                at[live] = step
                live = live[step >= 0]
            total += path
        return np.exp2(-total / len(self.trees) / max(self.norm, 1e-9))


def _score(forest):
    def run(batches):
        f = forest.value
        for b in batches:
            c = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(COUNTS))], 1).astype(float) \
                if b.num_rows else np.zeros((0, len(COUNTS)))
            s = f.score(rates(c)) if f is not None else np.zeros(len(c))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, "anomaly"])

    return run


def _base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def calibrated_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The bin edge that rejects most bad rows among those that lose few good ones, placed in
    the middle of the gap between the classes; 2 (nothing rejected) if either is empty."""
    if not good.sum() or not bad.sum():
        return 2.0
    lost = np.cumsum(good[::-1])[::-1] / good.sum()
    caught = np.cumsum(bad[::-1])[::-1] / bad.sum()
    value = np.where(lost <= MAX_GOOD_LOST, caught - 2 * lost, -1.0)
    best = np.flatnonzero(value >= value.max() - 1e-12)
    return float((best[0] + best[-1]) / 2 / len(good)) if value.max() > 0 else 2.0


def quality_verdicts(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                     text_col: str = "text", keep=()) -> DataFrame:
    """doc_id, COUNTS, anomaly (0 to 1), base_failed and kept of every row of ``docs``, and its columns
    ``keep`` (under names that are none of these).  ``labels`` (doc_id, quality) may hold rows for part of them."""
    counts = stored(spark, rule_counts(docs, id_col, text_col, keep).withColumn("base_failed", _base_failed()), "rules")
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")) \
        .filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = stored(spark, counts.select("doc_id", *COUNTS, "base_failed").join(marked, "doc_id"), "known")
    good = known.filter("quality = 1 and not base_failed").withColumn("h", F.xxhash64("doc_id"))
    good = least_hashes(good, FOREST_ROWS, "h").orderBy("h", "doc_id").limit(FOREST_ROWS)
    rows = np.array([list(r) for r in good.select(*COUNTS).collect()], float)
    forest = spark.sparkContext.broadcast(IsolationForest(rates(rows)) if len(rows) >= 2 else None)
    schema = STATS_SCHEMA + ", base_failed boolean, anomaly double"
    on_known = known.select("doc_id", *COUNTS, "base_failed", "quality") \
        .mapInArrow(_score(forest), STATS_SCHEMA + ", base_failed boolean, quality int, anomaly double")
    bins = on_known.filter("not base_failed").groupBy(
        "quality", F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).alias("bin")).count().collect()
    hist = {q: np.zeros(BINS) for q in (0, 1)}
    for r in bins:
        hist[1 if r.quality else 0][int(r.bin)] += r["count"]
    cut = calibrated_cut(hist[1], hist[0])
    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    schema = schema.replace("anomaly double", kept + "anomaly double")
    return counts.select("doc_id", *COUNTS, "base_failed", *keep).mapInArrow(_score(forest), schema) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(cut)))
