"""Toxicity by compression distance: two zstandard dictionaries, windows, calibrated scores.

The ordinary dictionary is trained on ordinary text.  The toxic one is not trained on windows of
toxic text, which finds too little here (see the README): it is the ordinary one and a lexicon,
the words of toxic texts that begin with a stem significantly more frequent in them by G squared.
Context and phrases of toxic text are not learnt.  A text is cut into windows of whole words; each
window is compressed with both, and the difference of the two lengths says how much of it is in
the lexicon.  Labelled documents that trained no dictionary give the thresholds: how much more
often each difference occurs in toxic texts is that window's weight, and a logistic fit on the
weights of a text gives its score.

The dictionaries see a bounded sample of labelled rows (``TRAIN_DOCS`` a class) in full.  Labels,
language, source and ids are never inputs of a score.  A null or empty text gets the score of a
text without windows; with labels of one class only, all scores are 0.  Repeated rows get equal
scores; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.graph import least_hashes, stored

TRAIN_DOCS = 1500
#: Documents of each class that calibrate the scores.
FIT_DOCS = 6000
DICT_BYTES = 112_640
WINDOW_WORDS = 12
LEVEL = 3
#: Differences in bytes are told apart up to this size on either side.
SPAN = 16
#: G squared by which a stem must be more frequent in toxic text, whatever other stems have.
G2 = 15.0
#: Bytes of the beginnings of words that are counted besides whole words.
STEM = 4, 24
#: The toxic dictionary's words with a marked stem; the rarest go first if they are more.
FAR_BYTES = 8192
MARKS = b".,;:!?\"'()"


def windows(text: str, words: int = WINDOW_WORDS) -> list[bytes]:
    """The whole text in runs of ``words`` words, lower-cased (A-Z), without outer punctuation."""
    w = [x.strip(MARKS) for x in text.encode().lower().split()]
    return [b" " + b" ".join(w[i:i + words]) + b" " for i in range(0, len(w), words)]


def stems(word: bytes) -> list[bytes]:
    """The word, and its beginnings of ``STEM`` bytes that end with a whole character."""
    ends = [i for i in range(STEM[0], min(len(word), STEM[1] + 1)) if word[i] & 0xC0 != 0x80]
    return [word[:i] for i in ends] + [word]


def marked_stems(toxic: list[str], ordinary: list[str]) -> dict[bytes, float]:
    """Words and beginnings of words that are significantly more frequent in toxic texts, both by
    documents and by occurrences, with the G squared of the occurrences; equal texts count once.
    Each is held to the bound by itself, whatever others there are; of two of which one begins
    with the other, the more significant one is given."""
    def counted(texts, only=None):
        documents, times, n = Counter(), Counter(), 0
        for t in texts:
            seen: Counter = Counter()
            for w, k in Counter(x.strip(MARKS) for x in t.encode().lower().split()).items():
                n += k
                for u in stems(w) if w else ():
                    if only is None or u in only:
                        seen[u] += k
            documents.update(seen.keys())
            times.update(seen)
        return documents, times, n

    def more_frequent(a, na, b, nb):
        out = {}
        for w, n in a.items():
            m = b.get(w, 0)
            if n * nb > 2 * m * na and (g := likelihood_ratio(n, na, m, nb)) >= G2:
                out[w] = g
        return out

    toxic, ordinary = set(toxic), set(ordinary)
    a, a_times, a_words = counted(toxic)
    b, b_times, b_words = counted(ordinary, a)
    found = more_frequent(a, len(toxic), b, len(ordinary))
    found = more_frequent({w: a_times[w] for w in found}, a_words, b_times, b_words)
    begun: set[bytes] = set()
    out: dict[bytes, float] = {}
    for w in sorted(found, key=lambda w: (-found[w], -len(w), w)):
        mine = stems(w)
        if w not in begun and not any(u in out for u in mine):
            out[w] = found[w]
            begun.update(mine)
    return out


def likelihood_ratio(n: int, na: int, m: int, nb: int) -> float:
    """G squared of n out of na against m out of nb: how unlike one common rate they are."""
    def term(x, total, rate):
        return x * log(x / total / rate) if x else 0.0

    rate = (n + m) / (na + nb)
    rest = max(1 - rate, 1e-12)
    return 2 * (term(n, na, rate) + term(m, nb, rate) + term(na - n, na, rest) + term(nb - m, nb, rest))


class Dictionaries:
    """The two dictionaries.  The ordinary one is trained on windows of ordinary text without
    marked stems (after blanks, so that its offsets are those of the other); the toxic one has
    this same text in the near part, which makes common language cost both alike, and in the
    far part the words of toxic text that begin with a marked stem, the most frequent last."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        marked = marked_stems(toxic, ordinary)
        plain = [x for t in ordinary for x in windows(t) if not any(u in marked for w in x.split() for u in stems(w))]
        odd = Counter(w for t in toxic for x in windows(t) for w in set(x.split()) if any(u in marked for u in stems(w)))
        common = self._train(plain, DICT_BYTES)
        far = b" " + b" ".join(w for w, _ in sorted(odd.items(), key=lambda x: (x[1], x[0])))[-FAR_BYTES:] + b" "
        self.toxic = far + common
        self.ordinary = b" " * len(far) + common

    @staticmethod
    def _train(samples: list[bytes], size: int) -> bytes:
        import zstandard

        try:
            return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            # too little text to choose from: the text itself is the dictionary
            return b"".join(samples)[:size]

    def compressors(self):
        import zstandard

        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=17,
            min_match=4, strategy=zstandard.STRATEGY_LAZY2, search_log=6)
        made = []
        for data in (self.ordinary, self.toxic):
            d = zstandard.ZstdCompressionDict(data or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)
        return made


class Differ:
    """Differences per window in one worker; equal windows are compressed once."""

    def __init__(self, dictionaries: Dictionaries):
        self.ordinary, self.toxic = dictionaries.compressors()
        self.known: dict[bytes, int] = {}

    def counts(self, text: str | None) -> np.ndarray:
        """Histogram of the text's window differences, cut off at SPAN."""
        out = np.zeros(2 * SPAN + 1)
        if not text:
            return out
        known = self.known
        if len(known) > 200_000:
            known.clear()
        for w in windows(text):
            d = known.get(w)
            if d is None:
                d = len(self.ordinary(w)) - len(self.toxic(w))
                d = known[w] = min(max(d, -SPAN), SPAN) + SPAN
            out[d] += 1
        return out


class Calibration:
    """Window weights from the differences of labelled texts, and a logistic fit on them.
    ``rate`` is the share of toxic rows among all that could be drawn; each class counts by it,
    so that a score does not depend on how many of each class were drawn."""

    def __init__(self, counts: np.ndarray, toxic: np.ndarray, rate: float | None = None):
        rates = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        p = rates[toxic].sum(axis=0) + 0.5 / (2 * SPAN + 1)
        q = rates[~toxic].sum(axis=0) + 0.5 / (2 * SPAN + 1)
        self.weights = np.clip(np.log(p / p.sum()) - np.log(q / q.sum()), -4, 4)
        x, drawn = self.features(counts), toxic.mean()
        rate = drawn if rate is None else rate
        share = np.where(toxic, rate / drawn, (1 - rate) / (1 - drawn))
        self.mean = np.average(x, axis=0, weights=share)
        self.scale = np.sqrt(np.average((x - self.mean) ** 2, axis=0, weights=share)) + 1e-6
        self.fit = self._logistic((x - self.mean) / self.scale, toxic.astype(float), share)

    def features(self, counts: np.ndarray) -> np.ndarray:
        n = np.maximum(counts.sum(axis=1), 1)
        total = counts @ self.weights
        strong = counts[:, SPAN + 2:]
        cols = [total / n, total / np.sqrt(n), np.log1p(n)]
        for k in (0, 2, 4):
            hits = strong[:, k:].sum(axis=1)
            cols += [np.sqrt(hits / n), np.log1p(hits)]
        return np.stack(cols, axis=1)

    @staticmethod
    def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
        x = np.hstack([x, np.ones((len(x), 1))])
        w = np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            step = np.linalg.solve(h, x.T @ (share * (y - p)) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        return w

    def score(self, counts: np.ndarray) -> np.ndarray:
        x = (self.features(counts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(np.hstack([x, np.ones((len(x), 1))]) @ self.fit, -30, 30)))


def _scores(model):
    def run(batches):
        if model.value is None:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([0.0] * b.num_rows), *b.columns[2:]],
                                                 ["doc_id", "score", *b.schema.names[2:]])
            return
        dictionaries, fit = model.value
        differ = Differ(dictionaries)
        for b in batches:
            counts = np.array([differ.counts(t.as_py()) for t in b.column(1)]).reshape(-1, 2 * SPAN + 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fit.score(counts)), *b.columns[2:]],
                                             ["doc_id", "score", *b.schema.names[2:]])

    return run


def _counts(dictionaries):
    def run(batches):
        differ = Differ(dictionaries.value)
        for b in batches:
            counts = [differ.counts(t.as_py()).tolist() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(counts, pa.list_(pa.float64()))], ["toxic", "counts"])

    return run


def _least(rows: DataFrame, limit: int) -> DataFrame:
    """Up to ``limit`` rows of each class, those of least text hash; a task sends on no more than its share."""
    one, other = (least_hashes(rows.filter(F.col("toxic") == k), limit, "h").orderBy("h", "doc_id").limit(limit) for k in (1, 0))
    return one.unionByName(other)


def _texts_of(texts: DataFrame, rows: DataFrame) -> DataFrame:
    return texts.join(F.broadcast(rows), "doc_id").filter(F.xxhash64("text") == F.col("h"))


def trained(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """(Dictionaries, Calibration) from the documents that ``labels`` (doc_id, toxic) mark;
    None unless both classes are there.  Equal texts go to the same side of the division."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
        .filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    known = stored(spark, texts.select("doc_id", F.xxhash64("text").alias("h")).join(marks, "doc_id").distinct(), "toxknown")
    # a few thousand rows of ids at most, whatever the input, so they may be sent to all tasks
    fitting = known.filter("pmod(h, 2) <> 0")
    fit_rows = _least(fitting, FIT_DOCS)
    train_rows = _least(known.filter("pmod(h, 2) = 0"), TRAIN_DOCS)
    rows = _texts_of(texts, train_rows).orderBy("toxic", "h", "doc_id").collect()
    toxic, ordinary = ([r.text for r in rows if r.toxic == k] for k in (1, 0))
    if not toxic or not ordinary:
        return None
    dictionaries = Dictionaries(toxic, ordinary)
    shared = spark.sparkContext.broadcast(dictionaries)
    fit = _texts_of(texts, fit_rows).select("text", "toxic") \
        .mapInArrow(_counts(shared), "toxic int, counts array<double>").collect()
    flags = np.array([r.toxic == 1 for r in fit], bool)
    if not flags.any() or flags.all():
        return None
    rate = fitting.agg(F.avg("toxic")).first()[0]
    return dictionaries, Calibration(np.array([r.counts for r in fit]), flags, rate)


def toxicity_scores(spark: SparkSession, docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text",
                    keep=()) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` by the result of ``trained``, and its columns ``keep``
    (under names other than these two)."""
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep) \
        .mapInArrow(_scores(spark.sparkContext.broadcast(model)), "doc_id long, score double" + kept)
