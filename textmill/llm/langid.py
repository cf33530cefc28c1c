"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text is built, so the longest match of any
position in that text is one walk from the start.  A text is parsed greedily into such
longest matches; a language whose text needs few phrases explains it well.  The phrases are
normalised by the letters read and by what an automaton of that size matches by chance,
and the language with fewest wins.  Whole texts are parsed, in segments of equal width that
one vectorised step reads side by side; a phrase ends with its segment.

A null text, or one without a letter, is ``und`` with score 0.  Training text is a bounded
sample (``SAMPLE_CHARS`` characters a language, documents of least id hash first); rows
without label or id do not train.  With no training text every document is ``und``.  Ties go
to the language that sorts first; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmill.llm import textops

#: Characters of training text a language, and of one document in it, at most.
SAMPLE_CHARS = 32_000
DOC_CHARS = 600
#: Letters told apart, at most; rarer ones read as one.
LETTERS = 80
SEGMENT = 512
SLICE_CHARS = 1 << 20
UND = "und"


def is_letter_table() -> np.ndarray:
    """Per code point of the basic plane, whether it is a letter."""
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x10000)])


def _lower_table() -> np.ndarray:
    table = np.arange(0x10000)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000:
            low = chr(c).lower()
            if len(low) == 1 and ord(low) < 0x10000:
                table[c] = ord(low)
    return table


_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        _TABLES.extend([is_letter_table(), _lower_table()])
    return _TABLES


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points with every run of other characters as one 0."""
    letter, lower = _tables()
    c = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    flat = np.minimum(c, 0xFFFF)
    ok = letter[flat]
    if (c > 0xFFFF).any():
        wide, where = np.unique(c[c > 0xFFFF], return_inverse=True)
        ok[c > 0xFFFF] = np.array([chr(x).isalpha() for x in wide])[where]
    out = np.where(ok, np.where(c > 0xFFFF, 0xFFFF, lower[flat]), 0)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


class Alphabet:
    """Symbols: 0 is any run of non-letters, 1 a rare letter, from 2 on the known letters."""

    def __init__(self, samples: list[np.ndarray], most: int = LETTERS):
        found, n = np.unique(np.concatenate(samples), return_counts=True)
        order = np.lexsort((found, -n))
        letters = [x for x in found[order].tolist() if x][:most]
        self.table = np.ones(0x10000, np.uint8)
        self.table[0] = 0
        for i, x in enumerate(letters):
            self.table[x] = i + 2
        self.size = len(letters) + 2

    def symbols(self, points: np.ndarray) -> np.ndarray:
        return self.table[points]


def suffix_automaton(symbols: list[int], size: int) -> np.ndarray:
    """Dense transitions (states x symbols) of the smallest automaton that accepts every
    substring of ``symbols``; -1 where no substring goes on.  State 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for s in symbols:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in go[p]:
            go[p][s] = new
            p = link[p]
        if p >= 0:
            q = go[p][s]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(s) == q:
                    go[p][s] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.full((len(go), size), -1, np.int32)
    for i, arcs in enumerate(go):
        for s, t in arcs.items():
            table[i, s] = t
    return table


def parsing_table(automaton: np.ndarray) -> np.ndarray:
    """The automaton closed for greedy parsing: where a match cannot go on, a phrase ends
    and the symbol begins the next one.  Entries are 2 * state + (a phrase ended)."""
    restart = np.maximum(automaton[0], 0)
    return np.where(automaton >= 0, 2 * automaton, 2 * restart + 1).astype(np.int32)


class CrossParser:
    """Parses texts against every language at once."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        if not self.langs:
            return
        points = {x: np.concatenate([code_points(" " + t + " ") for t in samples[x]])[:SAMPLE_CHARS] for x in self.langs}
        self.alphabet = Alphabet(list(points.values()))
        self.tables, self.scale = [], []
        for x in self.langs:
            table = suffix_automaton(self.alphabet.symbols(points[x]).tolist(), self.alphabet.size)
            self.tables.append(parsing_table(table).reshape(-1))
            # phrases grow about one symbol longer per doubling of the text they are found in
            self.scale.append(np.log2(len(points[x]) + 2))
        self.scale = np.array(self.scale) / max(self.scale) if self.langs else np.zeros(0)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Normalised phrases (text x language) of symbol arrays."""
        lens = np.array([len(t) for t in texts])
        n_seg = np.maximum(-(-lens // SEGMENT), 1)
        owner = np.repeat(np.arange(len(texts)), n_seg)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
        width = np.minimum(SEGMENT, lens[owner] - part * SEGMENT)
        order = np.argsort(-width, kind="stable")
        flat = np.concatenate(texts) if len(texts) else np.zeros(0, np.uint8)
        begin = (np.cumsum(lens) - lens)[owner[order]] + part[order] * SEGMENT
        width = width[order]
        count = np.zeros((len(self.langs), len(order)), np.int32)
        state = np.zeros((len(self.langs), len(order)), np.int32)
        size = self.alphabet.size
        live = np.searchsorted(-width, -np.arange(1, int(width.max(initial=0)) + 1), "right")
        for step, m in enumerate(live.tolist()):
            sym = flat[begin[:m] + step]
            for k, table in enumerate(self.tables):
                v = table[state[k, :m] * size + sym]
                count[k, :m] += v & 1
                state[k, :m] = v >> 1
        total = np.zeros((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            total[:, k] = np.bincount(owner[order], count[k] + (width > 0), minlength=len(texts))
        return total * self.scale / np.maximum(lens, 1)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        points = [code_points(" " + t + " ") if t else np.zeros(0, np.int64) for t in texts]
        lettered = [bool((p != 0).any()) for p in points]
        names, scores = [UND] * len(texts), [0.0] * len(texts)
        if not self.langs or not any(lettered):
            return names, scores
        at = [i for i, x in enumerate(lettered) if x]
        cost = self.phrases([self.alphabet.symbols(points[i]) for i in at])
        best = np.argmin(cost, axis=1)
        share = np.exp(-4 * (cost / np.maximum(cost.min(axis=1, keepdims=True), 1e-12) - 1))
        share = share[np.arange(len(at)), best] / share.sum(axis=1)
        for i, b, s in zip(at, best.tolist(), share.tolist(), strict=True):
            names[i], scores[i] = self.langs[b], s
        return names, scores


def _predict(parser):
    def run(batches):
        p = parser.value
        for b in batches:
            texts = b.column(1)
            names: list[str] = []
            scores: list[float] = []
            for t in textops.slices(texts, SLICE_CHARS):
                part = texts.slice(t.first, t.n).to_pylist()
                n, s = p.predict(part)
                names += n
                scores += s
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    return run


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """Per language up to SAMPLE_CHARS characters, from the middle of documents of least id
    hash, DOC_CHARS of each at most; short texts do not leave a language out."""
    take = SAMPLE_CHARS // DOC_CHARS * 4
    middle = F.greatest(F.lit(1), F.floor((F.length(text_col) - DOC_CHARS) / 2).cast("int"))
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()) \
        .select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), F.col(id_col).alias("id"),
                F.col(text_col).substr(middle, F.lit(DOC_CHARS)).alias("t"))
    # the rank limit is applied in every task before the shuffle
    best = rows.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "id"))).filter(F.col("r") <= take)
    out: dict[str, list[str]] = {}
    for r in best.select("lang", "h", "t").orderBy("lang", "h").collect():
        out.setdefault(r.lang, []).append(r.t)
    return {k: v for k, v in out.items() if any(c.isalpha() for t in v for c in t)}


def identify_languages(spark: SparkSession, docs: DataFrame, train: DataFrame, id_col: str = "doc_id",
                       text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``, learnt from the rows of ``train``."""
    parser = spark.sparkContext.broadcast(CrossParser(training_sample(train, id_col, text_col, lang_col)))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(_predict(parser), "doc_id long, lang_pred string, score double")
