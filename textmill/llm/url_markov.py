"""URL filter: rules first, then the ratio of two character Markov models.

A url's host and path are looked up among the rules; the longest that fits decides.  The
urls so decided train two variable-order Markov models, one of accepted and one of rejected
urls: every context up to ``ORDER`` characters is counted over all of them, and a longer
context is trusted in proportion to how often and how variously it was followed
(Witten-Bell).  The other urls are scored by the difference of the two log-likelihoods a
character, and blocked above a threshold calibrated on a part of the decided urls that
did not train the models used for it.

Characters are folded to ``SYMBOLS`` symbols, so the models have a fixed size whatever the
corpus.  A null url, or one without ``://``, has empty host and path and fits no rule; the
models judge its characters like any other url.  Without decided urls of both kinds every
other url is allowed.  Repeated rows get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = 3
#: Letters, digits, ``-``, ``.``, ``/``, anything else, and the border.
SYMBOLS = 41
BINS = 4000
SPAN = 4.0
FOLDS = 4

_FOLD = np.full(256, 39, np.int64)
for _i in range(26):
    _FOLD[[65 + _i, 97 + _i]] = _i
for _i in range(10):
    _FOLD[48 + _i] = 26 + _i
_FOLD[45], _FOLD[46], _FOLD[47] = 36, 37, 38
_BORDER = 40

ALLOW, BLOCK = "allow", "block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or lacks ``://``."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*).*\z"
    return tuple(F.coalesce(F.when(url.contains("://"), x), F.lit("")) for x in (
        F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        F.regexp_extract(url, pattern, 2)))


def decide(urls: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """Adds host, path, rule and ruled (the rule's verdict) to ``urls``.  ``rules`` are
    (host and path, verdict); a rule's host covers its subdomains."""
    host, path = host_and_path(F.col(url_col))
    urls = urls.withColumn("host", host).withColumn("path", path)
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, rest = name.partition("/")
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith("/" + rest)
        rule, ruled = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return urls.withColumn("rule", rule).withColumn("ruled", ruled)


def symbols(url: str) -> np.ndarray:
    """Folded characters between ORDER borders in front and one behind."""
    body = _FOLD[np.frombuffer(url.encode(), np.uint8)]
    return np.concatenate([np.full(ORDER, _BORDER), body, [_BORDER]])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code of each character with its context, index of its text) over all texts."""
    seqs = [symbols(t) for t in texts]
    codes, owner = [], []
    for i, s in enumerate(seqs):
        code = np.zeros(len(s) - ORDER, np.int64)
        for k in range(ORDER + 1):
            code = code * SYMBOLS + s[k:len(s) - ORDER + k]
        codes.append(code)
        owner.append(np.full(len(code), i))
    return (np.concatenate(codes), np.concatenate(owner)) if codes else (np.zeros(0, np.int64),) * 2


def _gram_counts(batches):
    """Counts per (verdict, fold, code), summed within the batch."""
    for b in batches:
        verdicts, folds, urls = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_pylist()
        code, owner = grams(urls)
        kind = np.array([v == BLOCK for v in verdicts], np.int64)[owner] * FOLDS + folds[owner]
        key, n = np.unique(kind * SYMBOLS ** (ORDER + 1) + code, return_counts=True)
        kind, code = np.divmod(key, SYMBOLS ** (ORDER + 1))
        yield pa.RecordBatch.from_arrays([pa.array(kind // FOLDS, pa.int32()), pa.array(kind % FOLDS, pa.int32()),
                                          pa.array(code, pa.int64()), pa.array(n, pa.int64())],
                                         ["rejected", "fold", "code", "n"])


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(character | up to ORDER before it) for every code, from counts of the codes."""
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(ORDER + 1):
        n = counts.reshape(-1, SYMBOLS ** order, SYMBOLS).sum(axis=0).astype(float)
        kinds = (n > 0).sum(axis=1, keepdims=True)
        total = n.sum(axis=1, keepdims=True)
        # the shorter context's estimate, for every longer one that ends in it
        short = np.tile(p.reshape(-1, SYMBOLS), (SYMBOLS if order else 1, 1)) if order else p.reshape(1, -1)
        p = np.where(total > 0, (n + kinds * short) / np.maximum(total + kinds, 1), short)
    return np.log(p).reshape(-1)


def _score(model):
    def run(batches):
        ratio = model.value
        for b in batches:
            urls = [u or "" for u in b.column(b.schema.get_field_index("url")).to_pylist()]
            code, owner = grams(urls)
            total = np.bincount(owner, ratio[code], minlength=len(urls)) if len(urls) else np.zeros(0)
            size = np.bincount(owner, minlength=len(urls)) if len(urls) else np.ones(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total / np.maximum(size, 1))], [*b.schema.names, "ratio"])

    return run


def calibrated(accepted: np.ndarray, rejected: np.ndarray) -> float:
    """The ratio above which a url is rejected: the edge with the best mean of the two
    classes' rates, in the middle of equally good ones."""
    keep = np.cumsum(accepted) / accepted.sum()
    catch = 1 - np.cumsum(rejected) / rejected.sum()
    value = keep + catch
    best = np.flatnonzero(value >= value.max() - 1e-12)
    return ((best[0] + best[-1]) / 2 + 1) / BINS * 2 * SPAN - SPAN


def judge(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, ratio) of every row of ``pages``; ratio is the
    log-likelihood difference a character, higher for urls like the rejected ones."""
    urls = decide(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), rules)
    known = urls.filter("ruled is not null and url is not null") \
        .select("ruled", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int").alias("fold"), "url")
    counted = known.mapInArrow(_gram_counts, "rejected int, fold int, code long, n long") \
        .groupBy("rejected", "code").agg(F.sum("n").alias("n"),
                                         F.sum(F.when(F.col("fold") > 0, F.col("n")).otherwise(0)).alias("most"))
    # at most 2 * SYMBOLS ** (ORDER + 1) rows, however many urls there are
    table = counted.toPandas()
    full = np.zeros((2, SYMBOLS ** (ORDER + 1)))
    part = np.zeros_like(full)
    full[table.rejected, table.code], part[table.rejected, table.code] = table.n, table.most
    threshold = None
    ratio = (log_model(full[1]) - log_model(full[0])).astype(np.float32)
    if part.sum(axis=1).all():
        trial = spark.sparkContext.broadcast((log_model(part[1]) - log_model(part[0])).astype(np.float32))
        bins = known.filter("fold = 0").mapInArrow(_score(trial), "ruled string, fold int, url string, ratio double") \
            .groupBy("ruled", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(
                (F.col("ratio") + SPAN) / (2 * SPAN) * BINS))).alias("bin")).count().collect()
        hist = {v: np.zeros(BINS) for v in (ALLOW, BLOCK)}
        for r in bins:
            hist[r.ruled][int(r.bin)] += r["count"]
        if hist[ALLOW].sum() and hist[BLOCK].sum():
            threshold = calibrated(hist[ALLOW], hist[BLOCK])
    model = spark.sparkContext.broadcast(ratio)
    schema = "page_id long, url string, host string, path string, rule string, ruled string, ratio double"
    scored = urls.select(F.col("page_id").cast("long").alias("page_id"), "url", "host", "path", "rule", "ruled") \
        .mapInArrow(_score(model), schema)
    own = F.when(F.col("ratio") > F.lit(threshold), F.lit(BLOCK)).otherwise(F.lit(ALLOW)) if threshold is not None else F.lit(ALLOW)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "ratio")
