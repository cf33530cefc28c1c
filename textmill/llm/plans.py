"""The registered queries of the training-data operators, one per operator, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.bpe import encode_digests
from textmill.llm.collocations import collocations
from textmill.llm.embed_dedup import near_duplicates
from textmill.llm.importance import importance_sample
from textmill.llm.jaccard import jaccard_groups
from textmill.llm.langid import identify_languages
from textmill.llm.line_dedup import without_duplicate_lines
from textmill.llm.packing import pack_documents
from textmill.llm.quality import quality_verdicts
from textmill.llm.sharding import shard_by_bytes
from textmill.llm.toxicity import toxicity_scores, trained
from textmill.llm.url_markov import judge
from textmill.llm.warc import archived
from textmill.session import read_table, scratch_path


#: Host and path, verdict.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's labels are kept from learning."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, or else by the two Markov models."""
    return judge(spark, read_table(spark, sf_dir, "pages"), URL_RULES)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label linked at a cosine of 0.98."""
    return near_duplicates(spark, read_table(spark, sf_dir, "embeddings"))


def op3_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labels that are not held out."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = trained(spark, docs, labels.filter(~held_out()))
    return toxicity_scores(spark, docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and the isolation forest's verdict of every document."""
    return quality_verdicts(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")) \
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                "anomaly")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in token sequences of at most 2048 ids."""
    return pack_documents(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                          public_tokenizers.PATTERN)


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards of nearly equal bytes through a stored map of virtual slots."""
    out = shard_by_bytes(spark, read_table(spark, sf_dir, "documents"), 40, scratch_path(spark, "slotmap"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op7_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of the text decoded from them."""
    return encode_digests(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)


def op8_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    out = identify_languages(spark, docs, docs.filter(~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at a Jaccard similarity of 0.9 over 3-word shingles."""
    return jaccard_groups(spark, read_table(spark, sf_dir, "documents"), width=3, percent=90) \
        .select("doc_id", "n_shingles", "component_id")


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the lines that repeat an earlier one, exactly or nearly."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_duplicate_lines(spark, docs, percent=95)


def op11_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives it was written to."""
    out = archived(spark, read_table(spark, sf_dir, "pages"), min_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = r"""
WITH held AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM held
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the words of the benchmark texts."""
    out = importance_sample(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"),
                            lo=1, hi=1, percent=10)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two to four words of each language."""
    return collocations(spark, read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH piece AS (
  SELECT lang, row_number() OVER () AS pid, words FROM (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words FROM documents)
  WHERE len(words) > 0
), begun AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM piece),
f AS (
  SELECT lang, n AS words, array_to_string(words[i:i + n - 1], ' ') AS phrase, count(*) AS f
  FROM begun, range(1, 5) r(n) WHERE i + n - 1 <= len(words) GROUP BY ALL
), totals AS (SELECT lang, sum(len(words)) AS n FROM piece GROUP BY 1),
cand AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 30),
around AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM cand, range(2, 4) s(n), range(1, 4) t(i) WHERE n < words AND i + n - 1 <= words)
  GROUP BY 1, 2
), kept AS (
  SELECT c.* FROM cand c LEFT JOIN around USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
  FROM kept, range(1, 4) r(k) WHERE k < words
), scored AS (
  SELECT c.lang, c.phrase, a, k, h.f AS l, t.f AS r, (2000000::HUGEINT * a) // (h.f + t.f) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = head JOIN f t ON t.lang = c.lang AND t.phrase = rest
), least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least
)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM placed JOIN totals USING (lang) WHERE rank <= 2000
"""


#: Unsigned crc32 of a blob in SQL: the register folded over the bytes by a table made from its rule.
CRC32_MACROS = r"""
WITH RECURSIVE crc_bits AS (
  SELECT i::BIGINT AS i, 0 AS k, i::BIGINT AS r FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END FROM crc_bits WHERE k < 8
), crc_table AS (SELECT list(r ORDER BY i) AS t FROM crc_bits WHERE k = 8),
"""

OP12_SQL = CRC32_MACROS + r"""
doc AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), occ AS (SELECT rid, unnest(words) AS w FROM doc),
goal AS (
  SELECT unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM occ UNION SELECT w FROM goal)),
hashed AS (
  SELECT w, xor(list_reduce(
           list_prepend(4294967295::BIGINT,
                        list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
           lambda reg, b: xor(reg >> 8, t[(xor(reg, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM vocabulary, crc_table
), s AS (SELECT bucket, count(*) AS s FROM occ JOIN hashed USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM goal JOIN hashed USING (w) GROUP BY 1),
totals AS (SELECT (SELECT count(*) FROM occ) AS s_all, (SELECT count(*) FROM goal) AS t_all),
gains AS (
  SELECT b AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)
                                      / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
  FROM range(10000) r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b, totals
), weights AS (SELECT rid, sum(gain)::BIGINT AS weight FROM occ JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY 1),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                    / 4294967296)))::BIGINT AS score
  FROM doc LEFT JOIN weights USING (rid)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY n_features >= 20) AS able FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank
FROM placed
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_url_markov, op2_embedding_dedup, op3_compression_toxicity, op4_quality_forest,
        op5_best_fit_packing, op6_virtual_slots, op7_bpe_transducer, op8_cross_parsing,
        op9_ngram_jaccard, op10_fuzzy_lines, op11_dictionary_warc, op12_importance_resampling,
        op13_phrase_collocations,
    )}


def oracles() -> dict[str, str]:
    return {"op11_dictionary_warc": OP11_SQL, "op12_importance_resampling": OP12_SQL,
            "op13_phrase_collocations": OP13_SQL}
