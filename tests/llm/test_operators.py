"""Operators on small tables against plain statements of their contracts, and odd inputs."""

import collections
import itertools
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.llm import (
    bpe,
    embed_dedup,
    graph,
    jaccard,
    langid,
    line_dedup,
    packing,
    quality,
    sharding,
    textops,
    toxicity,
    url_markov,
)
from textmill.session import configure

WORD = r"[^\x20\x09-\x0D]+"
ODD = [None, "", " ", "\n\n", "one", "one two", "\x1c a \x85 b", "é 日本 🎉", "a  b\t\tc   d", "x" * 5000, "tail \n", "\nhead",
       "🎉🎉", "🎉 12 🚀", "𐐀𐐁 𐐂"]


@pytest.fixture(scope="module")
def spark(spark):
    return configure(spark)


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def frame(spark, texts, extra=False):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("row", F.lit("clash")).withColumn("n", F.lit(None).cast("int")) if extra else df


def sentences(rng, n, words=60, vocabulary=400):
    return [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words)) for _ in range(n)]


# ---- kernels ---------------------------------------------------------------------------

def test_words_and_shingles_match_plain_splitting():
    texts = [t or "" for t in ODD] + ["a b c a b c", "A b C", "\tx y\x0bz"]
    for limit in (1, 20, 1 << 20):
        seen = {}
        for t in textops.slices(pa.array(texts), limit):
            h, _, before = t.words(lower=True)
            for i in range(t.n):
                words = re.findall(WORD, lowered(texts[t.first + i]))
                got = h[before[i]:before[i + 1]].tolist()
                assert len(got) == len(words)
                for w, x in zip(words, got, strict=True):
                    assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


def test_sorted_runs_across_batches():
    keys = [1, 2, 2, 3, 3, 3, 4, 5, 5]
    for size in (1, 2, 4, 20):
        batches = [pa.RecordBatch.from_pydict({"k": keys[i:i + size]}) for i in range(0, len(keys), size)]
        runs = [t.column("k").to_pylist() for t in textops.sorted_runs(iter(batches), ["k"])]
        assert runs == [[2, 2], [3, 3, 3], [5, 5]]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200)]
    got = dict(graph.components(spark, spark.createDataFrame(links, "a long, b long")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100}
    assert got[300] == got[200] == 200
    assert graph.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_cells_bring_every_pair_together_once(spark):
    df = spark.createDataFrame([("g", i) for i in range(50)] + [("one", 1)], "k string, m long")
    rows = graph.cells(df, ["k"], "m", 8).collect()
    by_cell = collections.defaultdict(list)
    for r in rows:
        by_cell[r.cell].append(r.m)
    met = {frozenset((a, b)) for c in by_cell.values() for a in c for b in c if a != b}
    assert len(met) == 50 * 49 // 2 and all(r.k == "g" for r in rows)
    assert len(rows) <= 50 * 8


# ---- 1 ---------------------------------------------------------------------------------

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def plain_rule(url):
    at = url.find("://") if url else -1
    rest = url[at + 3:] if at >= 0 else ""
    host = lowered(re.split(r"[/?#]", rest)[0])
    path = re.split(r"[?#]", rest[len(host):])[0]
    fit = [(r, v) for r, v in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
           and path.startswith("/" + r.split("/", 1)[1])]
    return (host, path, *max(fit, key=lambda x: len(x[0]), default=(None, None)))


def test_urls(spark):
    urls = [None, "", "nothing", "http://A.Example.NET/en/x?y#z", "http://net/", "http://net", "https://xnet/", "a://b.org/fr/",
            "a://b.org/FR/", "http://x.example.com/de/#q", "http://x.net?/en/", "p://q://r.net/", "http://é.net/\nen/", "://net/en"]
    urls += [f"https://good{i}.org/fr/{i}" for i in range(80)] + [f"https://bad{i}.net/zz/{i}" for i in range(80)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_markov.judge(spark, df, RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert url_markov.judge(spark, df.limit(0), RULES).count() == 0


def test_models_judge_unseen_domains(spark):
    urls = [f"https://good{i}.org/fr/{i}" for i in range(80)] + [f"https://bad{i}.net/zz/{i}" for i in range(80)]
    urls += ["https://good7.info/fr/3", "https://bad3.info/zz/9"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_markov.judge(spark, df, RULES).collect()}
    assert got[160] == "allow" and got[161] == "block"


def test_markov_model_is_a_distribution():
    counts = np.random.default_rng(1).integers(0, 3, url_markov.SYMBOLS ** 4) * (np.arange(url_markov.SYMBOLS ** 4) % 7 == 0)
    p = np.exp(url_markov.log_model(counts)).reshape(-1, url_markov.SYMBOLS)
    assert np.allclose(p.sum(axis=1), 1)


# ---- 2 ---------------------------------------------------------------------------------

def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 32))
    rows = []
    for i in range(300):
        v = base[i % 12] + rng.normal(size=32) * (0.02 if i % 3 else 0.3)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2))
    rows += [(900, [0.0] * 32, 0), (901, None, 0), (902, [float("nan")] * 32, 0), (903, rows[0][1], None),
             (904, rows[0][1], 0), (905, [1e30] * 32, 0), (906, [], 0), (907, [1.0, None] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("row", F.lit(1))
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(spark, df).collect()}
    good = [r for r in rows if r[0] < 900 or r[0] in (904, 905)]
    x = np.array([np.float32(r[1]).astype(float) for r in good])
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    same = np.array([[a[2] == b[2] for b in good] for a in good])
    close = (x @ x.T >= 0.98) & same & ~np.eye(len(good), dtype=bool)
    found = sum(got[r[0]].n_links for r in good)
    assert 0.995 * close.sum() <= found <= close.sum()
    assert close.sum() > 500
    assert [got[i].n_links for i in (900, 901, 902, 903, 906, 907)] == [0] * 6
    assert got[904].component_id == 0 and got[0].kept and not got[904].kept
    assert embed_dedup.near_duplicates(spark, df.limit(0)).count() == 0


# ---- 3, 4, 8 ---------------------------------------------------------------------------

def test_toxicity_finds_marked_documents(spark):
    rng = random.Random(2)
    bad = ["vilename", "foulword", "nastything"]
    rows, labels = [], []
    for i in range(400):
        words = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.choice('aeiou')}" for _ in range(120)]
        toxic = i % 5 == 0
        for k in range(8 if toxic else 0):
            words[rng.randrange(120)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        if i < 300:
            labels.append((i, int(toxic)))
    rows += [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(spark, docs, toxicity.trained(spark, docs, marks)).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in range(300, 400))
    none = toxicity.trained(spark, docs, marks.filter("toxic = 0"))
    assert none is None and toxicity.toxicity_scores(spark, docs, none).agg(F.max("score")).first()[0] == 0
    assert toxicity.trained(spark, docs.limit(0), marks) is None


def syllables(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.choice('aeiou')}" for _ in range(n)]


def test_toxicity_keeps_a_rarer_vocabulary_beside_a_frequent_one():
    rng = random.Random(5)
    texts, kinds = [], []
    for i in range(900):
        words = syllables(rng, 120)
        kind = "frequent" if i % 5 == 0 else "rare" if i % 25 == 1 else ""
        for _ in range(6 if kind else 0):
            # the rare kind is told by a stem with changing ends
            words[rng.randrange(120)] = rng.choice(["vilename", "foulword"]) if kind == "frequent" else "zwertz" + syllables(rng, 1)[0]
        texts.append(" ".join(words))
        kinds.append(kind)
    made = toxicity.Dictionaries([t for t, k in zip(texts[:400], kinds[:400], strict=True) if k],
                                 [t for t, k in zip(texts[:400], kinds[:400], strict=True) if not k])
    differ = toxicity.Differ(made)
    counts = np.array([differ.counts(t) for t in texts[400:]])
    toxic = np.array([bool(k) for k in kinds[400:]])
    score = toxicity.Calibration(counts[:250], toxic[:250]).score(counts[250:])
    for kind, least, most in (("frequent", 0.9, 1), ("rare", 0.8, 1), ("", 0, 0.05)):
        found = [s >= 0.3 for s, k in zip(score, kinds[650:], strict=True) if k == kind]
        assert least <= np.mean(found) <= most, (kind, np.mean(found))


def test_toxicity_scores_do_not_depend_on_the_cap(spark, monkeypatch):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(800):
        words = syllables(rng, 60)
        toxic = i % 10 == 0
        # a mark that only half of the toxic rows hold, so that scores are far from 0 and 1
        if i % 20 == 0 or (not toxic and i % 9 == 0):
            words[rng.randrange(60)] = "vilename"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    mean = []
    for cap in (6000, 35):
        monkeypatch.setattr(toxicity, "FIT_DOCS", cap)
        scores = toxicity.toxicity_scores(spark, docs, toxicity.trained(spark, docs, marks))
        mean.append(scores.agg(F.avg("score")).first()[0])
    assert abs(mean[0] - 0.1) < 0.05 and abs(mean[1] - 0.1) < 0.1, mean


def test_training_rows_are_the_least_of_each_class_by_task(spark):
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    least = toxicity._least(rows, 1500)
    want = {k: sorted((r.h, r.doc_id) for r in rows.collect() if r.toxic == k)[:1500] for k in (0, 1)}
    got = least.collect()
    assert {k: sorted((r.h, r.doc_id) for r in got if r.toxic == k) for k in (0, 1)} == want
    plan = least._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 2 and "Window" not in plan


def test_toxicity_learns_from_the_end_of_long_texts(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(60):
        words = syllables(rng, 1500)
        if i % 3 == 0:
            words[1400:] = [w if k % 5 else "vilename" for k, w in enumerate(words[1400:])]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, _ = toxicity.trained(spark, docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert b" vilename " in made.toxic and b"vilename" not in made.ordinary


def test_toxicity_dictionary_sees_every_window(monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity.Dictionaries, "_train", staticmethod(lambda samples, size: seen.extend(samples) or b"x"))
    text = " ".join(syllables(random.Random(8), 240))
    toxicity.Dictionaries(["vilename"], [text])
    assert seen == toxicity.windows(text)


def plain_counts(t):
    t = t or ""
    w = re.findall(WORD, t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    triples = collections.Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    covered = {k + i for k in range(len(w) - 2) if triples[tuple(w[k:k + 3])] > 1 for i in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_rule_counts_and_forest(spark):
    rng = random.Random(4)
    texts = [*ODD, "a b c a b c", "x\nx\n\n \nx", "#a *b* $%&|<>", "l1\nl1 \nl1"]
    texts += sentences(rng, 300, 80, 5000) + [" ".join(f"$$%w{rng.randrange(5000)}##" for _ in range(80)) for _ in range(60)]
    texts += ["same three words " * 40]
    docs = frame(spark, texts, extra=True)
    first_bad = len(texts) - 61
    labels = spark.createDataFrame([(i, 0 if i >= first_bad else 1) for i in range(len(ODD) + 4, len(texts) - 1, 2)],
                                   "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_verdicts(spark, docs, labels).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(t), t
        n, *_, again = plain_counts(t)
        assert r.base_failed == (n < 50 or 100 * again > 50 * n)
        assert not (r.base_failed and r.kept)
    assert all(got[i].kept for i in range(len(ODD) + 4, first_bad))
    assert not any(got[i].kept for i in range(first_bad, len(texts)))
    no_labels = quality.quality_verdicts(spark, docs, labels.limit(0)).filter("kept = base_failed")
    assert no_labels.count() == 0
    assert quality.quality_verdicts(spark, docs.limit(0), labels).count() == 0


def plain_phrases(text, sample):
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in sample and text[at:at + size] in sample:
            size += 1
        n, at = n + 1, at + size
    return n


def test_suffix_automaton_parses_like_substring_search():
    rng = random.Random(9)
    sample = [rng.randrange(4) for _ in range(200)]
    table = langid.parsing_table(langid.suffix_automaton(sample, 4))
    joined = "".join(map(str, sample))
    for _ in range(30):
        text = [rng.randrange(4) for _ in range(60)]
        state = count = 0
        for s in text:
            v = int(table[state, s])
            count, state = count + (v & 1), v >> 1
        assert count + 1 == plain_phrases("".join(map(str, text)), joined)


def test_language_on_held_out_rows(spark):
    rng = random.Random(8)
    parts = {"aa": ["ka", "ro", "mi", "tu"], "bb": ["sch", "ein", "und", "ter"], "cc": ["ção", "mento", "os", "que"]}
    rows = [(i, " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randint(1, 4))) for _ in range(40)), x)
            for i in range(240) for x in [sorted(parts)[i % 3]]]
    rows += [(1000 + i, t, None) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify_languages(spark, docs, docs.filter("doc_id < 150")).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == rows[i][2] for i in range(150, 240))
    for i, t in enumerate(ODD):
        assert (got[1000 + i].lang_pred == "und") == (not t or not any(c.isalpha() for c in t)), t
    untrained = langid.identify_languages(spark, docs, docs.limit(0))
    assert untrained.filter("lang_pred <> 'und'").count() == 0


# ---- 5, 7 ------------------------------------------------------------------------------

JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))


def odd_strings(n=3000):
    rng = random.Random(3)
    letters = " \n\t'sabtrelmvdT1é日🎉\xa0\x1c!."
    return [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)] + \
        ["".join(chr(rng.randint(0, 0x2FFF)) for _ in range(rng.randint(0, 40))) for _ in range(n // 3)]


def test_transducer_encodes_like_the_library_and_decodes_back(monkeypatch):
    import tiktoken

    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = odd_strings()
    full = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    packed = [full.encode(t) for t in texts]
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [library.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(bpe, "CACHE_STATES", 30)
    monkeypatch.setattr(bpe, "CACHE_STRINGS", 20)
    small = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    assert [small.encode(t) for t in texts] == packed
    for p, t in zip(packed, texts, strict=True):
        for block in (1, 3, 4096):
            parts = list(bpe.decoded_blocks(p, full.fst.merges.tokens, block))
            assert b"".join(parts) == t.encode()
            assert all(x.decode() is not None for x in parts)


def test_encode_decode_frames(spark):
    docs = frame(spark, ODD, extra=True)
    ids = bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN)
    back = dict(bpe.decode_ids(ids, RANKS, public_tokenizers.PATTERN).collect())
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.encode_digests(spark, docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_pieces_hold_added_tokens(spark):
    from tokenizers import Tokenizer

    texts = ["<|endoftext|>", "a<|endoftext|>b " * 700]
    ids = [e.ids + [0] for e in Tokenizer.from_file(JSON).encode_batch(texts, add_special_tokens=False)]
    got = collections.defaultdict(list)
    for r in packing.pack_documents(spark, frame(spark, texts), JSON, public_tokenizers.PATTERN).orderBy("doc_id", "piece").collect():
        want = ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(want)}I", *want))
        got[r.doc_id] += want
    assert [got[0], got[1]] == ids


def test_vocabulary_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    own = packing.VocabularyIds(JSON, public_tokenizers.PATTERN)
    end = "<|endoftext|>"
    texts = odd_strings() + [end, f"a{end}b", f" {end} {end}{end}\n", f"{end[:-1]} {end.upper()}", f"don{end}'t 12{end}34"]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == e.ids, t


def test_plan_uses_every_piece_once_and_fills_well():
    rng = random.Random(6)
    for _ in range(40):
        capacity = rng.choice([10, 64, 200])
        counts = collections.Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 400)))
        used = collections.Counter()
        sequences = 0
        for template, times in packing.plan(dict(counts), capacity):
            assert sum(template) <= capacity and times > 0
            sequences += times
            for x in template:
                used[x] += times
        assert used == counts
        bound = -(-sum(k * n for k, n in counts.items()) // capacity)
        big = sum(n for k, n in counts.items() if 2 * k > capacity)
        assert sequences <= max(bound, big) * 1.15 + 1


def test_packed_documents(spark):
    rng = random.Random(7)
    texts = [*ODD, *sentences(rng, 60, 40), " ".join(f"word{i}" for i in range(4000))]
    docs = frame(spark, texts + texts[:3], extra=True)
    rows = packing.pack_documents(spark, docs, JSON, public_tokenizers.PATTERN, capacity=256).collect()
    library = packing.VocabularyIds(JSON, public_tokenizers.PATTERN)
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(texts + texts[:3]):
        ids = np.frombuffer(library.encode(t or ""), "<u4").tolist() + [0]
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            part = ids[r.start:r.start + r.length]
            assert (r.piece, r.start) == (k, at) and (r.length == 256 or k == 0)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids)
    for members in by_seq.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert packing.pack_documents(spark, docs.limit(0), JSON, public_tokenizers.PATTERN).count() == 0


# ---- 6 ---------------------------------------------------------------------------------

def test_shards_and_versions(spark, tmp_path):
    rng = random.Random(1)
    texts = [*ODD, *["copy " * 30] * 200, *[x[:rng.randint(5, 400)] for x in sentences(rng, 800)]]
    docs = frame(spark, texts, extra=True)
    path = str(tmp_path / "map")
    rows = sharding.shard_by_bytes(spark, docs, 8, path, slots=512).collect()
    size = collections.Counter()
    places = collections.defaultdict(list)
    for r in rows:
        t = texts[r.doc_id]
        assert r.size == len((t or "").encode()) + 16 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        size[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(size.values()) < 1.05 * min(size.values())
    before = {r.doc_id: r.shard for r in rows}
    grown = {r.doc_id: r.shard for r in sharding.shard_by_bytes(spark, docs, 9, path, slots=512).collect()}
    moved = [i for i, s in before.items() if grown[i] != s]
    assert 8 in grown.values() and len(moved) < len(before) / 3
    assert {r.version for r in spark.read.parquet(path).select("version").distinct().collect()} == {1, 2}
    first = {r.virtual_slot: r.shard for r in sharding.read_map(spark, path, 1).collect()}
    assert len(first) == 512
    assert sharding.shard_by_bytes(spark, docs.limit(0), 4, str(tmp_path / "empty"), slots=64).count() == 0


def test_rebalance_moves_little_and_serves_fewer_shards():
    rng = random.Random(2)
    loads = {s: rng.randint(1, 1000) for s in range(400)}
    placed = sharding.first_map(loads, 10, 400)
    fewer = sharding.rebalanced(placed, loads, 9)
    assert set(fewer.values()) == set(range(9))
    assert sum(placed[s] != fewer[s] for s in placed) < 80
    assert sharding.rebalanced(placed, loads, 10) == placed or max(
        collections.Counter(sharding.rebalanced(placed, loads, 10).values()).values()) < 60


# ---- 9 ---------------------------------------------------------------------------------

def plain_groups(texts, width, percent):
    sets = []
    for t in texts:
        w = re.findall(WORD, lowered(t or ""))
        sets.append({tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def variants(rng, n):
    texts = list(ODD) + ["short one", "Short ONE", "a b", "b a"]
    for base in sentences(rng, 6, 80, 3000):
        for _ in range(n):
            w = base.split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(50)}"
            texts.append(" ".join(w))
    shared = " ".join(f"p{i}" for i in range(30))
    texts += [f"{x} {shared}" for x in sentences(rng, 40, 50, 3000)]
    return texts + texts[:5]


@pytest.mark.parametrize(("width", "percent", "short", "block"), [(3, 90, 32, 256), (5, 80, 4, 8)])
def test_jaccard_groups_equal_all_pairs(spark, monkeypatch, width, percent, short, block):
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = variants(random.Random(11), 25)
    rows = jaccard.jaccard_groups(spark, frame(spark, texts, extra=True), width=width, percent=percent).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert [got[i] for i in range(len(texts))] == plain_groups(texts, width, percent)


def test_jaccard_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (1, "x y z")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_groups(spark, docs, width=3).collect()), key=str)
    assert got == sorted([(None, None), (3, 3), (3, 3), (1, 1)], key=str)
    assert jaccard.jaccard_groups(spark, docs.limit(0)).count() == 0


def test_parities_never_part_sets_that_link():
    rng = np.random.default_rng(5)
    parted = 0
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 700)), dtype=np.uint64))
        keep = x[rng.random(len(x)) < rng.choice([0.3, 0.9, 0.99])]
        y = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 60)), dtype=np.uint64)]))
        if not len(y):
            continue
        both = len(np.intersect1d(x, y))
        may = jaccard.may_link(80, len(x), jaccard.parities(x), len(y), jaccard.parities(y))
        assert may or 100 * both < 80 * (len(x) + len(y) - both)
        parted += not may
    assert parted


def test_divide_skip_finds_every_frequent_member():
    rng = random.Random(12)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 25))) for _ in range(rng.randint(1, 12))]
        least = rng.randint(1, 12)
        count = collections.Counter(x for v in lists for x in v)
        want = sorted((x, n) for x, n in count.items() if n >= least)
        assert sorted(jaccard.divide_skip(lists, least, rng.choice([0.01, 0.3, 5]))) == want


def test_jaccard_candidates_do_not_depend_on_batches():
    rows = [(1, 5, 10), (2, 5, 20), (2, 5, 21), (3, 5, 30), (3, 5, 31)]

    def found(sizes):
        batches, at = [], 0
        for n in sizes:
            cols = zip(*rows[at:at + n], strict=True) if n else [[], [], []]
            batches.append(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["mark", "n", "class"]))
            at += n
        return sorted((r["a"], r["b"]) for b in jaccard._candidates(80)(iter(batches)) for r in b.to_pylist())

    for sizes in ([5], [4, 1], [2, 1, 2], [1] * 5, [0, 2, 0, 3]):
        assert found(sizes) == [(20, 21), (30, 31)], sizes


def test_jaccard_near_pairs_are_all_that_may_link():
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(8):
        base = rng.integers(0, 2**63, int(rng.integers(200, 1200)), dtype=np.uint64)
        for _ in range(12):
            kept = base[rng.random(len(base)) < rng.choice([0.85, 0.95, 0.99])]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**63, int(rng.integers(1, 40)), dtype=np.uint64)])))
    rows = sorted(((len(x), i, int(rng.integers(0, 40)), int(rng.integers(0, 2)), jaccard.parities(x)) for i, x in enumerate(sets)))
    lists = [sorted(rng.choice(50, jaccard.FIRST, replace=False).tolist()) for _ in rows]
    n, ids, roots, homes, bits = zip(*rows, strict=True)
    batch = pa.RecordBatch.from_pydict(
        {"mark": [25] * len(rows), "cell": [1] * len(rows), "n": [99] * len(rows), "class": ids, "root": roots,
         "home": pa.array(homes, pa.int32()), **{f"first_{k}": [x[k] for x in lists] for k in range(jaccard.FIRST)},
         "n_shingles": n, "bits": pa.array(bits, pa.binary())})
    got = [(r["a"], r["b"], r["mark"], r["n"]) for b in jaccard._near(80)(iter([batch[:50], batch[50:]])) for r in b.to_pylist()]
    want = [(ids[i], ids[j], 25, 99) for i in range(len(rows)) for j in range(i + 1, len(rows))
            if 100 * n[i] >= 80 * n[j] and roots[i] != roots[j] and homes[i] != homes[j]
            and not any(x < 25 for x in set(lists[i]) & set(lists[j])) and jaccard.may_link(80, n[i], bits[i], n[j], bits[j])]
    assert len(want) > 20
    assert sorted(got) == sorted(want)
    assert len({len(x) for x in bits}) > 2


def test_jaccard_lists_in_several_blocks(spark, monkeypatch):
    for name, value in (("SHORT", 3), ("BLOCK", 4), ("WIDE", 2)):
        monkeypatch.setattr(jaccard, name, value)
    texts = variants(random.Random(14), 25)
    rows = jaccard.jaccard_groups(spark, frame(spark, texts, extra=True), width=3, percent=80).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert [got[i] for i in range(len(texts))] == plain_groups(texts, 3, 80)


def test_jaccard_long_lists_of_unlike_texts_bring_no_sets(spark, monkeypatch):
    # passages that twenty texts share chain all texts together, and no two of them are alike
    rng, written = random.Random(15), collections.defaultdict(list)
    monkeypatch.setattr(jaccard, "stored", lambda s, df, name, f=jaccard.stored: written[name].append(f(s, df, name)) or written[name][-1])
    passages = sentences(rng, 24, 30, 10**6)
    texts = [" ".join(passages[k] for k in x) for x in rng.sample(list(itertools.combinations(range(24), 4)), 120)]
    rows = jaccard.jaccard_groups(spark, frame(spark, texts), width=3, percent=80).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(i, i) for i in range(len(texts))]
    assert sum(x.count() for x in written["openlists"]) >= len(texts)
    assert sum(x.count() for x in written["sets"]) == 0


# ---- 10 --------------------------------------------------------------------------------

def plain_similar(a, b, percent):
    """Edit similarity of two lists of words by the whole table."""
    longer = max(len(a), len(b))
    if 100 * abs(len(a) - len(b)) > (100 - percent) * longer:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next_row(row, i, x, b)
    return 100 * row[-1] <= (100 - percent) * longer


def plain_lines(texts, percent=95):
    """The texts without later lines of each group that edit similarity links, by comparing all pairs."""
    occ = []
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            w = re.findall(WORD, lowered(line))
            if w:
                occ.append((i, k, " ".join(w)))
    bodies = sorted({o[2] for o in occ})
    up = {b: b for b in bodies}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    words = {b: b.split() for b in bodies}
    for i, a in enumerate(bodies):
        for b in bodies[:i]:
            if len(set(words[a]) & set(words[b])) * 2 >= len(set(words[a])) and plain_similar(words[a], words[b], percent):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    stays = {}
    for i, k, b in occ:
        stays[root(b)] = min(stays.get(root(b), (1 << 60, 0)), (i, k))
    gone = {(i, k) for i, k, b in occ if (i, k) != stays[root(b)]}
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in enumerate(texts)]


def edited(rng, words, n):
    """``n`` word edits, each a replacement, an insertion or a deletion."""
    out = list(words)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.choice("rid")
        out[at:at + (kind != "i")] = [] if kind == "d" else [f"new{rng.randrange(10**6)}"]
    return out


@pytest.mark.parametrize("n", [19, 20, 21, 38, 39, 40, 60, 79, 100, 199, 400, 1000])
def test_lines_at_the_threshold_share_a_block(n):
    """Of lines that are 0.95 similar by edit distance alone, those that meet."""
    rng = random.Random(n)
    met = total = 0
    for _ in range(60 if n > 300 else 200):
        a = [f"w{rng.randrange(5000)}" for _ in range(n)]
        b = edited(rng, a, max(1, rng.choice([n // 20, (n * 100 // 95) // 20])))
        if a == b or not plain_similar(a, b, 95):
            continue
        lines = [line_dedup.Lines(t) for x in (a, b) for t in textops.slices(pa.array([" ".join(x)]))]
        keys = [set(x.blocks(95)[0].tolist()) for x in lines]
        near = int(np.bitwise_count(lines[0].sim[0] ^ lines[1].sim[0])) <= line_dedup.RADIUS
        met += bool(keys[0] & keys[1]) and near
        total += 1
    assert total >= 15 and met >= 0.99 * total


@pytest.mark.parametrize(("short", "block"), [(32, 512), (3, 6)])
def test_lines_against_all_pairs(spark, monkeypatch, short, block):
    monkeypatch.setattr(line_dedup, "SHORT", short)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(13)
    base = sentences(rng, 12, 40, 3000)
    texts = list(ODD)
    for _ in range(60):
        lines = []
        for _ in range(4):
            w = edited(rng, rng.choice(base).split(), rng.randint(0, 2))
            lines.append((" ".join(w)).upper() if rng.random() < 0.2 else "  ".join(w))
        texts.append("\n".join([*lines, "", "tiny line"]))
    docs = frame(spark, texts, extra=True)
    got = {r.doc_id: r for r in line_dedup.without_duplicate_lines(spark, docs).collect()}
    want = plain_lines(texts)
    assert [got[i].text for i in range(len(texts))] == want
    assert sum(got[i].n_removed for i in got) > 100
    assert set(docs.columns) <= set(got[0].asDict())
    assert line_dedup.without_duplicate_lines(spark, docs.limit(0)).count() == 0


def test_only_texts_with_wanted_lines_are_shuffled(spark, monkeypatch):
    """Of texts none of whose lines is like another's, next to none meet the joins."""
    rng = random.Random(16)
    texts = [" ".join(f"u{i}x{j}" for j in range(25)) for i in range(1500)]
    for i in (3, 700):
        texts[i + 1] = f"own {i}\n" + " ".join(edited(rng, texts[i].split(), 1)) + f"\nrest {i}"
    marks = []

    def seen(rows, keys, key, mark):
        marks.append((graph.marked(rows, keys, key, mark), keys, key, mark))
        return marks[-1][0]

    monkeypatch.setattr(line_dedup, "marked", seen)
    out = line_dedup.without_duplicate_lines(spark, frame(spark, texts)).select("doc_id", "text").collect()
    assert [r.text for r in sorted(out)] == [f"own {i - 1}\nrest {i - 1}" if i in (4, 701) else t for i, t in enumerate(texts)]
    texts_marked = [m for m in marks if m[2] == "row"]
    assert len(texts_marked) == 2
    for rows, keys, key, mark in texts_marked:
        assert keys.count() <= rows.filter(mark).count() <= 20
        assert rows.filter(f"not {mark}").join(keys, key, "left_semi").count() == 0


def test_marks_lose_no_key(spark, monkeypatch):
    rows = spark.range(3000).select(F.xxhash64("id").alias("h"), "id")
    for keys, most in ((rows.filter("id % 7 = 0"), 700), (rows.limit(0), 0)):
        got = {r.id: r.m for r in graph.marked(rows, keys.select("h"), "h", "m").collect()}
        assert len(got) == 3000 and all(got[r.id] for r in keys.collect()) and sum(got.values()) <= most
    # bitmaps that are too small make more marks, and lose none
    monkeypatch.setattr(graph, "MOST_BITS", 1 << 11)
    got = {r.id: r.m for r in graph.marked(rows, rows.filter("id % 2 = 0").select("h"), "h", "m").collect()}
    assert all(got[i] for i in range(0, 3000, 2)) and len(got) == 3000


def test_short_lines_go_too(spark):
    rng = random.Random(15)
    # exact repeats of lines of one to four words, by plain splitting
    pool = [" ".join(f"s{rng.randrange(40)}" for _ in range(k)) for k in (1, 2, 3, 4) for _ in range(20)]
    texts = ["\n".join([*(rng.choice(pool) for _ in range(6)), "", " "]) for _ in range(40)]
    seen, want = set(), []
    for t in texts:
        kept = []
        for line in t.split("\n"):
            if not line.split() or line not in seen:
                kept.append(line)
            seen.add(line)
        want.append("\n".join(kept))
    # of 5 to 7 words, one edit apart: the same words, one of them twice
    fuzzy = [w + "\n" + w + " " + w.split()[-1] for w in (" ".join(f"f{k}x{i}" for i in range(k)) for k in (5, 6))]
    got = {r.doc_id: r.text for r in line_dedup.without_duplicate_lines(spark, frame(spark, texts + fuzzy), 80).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert [got[len(texts) + i] for i in range(2)] == [t.split("\n")[0] for t in fuzzy]


def test_edit_distance_is_the_plain_one():
    rng = random.Random(14)
    for _ in range(400):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 9))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next_row(row, i, x, b)
        for most in (0, 2, 20):
            got = line_dedup.edit_distance(a, b, most)
            assert got == row[-1] if row[-1] <= most else got > most


def _next_row(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
    return new
