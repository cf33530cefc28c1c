"""Fuzzy line dedup: SimHash, pigeonhole blocks, edit verification, one line per group.

Lines are normalised (A-Z lower-cased, runs of white space one space).  Equal normalised
lines are one line from the start.  A line's wide SimHash is made of blocks: its distinct words are dealt
into blocks by their hashes, and each block is the 64-bit SimHash of its words.  Replacing
a word changes the block it leaves and the one it enters, so lines that are ``e`` word edits apart
agree on at least one of ``2 e + 1`` blocks, and lines meet under every block.  How many edits count
follows from the length: an edit similarity of ``percent`` / 100, 1 - distance / longer length in words; a
line whose longer partners allow more edits has blocks of both numbers.  Lines that share a block but
whose SimHashes as a whole differ in more than ``RADIUS`` bits are left.  A short bucket gives
its pairs; a long one gives links to pivots first and, where these leave several groups, all
pairs of blocks of its members.  A link needs the edit similarity itself.

In every connected group the occurrence of least (doc_id, line number) stays and all others
go; repeated rows (equal id and text) are one document and stay alike.  Blank lines stay; lines
so short that one edit is too much (fewer than 19 words at 95 percent) go as equal
lines only.  A null text stays null and
an empty one empty; a row without id keeps its text and takes no part; extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import textops
from textmill.llm.graph import cells, components, marked, stored

#: Bits of 64 in which similar lines may differ; those of 0.95 similarity differ in 6.5 on average,
#: with a deviation of 2.4.
RADIUS = 20
#: Every line with a word takes part.
MIN_WORDS = 1
SHORT = 32
BLOCK = 512
CHUNK = 512


def _ladder() -> np.ndarray:
    """Numbers of edits that blocks are made for: each to 8, then a quarter more each time."""
    out = list(range(1, 9))
    while out[-1] < 1 << 40:
        out.append(-(-out[-1] * 5 // 4))
    return np.array(out)


_LADDER = _ladder()


def steps(words: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last step of the ladder that a line of so many words needs: for as many
    edits as it may be from one no longer, and from the longest it can match; 0 is none."""
    longest = words * 100 // percent
    own, other = (n * (100 - percent) // 100 for n in (words, longest))
    return tuple(np.where(e > 0, np.searchsorted(_LADDER, e) + 1, 0) for e in (own, other))


def _bit_counts() -> np.ndarray:
    """For each byte, eight one-byte counters in one 64-bit word: its bits."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return bits.astype(np.uint8).view(np.uint64).reshape(-1)


_SPREAD = _bit_counts()


def simhash(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SimHash of each non-empty run of word hashes; bit i is set if most words set it."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = np.diff(starts, append=len(hashes))
    # one-byte counters hold 255 words, so long runs are summed in parts
    n_parts = -(-sizes // 255)
    first = np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
    part = np.repeat(starts, n_parts) + 255 * (np.arange(n_parts.sum()) - first)
    owner = np.cumsum(n_parts) - n_parts
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    out = np.zeros((len(starts), 8), np.uint8)
    short = len(part) == len(starts)
    half = (sizes >> 1)[:, None].astype(np.uint8 if short else np.int64)
    for k in range(8):
        packed = np.add.reduceat(_SPREAD[octets[:, k]], part)
        if short:
            out[:, k] = np.packbits(packed.view(np.uint8).reshape(-1, 8) > half, axis=1, bitorder="little")[:, 0]
            continue
        ones = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), owner, axis=0)
        out[:, k] = np.packbits(ones > half, axis=1, bitorder="little")[:, 0]
    return out.view(np.uint64).reshape(-1)


class Lines:
    """Lines with a word of a slice of texts: text index, place among the text's ``\\n``
    splits, number of words, hash of the normalised line and its SimHash."""

    def __init__(self, t: textops.Texts):
        hashes, starts, _ = t.words(lower=True)
        breaks = np.flatnonzero(t.buf == 10)
        edges = np.union1d(breaks, t.offs[:-1])
        seg = np.searchsorted(edges, starts, "right")
        head = np.flatnonzero(np.diff(seg, prepend=-1))
        self.words = np.diff(head, append=len(hashes))
        self.text = np.searchsorted(t.offs, starts[head], "right") - 1
        earlier = np.searchsorted(breaks, t.offs[:-1])
        self.place = np.searchsorted(breaks, starts[head]) - earlier[self.text]
        at = np.arange(len(hashes)) - np.repeat(head, self.words)
        powers = textops._powers(int(self.words.max(initial=1)))
        self.hash = textops.mix(np.add.reduceat(hashes * powers[at], head) + self.words.astype(np.uint64)) \
            if len(head) else np.zeros(0, np.uint64)
        # each word of a line counts once, or a mark between all words would be the whole hash
        lane = np.repeat(np.arange(len(head), dtype=np.uint64), self.words) << np.uint64(40)
        kinds = np.sort(lane | (hashes >> np.uint64(24)))
        kinds = kinds[np.diff(kinds, prepend=np.uint64(2**64 - 1)) != 0]
        self.kinds = textops.mix(kinds & np.uint64(2**40 - 1))
        self.line = (kinds >> np.uint64(40)).astype(np.int64)
        self.sim = simhash(self.kinds, np.searchsorted(self.line, np.arange(len(head))))

    def blocks(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, line) of every block of every line that allows an edit."""
        own, other = steps(self.words, percent)
        keys, lines = [], []
        first_step = np.maximum(own, 1)
        for more in range(int((other - first_step).max(initial=-1)) + 1):
            step = np.where(first_step + more <= other, first_step + more, 0)
            level = np.where(step > 0, _LADDER[step - 1], 0)
            use = level[self.line] > 0
            line, kind = self.line[use], self.kinds[use]
            if not len(line):
                continue
            n = 2 * level + 1
            block = (np.cumsum(n) - n)[line] + (kind >> np.uint64(20)).astype(np.int64) % n[line]
            # a block's hash does not depend on the order of its words
            order = np.argsort(block)
            starts = np.flatnonzero(np.diff(block[order], prepend=-1))
            first = order[starts]
            place = (block[first] - (np.cumsum(n) - n)[line[first]]).astype(np.uint64)
            tag = textops.mix(place * textops._MULT[3] + level[line[first]].astype(np.uint64))
            keys.append(textops.mix(simhash(kind[order], starts) + tag))
            lines.append(line[first])
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(keys) == 1:
            return keys[0], lines[0]
        keys, lines = np.concatenate(keys), np.concatenate(lines)
        order = np.argsort(lines, kind="stable")
        return keys[order], lines[order]


def _line_rows(percent: int):
    def run(batches):
        for b in batches:
            ids, rows = b.column(0), b.column(2).to_numpy()
            valid = np.array(ids.is_valid())
            numbers = ids.fill_null(0).to_numpy()
            for t in textops.slices(b.column(1)):
                x = Lines(t)
                at = x.text + t.first
                ok = valid[at] & (x.words >= MIN_WORDS)
                at = at[ok]
                keys, line = x.blocks(percent)
                held = ok[line]
                sizes = np.bincount(line[held], minlength=len(ok))[ok]
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(textops.as_long(x.hash[ok])), pa.array(textops.as_long(x.sim[ok])),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(textops.as_long(keys[held]))),
                     pa.array(numbers[at]), pa.array(x.place[ok].astype(np.int32)), pa.array(rows[at])],
                    ["line", "sim", "keys", "doc_id", "place", "row"])

    return run


LINE_SCHEMA = "line long, sim long, keys array<long>, doc_id long, place int, row long"


def _near(a: int, sims: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sims ^ np.uint64(a)) <= RADIUS


def _candidates(batches):
    """Rows (key, line, sim) sorted by key.  Buckets of up to SHORT lines give their pairs within the radius;
    of longer ones each line is linked to a pivot (the last line that was far from the one
    before it), and its row goes on for the blocks: (key, a, sim)."""
    out: list[tuple] = []

    def flush():
        cols = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["key", "a", "b", "sim"])

    def pairs(held):
        for i, (x, sx) in enumerate(held):
            for y, sy in held[i + 1:]:
                if x != y and ((sx ^ sy) & (2**64 - 1)).bit_count() <= RADIUS:
                    out.append((None, min(x, y), max(x, y), None))

    key, held, pivot = None, [], None

    def star(x, s, pivot):
        if pivot is None or ((s ^ pivot[1]) & (2**64 - 1)).bit_count() > RADIUS:
            pivot = (x, s)
        elif pivot[0] != x:
            out.append((None, min(x, pivot[0]), max(x, pivot[0]), None))
        out.append((key, x, None, s))
        return pivot

    for b in batches:
        keys = b.column(0).to_numpy()
        if not len(keys):
            continue
        single = np.ones(len(keys), bool)
        same = keys[1:] == keys[:-1]
        single[1:] &= ~same
        single[:-1] &= ~same
        single[0] &= keys[0] != key
        single[-1] = False
        keep = np.flatnonzero(~single)
        for k, x, s in zip(keys[keep].tolist(), b.column(1).to_numpy()[keep].tolist(), b.column(2).to_numpy()[keep].tolist(),
                           strict=True):
            if k != key:
                if pivot is None and len(held) > 1:
                    pairs(held)
                key, held, pivot = k, [], None
            if pivot is not None:
                pivot = star(x, s, pivot)
            else:
                held.append((x, s))
                if len(held) > SHORT:
                    for y, sy in held:
                        pivot = star(y, sy, pivot)
                    held = []
            if len(out) > 50_000:
                yield flush()
    if pivot is None and len(held) > 1:
        pairs(held)
    if out:
        yield flush()


def edit_distance(a: list, b: list, most: int) -> int:
    """Word edits between two lines, or more than ``most`` if it takes more: for each number of
    edits, the furthest word of ``a`` that every diagonal reaches."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1

    def run(i: int, k: int) -> int:
        while i < n and i + k < m and a[i] == b[i + k]:
            i += 1
        return i

    reach = {0: run(0, 0)}
    for e in range(most + 1):
        if reach.get(m - n, -1) >= n:
            return e
        if e < most:
            last = reach
            reach = {}
            # diagonals from which the end is within the edits left
            for k in range(max(-e - 1, m - n - (most - e - 1)), min(e + 1, m - n + (most - e - 1)) + 1):
                i = max(last.get(k, -2) + 1, last.get(k - 1, -2), last.get(k + 1, -2) + 1)
                if i >= 0:
                    reach[k] = run(min(i, n, m - k), k)
    return most + 1


class Line:
    """A normalised line to be compared: its words, and the set of them."""

    def __init__(self, body: bytes):
        self.words = body.split()
        self.kinds = set(self.words)

    def similar(self, other: "Line", percent: int) -> bool:
        longer = max(len(self.words), len(other.words))
        most = (100 - percent) * longer // 100
        # an edit takes one kind of word away at most, and brings one
        if len(self.kinds & other.kinds) < max(len(self.kinds), len(other.kinds)) - most:
            return False
        return edit_distance(self.words, other.words, most) <= most


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())],
                                      ["a", "b"])


def _verify(percent: int):
    """Runs of (a, chunk): the first row is a itself, the others its candidates."""

    def run(batches):
        out = []
        for t in textops.sorted_runs(batches, ["a", "chunk"]):
            ids, lines = t.column("line").to_pylist(), [Line(x) for x in t.column("body").to_pylist()]
            out += [(ids[0], ids[i]) for i in range(1, len(ids)) if lines[0].similar(lines[i], percent)]
            if len(out) > 10_000:
                yield _links(out)
                out = []
        yield _links(out)

    return run


def _block_links(percent: int):
    """Runs of (key, cell): links that join two groups, pairs within the radius only."""

    def run(batches):
        for t in textops.sorted_runs(batches, ["key", "cell"]):
            ids, roots = t.column("line").to_pylist(), t.column("root").to_pylist()
            forest, place = textops.Forest(len(ids)), {}
            for i, r in enumerate(roots):
                forest.join(place.setdefault(r, i), i)
            if len(place) < 2:
                continue
            sims = t.column("sim").to_numpy().view(np.uint64)
            lines, out = [Line(x) for x in t.column("body").to_pylist()], []
            for i in range(len(ids) - 1):
                for j in (np.flatnonzero(_near(int(sims[i]), sims[i + 1:])) + i + 1).tolist():
                    if forest.root(i) != forest.root(j) and lines[i].similar(lines[j], percent):
                        forest.join(i, j)
                        out.append((ids[i], ids[j]))
            if out:
                yield _links(out)

    return run


def _bodies(batches):
    """(doc_id, row, text, wanted places and lines) to one normalised body per wanted line."""
    for b in batches:
        line, body = [], []
        for text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parts = text.encode().split(b"\n")
            for w in wanted:
                line.append(w["line"])
                body.append(b" ".join(parts[w["place"]].lower().split()))
        yield pa.RecordBatch.from_arrays([pa.array(line, pa.int64()), pa.array(body, pa.binary())], ["line", "body"])


def duplicate_lines(spark: SparkSession, docs: DataFrame, percent: int = 95) -> DataFrame:
    """(row, place) of every line to be removed from ``docs`` (doc_id, text, row)."""
    lines = stored(spark, docs.select("doc_id", "text", "row").mapInArrow(_line_rows(percent), LINE_SCHEMA), "lines")
    first = F.min(F.struct("doc_id", "place", "row")).alias("first")
    distinct = stored(spark, lines.groupBy("line").agg(first, F.first("sim").alias("sim"), F.first("keys").alias("keys"),
                                                       F.count("*").alias("copies")), "distinct")
    # lines that allow no edit have no keys: only equal lines are similar to them
    keys = distinct.select(F.explode("keys").alias("key"), "line", "sim")
    distinct = distinct.drop("keys")
    found = stored(spark, keys.repartition("key").sortWithinPartitions("key").mapInArrow(
        _candidates, "key long, a long, b long, sim long"), "linecandidates")
    pairs = found.filter("b is not null").select("a", "b").distinct()
    wanted = pairs.select(F.col("a").alias("line")).unionByName(pairs.select(F.col("b").alias("line"))) \
        .unionByName(found.filter("b is null").select(F.col("a").alias("line"))).distinct()
    wanted = stored(spark, wanted, "wantedlines")
    where = marked(distinct, wanted, "line", "_some").filter("_some").join(wanted, "line", "left_semi") \
        .select("first.row", F.struct("line", F.col("first.place").alias("place")).alias("w")).groupBy("row").agg(F.collect_list("w").alias("wanted"))
    where = stored(spark, where, "linerows")
    # only texts that hold such a line, or look so by the bitmaps, are shuffled; their side is not sorted
    asked = marked(docs, where, "row", "_some").filter("_some").join(where.hint("shuffle_hash"), "row")
    bodies = stored(spark, asked.select("text", "wanted").mapInArrow(_bodies, "line long, body binary")
                    .dropDuplicates(["line"]), "bodies")

    fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("_chunks"))
    pairs = pairs.join(fan, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("_chunks")))
    asked = pairs.select("a", "chunk").distinct().withColumn("line", F.col("a")).withColumn("turn", F.lit(0))
    given = pairs.select("a", "chunk", F.col("b").alias("line"), F.lit(1).alias("turn"))
    links = stored(spark, asked.unionByName(given).join(bodies, "line").repartition("a", "chunk")
                   .sortWithinPartitions("a", "chunk", "turn").mapInArrow(_verify(percent), "a long, b long"), "linelinks")
    roots = components(spark, links)

    members = found.filter("b is null").select("key", F.col("a").alias("line"), "sim").distinct() \
        .join(roots.withColumnRenamed("node", "line"), "line", "left").withColumn("root", F.coalesce("root", "line"))
    open_keys = members.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo < _hi").select("key")
    members = cells(members.join(open_keys, "key", "left_semi"), ["key"], "line", BLOCK, root="root")
    more = stored(spark, members.select("key", "cell", "line", "sim", "root").join(bodies, "line")
                  .repartition("key", "cell").sortWithinPartitions("key", "cell")
                  .mapInArrow(_block_links(percent), "a long, b long"), "lineblocklinks")
    if not more.isEmpty():
        roots = components(spark, links.unionByName(more))

    # lines that occur once and have no similar one are settled before any join
    roots = stored(spark, roots.withColumnRenamed("node", "line"), "lineroots")
    grouped = marked(distinct, roots, "line", "_some").filter("_some or copies > 1").join(roots, "line", "left") \
        .withColumn("root", F.coalesce("root", "line")).select("line", "root", "first", "copies")
    stays = grouped.groupBy("root").agg(F.min("first").alias("stays"), F.sum("copies").alias("all"))
    repeated = stored(spark, grouped.join(stays.filter(F.col("all") > 1), "root").select("line", "stays"), "repeatedlines")
    return marked(lines, repeated, "line", "_some").filter("_some").select("line", "doc_id", "place", "row").join(repeated, "line") \
        .filter(~F.struct("doc_id", "place", "row").eqNullSafe(F.col("stays"))).select("row", "place")


def _without(names: list[str], text_at: int):
    def run(batches):
        for b in batches:
            texts, removed = b.column(text_at), b.column(b.schema.get_field_index("_gone"))
            lines = pc.fill_null(pc.add(pc.count_substring(texts, "\n"), 1), 0).cast(pa.int32())
            gone_n = pc.fill_null(pc.list_value_length(removed), 0).cast(pa.int32())
            if removed.null_count < len(removed):
                texts = texts.to_pylist()
                for i, gone in enumerate(removed.to_pylist()):
                    if gone and texts[i] is not None:
                        out = set(gone)
                        texts[i] = "\n".join(p for k, p in enumerate(texts[i].split("\n")) if k not in out)
                texts = pa.array(texts, pa.string())
            cols = [texts if k == text_at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, lines, gone_n], [*names, "n_lines", "n_removed"])

    return run


def without_duplicate_lines(spark: SparkSession, docs: DataFrame, percent: int = 95, id_col: str = "doc_id",
                            text_col: str = "text") -> DataFrame:
    """``docs`` with duplicate lines cut from the texts, plus n_lines (before) and n_removed."""
    names = docs.columns
    fields = [f"_c{i}" for i in range(len(names))]
    text_at = names.index(text_col)
    renamed = docs.toDF(*fields)
    # a row is known by its id and text, which no second reading changes
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gone = duplicate_lines(spark, plain.withColumn("row", F.xxhash64("doc_id", "text")), percent) \
        .distinct().groupBy("row").agg(F.collect_list("place").alias("_gone"))
    gone = stored(spark, gone, "gonelines")
    rows = renamed.withColumn("row", F.xxhash64(F.col(fields[names.index(id_col)]).cast("long"), F.col(fields[text_at])))
    rows = marked(rows, gone, "row", "_some")
    # a text that loses no line stays where it is
    joined = rows.filter("_some").join(gone.hint("shuffle_hash"), "row", "left").select(*fields, "_gone") \
        .unionAll(rows.filter("not _some").select(*fields, F.lit(None).cast("array<int>").alias("_gone")))
    schema = ", ".join(f"`{f}` {kind}" for f, kind in renamed.dtypes) + ", n_lines int, n_removed int"
    out = joined.mapInArrow(_without(fields, text_at), schema)
    extra = [n if n not in names else f"{n}_" for n in ("n_lines", "n_removed")]
    return out.toDF(*names, *extra)
