"""N-gram Jaccard join: a T-occurrence search (DivideSkip) behind an exact prefix filter.

Two documents link when the Jaccard similarity of their sets of word shingles is at least
``percent`` / 100.  Texts with equal sets form one class and are searched once.

1. A fixed-size count of all shingles (2^22 cells, summed over all documents) gives one
   total order of shingles, frequent ones last.  It only steers the work: any order is right.
2. Sets of sizes a, b that link share at least ceil(percent * max(a, b) / 100) shingles, so
   they share one among the first ``size - that + 1`` in this order.  Classes are dealt by
   these few shingles.  A short list gives its pairs, a long one its links to a pivot.
   Pairs whose sets must differ in too many members are left out: each set has a bitmap of
   parities, and bitmaps never differ in more places than their sets have members apart.
3. Candidates meet as full sets.  Each query merges its short inverted lists on a heap and
   probes the long ones by bisection; members that reach the required overlap are kept and
   their Jaccard similarity is taken in whole numbers.
4. Long lists that the links so far leave in several components are compared by sizes and
   parities alone, each pair of members in one of the first lists that it shares: in blocks of
   members, every pair of blocks a cell of its own, so no cap, and no list in one task.  Only
   the members of pairs that may link go on as full sets, dealt into smaller cells of a list.

Class identities are 64-bit content hashes.  Null or wordless texts have an empty set and
link with nothing; a row without id takes no part.  Repeated rows are one document.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import textops
from textmill.llm.graph import cells, components, join_counted, marked, stored

CELLS = 1 << 22
_PART = 1 << 12
SHORT = 8
BLOCK = 256
#: Blocks of parities, which are small, hold so many blocks of sets.
WIDE = 8
#: Of the lists that hold a member, so many go with it to say where else a pair meets.
FIRST = 4
CHUNK = 256


def text_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for t in textops.slices(column):
        hashes, _, before = t.words(lower=True)
        marks, at = textops.shingles(hashes, before, width)
        at = at.tolist()
        for i in range(t.n):
            yield t.first + i, np.unique(marks[at[i]:at[i + 1]])


def need(percent: int, a: int, b: int) -> int:
    """Least overlap of sets of sizes a and b that link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def _class_id(s: np.ndarray) -> int:
    n = np.uint64(len(s))
    return int(textops.as_long(textops.mix(np.array([np.add.reduce(textops.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))) + n],
                                                    np.uint64)))[0])


def parities(s: np.ndarray) -> bytes:
    """One bit per cell, at least as many cells as members: whether it holds an odd number."""
    bits = 1 << max(8, (len(s) - 1).bit_length())
    held = np.bincount(((s >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((held & 1).astype(np.uint8), bitorder="little").tobytes()


def may_link(percent: int, a: int, bits_a: bytes, b: int, bits_b: bytes) -> bool:
    """False only where sets of sizes a and b with these parities cannot link."""
    x, y = int.from_bytes(bits_a, "little"), int.from_bytes(bits_b, "little")
    wide_x, wide_y = 8 * len(bits_a), 8 * len(bits_b)
    while wide_x != wide_y:
        if wide_x < wide_y:
            x, y, wide_x, wide_y = y, x, wide_y, wide_x
        wide_x //= 2
        x = (x & ((1 << wide_x) - 1)) ^ (x >> wide_x)
    return (x ^ y).bit_count() <= a + b - 2 * need(percent, a, b)


def _packed(counts: np.ndarray) -> bytes:
    return pa.compress(counts.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data, kind) -> np.ndarray:
    size = _PART * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True), kind)


def _count(width: int):
    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for t in textops.slices(b.column(0)):
                hashes, _, before = t.words(lower=True)
                marks, _ = textops.shingles(hashes, before, width)
                total += np.bincount((marks & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        total = np.minimum(total, 2**32 - 1).astype(np.uint32)
        parts = [_packed(total[i:i + _PART]) for i in range(0, CELLS, _PART)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())],
                                         ["part", "counts"])

    return run


def _total(batches):
    """Sums the counts of each part; the rows come sorted by part."""
    part, acc = None, None
    for b in batches:
        for p, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            counts = _unpacked(c.as_buffer(), np.uint32).astype(np.int64)
            if p == part:
                acc += counts
                continue
            if part is not None:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_packed(acc)], pa.binary())],
                                                 ["part", "counts"])
            part, acc = p, counts
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_packed(acc)], pa.binary())],
                                         ["part", "counts"])


def frequency_levels(docs: DataFrame, width: int) -> np.ndarray:
    """One byte per cell of the shingle count, rising with the count (4 MB, whatever the input)."""
    rows = docs.select("text").mapInArrow(_count(width), "part int, counts binary") \
        .repartition("part").sortWithinPartitions("part").mapInArrow(_total, "part int, counts binary").collect()
    total = np.zeros(CELLS, np.int64)
    for r in rows:
        total[r.part * _PART:(r.part + 1) * _PART] = _unpacked(bytes(r.counts), np.int64)
    scaled = 64 + 24 * np.log2((total + 1) / (np.median(total) + 1))
    return np.clip(scaled, 0, 255).astype(np.uint8)


def _digest(width: int, percent: int, levels):
    def run(batches):
        level = levels.value
        for b in batches:
            ids = b.column(0)
            sizes, classes, rows = [], [], []
            marks: list[np.ndarray] = []
            bits = []
            for i, s in text_sets(b.column(1), width):
                n = len(s)
                sizes.append(n)
                known = n and ids[i].is_valid
                classes.append(_class_id(s) if known else None)
                bits.append(parities(s) if known else None)
                if not known:
                    rows.append(0)
                    continue
                first = n - (percent * n + 99) // 100 + 1
                order = (level[(s & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) \
                    | (s >> np.uint64(8))
                marks.append(np.partition(order, first - 1)[:first] if first < n else order)
                rows.append(first)
            at = np.concatenate([[0], np.cumsum(rows)]).astype(np.int32)
            flat = textops.as_long(np.concatenate(marks)) if marks else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int64())), pa.array(bits, pa.binary()),
                 *b.columns[2:]], ["doc_id", "n_shingles", "class", "marks", "bits", *b.schema.names[2:]])

    return run


def _candidates(percent: int):
    """Rows sorted by (mark, n, class).  Lists of up to SHORT members give all pairs of
    fitting sizes; longer ones a link from each member to the last pivot of a fitting
    size, and one row (mark, class) per member for the blocks."""

    def run(batches):
        mark, held, pivot = None, [], None
        out: list[tuple] = []

        def fits(a, b):
            return 100 * a[0] >= percent * b[0]

        def close():
            if pivot is None:
                for i, x in enumerate(held):
                    for y in held[i + 1:]:
                        if not fits(x, y):
                            break
                        if x[1] != y[1]:
                            out.append((None, min(x[1], y[1]), max(x[1], y[1])))

        def star(x, pivot):
            if pivot is None or not fits(pivot, x):
                pivot = x
            elif pivot[1] != x[1]:
                out.append((None, min(pivot[1], x[1]), max(pivot[1], x[1])))
            out.append((mark, x[1], None))
            return pivot

        def flush():
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["mark", "a", "b"])

        for b in batches:
            marks = b.column(0).to_numpy()
            if not len(marks):
                continue
            single = np.ones(len(marks), bool)
            same = marks[1:] == marks[:-1]
            single[1:] &= ~same
            single[:-1] &= ~same
            single[0] &= marks[0] != mark
            single[-1] = False
            keep = np.flatnonzero(~single)
            for m, n, c in zip(marks[keep].tolist(), b.column(1).to_numpy()[keep].tolist(),
                               b.column(2).to_numpy()[keep].tolist(), strict=True):
                if m != mark:
                    close()
                    mark, held, pivot = m, [], None
                x = (n, c)
                if pivot is not None:
                    pivot = star(x, pivot)
                else:
                    held.append(x)
                    if len(held) > SHORT:
                        for y in held:
                            pivot = star(y, pivot)
                        held = []
                if len(out) > 50_000:
                    yield flush()
        close()
        if out:
            yield flush()

    return run


def _possible(percent: int):
    """Keeps the pairs (a, b) whose sizes and parities allow a link."""

    def run(batches):
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(2, 6)]
            keep = [may_link(percent, *x) for x in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _folded(bits: list[bytes]) -> dict[int, tuple[int, np.ndarray]]:
    """For each width of these parities, which come with rising widths: the first that has it,
    and from there on all, folded to that width."""
    widths = np.array([len(x) for x in bits])
    out, rest = {}, None
    for w in np.unique(widths)[::-1].tolist():
        first, last = np.searchsorted(widths, w, "left"), np.searchsorted(widths, w, "right")
        own = np.frombuffer(b"".join(bits[first:last]), np.uint64).reshape(last - first, w // 8)
        while rest is not None and rest.shape[1] > w // 8:
            half = rest.shape[1] // 2
            rest = rest[:, :half] ^ rest[:, half:]
        rest = own if rest is None else np.concatenate([own, rest])
        out[w] = int(first), rest
    return out


def _near(percent: int):
    """Runs of one cell of a list, sorted by (n_shingles, class): the pairs whose roots differ
    and whose sizes and parities allow a link, but for those that one of the first lists
    of both, before this one, holds too."""

    def run(batches):
        out: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush():
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "mark", "n"])

        for t in textops.sorted_runs(batches, ["mark", "cell"]):
            roots = t.column("root").to_numpy()
            if (roots == roots[0]).all():
                continue
            mark, n = t.column("mark")[0].as_py(), t.column("n")[0].as_py()
            ids, sizes, homes = (t.column(c).to_numpy() for c in ("class", "n_shingles", "home"))
            apart = (homes != homes[0]).any()
            firsts = np.stack([t.column(f"first_{k}").to_numpy() for k in range(FIRST)])
            bits = t.column("bits").to_pylist()
            folded = _folded(bits)
            ends = np.searchsorted(sizes, 100 * sizes // percent, "right").tolist()
            for i, end in enumerate(ends):
                if end <= i + 1:
                    continue
                window = slice(i + 1, end)
                keep = roots[window] != roots[i]
                if apart:
                    keep &= homes[window] != homes[i]
                for first in firsts[:, i]:
                    if first < mark:
                        keep &= (firsts[:, window] != first).all(axis=0)
                at = np.flatnonzero(keep) + i + 1
                if not len(at):
                    continue
                begin, rows = folded[len(bits[i])]
                differ = np.bitwise_count(rows[at - begin] ^ rows[i - begin]).sum(axis=1, dtype=np.int64)
                both = sizes[at] + sizes[i]
                at = at[differ <= both - 2 * -(-percent * both // (100 + percent))]
                if len(at):
                    out.append((np.full(len(at), ids[i]), ids[at], np.full(len(at), mark), np.full(len(at), n)))
                    held += len(at)
            if held > 50_000:
                yield flush()
                held = 0
        if out:
            yield flush()

    return run


class InvertedIndex:
    """Sorted posting lists over the sets of one task's members."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        members = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((members, tokens))
        self.tokens, self.members = tokens[order], members[order]

    def lists(self, query: np.ndarray) -> list[list[int]]:
        lo = np.searchsorted(self.tokens, query, "left")
        hi = np.searchsorted(self.tokens, query, "right")
        full = np.flatnonzero(hi > lo)
        return [self.members[a:b].tolist() for a, b in zip(lo[full].tolist(), hi[full].tolist(), strict=True)]


def divide_skip(lists: list[list[int]], least: int, mu: float = 0.05) -> list[tuple[int, int]]:
    """(member, occurrences) of every member on at least ``least`` of the sorted lists.
    The longest lists are set aside for bisection; the others are merged on a heap, which
    jumps over members that cannot occur often enough."""
    if least < 1 or len(lists) < least:
        return []
    lists = sorted(lists, key=len, reverse=True)
    aside = min(least - 1, int(least / (mu * np.log2(len(lists[0]) + 1) + 1)))
    long, short = lists[:aside], lists[aside:]
    floor = least - aside
    heap = [(x[0], i, 0) for i, x in enumerate(short)]
    heapq.heapify(heap)
    found = []
    while len(heap) >= floor:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= floor:
            count, left = len(popped), aside
            for x in long:
                if count + left < least:
                    break
                at = bisect_left(x, top)
                count += at < len(x) and x[at] == top
                left -= 1
            if count >= least:
                found.append((top, count))
            for _, i, p in popped:
                if p + 1 < len(short[i]):
                    heapq.heappush(heap, (short[i][p + 1], i, p + 1))
            continue
        while heap and len(popped) < floor - 1:
            popped.append(heapq.heappop(heap))
        if not heap:
            break
        reach = heap[0][0]
        for _, i, p in popped:
            p = bisect_left(short[i], reach, p)
            if p < len(short[i]):
                heapq.heappush(heap, (short[i][p], i, p))
    return found


def linked(query: np.ndarray, index: InvertedIndex, percent: int) -> list[int]:
    """Members of ``index`` whose Jaccard similarity with ``query`` is high enough."""
    n = len(query)
    fitting = [m for m in index.sizes if 100 * m >= percent * n and 100 * n >= percent * m]
    if not fitting:
        return []
    found = divide_skip(index.lists(query), need(percent, n, min(fitting)))
    return [m for m, count in found if count >= need(percent, n, index.sizes[m])]


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("marks")]


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                       pa.array([r[1] for r in rows], pa.int64())], ["a", "b"])


def _verify(percent: int):
    """Runs of (a, chunk): first the query's own set, then those of its candidates."""

    def run(batches):
        out = []
        for t in textops.sorted_runs(batches, ["a", "chunk"]):
            sets, ids = _sets(t), t.column("class").to_pylist()
            out += [(ids[0], ids[1 + m]) for m in linked(sets[0], InvertedIndex(sets[1:]), percent)]
            if len(out) > 10_000:
                yield _links(out)
                out = []
        yield _links(out)

    return run


def _block_links(percent: int):
    """Runs of one cell, each member with those that it may link with: links that join two
    components of what the run has linked so far."""

    def run(batches):
        for t in textops.sorted_runs(batches, ["mark", "cell"]):
            ids, roots, sets = t.column("class").to_pylist(), t.column("root").to_pylist(), _sets(t)
            place, at = {}, {}
            forest = textops.Forest(len(ids))
            for i, (c, r) in enumerate(zip(ids, roots, strict=True)):
                forest.join(place.setdefault(r, i), i)
                forest.join(at.setdefault(c, i), i)
            out = []
            for i, others in enumerate(t.column("others").to_pylist()):
                left = [at[c] for c in others if forest.root(at[c]) != forest.root(i)]
                if left:
                    found = linked(sets[i], InvertedIndex([sets[j] for j in left]), percent)
                    out += [(ids[i], ids[left[m]]) for m in found if forest.join(i, left[m])]
            if out:
                yield _links(out)

    return run


def _full_sets(width: int):
    def run(batches):
        for b in batches:
            ids, classes, sets = b.column(0).to_pylist(), [], []
            for i, s in text_sets(b.column(1), width):
                # an id that repeats with another text brings that text too
                if _class_id(s) == ids[i]:
                    classes.append(ids[i])
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())],
                                             ["class", "marks"])

    return run


def jaccard_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   width: int = 5, percent: int = 80, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by
    links, itself included; null without id), class (the id of equal sets; null if empty) and root
    (the least class of the component); with ``row_col``, a string column of ``docs``, also row."""
    row = [F.col(row_col).alias("row")] if row_col else []
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row)
    levels = spark.sparkContext.broadcast(frequency_levels(texts, width))
    digests = stored(spark, texts.mapInArrow(
        _digest(width, percent, levels), "doc_id long, n_shingles long, class long, marks array<long>, bits binary"
        + (", row string" if row else "")), "digests")
    classes = stored(spark, digests.filter("class is not null").groupBy("class")
                     .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = _representatives(digests, classes)
    postings = reps.select(F.explode("marks").alias("mark"), F.col("n_shingles").alias("n"), "class")
    found = stored(spark, postings.repartition("mark").sortWithinPartitions("mark", "n", "class")
                   .mapInArrow(_candidates(percent), "mark long, a long, b long"), "candidates")
    # written, as a join with it can then deal out a class that many pairs share
    bits = stored(spark, reps.select("class", "n_shingles", "bits").dropDuplicates(["class"]), "bits")
    pairs = _possible_pairs(spark, found.filter("b is not null").select("a", "b").distinct(), bits, percent)
    wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    sets = _fetched(spark, texts, classes.join(wanted, "class", "left_semi"), width)
    links = _linked_pairs(spark, pairs, sets, percent)
    roots = components(spark, links)
    members = _open_lists(spark, found, roots)
    near = _near_pairs(spark, members, bits, percent)
    if near.isEmpty():
        return _labelled(digests, classes, roots)
    wanted = near.select(F.col("a").alias("class")).unionByName(near.select(F.col("b").alias("class"))).distinct() \
        .join(sets.select("class"), "class", "left_anti")
    sets = sets.unionByName(_fetched(spark, texts, classes.join(wanted, "class", "left_semi"), width))
    more = _cell_links(spark, near, roots, sets, percent)
    if not more.isEmpty():
        roots = components(spark, links.unionByName(more))
    return _labelled(digests, classes, roots)


def _representatives(digests: DataFrame, classes: DataFrame) -> DataFrame:
    """The digests of least id of each class; only those whose class may repeat are shuffled."""
    repeated = classes.filter("copies > 1").select("class", F.col("rep").alias("doc_id"))
    some = marked(digests.filter("class is not null"), repeated.select("class"), "class", "_some")
    return some.filter("not _some").unionByName(
        some.filter("_some").join(classes.select("class", F.col("rep").alias("doc_id")), ["doc_id", "class"], "left_semi")
        .select(*some.columns)).drop("_some")


def _fetched(spark: SparkSession, texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(class, marks): the full sets of the classes ``wanted``; only texts whose id can be one of theirs are shuffled."""
    wanted = stored(spark, wanted.select("class", F.col("rep").alias("doc_id")), "wanted")
    some = marked(texts.select("doc_id", "text", F.xxhash64("doc_id").alias("_key")),
                  wanted.select(F.xxhash64("doc_id").alias("_key")).distinct(), "_key", "_some").filter("_some")
    return stored(spark, some.join(wanted, "doc_id").select("class", "text")
                  .mapInArrow(_full_sets(width), "class long, marks binary"), "sets")


def _open_lists(spark: SparkSession, found: DataFrame, roots: DataFrame) -> DataFrame:
    """(mark, class, root, n): the members of the long lists that hold several roots; n is the list's length."""
    members = stored(spark, found.filter("b is null").select("mark", F.col("a").alias("class")).distinct()
                     .join(roots.withColumnRenamed("node", "class"), "class", "left")
                     .withColumn("root", F.coalesce("root", "class")), "longlists")
    lists = members.groupBy("mark").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count("*").alias("n")) \
        .filter("_lo < _hi").select("mark", "n")
    return stored(spark, join_counted(members, stored(spark, lists, "lists"), "mark", "n")
                  .select("mark", "class", "root", "n"), "openlists")


def _near_pairs(spark: SparkSession, members: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """(a, b, mark, n): the pairs of members of a list that may link and do not share a root,
    each once, with one of their lists and its length."""
    wide = WIDE * BLOCK
    dealt = cells(members.filter(F.col("n") > wide), ["mark"], "class", wide, root="root")
    whole = members.filter(F.col("n") <= wide).withColumn("home", F.lit(0)).withColumn("cell", F.lit(0).cast("long"))
    lists = members.groupBy("class").agg(F.array_sort(F.collect_set("mark")).alias("_lists"))
    firsts = lists.select("class", *[F.coalesce(F.get("_lists", F.lit(k)), F.lit(2**63 - 1)).alias(f"first_{k}")
                                     for k in range(FIRST)])
    # the number is given, as cells of few bytes may be long work
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = whole.unionByName(dealt).join(firsts, "class").join(bits, "class") \
        .repartition(tasks, "mark", "cell").sortWithinPartitions("mark", "cell", "n_shingles", "class") \
        .mapInArrow(_near(percent), "a long, b long, mark long, n long")
    return stored(spark, near.groupBy("a", "b").agg(F.min(F.struct("mark", "n")).alias("_at"))
                  .select("a", "b", "_at.mark", "_at.n"), "near")


def _cell_links(spark: SparkSession, near: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the pairs ``near``, whose members meet as full sets in cells of two blocks of a list."""
    blocks = F.ceil(F.col("n") / BLOCK)
    homes = [F.pmod(F.xxhash64(c), blocks) for c in ("a", "b")]
    near = near.withColumn("cell", F.least(*homes) * blocks + F.greatest(*homes))
    rows = near.select("mark", "cell", F.col("a").alias("class"), F.col("b").alias("other")) \
        .unionByName(near.select("mark", "cell", F.col("b").alias("class"), F.lit(None).cast("long").alias("other"))) \
        .groupBy("mark", "cell", "class").agg(F.collect_list("other").alias("others"))
    rows = rows.join(roots.withColumnRenamed("node", "class"), "class", "left") \
        .withColumn("root", F.coalesce("root", "class")).join(sets, "class")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stored(spark, rows.repartition(tasks, "mark", "cell").sortWithinPartitions("mark", "cell")
                  .mapInArrow(_block_links(percent), "a long, b long"), "blocklinks")


def _possible_pairs(spark: SparkSession, pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(bits.toDF(side, f"n_{side}", f"bits_{side}"), side)
    return stored(spark, pairs.select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
                  .mapInArrow(_possible(percent), "a long, b long"), "pairs")


def _linked_pairs(spark: SparkSession, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    pairs = pairs.withColumn("chunk", F.pmod(F.xxhash64("b"), F.lit(2**40)))
    fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("_chunks"))
    pairs = pairs.join(fan, "a").select("a", "b", F.pmod("chunk", F.col("_chunks")).alias("chunk"))
    asked = pairs.select("a", "chunk").distinct().withColumn("class", F.col("a")).withColumn("turn", F.lit(0))
    given = pairs.withColumnRenamed("b", "class").withColumn("turn", F.lit(1))
    rows = asked.unionByName(given).join(sets, "class")
    return stored(spark, rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "turn")
                  .mapInArrow(_verify(percent), "a long, b long"), "links")


def _labelled(digests: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    known = classes.join(roots.withColumnRenamed("node", "class"), "class", "left") \
        .withColumn("root", F.coalesce("root", "class"))
    least = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = known.join(least, "root").select("class", "component_id", "root")
    row = [c for c in ("row",) if c in digests.columns]
    return digests.drop("marks", "bits").join(labels, "class", "left") \
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "class", "root", *row)
