"""Best-fit packing by exact-complement hashing.

Every text becomes ids (plus one end id) by a ``tokenizers`` vocabulary; what is longer than a
sequence is cut, the first piece taking the rest of the division.  How pieces combine depends
only on how many there are of each length, a histogram of at most ``capacity`` entries.  The
plan for it is made once: for each length, longest first, the gap it leaves is looked up
among the sums of one, two and three lengths still available, and as many equal sequences
as the counts allow are filled exactly; what is left is packed best-fit.  The plan is a list
of (template, times).  Pieces are numbered within their length and look their place up in
the plan, so no sequence, length or document group passes through one task.

Null texts count as empty: one piece, the end id alone.  Repeated rows are packed each for
itself (they share doc_id and piece numbers); extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmill.llm.graph import stored

CAPACITY = 2048
END_ID = 0
#: Groups that the numbering of one length is dealt over.
DEALS = 256

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, copy long"


# ---- ids -------------------------------------------------------------------------------

class VocabularyIds:
    """Packed ids of a byte-level BPE vocabulary in the ``tokenizers`` format.  Its merges are
    in the order of the ids they make (checked on reading), so its ids are those of the same
    vocabulary as ranks, which ``tiktoken`` encodes several times faster.  The strings of the file's
    added tokens get their ids wherever they stand in a text, as in that library."""

    def __init__(self, path: str, pattern: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, added = file["model"], file.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that take in what is around them")
        back = byte_letters()
        ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if all(c in back for c in t)}
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(made) or len(ranks) < 256:
            raise ValueError(f"{path}: not a byte-level BPE vocabulary with merges in the order of ids")
        made_ids = set(made)
        ranks = {t: i for t, i in ranks.items() if len(t) == 1 or i in made_ids}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks,
                                          special_tokens={t["content"]: t["id"] for t in added})

    def encode(self, text: str) -> bytes:
        return np.array(self.encoding.encode(text, allowed_special="all"), "<u4").tobytes()


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    characters for themselves, the other bytes in order from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_LIBRARY: dict[tuple[str, str], VocabularyIds] = {}


def piece_bounds(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` ids: whole, or the rest first and then full ones."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity
    starts = ([0] if first else []) + list(range(first, total, capacity))
    return [(s, (first if first and not s else capacity)) for s in starts]


def _cut(path: str, pattern: str, capacity: int, end_id: int):
    end = struct.pack("<I", end_id)

    def run(batches):
        if (path, pattern) not in _LIBRARY:
            _LIBRARY[path, pattern] = VocabularyIds(path, pattern)
        lib = _LIBRARY[path, pattern]
        for b in batches:
            rows: list[tuple] = []
            for at in range(0, b.num_rows, 256):
                texts = [v or "" for v in b.column(1).slice(at, 256).to_pylist()]
                for doc, copy, text in zip(b.column(0).slice(at, 256).to_pylist(), b.column(2).slice(at, 256).to_pylist(),
                                           texts, strict=True):
                    packed = lib.encode(text) + end
                    for k, (start, length) in enumerate(piece_bounds(len(packed) // 4, capacity)):
                        rows.append((doc, k, start, length, zlib.crc32(packed[4 * start:4 * (start + length)]), copy))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "copy"])

    return run


def token_pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; ``copy`` tells repeated rows apart."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.monotonically_increasing_id().alias("copy")) \
        .mapInArrow(_cut(path, pattern, capacity, end_id), _PIECES)


# ---- the plan --------------------------------------------------------------------------

class Complements:
    """Lengths still available, hashed by the sums that one, two and three of them give."""

    def __init__(self, counts: np.ndarray):
        self.left = counts
        self.have = counts > 0
        self.pair_of: dict[int, tuple[int, int]] = {}

    def use(self, lengths: Iterable[int], times: int) -> None:
        for x in lengths:
            self.left[x] -= times
            if not self.left[x]:
                self.have[x] = False

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often the combination can be taken."""
        return min(int(self.left[x]) // lengths.count(x) for x in set(lengths))

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two available lengths with this sum, the most even split first found being kept."""
        known = self.pair_of.get(total)
        if known and self.times(known):
            return known
        half = total // 2
        big = np.arange(total - half, total)
        both = big[self.have[big] & self.have[total - big]] if total > 1 else big[:0]
        for b in both.tolist():
            found = (b, total - b)
            if self.times(found):
                self.pair_of[total] = found
                return found
        return None

    def combination(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill the gap exactly."""
        if self.have[gap]:
            return (gap,)
        found = self.pair(gap)
        if found:
            return found
        for c in np.flatnonzero(self.have[:gap])[::-1].tolist():
            found = self.pair(gap - c)
            if found and self.times((c, *found)):
                return (c, *found)
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Templates and how often each is used; together they use every length exactly as often
    as it is there.  Work and size depend on the number of lengths, not on their counts."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    index, out = Complements(left), []
    rest: list[tuple[int, int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        index.use((capacity,), int(left[capacity]))
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            index.left[length] -= 1          # the gap is to be filled beside this one
            index.have[length] = left[length] > 0
            others = index.combination(capacity - length)
            index.left[length] += 1
            index.have[length] = True
            if others is None:
                rest.append((length, int(left[length])))
                index.use((length,), int(left[length]))
                break
            whole = (length, *others)
            n = index.times(whole)
            out.append((whole, n))
            index.use(whole, n)
    return out + best_fit(rest, capacity)


def best_fit(rest: list[tuple[int, int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit for (length, count), longest first, over groups of equal open sequences."""
    gaps: list[int] = []                       # sorted gaps with open groups
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(template, n):
        gap = capacity - sum(template)
        if gap not in groups:
            groups[gap] = []
            bisect.insort(gaps, gap)
        groups[gap].append((template, n))

    for length, n in rest:
        while n:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                if n >= each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                break
            gap = gaps[at]
            template, m = groups[gap].pop()
            if not groups[gap]:
                del groups[gap], gaps[at]
            taken = min(n, m)
            put((*template, length), taken)
            if m > taken:
                put(template, m - taken)
            n -= taken
    return [g for gap in gaps for g in groups[gap]]


def _places(templates: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int]]:
    """(length, first number, first sequence, offset): pieces of a length with numbers from
    the first on go one by one to the sequences from the first on, at that offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for template, times in templates:
        offset = 0
        for length in template:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        sequence += times
    return sorted(rows)


def _place(places):
    def run(batches):
        table = places.value
        for b in batches:
            length, number = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            at = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                lo, hi = np.searchsorted(table[:, 0], [x, x + 1])
                mine = length == x
                at[mine] = lo + np.searchsorted(table[lo:hi, 1], number[mine], "right") - 1
            keep = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(table[at, 2] + number - table[at, 1], pa.int64()), pa.array(table[at, 3], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, copy)."""
    pieces = stored(spark, pieces.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "copy"), F.lit(DEALS)).cast("int")),
                    "pieces")
    sums = pieces.groupBy("length", "deal").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan(counts, capacity))
    table = spark.sparkContext.broadcast(np.array(places, np.int64).reshape(-1, 4))
    earlier = W.partitionBy("length").orderBy("deal").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = W.partitionBy("length", "deal").orderBy("doc_id", "piece", "copy")
    numbered = pieces.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["length", "deal"]) \
        .withColumn("number", F.col("first") + F.col("at"))
    return numbered.mapInArrow(_place(table), "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                              "sequence_id long, offset long")


def pack_documents(spark: SparkSession, docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    return pack(spark, token_pieces(docs, path, pattern, capacity, end_id, id_col, text_col), capacity)
