"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

The merges are compiled into a rule on neighbours: a token sequence is what the merges give
if and only if every two neighbouring tokens, joined and merged again, come back as the same
two.  So each prefix of a piece has one last token, the longest vocabulary entry that ends
there and is compatible with the last token before it.  The transducer reads bytes.  Its
state is what the future can still see: the last token of every prefix from which a longer
token may yet run on.  States and arcs are made when first met and kept.  A token goes out
once all those prefixes build on it; they begin at most one token's length back.

Texts are cut before a space that a solid character follows, which is always a piece
border, so repeated strings between spaces are looked up before the pattern is run.

Null texts count as empty: no ids, the digest of nothing.  Rows are independent, so ties,
repeated rows and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import contextlib
import gc
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Strings kept with their ids, and states made, before the tables start afresh.  Both bound
#: the memory; ids never change.
CACHE_STRINGS = 250_000
CACHE_STATES = 250_000

#: Bytes of one piece read between two emissions.
STRIDE = 1024

#: Fixed value: white space as the Unicode property, which the rank files' pattern means.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file: base64 and number per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def splitter(pattern: str):
    """The split pattern with ``\\s`` and ``\\S`` as the Unicode property, nothing else changed."""
    inside = regex.sub(r"(\[\^?[^\]]*?)\\s", lambda m: m[1] + _WS, pattern)
    return regex.compile(inside.replace("\\s", f"[{_WS}]").replace("\\S", f"[^{_WS}]"))


class Merges:
    """The merge rule itself, for short strings: joins the neighbours of least rank first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._halves: dict[int, tuple[int, int]] = {}

    def merged(self, piece: bytes, below: int | None = None) -> list[int]:
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best) and (below is None or r < below):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a and b side by side."""
        key = (a, b)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            known = self._pairs[key] = self._apart(a, b)
        return known

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; a single byte is its own half."""
        found = self._halves.get(token)
        if found is None:
            parts = self.merged(self.tokens[token], below=token)
            found = self._halves[token] = (parts[0], parts[-1])
        return found

    def _apart(self, a: int, b: int) -> bool:
        """Undoes the later merge of the two sides again and again.  If, before it is made,
        what faces each other at the border would merge earlier, the border does not hold."""
        earliest = len(self.ranks) + 1
        while True:
            joint = self.ranks.get(self.tokens[a] + self.tokens[b])
            if joint is not None and joint < earliest:
                return False
            left, right = self.halves(a)[1], self.halves(b)[0]
            if left == a and right == b:
                return True
            if right == b or (left != a and a > b):
                earliest, a = a, left
            else:
                earliest, b = b + 1, right


class Transducer:
    """Bytes in, ranks out.  A state holds each open prefix, as the bytes read since it and
    the last token before them; equal states are one state.  An arc gives the last token of
    the prefix it completes.  Tokens are emitted once every open prefix builds on them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self.ranks = ranks
        self.lengths = {r: len(t) for t, r in ranks.items()}
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self._afresh()

    def _afresh(self) -> None:
        """Only the start state, whose number is 0; the number of a state is 256 times its place."""
        start = ((b"", -1),)
        self.state_ids = {start: 0}
        self.states = [start]
        self.arcs: dict[int, tuple[int, int]] = {}

    def _state(self, fronts: tuple) -> int:
        at = self.state_ids.get(fronts)
        if at is None:
            at = self.state_ids[fronts] = len(self.states) << 8
            self.states.append(fronts)
        return at

    def _arc(self, state: int, byte: int) -> tuple[int, int]:
        one, ranks, prefixes = bytes((byte,)), self.ranks, self.prefixes
        new, live = -1, []
        for run, last in self.states[state >> 8]:
            run += one
            if new < 0:
                # the longest token that may follow the last token of the prefix where it begins
                rank = ranks.get(run)
                if rank is not None and (last < 0 or self.merges.neighbours(last, rank)):
                    new = rank
            if run in prefixes:
                live.append((run, last))
        if new < 0:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        live.append((b"", new))
        arc = self.arcs[state + byte] = (self._state(tuple(live)), new)
        return arc

    def _back(self, lasts: list[int], at: int) -> list[int]:
        """The tokens of the first ``at`` bytes, from the last token of each prefix."""
        lengths, out = self.lengths, []
        while at:
            token = lasts[at - 1]
            out.append(token)
            at -= lengths[token]
        out.reverse()
        return out

    def _settled(self, lasts: list[int], state: int) -> int:
        """The last border on which all open prefixes agree."""
        at = {len(lasts) - len(run) for run, _ in self.states[state >> 8]}
        while len(at) > 1:
            end = max(at)
            at.remove(end)
            at.add(end - self.lengths[lasts[end - 1]])
        return at.pop()

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) >= CACHE_STATES:
            self._afresh()
        arcs, state, out, lasts = self.arcs.get, 0, [], []
        add = lasts.append
        for begin in range(0, len(piece), STRIDE):
            for byte in piece[begin:begin + STRIDE]:
                state, last = arcs(state + byte) or self._arc(state, byte)
                add(last)
            if begin + STRIDE < len(piece):
                border = self._settled(lasts, state)
                out += self._back(lasts, border)
                del lasts[:border]
        return out + self._back(lasts, len(lasts))


class Encoder:
    """Whole texts to packed little-endian ids.  ``pieces`` of a text are found by pattern;
    strings between spaces are kept with their ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.fst = Transducer(ranks)
        self.split = splitter(pattern)
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.odd = regex.compile(f" (?=[{_WS}]|$)")

    def _fresh(self, piece: str) -> bytes:
        out = self.fst.encode(piece.encode())
        return struct.pack(f"<{len(out)}I", *out)

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self._fresh(piece)
            if len(piece) < 64:
                if len(self.pieces) > CACHE_STRINGS:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        found = self.split.findall(chunk)
        # a chunk that is one piece is kept as a chunk
        return self._fresh(found[0]) if len(found) == 1 else b"".join(map(self._piece, found))

    def encode(self, text: str) -> bytes:
        return cut_and_join(text, self.odd, self.chunks, self._chunk)


def cut_and_join(text: str, odd, cache: dict[str, bytes], encode_chunk) -> bytes:
    """The joined ids of ``text`` from those of its chunks.  Chunks begin at a space before
    a solid character; a space before white space or the end stays inside its chunk."""
    parts = text.split(" ")
    if odd.search(text):
        merged = [parts[0]]
        for p in parts[1:]:
            if not p or p[0].isspace():
                merged[-1] += " " + p
            else:
                merged.append(p)
        parts = merged
    first = encode_chunk(parts[0]) if parts[0] else b""
    if len(cache) > CACHE_STRINGS:
        cache.clear()
    out = [first]
    get = cache.get
    for p in parts[1:]:
        ids = get(p)
        if ids is None:
            ids = encode_chunk(" " + p)
            if len(p) < 64:
                cache[p] = ids
        out.append(ids)
    return b"".join(out)


class Utf8Stream:
    """Decodes ids block by block.  The state is the number of continuation bytes still due;
    bytes of a code point that is not complete wait for the next block."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.held = b""

    @staticmethod
    def _open_tail(data: bytes) -> int:
        """Bytes at the end that begin a code point without ending it."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                due = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if due > back else 0
            if byte < 0x80:
                return 0
        return 0

    def feed(self, ids: Iterable[int]) -> bytes:
        data = self.held + b"".join(map(self.tokens.__getitem__, ids))
        tail = self._open_tail(data)
        self.held = data[len(data) - tail:]
        return data[:len(data) - tail]

    def finish(self) -> bytes:
        rest, self.held = self.held, b""
        return rest


def decoded_blocks(packed: bytes, tokens: dict[int, bytes], block: int = 4096) -> Iterator[bytes]:
    """The bytes of packed ids, block by block, each block whole code points."""
    stream = Utf8Stream(tokens)
    ids = np.frombuffer(packed, "<u4")
    for i in range(0, len(ids), block):
        yield stream.feed(ids[i:i + block].tolist())
    yield stream.finish()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary; its tables serve task after task."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(read_ranks(path), pattern)
    return _ENCODERS[path, pattern]


@contextlib.contextmanager
def _without_collection():
    """The tables hold many objects and no cycles: searching them for cycles finds nothing."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _digests(path: str, pattern: str):
    def run(batches):
        with _without_collection():
            yield from digests(batches)

    def digests(batches):
        enc = _encoder(path, pattern)
        tokens = enc.fst.merges.tokens
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for value in b.column(1):
                packed = enc.encode(value.as_py() or "")
                back = hashlib.sha256()
                for block in decoded_blocks(packed, tokens):
                    back.update(block)
                counts.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str, pattern: str):
    def run(batches):
        with _without_collection():
            yield from ids(batches)

    def ids(batches):
        enc = _encoder(path, pattern)
        for b in batches:
            lists = [np.frombuffer(enc.encode(v.as_py() or ""), "<u4").astype(np.int32) for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every text."""
    return _two(docs, id_col, text_col).mapInArrow(_ids(path, pattern), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        tokens = _encoder(path, pattern).fst.merges.tokens
        for b in batches:
            texts = [b"".join(decoded_blocks(np.array(v.as_py() or [], "<u4").tobytes(), tokens)).decode("utf-8", "replace")
                     for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digests(spark: SparkSession, docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded again."""
    return _two(docs, id_col, text_col).mapInArrow(
        _digests(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
