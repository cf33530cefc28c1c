"""The greedy sentence packer with hybrid overlap, as one array fold.

Input: ``array<struct<t: string, toks: array<string>>>`` (stripped, non-blank
sentences with their tokens).  Output: ``array<string>`` chunk texts.  The fold
runs per row (one page), so pages pack in parallel with no shuffle; the state
is (chunks so far, current buffer of sentences, buffer token count).

Token counts are additive under the default tokenizer (joining texts with a
space never merges or splits tokens), so a buffer's length is the sum of its
sentences' lengths and the overlap's length is known without re-tokenising.
``pack`` states the rule over whole buffers, as the DuckDB oracle runs it; ``pack_spark`` is the same
rule for the engine, whose fold holds numbers and cuts texts only where a chunk ends.
"""

from __future__ import annotations

from textmill.functions.sqltext import SPARK, Dialect
from textmill.functions.text import (
    MAX_TOKENS,
    MIN_OVERLAP_TOKENS,
    OVERLAP_TOKENS,
    TARGET_TOKENS,
    tokens,
)


def _types(d: Dialect):
    if d.spark:
        return "struct<t:string,toks:array<string>>"
    return "STRUCT(t VARCHAR, toks VARCHAR[])"


def _empty_cur(d: Dialect) -> str:
    if d.spark:
        return f"cast(array() as array<{_types(d)}>)"
    return f"[]::{_types(d)}[]"


def _sent(d: Dialect, text: str, toks: str) -> str:
    return d.struct(t=text, toks=toks)


def overlap(d: Dialect, cur: str, tok: str, ov: int, mn: int) -> str:
    """C05 build_overlap on a buffer -> the seed buffer (0 or 1 pseudo-sentence)."""
    empty = _empty_cur(d)
    acc0 = d.struct(k="0", s="0", stop="false")
    n = d.size("e_.toks")
    step = (f"if(r.stop or r.s + {n} > {ov}, {d.struct(k='r.k', s='r.s', stop='true')}, "
            f"{d.struct(k='r.k + 1', s=f'r.s + {n}', stop='false')})")
    suffix = d.reduce(d.reverse(cur), acc0, "r", "e_", step)
    ovs = d.slice(cur, f"{d.size(cur)} - q.k + 1", "q.k")
    ov_text = d.join(d.field(ovs, "t"))
    ov_toks = d.flatten(d.field(ovs, "toks"))
    whole = (f"if(q.s >= {tok} or {ov_text} = '', {empty}, "
             f"{d.arr(_sent(d, ov_text, ov_toks))})")
    last_toks = d.at(cur, "-1") + ".toks"
    need = f"least(greatest({mn} - q.s, 0), {ov})"
    tail = d.last_n(last_toks, need)
    h_text = f"trim(concat({ov_text}, ' ', {d.join(tail)}))"
    h_toks = d.concat(ov_toks, tail)
    hybrid = (f"if({h_text} = '' or {d.size(h_toks)} >= {tok}, {empty}, "
              f"{d.arr(_sent(d, h_text, h_toks))})")
    body = f"if(q.s >= {mn}, {whole}, {hybrid})"
    return f"if({tok} < {mn}, {empty}, {d.let(suffix, 'q', body)})"


def flush(d: Dialect, s: str, ov: int, mn: int) -> str:
    """Emit the buffer of state ``s`` as a chunk and seed the next buffer with overlap."""
    chunk = f"trim({d.join(d.field(f'{s}.cur', 't'))})"
    seeded = d.let(overlap(d, f"{s}.cur", f"{s}.tok", ov, mn), "o",
                   d.struct(chunks=d.append(f"{s}.chunks", chunk), cur="o",
                            tok=f"if({d.size('o')} = 0, 0, {d.size(d.at('o', '1') + '.toks')})"))
    return f"if({d.size(f'{s}.cur')} = 0, {s}, {seeded})"


def pack(d: Dialect, sents: str, target: int = TARGET_TOKENS, mx: int = MAX_TOKENS,
         ov: int = OVERLAP_TOKENS, mn: int = MIN_OVERLAP_TOKENS) -> str:
    """C06 chunk_sentences -> array<string>."""
    empty_chunks = d.empty("string", "VARCHAR")
    init = d.struct(chunks=empty_chunks, cur=_empty_cur(d), tok="0")
    n = d.size("x.toks")
    # Case A: one sentence longer than max -> flush, token-split, seed with its tail.
    parts = d.transform(d.seq("0", d.idiv(f"{n} - 1", str(mx))), "i", d.slice("x.toks", f"i * {mx} + 1", str(mx)))
    seed_toks = d.last_n(d.at("p", "-1"), str(ov))
    seed = (f"if({ov} > 0 and {d.size(seed_toks)} >= {mn} and {d.size(seed_toks)} > 0, "
            f"{d.arr(_sent(d, d.join(seed_toks), seed_toks))}, {_empty_cur(d)})")
    case_a = d.let(flush(d, "s", ov, mn), "f",
                   d.let(parts, "p", d.let(seed, "sd", d.struct(
                       chunks=d.concat("f.chunks", d.transform("p", "pp", d.join("pp"))),
                       cur="sd",
                       tok=f"if({d.size('sd')} = 0, 0, {d.size(d.at('sd', '1') + '.toks')})"))))
    # Case B (retry after flush, at most twice) then case C (add, soft flush at target).
    add = d.struct(chunks="s2.chunks", cur=d.append("s2.cur", "x"), tok=f"s2.tok + {n}")
    case_c = d.let(add, "s3", f"if(s3.tok >= {target}, {flush(d, 's3', ov, mn)}, s3)")
    case_b = d.let(f"if(s.tok + {n} > {mx}, {flush(d, 's', ov, mn)}, s)", "s1",
                   d.let(f"if(s1.tok + {n} > {mx}, {flush(d, 's1', ov, mn)}, s1)", "s2", case_c))
    step = f"if({n} > {mx}, {case_a}, {case_b})"
    folded = d.reduce(sents, init, "s", "x", step)
    return d.let(d.let(folded, "z", flush(d, "z", ov, mn)), "w", "w.chunks")


def _seed_spark(tok: str, ov: int, mn: int) -> str:
    """C05 on the buffer ``ct__`` (texts) and ``cn__`` (their token counts): the seed as struct(t, n), n = 0 for
    none.  Only the last text is tokenised, and only where some of its tokens are wanted."""
    d = SPARK
    none = d.struct(t="''", n="0")
    # a text holds a token or more, so ov + 1 of them decide the suffix
    step = (f"if(r.stop or r.s + e_ > {ov}, {d.struct(k='r.k', s='r.s', stop='true')}, "
            f"{d.struct(k='r.k + 1', s='r.s + e_', stop='false')})")
    suffix = d.reduce(d.reverse(d.last_n("cn__", str(ov + 1))), d.struct(k="0", s="0", stop="false"), "r", "e_", step)
    ov_text = d.join(d.slice("ct__", "size(ct__) - q.k + 1", "q.k"))
    whole = f"if(q.s >= {tok}, {none}, {d.let(ov_text, 'ot__', f"if(ot__ = '', {none}, {d.struct(t='ot__', n='q.s')})")})"
    tail = d.last_n("lt__", f"least(greatest({mn} - q.s, 0), {ov})")
    text = f"trim(concat({ov_text}, ' ', {d.join('tl__')}))"
    hybrid = d.let(tokens(d, d.at("ct__", "-1")), "lt__", d.let(tail, "tl__", (
        f"if(q.s + size(tl__) >= {tok}, {none}, "
        f"{d.let(text, 'ht__', f"if(ht__ = '', {none}, {d.struct(t='ht__', n='q.s + size(tl__)')})")})")))
    return f"if({tok} < {mn}, {none}, {d.let(suffix, 'q', f'if(q.s >= {mn}, {whole}, {hybrid})')})"


def _flush_spark(s: str, ov: int, mn: int) -> str:
    """Emit the buffer of state ``s`` and seed the next one.  The buffer is the seed (if ``sn`` > 0) and the
    sentences ``at`` to ``i``."""
    d = SPARK
    size = f"{s}.i - {s}.at + 1"
    texts = f"concat(if({s}.sn > 0, array({s}.seed), {d.empty('string', '')}), {d.slice('ps__', f'{s}.at', size)})"
    counts = f"concat(if({s}.sn > 0, array({s}.sn), {d.empty('int', '')}), {d.slice('pn__', f'{s}.at', size)})"
    after = d.struct(chunks=d.append(f"{s}.chunks", f"trim({d.join('ct__')})"), seed="o.t", sn="o.n", at=f"{s}.i + 1", i=f"{s}.i", tok="o.n")
    seeded = d.let(texts, "ct__", d.let(counts, "cn__", d.let(_seed_spark(f"{s}.tok", ov, mn), "o", after)))
    return f"if({s}.sn = 0 and {s}.at > {s}.i, {s}, {seeded})"


def pack_spark(sents: str, target: int = TARGET_TOKENS, mx: int = MAX_TOKENS,
               ov: int = OVERLAP_TOKENS, mn: int = MIN_OVERLAP_TOKENS) -> str:
    """C06 for Spark: array<string> of stripped, non-blank sentences -> array<string>.  ``ps__`` are the sentences and
    ``pn__`` their token counts; state: chunks, seed and its tokens, the buffer's first sentence, sentences
    seen, the buffer's tokens."""
    d = SPARK
    state = lambda chunks, seed, sn, at, tok, i="s.i + 1": d.struct(
        chunks=chunks, seed=seed, sn=sn, at=at, i=i, tok=tok)
    add = lambda s: state(f"{s}.chunks", f"{s}.seed", f"{s}.sn", f"{s}.at", f"{s}.tok + n", f"{s}.i + 1")
    # Case A: one sentence longer than max -> flush, token-split, seed with its tail.
    parts = d.transform(d.seq("0", d.idiv("n - 1", str(mx))), "j", d.slice("xt__", f"j * {mx} + 1", str(mx)))
    kept = d.last_n(d.at("p", "-1"), str(ov))
    seeds = f"size(sd) > 0 and size(sd) >= {mn}" if ov > 0 else "false"
    case_a = d.let(_flush_spark("s", ov, mn), "f", d.let(tokens(d, d.at("ps__", "s.i + 1")), "xt__", d.let(
        parts, "p", d.let(kept, "sd", state(d.concat("f.chunks", d.transform("p", "pp", d.join("pp"))),
                                            f"if({seeds}, {d.join('sd')}, '')", f"if({seeds}, size(sd), 0)",
                                            "s.i + 2", f"if({seeds}, size(sd), 0)")))))
    # Case B (retry after flush, at most twice) then case C (add, soft flush at target).
    case_c = d.let(add("s2"), "s3", f"if(s3.tok >= {target}, {_flush_spark('s3', ov, mn)}, s3)")
    case_b = d.let(f"if(s.tok + n > {mx}, {_flush_spark('s', ov, mn)}, s)", "s1",
                   d.let(f"if(s1.tok + n > {mx}, {_flush_spark('s1', ov, mn)}, s1)", "s2", case_c))
    # most sentences neither overflow the buffer nor fill it
    step = f"if(s.tok + n < {target} and s.tok + n <= {mx}, {add('s')}, if(n > {mx}, {case_a}, {case_b}))"
    init = state(d.empty("string", ""), "''", "0", "1", "0", "0")
    folded = f"aggregate(pn__, {init}, (s, n) -> {step}, z -> {d.let(_flush_spark('z', ov, mn), 'w', 'w.chunks')})"
    return d.let(sents, "ps__", d.let(d.transform("ps__", "y", d.size(tokens(d, "y"))), "pn__", folded))


def sentence_structs(d: Dialect, sents: str) -> str:
    """array<string> of sentences -> array<struct<t, toks>> with default tokens."""
    return d.transform(sents, "y", _sent(d, "y", tokens(d, "y")))
