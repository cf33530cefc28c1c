"""Vector expressions shared by Spark and the DuckDB oracle.

Inner products and norms are accumulated in double, left to right, so both
engines produce the same bits before any rounding.
"""

from __future__ import annotations

import string

from textmill.functions.sqltext import Dialect
from textmill.functions.text import tokens

DIM = 64
#: One character a bucket, in the order that they sort in.
CODES = "".join(sorted(string.ascii_letters + string.digits + "+-"))


def dot(d: Dialect, a: str, b: str) -> str:
    if d.spark:
        return (f"aggregate(zip_with({a}, {b}, (x_, y_) -> cast(x_ as double) * cast(y_ as double)), "
                f"0D, (s_, v_) -> s_ + v_)")
    return (f"list_reduce(list_transform(list_zip({a}, {b}), lambda p_: cast(p_[1] AS DOUBLE) * "
            f"cast(p_[2] AS DOUBLE)), lambda s_, v_: s_ + v_, 0::DOUBLE)")


def l2_normalise(d: Dialect, v: str) -> str:
    """V / ||v||; a zero vector stays zero.  ``v`` is bound once (it is often an
    expensive expression such as the hashing encoder)."""
    zero = "0D" if d.spark else "0::DOUBLE"
    dbl = "double" if d.spark else "DOUBLE"
    body = d.let(dot(d, "v__", "v__"), "n_", d.transform("v__", "x_", f"if(n_ = 0, {zero}, cast(x_ as {dbl}) / sqrt(n_))"))
    return d.let(v, "v__", body)


def hex_bucket(d: Dialect, md5: str, dim: int = DIM) -> str:
    """Feature-hashing bucket of an md5 in hex: its first 32 bits mod dim."""
    if not d.spark:
        return f"cast((('0x' || substr({md5}, 1, 8))::BIGINT) % {dim} AS INTEGER)"
    if dim <= 256 and dim & (dim - 1) == 0:  # the low bits are those of the last two digits, found by their place
        low, high = (f"instr('123456789abcdef', substr({md5}, {i}, 1))" for i in (8, 7))
        return f"(({high} * 16 + {low}) & {dim - 1})"
    return f"cast(pmod(cast(conv(substr({md5}, 1, 8), 16, 10) as bigint), {dim}) as int)"


def token_buckets(d: Dialect, text: str, dim: int, code) -> str:
    """What ``code`` makes of the bucket of each token."""
    if d.spark:  # hashed in a pass of its own, so that each is hashed once
        return d.transform(d.transform(tokens(d, text), "t_", "md5(t_)"), "h_", code(hex_bucket(d, "h_", dim)))
    return d.transform(tokens(d, text), "t_", code(hex_bucket(d, "md5(t_)", dim)))


def hashing_counts(d: Dialect, text: str, dim: int = DIM) -> str:
    """E02 default encoder, before normalisation: token counts per hash bucket."""
    if d.spark and dim <= len(CODES):
        # each token becomes one character; sorted together with every character once, they are one
        # run a bucket, in the buckets' order
        codes = token_buckets(d, text, dim, lambda b: f"substr('{CODES}', {b} + 1, 1)")
        runs = rf"regexp_extract_all(array_join(sort_array(concat({codes}, split('{CODES[:dim]}', ''))), ''), '(.)\\1*', 0)"
        return d.transform(runs, "r_", "cast(length(r_) - 1 as double)")
    # each token becomes one character (U+00C0 + bucket); a bucket's count is how much
    # shorter the code string gets when that character is removed (native replace, no
    # per-token lambda per bucket)
    codes = d.join(token_buckets(d, text, dim, lambda b: f"chr({d.cast_int('192 + ' + b)})"), "''")
    cnt = f"length(bs_) - length(replace(bs_, chr({d.cast_int('192 + i_')}), ''))"
    vec = d.transform(d.seq("0", str(dim - 1)), "i_", f"cast({cnt} as double)" if d.spark else f"cast({cnt} AS DOUBLE)")
    return d.let(codes, "bs_", vec)


def hashing_embedding(d: Dialect, text: str, dim: int = DIM) -> str:
    """E02 + E03: unit-norm hashed bag of tokens (array<double>)."""
    return l2_normalise(d, hashing_counts(d, text, dim))


def as_float_rounded(d: Dialect, v: str, places: int = 4) -> str:
    """Round each element after the float32 cast, the way a stored embedding is read back;
    adding zero makes a negative zero a plain one."""
    if d.spark:
        # a decimal rounding each is what costs, so zeros go without
        return d.transform(v, "x_", f"if(x_ = 0, 0.0D, round(cast(cast(x_ as float) as double), {places}) + 0.0D)")
    return d.transform(v, "x_", f"round(cast(cast(x_ AS FLOAT) AS DOUBLE), {places}) + CAST(0 AS DOUBLE)")
