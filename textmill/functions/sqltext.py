"""One expression, two SQL dialects.

The fold-style operators (chunk packer, soft-wrap merge, overlap builder) are
written once against this tiny helper and rendered as Spark SQL (run by
Catalyst through ``F.expr``) and as DuckDB SQL (used only by the oracle), so
the engine and its check cannot drift apart.  Nothing here plans or parses
queries; each method returns a string fragment.
"""

from __future__ import annotations

import re

# The white space of Python's str.isspace(), as a class body for RE2 and Python, as the
# same class for Java (which tests a property faster than a dozen ranges), and as characters.
WS_BODY = "\\t-\\r\\x1c-\\x20\\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS_JAVA = r"\p{IsWhite_Space}\x1c-\x1f"
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
            "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


class Dialect:
    def __init__(self, name: str):
        assert name in ("spark", "duck")
        self.name = name

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    # lambdas and let-binding -------------------------------------------------
    def lam(self, params: str, body: str) -> str:
        return f"({params}) -> {body}" if self.spark else f"lambda {params}: {body}"

    def let(self, expr: str, var: str, body: str) -> str:
        """Evaluate ``expr`` once and bind it to ``var`` inside ``body``."""
        if self.spark:
            return f"element_at(transform(array({expr}), {var} -> {body}), 1)"
        return f"list_transform([{expr}], lambda {var}: {body})[1]"

    # structs -----------------------------------------------------------------
    def struct(self, **kw: str) -> str:
        if self.spark:
            return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in kw.items()) + ")"
        return "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in kw.items()) + ")"

    # arrays --------------------------------------------------------------------
    def size(self, a: str) -> str:
        return f"size({a})" if self.spark else f"len({a})"

    def arr(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def empty(self, spark_type: str, duck_type: str) -> str:
        return f"cast(array() as array<{spark_type}>)" if self.spark else f"[]::{duck_type}[]"

    def at(self, a: str, i: str) -> str:
        """1-based element access; ``-1`` is the last element."""
        return f"try_element_at({a}, {i})" if self.spark else f"{a}[{i}]"

    def slice(self, a: str, start: str, length: str) -> str:
        """1-based ``start`` (>= 1), ``length`` >= 0 elements."""
        if self.spark:
            return f"slice({a}, {start}, {length})"
        return f"list_slice({a}, {start}, ({start}) + ({length}) - 1)"

    def last_n(self, a: str, n: str) -> str:
        """The last ``n`` elements (all when ``n`` exceeds the size, none when n <= 0)."""
        k = f"least(greatest({n}, 0), {self.size(a)})"
        return self.slice(a, f"{self.size(a)} - {k} + 1", k)

    def concat(self, a: str, b: str) -> str:
        return f"concat({a}, {b})" if self.spark else f"list_concat({a}, {b})"

    def append(self, a: str, x: str) -> str:
        return self.concat(a, self.arr(x))

    def flatten(self, a: str) -> str:
        return f"flatten({a})"

    def reverse(self, a: str) -> str:
        return f"reverse({a})" if self.spark else f"list_reverse({a})"

    def transform(self, a: str, var: str, body: str) -> str:
        if self.spark:
            return f"transform({a}, {var} -> {body})"
        return f"list_transform({a}, lambda {var}: {body})"

    def filter(self, a: str, var: str, body: str) -> str:
        if self.spark:
            return f"filter({a}, {var} -> {body})"
        return f"list_filter({a}, lambda {var}: {body})"

    def field(self, a: str, name: str) -> str:
        """Array of structs -> array of one field."""
        return f"{a}.{name}" if self.spark else f"list_transform({a}, lambda e__: e__.{name})"

    def reduce(self, a: str, init: str, acc: str, x: str, body: str) -> str:
        if self.spark:
            return f"aggregate({a}, {init}, ({acc}, {x}) -> {body})"
        return f"list_reduce({a}, lambda {acc}, {x}: {body}, {init})"

    def seq(self, lo: str, hi: str) -> str:
        """Inclusive integer range, empty when hi < lo."""
        if self.spark:
            return f"if(({hi}) < ({lo}), cast(array() as array<int>), sequence({lo}, {hi}))"
        return f"generate_series({lo}, {hi})"

    def join(self, a: str, sep: str = "' '") -> str:
        return f"array_join({a}, {sep})" if self.spark else f"array_to_string({a}, {sep})"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def cast_int(self, a: str) -> str:
        return f"cast({a} as int)" if self.spark else f"cast({a} as integer)"

    # regex -----------------------------------------------------------------------
    def lit(self, s: str) -> str:
        """A string literal: Spark unescapes backslashes inside literals, DuckDB does not."""
        if self.spark:
            return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "'" + s.replace("'", "''") + "'"

    def rx(self, pattern: str) -> str:
        """A pattern literal, its white space written for the engine."""
        return self.lit(pattern.replace(WS_BODY, WS_JAVA) if self.spark else pattern)

    def rx_replace(self, s: str, pattern: str, repl: str) -> str:
        """Global replace; ``repl`` uses ``$1`` style groups (translated for DuckDB)."""
        if self.spark:
            return f"regexp_replace({s}, {self.rx(pattern)}, {self.lit(repl)})"
        return (f"regexp_replace({s}, {self.lit(pattern)}, "
                f"{self.lit(re.sub(r'[$](\d)', lambda m: chr(92) + m.group(1), repl))}, 'g')")

    def rx_like(self, s: str, pattern: str) -> str:
        if self.spark:
            return f"({s} rlike {self.rx(pattern)})"
        return f"regexp_matches({s}, {self.lit(pattern)})"

    def trim(self, s: str, side: str = "both") -> str:
        """Without white space at both ends, or at the trailing one."""
        chars = self.lit(WS_CHARS)
        if self.spark:
            return f"btrim({s}, {chars})" if side == "both" else f"trim(trailing {chars} from {s})"
        return f"{'trim' if side == 'both' else 'rtrim'}({s}, {chars})"

    def rx_all(self, s: str, pattern: str) -> str:
        if self.spark:
            return f"regexp_extract_all({s}, {self.rx(pattern)}, 0)"
        return f"regexp_extract_all({s}, {self.lit(pattern)})"


SPARK = Dialect("spark")
DUCK = Dialect("duck")
