"""Analytics over agent / session logs.

The reference runs its agent loop interactively; what a Spark user runs is the
batch side: parse the decisions a model wrote, classify them, cap and number
steps, render scratchpads, attach feedback to runs, screen SQL, and keep user
and session tables.  Runs are (user, day) groups ordered by (ts, event_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmill.functions.sqltext import SPARK

# Fixed values of the reference's agent: tool names are the caller's; the
# limits and labels are the reference's defaults.
MAX_STEPS = 8
OBS_LIMIT = 1500
STEP_LOG_LIMIT = 500
TRUNC_SUFFIX = " ... [truncated]"
INTENTS = ("POSITIVE_FEEDBACK", "NEGATIVE_FEEDBACK", "CONTINUATION")
DEFAULT_INTENT = "CONTINUATION"
SOURCE_SQL_MAX, SANDBOX_SQL_MAX = 3000, 5000
READ_ONLY_KEYWORDS = ("select", "with", "explain")

def _parse_obj(s: str) -> str:
    """SQL: the JSON object that ``s`` is as a whole, else null; ``s`` is parsed once.

    Spark's JSON readers stop after the first value, so it is read as the first of two elements:
    the second, the text's own digest, is only there if nothing else follows the first."""
    mark = f"md5({s})"
    whole = f"try_parse_json(concat('[', {s}, ',\"', {mark}, '\"]'))"
    first = f"if(variant_get(w_, '$[1]', 'string') = {mark}, variant_get(w_, '$[0]', 'variant'), null)"
    return f"if(startswith(btrim({s}, ' \\t\\r\\n'), '{{'), {SPARK.let(whole, 'w_', first)}, null)"


def parse_decision(raw: Column | str) -> Column:
    """The JSON object in ``raw``; else the text from the first '{' to the last '}'
    parsed again; else null.  Fields are read as strings."""
    r = raw if isinstance(raw, str) else None
    if r is None:
        raise TypeError("pass the column name")
    inner = f"regexp_extract({r}, '(?s)\\\\{{.*\\\\}}', 0)"
    v = f"coalesce({_parse_obj(r)}, {_parse_obj(inner)})"
    fields = ", ".join(f"'{k}', variant_get(v_, '$.{k}', 'string')" for k in ("type", "tool", "input", "answer"))
    return F.expr(f"element_at(transform(array({v}), v_ -> if(v_ is null, null, named_struct({fields}))), 1)")


def classify_decision(decision: str, tools: list[str]) -> Column:
    """Final / action / invalid_tool / unknown_type / parse_error."""
    d = F.col(decision)
    return (F.when(d.isNull(), "parse_error")
            .when(d["type"] == "final", "final")
            .when((d["type"] == "action") & d["tool"].isin(*tools), "action")
            .when(d["type"] == "action", "invalid_tool")
            .otherwise("unknown_type"))


def truncate(c: Column, limit: int = OBS_LIMIT, suffix: str = TRUNC_SUFFIX) -> Column:
    """A03."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(suffix))).otherwise(c)


def runs(events: DataFrame, user: str = "user_id", ts: str = "ts", order: str = "event_id",
         skew_safe: bool = False) -> DataFrame:
    """Steps numbered 1.. within each run (user, day).  ``skew_safe`` numbers a run
    that holds a large share of all events across many tasks
    (``relational.keyed_row_number``) instead of one window partition."""
    ev = events.withColumn("run_day", F.to_date(ts))
    if skew_safe:
        from textmill.operators.relational import keyed_row_number

        return keyed_row_number(ev.sparkSession, ev, [user, "run_day"], [ts, order], name="step_no")
    w = W.partitionBy(user, "run_day").orderBy(ts, order)
    return ev.withColumn("step_no", F.row_number().over(w).cast("int"))


def capped_steps(events: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """The first ``max_steps`` steps of each run.  ``row_number() <= k`` lets Spark
    place a WindowGroupLimit before the shuffle, so a huge run sends only k rows."""
    return runs(events).filter(F.col("step_no") <= max_steps)


def scratchpad(steps: DataFrame, keys: list[str], tool: str, inp: str, obs: str) -> DataFrame:
    """Numbered Step/Action/Input/Observation text per run (steps already capped)."""
    g = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("step_no", tool, inp, obs))).alias("_s"))
    txt = F.transform("_s", lambda s: F.concat(
        F.lit("Step "), s["step_no"].cast("string"), F.lit(":\nAction: "), s[tool], F.lit("\nInput: "), s[inp],
        F.lit("\nObservation: "), s[obs]))
    return g.select(*keys, F.array_join(txt, "\n").alias("scratchpad"))


def once_policy(steps: DataFrame, keys: list[str], tool: str) -> DataFrame:
    """A10: a tool used a second time in the same run is a violation.

    The first use per (run, tool) is a partial-aggregating ``min`` rather than a
    window over the group, so a run with a huge number of steps is pre-combined
    map-side; the join back is an equi-join AQE can split if one key is hot."""
    first = steps.groupBy(*keys, tool).agg(F.min("step_no").alias("_first"))
    return steps.join(first, [*keys, tool]).withColumn("violation", F.col("step_no") > F.col("_first")) \
        .drop("_first")


def intent_clamp(label: Column) -> Column:
    """Anything outside the three labels becomes CONTINUATION."""
    return F.when(label.isin(*INTENTS), label).otherwise(F.lit(DEFAULT_INTENT))


def attach_to_last_run(df: DataFrame, session: str, order: str, run_col: str) -> DataFrame:
    """Carry the latest run id forward (as-of within a session)."""
    w = W.partitionBy(session).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("last_run", F.last(run_col, ignorenulls=True).over(w))


#: What a statement's words do not include: comments, string literals, quoted names.
QUOTED_RE = r"""--[^\n]*|/\*(?s:.*?)\*/|'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+"|`[^`]*`"""
#: A write behind a common table expression or an EXPLAIN.
INNER_WRITE_RE = (r"(?i)(?:\)|^\s*explain(?:\s+(?:analyze|extended|formatted|codegen|cost))?)\s*"
                  r"(insert\s+(?:into|overwrite)|delete\s+from|merge\s+into|update\s+[\w.]+\s+set"
                  r"|drop|alter|truncate|create|grant|revoke)\b")


def screen_sql(sql: Column, max_len: int = SOURCE_SQL_MAX) -> Column:
    """too_long / allowed / blocked:<word> / empty.  Every statement of the text must read
    only; the first that does not gives the word.  Null stays null."""
    def offence(statement):
        first = F.lower(F.regexp_extract(statement, r"^[\s(]*([A-Za-z]*)", 1))
        inner = F.lower(F.regexp_extract(statement, INNER_WRITE_RE, 1))
        return F.when(~first.isin(*READ_ONLY_KEYWORDS), first) \
            .when(inner != "", F.regexp_extract(inner, r"^[a-z]+", 0))

    statements = F.filter(F.split(F.regexp_replace(sql, QUOTED_RE, " "), ";"), lambda x: x.rlike(r"\S"))
    offences = F.filter(F.transform(statements, offence), lambda x: x.isNotNull())
    return (F.when(F.length(sql) > max_len, "too_long")
            .when(F.size(statements) == 0, "empty")
            .when(F.size(offences) == 0, "allowed")
            .when(sql.isNotNull(), F.concat(F.lit("blocked:"), F.try_element_at(offences, F.lit(1)))))


def _one_per_key(rows: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """One row per key: of several the greatest in ``cols``, nulls least."""
    return rows.groupBy(key).agg(F.max(F.struct(*cols)).alias("_m")).select(key, *[F.col("_m")[c].alias(c) for c in cols])


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Put rows only for keys not present, one row for each new key."""
    new = rows.join(table.select(key), key, "left_anti")
    return table.unionByName(_one_per_key(new, key, [c for c in table.columns if c != key]))


def keyed_update(table: DataFrame, updates: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Per-column update from the matching update row (left join + coalesce); several
    updates of one key count as one, so that no row of the table is doubled."""
    u = _one_per_key(updates, key, cols).select(key, *[F.col(c).alias("_u_" + c) for c in cols])
    j = table.join(u, key, "left")
    return j.select(*[F.coalesce(F.col("_u_" + c), F.col(c)).alias(c) if c in cols else F.col(c)
                      for c in table.columns])
