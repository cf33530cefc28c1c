"""Agent, session and SQL-log analytics (A01-A13, U01-U03) over ``events`` and
``conversations``.

Derivations (identical in Spark and the oracle):
* a run is (user_id, day); its steps are its events ordered by (ts, event_id);
  the tool of a step is ``event_type``, its input ``props.k``, its observation
  ``value=<value>``;
* a model decision string is built from each event in six shapes (clean JSON,
  JSON in prose, two objects, no braces, null, unknown type);
* in ``conversations`` every assistant turn is a run; a later user turn whose
  text length is even is positive feedback, odd negative.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmill.operators import logs as lg
from textmill.operators import relational as rel
from textmill.plans.registry import register
from textmill.session import read_table

TOOLS = ["click", "view", "purchase", "signup"]


def _ev(spark, sf):
    return read_table(spark, sf, "events")


RAW_SPARK = """CASE event_id % 6
  WHEN 0 THEN concat('{"type": "action", "tool": "', event_type, '", "input": "', get_json_object(props, '$.k'), '"}')
  WHEN 1 THEN concat('I will answer. {"type": "final", "answer": "', cast(round(value, 1) as string), '"} Thanks.')
  WHEN 2 THEN '{"type": "action", "tool": "view", "input": "1"} {"type": "final", "answer": "x"}'
  WHEN 3 THEN concat('no braces here: ', event_type)
  WHEN 4 THEN NULL
  ELSE concat('{"type": "', event_type, '", "tool": "click"}') END"""
RAW_DUCK = """CASE event_id % 6
  WHEN 0 THEN '{"type": "action", "tool": "' || event_type || '", "input": "' || json_extract_string(props, '$.k') || '"}'
  WHEN 1 THEN 'I will answer. {"type": "final", "answer": "' || cast(round(value, 1) AS VARCHAR) || '"} Thanks.'
  WHEN 2 THEN '{"type": "action", "tool": "view", "input": "1"} {"type": "final", "answer": "x"}'
  WHEN 3 THEN 'no braces here: ' || event_type
  WHEN 4 THEN NULL
  ELSE '{"type": "' || event_type || '", "tool": "click"}' END"""

_INNER_D = "regexp_extract(raw, '\\{.*\\}')"
_OBJ_D = ("CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw "
          f"WHEN json_valid({_INNER_D}) AND json_type({_INNER_D}) = 'OBJECT' THEN {_INNER_D} END")
DECISIONS_D = f"""(SELECT event_id, event_type, o,
    json_extract_string(o, '$.type') AS type, json_extract_string(o, '$.tool') AS tool,
    json_extract_string(o, '$.input') AS input, json_extract_string(o, '$.answer') AS answer
  FROM (SELECT event_id, event_type, {_OBJ_D} AS o FROM (SELECT event_id, event_type, {RAW_DUCK} AS raw FROM events)))"""


def _decisions(spark, sf):
    ev = _ev(spark, sf).withColumn("raw", F.expr(RAW_SPARK))
    return ev.withColumn("d", lg.parse_decision("raw"))


@register("parse_decision", oracle=f"SELECT event_id, type, tool, input, answer FROM {DECISIONS_D}")
def parse_decision(spark, sf):
    d = _decisions(spark, sf)
    return d.select("event_id", "d.type", "d.tool", "d.input", "d.answer")


@register("classify_decision", oracle=f"""
  SELECT event_id, CASE WHEN o IS NULL THEN 'parse_error' WHEN type = 'final' THEN 'final'
                        WHEN type = 'action' AND tool IN ('click', 'view', 'purchase', 'signup') THEN 'action'
                        WHEN type = 'action' THEN 'invalid_tool' ELSE 'unknown_type' END AS kind
  FROM {DECISIONS_D}""")
def classify_decision(spark, sf):
    return _decisions(spark, sf).select("event_id", lg.classify_decision("d", TOOLS).alias("kind"))


@register("truncate_obs", oracle="""
  SELECT conv_id, turn, length(text) AS n_chars,
         CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || ' ... [truncated]' ELSE text END AS observation,
         substr(text, 1, 500) AS step_log
  FROM conversations""")
def truncate_obs(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.length("text").alias("n_chars"),
                    lg.truncate(F.col("text")).alias("observation"),
                    F.substring("text", 1, lg.STEP_LOG_LIMIT).alias("step_log"))


_STEPS_D = """(SELECT user_id, cast(ts AS DATE) AS run_day, event_id, event_type, value, props,
     cast(row_number() OVER (PARTITION BY user_id, cast(ts AS DATE) ORDER BY ts, event_id) AS INTEGER) AS step_no
   FROM events)"""


def _steps(spark, sf):
    return lg.runs(_ev(spark, sf)).withColumn("input", F.get_json_object("props", "$.k")) \
        .withColumn("obs", F.concat(F.lit("value="), F.format_number("value", 2)))


@register("scratchpad", oracle=f"""
  SELECT user_id, run_day, string_agg('Step ' || step_no || ':' || chr(10) || 'Action: ' || event_type || chr(10) ||
         'Input: ' || json_extract_string(props, '$.k') || chr(10) || 'Observation: value=' || printf('%.2f', value),
         chr(10) ORDER BY step_no) AS scratchpad
  FROM {_STEPS_D} WHERE step_no <= 8 GROUP BY user_id, run_day""")
def scratchpad(spark, sf):
    s = _steps(spark, sf).filter(F.col("step_no") <= lg.MAX_STEPS)
    return lg.scratchpad(s, ["user_id", "run_day"], "event_type", "input", "obs")


@register("conversation_messages", oracle="""
  SELECT conv_id, 0 AS msg_no, 'system' AS role, 'You answer questions about data.' AS content FROM
    (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS msg_no, role, text
  FROM conversations""")
def conversation_messages(spark, sf):
    """A05 as ordered rows (system first, then history by turn; the last user turn ends it)."""
    c = read_table(spark, sf, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    hist = c.select("conv_id", F.row_number().over(w).cast("int").alias("msg_no"), "role", F.col("text").alias("content"))
    system = c.select("conv_id").distinct().select(
        "conv_id", F.lit(0).alias("msg_no"), F.lit("system").alias("role"),
        F.lit("You answer questions about data.").alias("content"))
    return system.unionByName(hist)


@register("audit_runs", oracle=f"""
  SELECT user_id, run_day, count(*) AS steps_count, list(event_type ORDER BY step_no) FILTER (step_no <= 8) AS tools_used,
         CASE WHEN arg_max(event_type, step_no) = 'purchase' THEN 'final'
              WHEN count(*) > 8 THEN 'max_steps' ELSE 'open' END AS terminated
  FROM {_STEPS_D} GROUP BY user_id, run_day""")
def audit_runs(spark, sf):
    """The tool of each kept step in order, repeats included, beside the counts of the whole run."""
    ev = _ev(spark, sf).withColumn("run_day", F.to_date("ts"))
    keys = ["user_id", "run_day"]
    g = ev.groupBy(*keys).agg(F.count("*").alias("steps_count"),
                              F.max_by("event_type", F.struct("ts", "event_id")).alias("_last"))
    kept = ev.withColumn("_no", F.row_number().over(W.partitionBy(*keys).orderBy("ts", "event_id"))) \
        .filter(F.col("_no") <= lg.MAX_STEPS).groupBy(*keys) \
        .agg(F.array_sort(F.collect_list(F.struct("_no", "event_type"))).alias("_steps"))
    return g.join(kept, keys).select(
        *keys, "steps_count", F.col("_steps.event_type").alias("tools_used"),
        F.when(F.col("_last") == "purchase", "final").when(F.col("steps_count") > lg.MAX_STEPS, "max_steps")
        .otherwise("open").alias("terminated"))


@register("audit_steps", oracle=f"""
  SELECT user_id, run_day, step_no, event_type AS tool, json_extract_string(props, '$.k') AS input,
         substr('value=' || printf('%.2f', value), 1, 500) AS observation FROM {_STEPS_D}""")
def audit_steps(spark, sf):
    """Every step numbered; a run holding a large share of events is split over tasks."""
    s = lg.runs(_ev(spark, sf), skew_safe=True).withColumn("input", F.get_json_object("props", "$.k")) \
        .withColumn("obs", F.concat(F.lit("value="), F.format_number("value", 2)))
    return s.select("user_id", "run_day", "step_no", F.col("event_type").alias("tool"), "input",
                    F.substring("obs", 1, lg.STEP_LOG_LIMIT).alias("observation"))


_FEED_D = """(SELECT conv_id, turn, role, text,
     CASE WHEN role = 'assistant' THEN conv_id * 1000 + turn END AS run_id,
     CASE WHEN role = 'user' AND turn >= 2 THEN CASE WHEN length(text) % 2 = 0 THEN 1.0 ELSE 0.0 END END AS score
   FROM conversations)"""


@register("feedback_scores", oracle=f"""
  SELECT last_run AS run_id, count(*) AS n_feedback, round(avg(score), 6) AS avg_score FROM (
    SELECT *, last_value(run_id IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
                                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_run
    FROM {_FEED_D}) WHERE score IS NOT NULL AND last_run IS NOT NULL GROUP BY last_run""")
def feedback_scores(spark, sf):
    c = read_table(spark, sf, "conversations")
    c = c.withColumn("run_id", F.when(F.col("role") == "assistant", F.col("conv_id") * 1000 + F.col("turn"))) \
        .withColumn("score", F.when((F.col("role") == "user") & (F.col("turn") >= 2),
                                    F.when(F.length("text") % 2 == 0, 1.0).otherwise(0.0)))
    a = lg.attach_to_last_run(c, "conv_id", "turn", "run_id")
    a = a.filter(F.col("score").isNotNull() & F.col("last_run").isNotNull())
    return a.groupBy(F.col("last_run").alias("run_id")).agg(F.count("*").alias("n_feedback"),
                                                            F.round(F.avg("score"), 6).alias("avg_score"))


_LABEL_SPARK = ("CASE substr(md5(text), 1, 1) WHEN '0' THEN 'POSITIVE_FEEDBACK' WHEN '1' THEN 'NEGATIVE_FEEDBACK' "
                "WHEN '2' THEN 'CONTINUATION' WHEN '3' THEN 'positive_feedback' WHEN '4' THEN '' "
                "ELSE concat('LABEL_', substr(md5(text), 1, 1)) END")


@register("intent_clamp", oracle=f"""
  SELECT conv_id, turn, raw_label, CASE WHEN raw_label IN ('POSITIVE_FEEDBACK', 'NEGATIVE_FEEDBACK', 'CONTINUATION')
                                        THEN raw_label ELSE 'CONTINUATION' END AS intent
  FROM (SELECT conv_id, turn, {_LABEL_SPARK.replace('concat(', '(').replace(", substr(md5(text), 1, 1))", " || substr(md5(text), 1, 1))")} AS raw_label
        FROM conversations WHERE role = 'user')""")
def intent_clamp(spark, sf):
    c = read_table(spark, sf, "conversations").filter(F.col("role") == "user")
    c = c.select("conv_id", "turn", F.expr(_LABEL_SPARK).alias("raw_label"))
    return c.withColumn("intent", lg.intent_clamp(F.col("raw_label")))


@register("policy_once", oracle=f"""
  SELECT user_id, run_day, step_no, event_type,
         row_number() OVER (PARTITION BY user_id, run_day, event_type ORDER BY step_no) > 1 AS violation
  FROM {_STEPS_D}""")
def policy_once(spark, sf):
    s = lg.once_policy(lg.runs(_ev(spark, sf), skew_safe=True), ["user_id", "run_day"], "event_type")
    return s.select("user_id", "run_day", "step_no", "event_type", "violation")


@register("step_cap", oracle=f"""
  SELECT user_id, run_day, count(*) FILTER (WHERE step_no <= 8) AS kept_steps,
         max(step_no) > 8 AS hit_max_steps FROM {_STEPS_D} GROUP BY user_id, run_day""")
def step_cap(spark, sf):
    n = F.count("*")
    return _ev(spark, sf).groupBy("user_id", F.to_date("ts").alias("run_day")).agg(
        F.least(n, F.lit(lg.MAX_STEPS).cast("long")).alias("kept_steps"), (n > lg.MAX_STEPS).alias("hit_max_steps"))


_SQL_SPARK = """CASE event_type
  WHEN 'click' THEN concat('SELECT * FROM data WHERE k = ', get_json_object(props, '$.k'))
  WHEN 'view' THEN CASE event_id % 4 WHEN 0 THEN '  with t AS (SELECT 1 AS x) SELECT x FROM t'
    WHEN 1 THEN '(SELECT "a;b" AS x)' WHEN 2 THEN '/* two; */ SELECT 1 ; SELECT 2;'
    ELSE 'WITH t AS (SELECT 1) INSERT INTO data SELECT * FROM t' END
  WHEN 'purchase' THEN concat('INSERT INTO data VALUES (', get_json_object(props, '$.k'), ')')
  WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'DROP TABLE data' WHEN 1 THEN 'SELECT 1; DROP TABLE data'
    ELSE ' ; /* nothing */' END
  ELSE repeat('SELECT 1 UNION ALL ', cast(100 + event_id % 200 AS INT)) END"""
_SQL_DUCK = _SQL_SPARK.replace("get_json_object(", "json_extract_string(").replace("AS INT)", "AS INTEGER)")


@register("screen_sql_log", oracle=f"""
  SELECT event_id, length(q) AS n_chars,
         CASE WHEN length(q) > 3000 THEN 'too_long'
              WHEN event_type = 'purchase' THEN 'blocked:insert'
              WHEN event_type = 'view' AND event_id % 4 = 3 THEN 'blocked:insert'
              WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 2 THEN 'empty' ELSE 'blocked:drop' END
              ELSE 'allowed' END AS verdict
  FROM (SELECT event_id, event_type, {_SQL_DUCK} AS q FROM events)""")
def screen_sql_log(spark, sf):
    e = _ev(spark, sf).select("event_id", F.expr(_SQL_SPARK).alias("q"))
    return e.select("event_id", F.length("q").alias("n_chars"), lg.screen_sql(F.col("q")).alias("verdict"))


# --- users and sessions ------------------------------------------------------------------------
@register("insert_if_absent", oracle="""
  SELECT user_id, min(ts) AS created_at FROM events WHERE user_id % 3 = 0 GROUP BY user_id
  UNION ALL
  SELECT user_id, min(ts) FROM events WHERE event_type = 'signup' AND user_id % 3 <> 0 GROUP BY user_id""")
def insert_if_absent(spark, sf):
    ev = _ev(spark, sf)
    table = ev.filter(F.col("user_id") % 3 == 0).groupBy("user_id").agg(F.min("ts").alias("created_at"))
    signups = ev.filter(F.col("event_type") == "signup").groupBy("user_id").agg(F.min("ts").alias("created_at"))
    return lg.insert_if_absent(table, signups, "user_id")


@register("session_valid", oracle="""
  SELECT event_id, user_id, expires_at, revoked, next_ts,
         NOT revoked AND next_ts IS NOT NULL AND next_ts < expires_at AS valid FROM (
    SELECT event_id, user_id, ts + to_seconds(cast(floor(value * 60) AS BIGINT)) AS expires_at, event_type = 'error' AS revoked,
           lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events)""")
def session_valid(spark, sf):
    ev = _ev(spark, sf)
    # a user with half of all events spans as many slices as the rows fill
    ev = rel.keyed_lead(ev.select("event_id", "user_id", "ts", "event_type", "value"), ["user_id"], ["ts", "event_id"], "ts", "next_ts")
    s = ev.select("event_id", "user_id",
                  (F.col("ts") + F.make_dt_interval(secs=F.floor(F.col("value") * 60))).alias("expires_at"),
                  (F.col("event_type") == "error").alias("revoked"), "next_ts")
    return s.withColumn("valid", ~F.col("revoked") & F.col("next_ts").isNotNull() & (F.col("next_ts") < F.col("expires_at")))


@register("keyed_update", oracle="""
  SELECT s.user_id, coalesce(u.token_hash, s.token_hash) AS token_hash, coalesce(u.ip, s.ip) AS ip,
         coalesce(u.revoked, s.revoked) AS revoked
  FROM (SELECT user_id, sha256('first:' || min(event_id)) AS token_hash, '10.0.0.' || (user_id % 250) AS ip,
               false AS revoked FROM events GROUP BY user_id) s
  LEFT JOIN (SELECT user_id, sha256('rot:' || max(event_id)) AS token_hash, '10.1.0.' || (max(event_id) % 250) AS ip,
                    bool_or(event_type = 'error') AS revoked FROM events WHERE event_type IN ('click', 'error')
             GROUP BY user_id) u ON s.user_id = u.user_id""")
def keyed_update(spark, sf):
    ev = _ev(spark, sf)
    sessions = ev.groupBy("user_id").agg(F.min("event_id").alias("_f")).select(
        "user_id", F.sha2(F.concat(F.lit("first:"), F.col("_f").cast("string")), 256).alias("token_hash"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("ip"), F.lit(False).alias("revoked"))
    upd = ev.filter(F.col("event_type").isin("click", "error")).groupBy("user_id").agg(
        F.max("event_id").alias("_m"), F.bool_or(F.col("event_type") == "error").alias("revoked")).select(
        "user_id", F.sha2(F.concat(F.lit("rot:"), F.col("_m").cast("string")), 256).alias("token_hash"),
        F.concat(F.lit("10.1.0."), (F.col("_m") % 250).cast("string")).alias("ip"), "revoked")
    return lg.keyed_update(sessions, upd, "user_id", ["token_hash", "ip", "revoked"])
