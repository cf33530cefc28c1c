"""A01/A12 guards, as-of / interval joins and global row numbers against brute force."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from textmill.operators import logs as lg
from textmill.operators import relational as rel
from textmill.sources import files as fs


def _py_decision(raw):
    def obj(s):
        try:
            v = json.loads(s)
        except Exception:  # noqa: BLE001
            return None
        return v if isinstance(v, dict) else None
    if raw is None:
        return None
    d = obj(raw)
    if d is None and "{" in raw and "}" in raw:
        d = obj(raw[raw.index("{"): raw.rindex("}") + 1])
    return None if d is None else d.get("type")


def test_parse_decision_of_a_long_and_a_deep_answer(spark):
    answer = 'x\\"' * 300_000
    deep = '{"type": "final", "answer": ' + "[" * 200 + "]" * 200 + "}"
    df = spark.createDataFrame([(1, '{"type": "final", "answer": "' + answer + '"}'), (2, deep)], "i int, raw string")
    got = df.select("i", lg.parse_decision("raw").alias("d")).select("i", "d.type", F.length("d.answer").alias("n")) \
        .orderBy("i").collect()
    assert [(r.type, r.n) for r in got] == [("final", 600_000), ("final", 400)]


def test_parse_decision_shapes(spark):
    raws = ['{"type": "action", "tool": "view", "input": "1"}', 'Sure. {"type": "final", "answer": "42"} bye',
            '{"type": "a"} {"type": "b"}', "no braces", None, '[1, 2]', '{"type": 5}', '  {"type": "final"}  ']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = [r.t for r in df.select("i", lg.parse_decision("raw").alias("d")).orderBy("i")
           .select(F.col("d.type").alias("t")).collect()]
    assert got == [None if _py_decision(r) is None else str(_py_decision(r)) for r in raws]


def test_guarded_sql_refuses_writes(spark):
    spark.range(5).createOrReplaceTempView("data")
    assert fs.query_source(spark, "SELECT count(*) AS n FROM data").first().n == 5
    for bad in ["DROP TABLE data", "INSERT INTO data VALUES (1)", "select 1; drop table data",
                "WITH t AS (SELECT 1) INSERT INTO data SELECT * FROM t", "x" * 3001]:
        with pytest.raises(fs.GuardError):
            fs.query_source(spark, bad)


def test_guarded_sql_reads_words_not_literals(spark):
    spark.createDataFrame([("a;b", 1)], "event string, command int").createOrReplaceTempView("data")
    for good in ["(SELECT 1 AS n)", "-- note; more\nSELECT command FROM data", "SELECT command FROM data WHERE event = 'a;b';",
                 "EXPLAIN SELECT command FROM data", "WITH t AS (SELECT 'insert into x' AS s) SELECT s FROM t"]:
        assert fs.query_source(spark, good).count() == 1
    for bad in ["SELECT nothing FROM data", "EXPLAIN DROP TABLE data", "/* x */", "SELECT 1; SELECT 2",
                "WITH t AS (SELECT r'\\') INSERT INTO data SELECT 'x', 1 --'"]:
        with pytest.raises(fs.GuardError):
            fs.query_source(spark, bad)


def test_sql_log_screen(spark):
    cases = [("SELECT 1; DROP TABLE data", "blocked:drop"), ("(SELECT 1)", "allowed"), ("", "empty"), (" ; -- x", "empty"),
             ("WITH t AS (SELECT 1) INSERT INTO d SELECT * FROM t", "blocked:insert"), ("SELECT 'x; DROP TABLE d'", "allowed"),
             ("EXPLAIN DELETE FROM d", "blocked:delete"), ("/* a; */ select 1; select 2;", "allowed"), ("x" * 3001, "too_long"),
             ("SELECT 'it\\'s; DROP'", "allowed"), (None, None), ("1 + 1", "blocked:")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, q string")
    assert [r.v for r in df.select("i", lg.screen_sql(F.col("q")).alias("v")).orderBy("i").collect()] == [c[1] for c in cases]


def test_sandbox_sql_stays_in_its_database(spark):
    one, two = fs.Sandbox(spark, "sqlone"), fs.Sandbox(spark, "sqltwo")
    try:
        one.sql("CREATE TABLE t AS SELECT 7 AS x")
        assert [r.table_name for r in one.tables().collect()] == ["t"] and two.tables().count() == 0
        assert one.sql("SELECT x FROM t").first().x == 7
        for bad in [f"SELECT * FROM {one.db}.t", f"DROP DATABASE {one.db} CASCADE", f"USE {one.db}", "CREATE TABLE default.leak (x int)",
                    f"INSERT INTO `{one.db}`.`t` VALUES (1)", "SELECT * FROM parquet.`/tmp/x`", "x" * 5001]:
            with pytest.raises(fs.GuardError):
                two.sql(bad)
        assert spark.catalog.currentDatabase() == "default"
    finally:
        one.drop()
        two.drop()


def _ts(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_asof_join_matches_brute_force(spark):
    rnd = random.Random(5)
    left = [(i, rnd.randint(0, 3), _ts(rnd.randint(0, 400))) for i in range(150)]
    right = [(1000 + i, rnd.randint(0, 3), _ts(rnd.randint(0, 400)), float(i)) for i in range(120)]
    l_df = spark.createDataFrame(left, "event_id long, user_id long, ts timestamp")
    r_df = spark.createDataFrame(right, "r_id long, user_id long, r_ts timestamp, r_value double")
    out = rel.asof_join(l_df, r_df, "user_id", "ts", "r_ts", ["r_id", "r_value"], "event_id", "r_id",
                        bucket_seconds=37)  # small buckets: most matches cross buckets
    got = {r.event_id: r.r_id for r in out.collect()}
    for eid, u, t in left:
        cands = [(rt, rid) for rid, ru, rt, _ in right if ru == u and rt <= t]
        assert got[eid] == (max(cands)[1] if cands else None)


def test_interval_join_matches_brute_force(spark):
    rnd = random.Random(9)
    a = [(i, rnd.randint(0, 2), _ts(rnd.randint(0, 3000))) for i in range(80)]
    b = [(i, rnd.randint(0, 2), _ts(rnd.randint(0, 3000))) for i in range(80)]
    adf = spark.createDataFrame(a, "event_id long, user_id long, ts timestamp")
    bdf = spark.createDataFrame(b, "b_id long, b_user long, b_ts timestamp")
    got = {(r.event_id, r.b_id) for r in rel.interval_join(adf, bdf, "user_id", "b_user", "ts", "b_ts", 120).collect()}
    exp = {(i, j) for i, u, t in a for j, v, s in b if u == v and abs((t - s).total_seconds()) <= 120}
    assert got == exp


def test_global_row_number_is_contiguous(spark):
    df = spark.range(0, 1000, 3).withColumnRenamed("id", "k").repartition(7)
    rows = sorted((r.k, r.row_number) for r in rel.global_row_number(spark, df, "k", n_parts=5).collect())
    assert [n for _, n in rows] == list(range(1, len(rows) + 1))


def test_keyed_row_number_matches_window_on_a_hot_key(spark):
    from pyspark.sql import Window as W

    rnd = random.Random(4)
    rows = [(0 if rnd.random() < 0.6 else rnd.randint(1, 20), rnd.randint(0, 10 ** 6), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, t long, id long")
    got = {r.id: r.rn for r in rel.keyed_row_number(spark, df, ["k"], ["t", "id"], n_parts=6, name="rn").collect()}
    w = W.partitionBy("k").orderBy("t", "id")
    exp = {r.id: r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == exp
