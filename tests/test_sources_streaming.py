import json

from pyspark.sql import functions as F

from tessera.operators import scan
from tessera.sources import documents as D
from tessera.sources import sinks
from tessera.streaming import incremental


def test_headers(spark):
    rows = spark.createDataFrame([("登录", None, "ok"), (None, None, "x")], "`用例名称` string, step string, `Expected Result` string")
    got = D.test_cases(rows).collect()
    assert [(r.name, r.steps, r.expected, r.priority) for r in got] == [("登录", None, "ok", None)]


def test_status_lines(spark):
    lines = spark.createDataFrame([("M\tsrc/a.js",), ("R100\tsrc/b.js\tsrc/c.js",), ("D\tsrc/d.js",), ("A\tREADME.md",), ("",), (None,)], "value string")
    assert {tuple(r) for r in D.status_lines(lines).collect()} == {("modified", "src/a.js"), ("renamed", "src/c.js")}


def test_flattened(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": "x", "d": {"e": true}}}',), ("bad",), (None,)], "s string")
    rows = df.select(F.explode(D.flattened(F.try_parse_json("s"))).alias("p")).select("p.*").collect()
    assert {(r.key, r.value) for r in rows} == {("a", "1"), ("b.c", "x"), ("b.d.e", "true")}


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "file", "a"), (2, "function", None)], "id long, type string, name string")
    edges = spark.createDataFrame([(1, 2, "contains")], "src long, dst long, type string")
    sinks.save_graph(nodes, edges, str(tmp_path / "g"))
    n, e = D.load_graph(spark, str(tmp_path / "g"))
    assert {tuple(r) for r in n.collect()} == {(1, "file", "a"), (2, "function", None)}
    assert [tuple(r) for r in e.collect()] == [(1, 2, "contains")]


def test_changelog_by_day(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("b", "2024-01-02 11:00:00")], "what string, at string").withColumn("at", F.col("at").cast("timestamp"))
    sinks.append_changelog(rows, str(tmp_path / "log"))
    sinks.append_changelog(rows.limit(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 3
    assert (tmp_path / "log" / "date=2024-01-01").exists()


def test_report(spark):
    cases = spark.createDataFrame([("s<1>", "passed"), ("s<1>", "failed")], "suite string, status string")
    assert sinks.junit(sinks.test_report(cases)).first().text == '<testsuite name="s&lt;1&gt;" tests="2" failures="1" skipped="0"/>'
    assert json.loads(sinks.knowledge_record(cases.limit(1)).first().record)["suite"] == "s<1>"


FILES = "file_path string, content string, modified_at timestamp"


def issues_of(files):
    found = scan.lines(files, "file_path", "content")
    return found.where(F.col("line").contains("todo")).select("file_path", "line_no")


def test_incremental_scan_equals_a_whole_one(spark, tmp_path):
    source, state, at = (str(tmp_path / x) for x in ("in", "state", "cp"))

    def deliver(*rows):
        spark.createDataFrame([(p, c, None) for p, c in rows], FILES).withColumn("modified_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(source)
        incremental.incremental_scan(spark, source, FILES, issues_of, state, at)
        return {(r.file_path, r.line_no) for r in incremental.read_state(spark, state).where("line_no is not null").collect()}

    assert deliver(("a", "x\ntodo"), ("b", "todo")) == {("a", 2), ("b", 1)}
    assert deliver(("a", "todo\ntodo"), ("c", None)) == {("a", 1), ("a", 2), ("b", 1)}
    assert deliver(("b", "done")) == {("a", 1), ("a", 2)}


def test_learnt_triggers_over_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), {}

    def keep(batch, number):
        out.update({r.rule_id: r.triggers for r in batch.collect()})

    for _ in range(2):
        spark.createDataFrame([("R1",), ("R1",), ("R2",)], "rule_id string").coalesce(1).write.mode("append").parquet(source)
        stream = incremental.learnt_triggers(spark.readStream.schema("rule_id string").parquet(source))
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert out == {"R1": 4, "R2": 2}


def test_windowed_counts_as_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 12:00:00"), ("b", "2024-01-03 09:00:00")], "event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(source)
    stream = incremental.windowed_counts(spark.readStream.schema("event_type string, ts timestamp").parquet(source))
    stream.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {(str(r.window.start.date()), r.n) for r in spark.table("windows").collect()} == {("2024-01-01", 2)}
