"""Readers, writers and streams on small files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from graphmill.sources import files as f
from graphmill.sources import sinks as s
from graphmill.streaming import events as ev


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"tool": "x", "ok": true}\n\nnot json\n{"tool": "y", "ok": false}\n')
    assert {r.tool for r in f.json_lines(spark, str(p), "tool string, ok boolean").collect()} == {"x", "y"}


def test_node_link(spark, tmp_path):
    for name, key in (("a", "links"), ("b", "edges")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"nodes": [{"id": name, "label": "L"}], key: [{"source": name, "target": "z", "confidence_score": 0.5}]}))
    n, e = f.node_link_graph(spark, str(tmp_path))
    assert {r.id for r in n.collect()} == {"a", "b"} and {(r.source, r.confidence_score) for r in e.collect()} == {("a", 0.5), ("b", 0.5)}


def test_junit(spark, tmp_path):
    p = tmp_path / "r.xml"
    p.write_text('<testsuite name="orders"><testcase name="adds_tax" time="1.5"/><testcase name="rounds_down" time="0.25"><failure message="3 is not 4">at line 9</failure></testcase><testcase name="needs_printer"><skipped message="none here"/></testcase><testcase name="loses_link" time="2"><failure message="timeout"/><error message="socket closed"/></testcase></testsuite>')
    cases = f.junit(spark, str(p))
    assert {r.name: r.status for r in cases.collect()} == {"adds_tax": "passed", "rounds_down": "failed", "needs_printer": "skipped", "loses_link": "error"}
    assert f.junit_totals(cases).first().asDict() == {"total": 4, "passed": 1, "failed": 1, "error": 1, "skipped": 1}


def test_markdown(spark):
    df = spark.createDataFrame([(i, "a|b") for i in range(5)], "k int, v string")
    assert f.table_markdown(df, ["k"], 2).first().markdown == "| k | v |\n|---|---|\n| 0 | a\\|b |\n| 1 | a\\|b |\n(3 more rows)"


def test_git_lines(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert f.commit_log(lines("a\x1fb\x1fc\x1fd\x1fe", "bad")).collect()[0].subject == "e"
    d = {r.path: (r.added, r.deleted, r.status) for r in f.diff_stats(lines("3\t1\tx.py", "-\t-\ty.png"), lines("M\tx.py", "A\ty.png")).collect()}
    assert d == {"x.py": (3, 1, "M"), "y.png": (None, None, "A")}
    w = {r.path: r.state for r in f.working_tree(lines("M  a", " M b", "?? c", "UU d")).collect()}
    assert w == {"a": "staged", "b": "unstaged", "c": "untracked", "d": "conflicted"}


def test_owner_rules_and_hunks(spark, tmp_path):
    p = tmp_path / "OWNERS"
    p.write_text("# who looks after what\ndocs/** @writers\n\n*.sql @warehouse @night-shift\n")
    assert [(r.pattern, r.owners) for r in f.owner_rules(spark, str(p)).orderBy("rule").collect()] == [("docs/**", ["@writers"]), ("*.sql", ["@warehouse", "@night-shift"])]
    c = spark.createDataFrame([("x", "a\n<<<<<<< HEAD\nours\n=======\ntheirs\n>>>>>>> b\n")], "path string, content string")
    assert [(r.ours, r.theirs) for r in f.conflict_hunks(c).collect()] == [("ours\n", "theirs\n")]


def test_zip(spark, tmp_path):
    p = tmp_path / "z.zip"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("a.txt", "hello")
    (tmp_path / "bad.zip").write_bytes(b"no")
    got = f.zip_entries(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [(r.entry, r.bytes) for r in got] == [("a.txt", 5)]


def test_rich_text(spark):
    doc = json.dumps({"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "one"}]}, {"type": "paragraph", "content": [{"type": "text", "text": "two"}]}]})
    assert spark.createDataFrame([(doc,)], "d string").select(f.rich_text(F.col("d")).alias("t")).first().t == "one\ntwo"


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "g")
    n, e = spark.range(10), spark.createDataFrame([("a'b", "c", "calls")], "source string, target string, relation string")
    assert s.write_graph(n, e, p) and not s.write_graph(n.limit(2), e, p) and spark.read.parquet(f"{p}/nodes").count() == 10
    assert s.cypher(e).first().value == "MERGE (a {id: 'a\\'b'}) MERGE (b {id: 'c'}) MERGE (a)-[:CALLS]->(b);"
    t = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(t)
    s.upsert_table(spark, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), t, ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(t).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    stream = ev.event_stream(spark, sf_dir, "events.parquet")
    q = ev.daily_totals(stream).writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = ev.daily_totals(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, batch.collect()))


def test_swap_that_died_halfway(spark, tmp_path):
    """The older copy comes back, and a move that fails leaves the old table."""
    t = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    one.write.parquet(f"{t}.before")
    s.upsert_table(spark, spark.createDataFrame([(2, "b")], "k int, v string"), t, ["k"])
    assert sorted(tuple(x) for x in spark.read.parquet(t).collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(OSError, match="next is not there"):
        s.swap_folder(spark, t)
    assert spark.read.parquet(t).count() == 2


def test_daily_folders(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-02 23:59:59' as ts, 'x' as tool union all select timestamp'2024-01-03 00:00:00', 'y'")
    s.append_daily(rows, str(tmp_path / "d"))
    s.append_daily(rows.limit(1), str(tmp_path / "d"))
    assert {str(x.day): x["count"] for x in spark.read.json(str(tmp_path / "d")).groupBy("day").count().collect()} == {"2024-01-02": 2, "2024-01-03": 1}
