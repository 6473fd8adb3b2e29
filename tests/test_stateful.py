"""Stateful streams against their batch forms, with late events, restarts and crashes."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from graphmill.streaming import stateful as st

BASE = datetime.datetime(2024, 1, 1)


def land(spark, folder, batches, schema):
    """One parquet file for each batch, in order of time."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b{i:03d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def run(df, name, folder, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return df.sparkSession.table(name).collect()


def test_recent_items(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(4), f"i{rng.randrange(9)}", BASE + datetime.timedelta(seconds=rng.randrange(1000))) for _ in range(150)]
    rows += [(None, "i1", BASE), (1, None, BASE), (1, "i1", None)]
    schema = "session long, item string, ts timestamp"
    stream = land(spark, tmp_path / "in", [rows[:60], rows[60:120], rows[120:]], schema)
    last = {}
    for x in run(st.recent_items(stream, 5), "recent", tmp_path / "ck", "update"):
        last[x.session, x.rank] = x  # a later batch tells all ranks anew
    want = {(x.session, x.rank): (x.item, x.used) for x in st.recent_items_of(spark.createDataFrame(rows, schema), 5).collect()}
    assert {k: (x.item, x.used) for k, x in last.items()} == want and not any(x.closed for x in last.values())
    brute = {}
    for s, item, ts in rows:
        if None not in (s, item, ts):
            brute.setdefault(s, {})[item] = max(ts, brute.get(s, {}).get(item, ts))
    assert {(s, i): item for s, v in brute.items() for i, (item, _) in enumerate(sorted(v.items(), key=lambda x: (-x[1].timestamp(), x[0]))[:5], 1)} == {k: v[0] for k, v in want.items()}


def test_idle_sessions_close(spark, tmp_path):
    at = lambda s: BASE + datetime.timedelta(seconds=s)
    schema = "session long, item string, ts timestamp"
    stream = land(spark, tmp_path / "in", [[(1, "a", at(0)), (2, "b", at(5))], [(2, "c", at(50))], [(2, "d", at(200))]], schema)
    got = run(st.recent_items(stream, 2, idle_ms=60_000), "idle", tmp_path / "ck")
    closed = [(x.session, x.item) for x in got if x.closed]
    # session 1 was idle for over a minute when the watermark came to 200 s; session 2 went on then
    assert closed == [(1, "a")] and [x.item for x in got if x.session == 2][-2:] == ["d", "c"]


def test_ordered_fold(spark, tmp_path):
    """Events come up to a minute late; up to the last watermark the stream is the fold in event-time order."""
    rng = random.Random(5)
    rows = sorted(((rng.randrange(5), i, rng.choice(["verify", "negate", "read"]), BASE + datetime.timedelta(seconds=10 * i)) for i in range(120)), key=lambda x: x[1] + rng.randrange(5))
    rows.append((None, 999, "verify", BASE))
    schema = "entry long, id long, kind string, ts timestamp"
    end = BASE + datetime.timedelta(seconds=10 * 119 - 60)
    stream = land(spark, tmp_path / "in", [rows[:40], rows[40:80], rows[80:]], schema)
    last = {}
    for x in run(st.ordered_fold(stream, "1 minute"), "ordered", tmp_path / "ck"):
        if x.entry not in last or x.at > last[x.entry].at:
            last[x.entry] = x
    want = st.ordered_fold_of(spark.createDataFrame(rows, schema).where(F.col("ts") < F.lit(end))).collect()
    assert {x.entry: tuple(x) for x in want} == {k: tuple(x) for k, x in last.items()}
    state = {}
    for e, _, kind, ts in sorted((x for x in rows if x[0] is not None and x[3] < end), key=lambda x: x[3]):
        state[e] = st.folded(*state.get(e, (0, 0, 0.0)), kind)
    assert state == {x.entry: (x.verified, x.negated, x.confidence) for x in want}


SCANS = "seq long, path string, hash string, deleted boolean, rows array<string>"


def scans():
    a = [(0, f"f{i}", f"h{i}", False, [f"f{i}-{k}" for k in range(i)]) for i in range(5)]
    b = [(1, "f1", "h1", False, ["not read again"]), (1, "f2", "new", False, ["x", "y"]), (1, "f3", "h3", True, []), (1, None, "h", False, ["z"])]
    c = [(2, "f2", "newer", False, ["w"]), (3, "f2", "newest", False, ["v"]), (2, "f9", "h9", False, ["n"])]
    return [a, b, c]


def table(spark, folder):
    return sorted(tuple(x) for x in st.VersionedTable(spark, str(folder)).read().select("path", "hash", "row").collect())


WANT = sorted([("f1", "h1", "f1-0"), ("f2", "newest", "v"), ("f9", "h9", "n"), *(("f4", "h4", f"f4-{k}") for k in range(4))])


def test_rebuild_survives_crashes(spark, tmp_path):
    """A stream that dies between a version and its commit leaves the same table once it has run again."""
    stream = lambda: spark.readStream.schema(SCANS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    land(spark, tmp_path / "in", scans(), SCANS)
    fails = {0, 1}

    def die(number):
        if number in fails:
            fails.discard(number)
            raise RuntimeError("killed")

    for _ in range(2):
        q = st.rebuild_stream(stream(), str(tmp_path / "out"), str(tmp_path / "ck"), die)
        with pytest.raises(Exception, match="killed"):
            q.awaitTermination(300)
    assert not fails
    st.rebuild_stream(stream(), str(tmp_path / "out"), str(tmp_path / "ck"), die).awaitTermination(300)
    assert table(spark, tmp_path / "out") == WANT
    # a version that was not written to its end is no table
    broken = tmp_path / "out" / "v=99"
    broken.mkdir()
    (broken / "part-0.parquet").write_text(json.dumps({}))
    assert table(spark, tmp_path / "out") == WANT and 99 not in st.VersionedTable(spark, str(tmp_path / "out")).versions()


def test_rebuild_of_one_batch(spark):
    rows = spark.createDataFrame([x for b in scans() for x in b], SCANS)
    got = sorted(tuple(x) for x in st.merged_by_hash(None, rows.where("seq <> 1")).collect())
    assert ("f2", "newest", "v") in got and ("f3", "h3", "f3-0") in got
    assert st.merged_by_hash(None, rows.limit(0)).count() == 0
