"""Readers of repositories and reports on small tables."""

import hashlib
import json

from graphmill.sources import reports as r


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_classified(spark):
    got = {x.path: x.kind for x in r.classified(table(spark, [("a/b.PY",), ("x.md",), ("p.pdf",), ("i.jpeg",), ("noend",)], "path string")).collect()}
    assert got == {"a/b.PY": "code", "x.md": "document", "p.pdf": "paper", "i.jpeg": "image", "noend": None}


def test_changed_files(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    now = table(spark, [("same", 1, "x"), ("touched", 2, "x"), ("edited", 2, "y"), ("fresh", 1, "z")], "path string, modified int, content string")
    was = table(spark, [("same", 1, "?"), ("touched", 1, sha("x")), ("edited", 1, sha("x")), ("gone", 1, sha("g"))], "path string, modified int, digest string")
    assert {x.path: x.change for x in r.changed_files(now, was).collect()} == {"same": "unchanged", "touched": "unchanged", "edited": "changed", "fresh": "new", "gone": "deleted"}


def test_lines(spark):
    b = table(spark, [("s1\tann\t1\ta\tb",), ("s2\tbob\t2\tc",), ("s2\tbob\tx\tc",), ("junk",)], "value string")
    assert [(x.line, x.sha, x.text) for x in r.blame(b).orderBy("line").collect()] == [(1, "s1", "a\tb"), (2, "s2", "c")]
    assert [x.line for x in r.blame(b, 2, 9).collect()] == [2]
    assert r.branches(table(spark, [("main\x1fabc\x1fann\x1f2024-01-02",), ("bad",)], "value string").coalesce(1)).first().sha == "abc"
    c = table(spark, [(f"s{i}", "Ann" if i % 2 else "Bob", f"2024-01-{i:02d}") for i in range(1, 20)], "sha string, author string, date string")
    assert [x.sha for x in r.log_rows(c, 3, "ann", "2024-01-05").collect()] == ["s19", "s17", "s15"]
    assert r.log_rows(c, 0).count() == 1 and r.log_rows(c, 9999).count() == 19


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes(b'\xef\xbb\xbfid,text\n1,"a, ""b""\nc"\n2,d\n')
    assert [(x.id, x.text) for x in r.csv_rows(spark, str(p)).collect()] == [("1", 'a, "b"\nc'), ("2", "d")]


def test_mutation_reports(spark):
    mutants = ["Survived"] * 4 + ["Killed"] * 9 + ["NoCoverage", "Timeout"]
    files = [
        ("report/one.json", json.dumps({"files": {f"src/part{i}.ts": {"mutants": [{"id": str(k), "status": m} for k, m in enumerate(mutants) if k % 3 == i]} for i in range(3)}})),
        ("report/cut.json", '{"files": {"src'),
        ("report/two.xml", "<mutations>" + "<mutation detected='true' status='KILLED'/>" * 6 + "<mutation detected='false' status=\"SURVIVED\"/>" * 7 + "</mutations>"),
        ("report/log", "run 31 done\nKILLED - 29\nsurvived: 12"),
    ]
    got = {x.path: (x.killed, x.survived) for x in r.mutation_reports(table(spark, files, "path string, content string")).collect()}
    assert got == {"report/one.json": (9, 4), "report/cut.json": (0, 0), "report/two.xml": (6, 7), "report/log": (29, 12)}
    assert all(x.total == x.killed + x.survived for x in r.mutation_reports(table(spark, files[1:], "path string, content string")).collect())


def test_stack_fingerprint(spark):
    files = [("web/package.json", '{"dependencies": {"left": "^1.0", "right": "~2"}}'), ("requirements.txt", "one==1.0\ntwo>=2\n# three\n"), ("sub/pom.xml", "<artifactId>x</artifactId>"), ("go.mod", "module m\nrequire example.com/a v1.2.3\n"), ("readme.md", "x")]
    got = {x.ecosystem: (x.manifests, x.dependencies) for x in r.stack_fingerprint(table(spark, files, "path string, content string")).collect()}
    assert got == {"npm": (1, 2), "pypi": (1, 2), "maven": (1, 1), "go": (1, 1)}


def test_findings_page(spark):
    f = table(spark, [(i, ("INFO", "BLOCKER", "MAJOR")[i % 3], f"f{i % 4}", i) for i in range(20)], "id int, severity string, file string, line int")
    one, two = r.findings_page(f, 1, 5).collect(), r.findings_page(f, 3, 5, 12).collect()
    assert [x.severity for x in one] == ["BLOCKER"] * 5 and one[0].total == 20 and not one[0].truncated
    assert len(two) == 2 and two[0].truncated


def test_memory_and_runs(spark, tmp_path):
    e = table(spark, [("A-1", ["x"], 0.5), ("A-2", [], None)], "id string, tags array<string>, score double")
    r.export_memory(e, str(tmp_path / "m"))
    assert sorted(map(tuple, r.import_memory(spark, str(tmp_path / "m"), e).collect())) == sorted(map(tuple, e.collect()))
    cases = table(spark, [("a", 1.0, "passed")], "name string, seconds double, status string")
    r.append_run(cases, "r1", str(tmp_path / "h"))
    r.append_run(cases, "r2", str(tmp_path / "h"))
    assert {x.run_id for x in spark.read.parquet(str(tmp_path / "h")).collect()} == {"r1", "r2"}


def test_cluster_report(spark):
    m = table(spark, [("c", f"f{i}", i) for i in range(7)], "cluster string, file string, degree int")
    assert r.cluster_report(m, 2).first().markdown == "## c (7)\n- f6\n- f5"
