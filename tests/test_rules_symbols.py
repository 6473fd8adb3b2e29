"""Ignore rules and name resolution against plain loops."""

import fnmatch
import random
import re

from graphmill.operators import pathrules as pr
from graphmill.operators import symbols


def brute_rules(content):
    out = []
    for line in content.splitlines():
        line = line.lstrip()
        if line and not line.startswith("#"):
            line = re.sub(r"(?<!\\) +$", "", re.sub(r"\s+#+[^\\].*$", "", line).replace("\\#", "#"))
            if line.lstrip("!").strip("/"):
                out.append((line.startswith("!"), line.removeprefix("!")))
    return out


def brute_ignored(path, files):
    def meets(rel, p):
        parts = rel.split("/")
        return any(fnmatch.fnmatchcase(x, p) for i in range(len(parts)) for x in (parts[i], "/".join(parts[: i + 1])))

    def verdict(target):
        result = False
        for folder in sorted(files, key=len):
            if folder and not target.startswith(folder + "/"):
                continue
            for negated, raw in brute_rules(files[folder]):
                inner = target[len(folder) + 1 :] if folder else target
                if meets(inner, raw.strip("/")) or (not raw.startswith("/") and meets(target, raw.strip("/"))):
                    result = not negated
        return result

    parts = path.split("/")
    return any(verdict("/".join(parts[:i])) for i in range(1, len(parts) + 1))


def test_ignored(spark):
    rng = random.Random(3)
    files = {
        "": "# remark\n\n*.log\nbuild/   # made\n!keep.log\n/top.py\nd?c\n[ab]x\n  lead.txt  \npath#x\n\\#hash\n![\n(a)+.b\n",
        "src": "!*.log\n/only.py\ngen/*.c\n!build\n",
        "src/lib": "*.py\n!good.py\r\n[!a]z\n",
        "other": "",
    }
    names = ["a.log", "keep.log", "build", "top.py", "doc", "ax", "cx", "lead.txt", "path#x", "#hash", "only.py", "gen", "x.c", "good.py", "bad.py", "bz", "az", "(a)+.b", "é.py", "["]
    paths = {"/".join(p) for _ in range(400) for p in [[rng.choice(["src", "src/lib", "other", "build", "gen", "d1"]) for _ in range(rng.randrange(3))] + [rng.choice(names)]]}
    rules = pr.rules_of(spark.createDataFrame(list(files.items()), "folder string, content string"))
    rows = [(p,) for p in paths] + [(None,), (next(iter(paths)),)]
    got = pr.ignored(spark.createDataFrame(rows, "path string"), rules).collect()
    want = {p: brute_ignored(p, files) for p in paths}
    assert {x.path: x.ignored for x in got} == want and len(got) == len(paths) and 0.2 < sum(want.values()) / len(want) < 0.9
    none = pr.rules_of(spark.createDataFrame([("", "#only\n")], "folder string, content string"))
    assert not any(x.ignored for x in pr.ignored(spark.createDataFrame(rows, "path string"), none).collect())


def brute_names(defs, aliases, stars):
    own = {}
    for m, n, node in defs:
        own[m, n] = min(node, own.get((m, n), node))
    alias = {}
    for m, n, *to in aliases:
        if (m, n) not in own:
            alias[m, n] = min(tuple(to), alias.get((m, n), tuple(to)))
    near = {}
    for m in {m for m, _ in stars}:
        far, todo = {m: 0}, [m]
        for x in todo:
            for a, b in sorted(stars):
                if a == x and b not in far:
                    far[b] = far[x] + 1
                    todo.append(b)
        near[m] = sorted((k, s) for s, k in far.items() if k)
    known = dict(own)
    while True:
        base = dict(own)
        for m in near:
            for n in {n for _, n in known}:
                if (m, n) not in own and (m, n) not in alias:
                    hit = next((known[s, n] for _, s in near[m] if (s, n) in known), None)
                    if hit is not None:
                        base[m, n] = hit
        new = dict(base)
        for key in alias:
            to, seen = alias[key], {key}
            while to in alias and to not in seen:
                seen.add(to)
                to = alias[to]
            if to not in seen and to not in alias and to in base:
                new[key] = base[to]
        if new == known:
            return new
        known = new


def test_resolved_names(spark):
    rng = random.Random(5)
    m = lambda: f"m{rng.randrange(12)}"
    n = lambda: rng.choice("abcdef")
    defs = [(m(), n(), i) for i in range(15)]
    aliases = [(m(), n(), m(), n()) for _ in range(40)] + [("c0", f"x{i}", "c0", f"x{i + 1}") for i in range(20)] + [("c1", "p", "c1", "q"), ("c1", "q", "c1", "p")]
    stars = {(m(), m()) for _ in range(7)} | {("s1", "s2"), ("s2", "s1"), ("s2", "m3")}
    defs.append(("c0", "x20", 99))
    make = spark.createDataFrame
    got = symbols.resolved_names(make(defs + [(None, "a", 1)], "module string, name string, node long"), make(aliases + [("m1", None, "m2", "a")], "module string, name string, to_module string, to_name string"), make([*stars, ("m1", None)], "module string, source string")).collect()
    want = brute_names(defs, aliases, {(a, b) for a, b in stars if a != b})
    assert {(x.module, x.name): x.node for x in got} == want and len(got) == len(want)
    assert want["c0", "x0"] == 99 and ("c1", "p") not in want and any(k[0] == "s1" for k in want)
    empty = make([], "module string, name string, node long")
    assert symbols.resolved_names(empty, make(aliases, "module string, name string, to_module string, to_name string"), make(list(stars), "module string, source string")).count() == 0
