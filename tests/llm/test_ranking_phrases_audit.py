"""Pairwise quality, phrases and the filter audit against brute force and SQL, and on odd tables."""

import collections
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.llm import op11_pairwise_quality as rank
from graphmill.llm import op12_phrases as phrases
from graphmill.llm import op13_filter_audit as audit
from graphmill.llm import queries as q
from graphmill.llm import text as tx
from graphmill.operators.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string"
CLASHES = ("part", "mask", "n", "sig", "h0", "word", "rank", "score", "y", "_id", "a", "id", "at", "x")


def clashing(df):
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abCdeé") for _ in range(rng.randrange(1, 5)))
    long = " ".join(word() for _ in range(60_000))
    near = long[:100] + ("x" if long[100] != "x" else "y") + long[101:]
    few = " ".join(word() for _ in range(150))
    rows = [(1, long, "en"), (2, near, "en"), (3, long, None), (4, few, "de"), (5, few, "de"), (5, few, "de"), (6, few + ".", "de"), (7, None, "en"), (8, "", ""), (9, "", "en"), (None, few, "en"), (None, None, None)]
    rows += [(0, few[:64], "en"), (11, few[:64], "en"), (12, few[:65], "en"), (13, "A" * 30_000, "en"), (14, "#😀 \t\n".encode("utf-16", "surrogatepass").decode("utf-16"), "fr"), (15, few, "en"), (15, long, "en")]
    return clashing(spark.createDataFrame(rows, SCHEMA))


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, 1), (5, 1, 1), (None, 1, 1), (13, 0, 0), (99, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def sql_rows(duck, name, columns):
    got = duck.sql(f"select {', '.join(columns)} from ({q.ORACLE_SQL[name]})").fetchall()
    return sorted(tuple(x if isinstance(x, str) else int(x) for x in r) for r in got)


# the audit of filters


def brute_audit(rows, labels):
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    masks = []
    for d, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        masks.append((lang or "", f, d in good, d in toxic))
    out = set()
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        removed = collections.Counter()
        lines = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [m for m in left if m[1][x]]
                redundant = sum(m[1][x] for m in own) - len(gone)
                left = [m for m in left if not m[1][x]]
                removed[x] += len(gone)
                unique = sum(m[1][x] and sum(m[1].values()) == 1 for m in own)
                lines.append((x, (part, "".join(order), step, len(left), len(gone), redundant, unique, sum(m[2] for m in gone), sum(m[3] for m in gone))))
        out |= {(*line, removed[x]) for x, line in lines}
    return out


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_of_odd_table(odd, labels):
    got = audit.filter_audit(odd, labels).select(*AUDIT).collect()
    rows = [tuple(x) for x in odd.select("doc_id", "text", "lang").collect()]
    assert {tuple(x) for x in got} == brute_audit(rows, [tuple(x) for x in labels.collect()]) and len(got) == 120 * 5 * 4


def test_audit_tells_texts_of_one_hash_apart(odd, labels, monkeypatch):
    """With every block of one hash, only the comparison of whole texts is left."""
    monkeypatch.setattr(audit.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    got = audit.filter_audit(odd.where("doc_id <> 15"), labels).select(*AUDIT).collect()
    rows = [tuple(x) for x in odd.where("doc_id <> 15").select("doc_id", "text", "lang").collect()]
    assert {tuple(x) for x in got} == brute_audit(rows, [tuple(x) for x in labels.collect()])


def test_audit_empty(odd, labels):
    assert audit.filter_audit(odd.limit(0), labels.limit(0)).count() == 0
    assert audit.filter_audit(odd, labels.limit(0)).where("good_lost > 0 or toxic_lost > 0").count() == 0


def test_audit_drops_singletons(spark, odd):
    rows = audit.with_blocks(odd.select("doc_id", "text"))
    left = {x.doc_id for x in audit.candidates(rows, Scratch(spark, "test")).collect()}
    assert left == {0, 1, 3, 4, 5, 8, 9, 7, 11, 15}


def test_audit_against_sql(spark, sf_dir, duck):
    got = q.op13_filter_audit(spark, sf_dir).select(*AUDIT).collect()
    assert sorted(map(tuple, got)) == sql_rows(duck, "op13_filter_audit", AUDIT)


# phrases


def brute_phrases(rows, least, percent, most):
    n, f = collections.Counter(), collections.Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if any(len(o) > len(p) and o_lang == lang and 100 * b >= percent * a and any(o[i : i + len(p)] == p for i in range(len(o))) for (o_lang, o), b in found.items()):
            continue
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return {(lang, i, x[2].decode(), *x[3:]) for lang, v in out.items() for i, x in enumerate(sorted(v)[:most], 1)}


PHRASES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(5)
    rows = []
    for d in range(60):
        w = [rng.choice(["the", "The", "a", "of", "été", "x", "new york", "new york city", "日本", "b\x0bc", "q.", "r,", f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(0, 120))]
        rows.append((d, rng.choice([" ", "\t", "  "]).join(w), rng.choice(["en", "de", None, "und"])))
    rows += [(1, None, "en"), (None, "the a the a the a", "en"), (2, "", "en"), (3, " \t.\n", "fr"), (4, "one two", "fr")]
    return rows


@pytest.mark.parametrize(("block", "run", "each"), [(2 << 20, 1 << 20, 1 << 20), (200, 20, 50)])
def test_phrases(spark, prose, monkeypatch, block, run, each):
    monkeypatch.setattr(phrases, "RANGE", each)
    monkeypatch.setattr(phrases, "ranges_for", lambda n: max(0, (2 * n // each).bit_length()))
    blocks, deal = phrases.encoded_blocks, phrases.dealt_keys
    monkeypatch.setattr(phrases, "encoded_blocks", lambda d: blocks(d, block))
    monkeypatch.setattr(phrases, "dealt_keys", lambda d, bits: deal(d, bits, run))
    df = clashing(spark.createDataFrame(prose, SCHEMA)).repartition(3)
    for least, percent, most in ((10, 50, 2000), (2, 50, 2000), (3, 90, 7)):
        got = phrases.mine_phrases(df, least, percent, most).select(*PHRASES).collect()
        want = brute_phrases(prose, least, percent, most)
        assert {tuple(x) for x in got} == want and len(got) == len(want) > 10


def test_phrases_empty(spark):
    assert phrases.mine_phrases(spark.createDataFrame([], SCHEMA)).collect() == []


def test_phrases_against_sql(spark, sf_dir, duck):
    got = q.op12_phrases(spark, sf_dir).select(*PHRASES).collect()
    assert sorted(map(tuple, got)) == sql_rows(duck, "op12_phrases", PHRASES)


def test_best_of_crowded_languages(spark):
    rng = random.Random(1)
    rows = [("en", f"p {i}", rng.randrange(5), rng.randrange(3)) for i in range(3000)]
    got = phrases.best(spark.createDataFrame(rows, "lang string, phrase string, score long, a long"), 50, 3).orderBy("rank").collect()
    want = sorted(rows, key=lambda x: (-x[2], -x[3], x[1]))[:50]
    assert [(x.rank, x.phrase) for x in got] == [(i, x[1]) for i, x in enumerate(want, 1)]


def test_keys():
    rng = np.random.default_rng(0)
    for top in (3, 1 << 20, 1 << 40):
        ids = rng.integers(1, top, (3, 500), dtype=np.uint64)
        ids[2, ::3] = 0
        ids = np.concatenate([ids, ids[:, :100]], 1)
        hi, lo = phrases.packed(*ids)
        n = rng.integers(1, 9, 600)
        want = collections.Counter()
        for key, k in zip(map(tuple, ids.T.tolist()), n.tolist()):
            want[key] += k
        for mix in (phrases.mixed, lambda hi, lo: hi & np.uint64(1)):
            with pytest.MonkeyPatch.context() as m:
                m.setattr(phrases, "mixed", mix)
                a, b, c, h = phrases.run_lengths(hi, lo, n)
            assert (h[1:] >= h[:-1]).all()
            back = phrases.from_planes(np.frombuffer(phrases.planes(a, b, c), np.uint8))
            low = (1 << 20) - 1
            got = {(x >> 20, (x & low) << 20 | y >> 40, y & ((1 << 40) - 1)): k for x, y, k in zip(*(v.tolist() for v in back))}
            assert got == want
        order = phrases.radix_order(hi, lo)
        assert order.tolist() == np.lexsort((lo, hi)).tolist()


def test_many_words_in_a_block():
    """Numbers of a block's words that don't fit three to a 64-bit number."""
    codes = np.array([-1, 0, 1, 2, 0, 1, 2, -1, 5, 1 << 21, 1], np.int32)
    few = phrases.block_grams(codes, np.arange(6), np.arange(1, 7))
    many = phrases.block_grams(codes, np.arange(2 << 20), np.arange(1, (2 << 20) + 1))
    key = lambda x: dict(zip(zip(x[0].tolist(), x[1].tolist()), x[2].tolist()))
    assert key(few).items() <= key(many).items() and sum(few[2]) == 9 == sum(many[2])


def test_parts_keep_pieces_whole():
    rng = random.Random(2)
    for most in (1, 7, 50):
        data = "".join(rng.choice("ab .") for _ in range(300)) + "c" * 200 + "." + "d" * 30
        parts = list(phrases.parts_of(np.frombuffer(data.encode(), np.uint8), most))
        assert b"".join(p.tobytes() for p in parts).decode() == data
        assert all(p.tobytes().endswith(b".") for p in parts[:-1])


# pairwise quality


def shares(t):
    """Values of one text by plain counting."""
    b = t.encode()
    classes = [int(rank._CLASS[x]) for x in b]
    pairs = collections.Counter(zip(classes, classes[1:]))
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", b) if x]
    n = max(len(w), 1)
    out = [pairs[i, j] / max(len(b) - 1, 1) for i in range(8) for j in range(8)]
    out += [sum(x == y for x, y in zip(w, w[1:])) / n, sum(x == y for x, y in zip(w, w[2:])) / n]
    out += [sum(not any(rank._CLASS[c] in (rank.SMALL, rank.CAPITAL) for c in x) for x in w) / n, sum(len(x) <= 2 for x in w) / n, sum(len(x) > 15 for x in w) / n, len(set(w)) / n]
    return [*(np.clip(np.log10(np.array(out) + 1e-4), -4, 0)), -4 + min(np.log10(n), 4)]


def test_values_against_counting(monkeypatch):
    texts = ["", "One two  two!\n12 ### é", "a a a b a b", " \t", "x" * 50 + " Y", "one"]
    data = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, data)])
    flat = np.frombuffer(b"".join(data), np.uint8)
    got = rank.values(flat, offs)
    assert np.allclose(got, [shares(t) for t in texts])
    # in pieces only what goes over a cut is lost; a word longer than a piece is cut
    monkeypatch.setattr(rank, "PIECE", 16)
    assert np.abs(10 ** rank.values(flat, offs)[:, :64] - 10 ** got[:, :64]).max() < 0.1
    assert np.allclose(np.delete(rank.values(flat, offs), 4, 0)[:, 66:], np.delete(got, 4, 0)[:, 66:])


def test_pieces_cover_texts(monkeypatch):
    monkeypatch.setattr(rank, "PIECE", 8)
    data = np.frombuffer(b"one two three four five" + b"x" * 40 + b"ab", np.uint8)
    at, owner = rank.pieces(data, np.array([0, 23, 63, 65]))
    assert at[0] == 0 and at[-1] == 65 and (np.diff(at) <= 8).all() and {23, 63} <= set(at.tolist()) and owner.tolist() == sorted(owner.tolist())


def test_pairs():
    for good, bad in ((5, 3), (3, 5), (1, 1), (1, 9), (40, 7)):
        a, b = rank.preference_pairs(good, bad, 4)
        assert set(a.tolist()) == set(range(good)) and set(b.tolist()) == set(range(bad)) and len(a) == 4 * max(good, bad)


def test_ranking_minimises_the_pairs_loss():
    rng = np.random.default_rng(1)
    good, bad = (np.clip(rng.normal(m, 0.6, (80, rank.N_VALUES)), -4, 0) for m in (-1.5, -2.0))
    w = rank.fit(good, bad, l2=1e-2, rounds=3000).weights
    a, b = rank.preference_pairs(80, 80)
    x, y = rank.spread(good), rank.spread(bad)
    loss = lambda w: np.log1p(np.exp(y[b] @ w - x[a] @ w)).mean() + 0.005 * w @ w
    for _ in range(30):
        assert loss(w) <= loss(w + rng.normal(0, 0.05, len(w))) + 1e-6


def test_cut_is_the_quantile():
    rng = random.Random(4)
    for _ in range(50):
        scores = [rng.randrange(-300, 300) for _ in range(rng.randrange(2, 60))]
        below = rng.randrange(1, len(scores))
        cut = rank.cut_at(collections.Counter(scores), below) * rank.CUT_STEPS
        under = sum(s < cut for s in scores)
        edge = sorted(scores)[below - 1 : below + 1]
        assert under == below or (edge[0] == edge[-1] and abs(under - below) <= scores.count(edge[0]))


def test_quality_held_out(spark):
    out = q.op11_pairwise_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert out.count() == docs.count() and out.where("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    held = out.where("held_out").join(labels, "doc_id").collect()
    assert sum(x.predicted == x.quality for x in held) >= 0.95 * len(held) and len(held) > 50


def test_quality_of_odd_table(odd, labels):
    got = rank.judge(odd, labels)
    assert got.columns == [*(c for c in odd.columns if c != "score"), "score"] and got.count() == odd.count()
    assert all(0 <= x.score <= 1 for x in got.select("score").collect())
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert {x.score for x in rank.judge(odd, some).select("score").collect()} == {0.5}
    assert rank.judge(odd.limit(0), labels).count() == 0


def test_quality_does_not_read_ids(odd, labels):
    """Scores depend on the text alone."""
    ranking = rank.train(odd, labels)
    a = rank.raw_scores(odd.select("doc_id", "text"), ranking).collect()
    b = {x.doc_id: x.score for x in rank.raw_scores(odd.select((F.col("doc_id") + 50).alias("doc_id"), "text"), ranking).collect()}
    assert all(b[None if x.doc_id is None else x.doc_id + 50] is not None for x in a)
    assert {(x.text or "", x.score) for x in a} == {(t or "", s) for t, s in {(x.text or "", x.score) for x in a}}
    assert len({x.text or "" for x in a}) == len({(x.text or "", x.score) for x in a})
