"""Secret scans: a pattern finds candidates, a random forest removes the false positives; DataFrame functions only.

A candidate is a run of at least 12 characters of the key alphabet with a digit, of 16
capitals and digits, or of 16 letters with capitals among small ones, or what a secret word is
assigned (a quoted or non-blank run of 6 or more), or the password in a URL. The forest sees
its length, its transitions between kinds of characters, how much of it dictionary words
cover, the path it comes from and the words on both sides. It is trained from labelled
findings: a table of (candidate, before, path, secret, and after if there is one), by default
one that labelled_findings() makes by rule, half of it with words that no feature knows. The
trained trees become one SQL expression, so scanning needs no model on the executors, no
shuffle and no Python.

Every occurrence is a finding of its own, with its place, and is judged by the text beside it
in its own line (BEFORE and AFTER characters, which bound the features and no finding).
redact() replaces the spans of the findings that are secrets and nothing else.

Nulls and odd cases: null or empty text has no candidates; a null path has no path words;
a null doc_id stays null; repeated rows are scanned each by itself; a text may be of any
length; an empty table gives no findings; columns besides those named pass through redact(),
and where docs has a column n_secrets, the new one is n_secrets_.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREES, DEPTH, FINDINGS = 15, 5, 4000
THRESHOLD = 0.5
MARK = "[REDACTED]"
BEFORE = AFTER = 40
#: Occurrences beside one that its context is read across; at 6 characters each they fill BEFORE.
ACROSS = 7
#: Words whose share of a candidate tells a name or a placeholder from random characters.
DICTIONARY = (
    "example", "sample", "test", "dummy", "your", "this", "that", "with", "from", "name", "file", "image", "photo", "version", "release", "build",
    "index", "page", "user", "data", "report", "final", "draft", "config", "default", "value", "string", "number", "class", "function", "module",
    "section", "chapter", "table", "figure", "model", "server", "client", "local", "host", "mail", "group", "order", "item", "product", "change", "insert", "here", "xxxx", "0000", "1234",
)
SECRET_WORDS = "passwo?r?d|passwd|pwd|secret|token|api.?key|access.?key|credential|private.?key|bearer|authorization|client.?secret"
_ASSIGNED = f"(?i:{SECRET_WORDS}|(?<![a-z])key)[\"'`]? {{0,3}}[:=] {{0,3}}"
CANDIDATE = (
    # the short look-behinds come first, since the long ones are slow
    "(?<=[:=\"' ])(?<=[:=] {0,3}[\"']?)(?:"
    f"(?<={_ASSIGNED}\")[^\"\\n]{{6,}}(?=\")|(?<={_ASSIGNED}')[^'\\n]{{6,}}(?=')|(?<={_ASSIGNED})[^\\s\"'`]{{5,}}[^\\s\"'`,;.)\\]}}>])"
    "|(?<=:)(?<=://[^\\s:/@]{0,60}:)[^\\s@/]+(?=@)"
    "|(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{12,}+={0,2}|[A-Z0-9]{16,}+|(?=(?:[a-z]*[A-Z]){3})(?=[A-Z]*[a-z])[A-Za-z]{16,}+)"
)
PLAIN_WORDS = "commit|sha-?\\d*|md5|hash|checksum|digest|integrity|uuid|guid|isbn|issn|doi|card|phone|tel|call|version|revision|serial|order|invoice|http|www"
PATH_WORDS = "test|spec|example|fixture|mock|sample|doc|lock"
FEATURES = ("length", "distinct", "digits", "uppers", "lowers", "symbols", "changes", "vowels", "covered", "hex", "prefix", "numeric", "path", "secret_word", "plain_word", "assigned", "quoted", "secret_after", "plain_after", "in_url", "reference")


def features(candidate: Column, before: Column, path: Column, after: Column) -> list[Column]:
    """The numbers that the forest sees, in the order of FEATURES."""
    n = F.greatest(F.length(candidate), F.lit(1)).cast("double")
    share = lambda keep: F.length(F.regexp_replace(candidate, f"[^{keep}]", "")) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(candidate, "[a-z]+", "l"), "[A-Z]+", "u"), "[0-9]+", "d"), "[^lud]+", "s")
    low = F.lower(candidate)
    near = F.lower(F.coalesce(before, F.lit("")))
    then = F.lower(F.coalesce(after, F.lit("")))
    flag = lambda c: c.cast("double")
    return [
        n,
        F.size(F.array_distinct(F.split(candidate, ""))) / n,
        share("0-9"),
        share("A-Z"),
        share("a-z"),
        F.length(F.regexp_replace(candidate, "[A-Za-z0-9]", "")) / n,
        (F.length(kinds) - 1) / n,
        F.length(F.regexp_replace(low, "[^aeiou]", "")) / n,
        (n - F.length(F.regexp_replace(low, "|".join(DICTIONARY), ""))) / n,
        flag(low.rlike("^[0-9a-f]+$")),
        flag(candidate.rlike("^(AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|sk_live|sk-|AIza|eyJ)")),
        flag(candidate.rlike("^[0-9]+$")),
        flag(F.lower(F.coalesce(path, F.lit(""))).rlike(PATH_WORDS)),
        flag(near.rlike(f"({SECRET_WORDS})[^a-z]*$|({SECRET_WORDS}) *(is|are|was|:|=)[^a-z]*$")),
        flag(near.rlike(f"\\b({PLAIN_WORDS})\\b[^a-z]*$")),
        flag(near.rlike("[=:] *[\"'`]?$")),
        flag(near.rlike("[\"'`]$")),
        flag(then.rlike(f"^[^a-z]*((is|was|as|for) +)?((the|my|our|a) +)?({SECRET_WORDS})")),
        flag(then.rlike(f"^[^a-z]*((is|was|as|for) +)?((the|my|our|a) +)?({PLAIN_WORDS})\\b")),
        flag(near.rlike("://[^ :/@]*:$") & then.startswith("@")),
        flag(candidate.rlike("^[$<{%]|[(]|^[A-Za-z_]+[.][A-Za-z_.]+$")),
    ]


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """n labelled findings made by rule: random keys beside the words for them, and names, digests, numbers and placeholders."""
    raw = spark.range(0, n, 1, 4).withColumn("k", F.sha2(F.concat(F.lit("finding "), F.col("id").cast("string")), 256)).withColumn("m", F.sha2("k", 256))
    b64 = F.regexp_replace(F.base64(F.unhex("k")), "=+$", "")
    pick = lambda words, salt: F.element_at(F.array(*(F.lit(w) for w in words)), F.pmod(F.xxhash64("k", F.lit(salt)), F.lit(len(words))).cast("int") + 1)
    digits = F.regexp_replace(F.conv(F.substring("k", 1, 14), 16, 10), "^", "4")
    key = pick(["password", "api_key", "secret", "token", "access_key", "auth_token", "client_secret", "passwd"], 1)
    # words that no feature looks for, so that the forest must also judge by the candidate itself
    other_key = pick(["login", "auth", "sign_with", "webhook", "db_pass", "session", "use this to enter", "unlock with"], 10)
    other_word = pick(["artifact", "object", "etag", "trace id", "fingerprint", "build", "ticket", "layer"], 11)
    join = pick(["=", " = \"", ": ", ": \"", "='", " is "], 2)
    word = pick(["the value of ", "see also ", "in ", "", "and then ", "about "], 3)
    d1, d2 = pick(DICTIONARY[:40], 4), pick(DICTIONARY[5:45], 5)
    length = F.pmod(F.xxhash64("m"), F.lit(24)).cast("int") + 14
    short = F.pmod(F.xxhash64("m"), F.lit(14)).cast("int") + 6
    kinds = [
        (F.substring("k", F.lit(1), length), F.concat(word, key, join), 1),
        (F.substring("k", 1, 40), F.concat(word, key, join), 1),
        (F.substring(b64, F.lit(1), length), F.concat(word, key, join), 1),
        (F.concat(F.lit("AKIA"), F.substring(F.upper(F.regexp_replace(b64, "[+/=]", "Q")), 1, 16)), word, 1),
        (F.concat(F.lit("AKIA"), F.substring(F.upper(F.regexp_replace(b64, "[+/=]", "7")), 1, 16)), F.concat(word, key, join), 1),
        (F.concat(pick(["ghp_", "xoxb-", "sk_live_", "glpat-", "AIza"], 6), F.substring(F.regexp_replace(b64, "[+/=]", "x"), 1, 30)), word, 1),
        (F.substring("k", 1, 40), F.concat(word, pick(["commit ", "sha1: ", "revision ", "hash "], 7)), 0),
        (F.substring("k", 1, 32), F.concat(word, pick(["md5: ", "checksum ", "uuid ", "digest = "], 7)), 0),
        (F.concat_ws("-", F.substring("k", 1, 8), F.substring("k", 9, 4), F.substring("k", 13, 4), F.substring("k", 17, 12)), F.concat(word, pick(["id ", "uuid: ", "guid=", ""], 7)), 0),
        (F.substring(digits, 1, 16), F.concat(word, pick(["card ", "order ", "call ", ""], 7)), 0),
        (F.concat(d1, F.lit("_"), d2, F.lit("_"), F.substring(digits, 2, 4)), F.concat(word, pick(["file ", "", "name: ", "see "], 7)), 0),
        (F.concat(d1, F.initcap(d2), F.lit("Value"), F.substring(digits, 2, 2)), word, 0),
        (F.concat(F.lit("your_"), key, F.lit("_1234")), F.concat(key, join), 0),
        (F.concat(F.lit("xxxxxxxxxxxx"), F.substring(digits, 2, 4)), F.concat(key, join), 0),
        (F.concat(d1, F.lit("-"), d2, F.lit("/"), F.substring(digits, 2, 8)), F.concat(word, pick(["path ", "at ", "/", "http://host/"], 7)), 0),
        (F.concat(F.upper(d1), F.upper(d2), F.lit("CONSTANT1")), word, 0),
        (F.concat(d2, F.substring(digits, 2, 1)), F.concat(word, key, join), 1),
        (F.regexp_replace(F.substring(b64, F.lit(1), short), "[0-9]", "Z"), F.concat(word, key, join), 1),
        (F.concat(F.initcap(d1), F.lit("@"), F.substring(digits, 2, 2), F.lit("!"), F.substring(b64, 1, 2)), F.concat(word, key, join), 1),
        (F.concat_ws(" ", d1, d2, F.reverse(d1), F.reverse(d2)), F.concat(key, F.lit("=\"")), 1),
        (F.substring(b64, F.lit(1), short), F.concat(word, F.lit("postgres://"), d1, F.lit(":")), 1, "@host/db"),
        (F.concat(d2, F.substring(digits, 2, 1)), F.concat(word, F.lit("postgres://"), d1, F.lit(":")), 1, "@host/db"),
        (F.substring("k", F.lit(1), length), word, 1, " is the password"),
        (F.substring("k", 1, 40), word, 0, " is the commit"),
        (F.concat(pick(["${", "<", "os.environ.", "get(", "config."], 9), d1, F.lit("_"), d2), F.concat(word, key, join), 0),
        (d2, F.concat(word, key, F.lit(": ")), 0),
        (F.substring(b64, F.lit(1), length), F.concat(word, other_key, join), 1),
        (F.regexp_replace(F.substring(b64, F.lit(1), length), "[0-9+/]", "Q"), F.concat(word, other_key, join), 1),
        (F.concat(pick(["ghp_", "xoxb-", "sk_live_", "glpat-", "AIza"], 12), F.substring(F.regexp_replace(b64, "[+/=]", "x"), 1, 32)), F.concat(word, other_key, F.lit(" ")), 1),
        (F.substring("k", 1, 40), F.concat(word, other_word, F.lit(" ")), 0),
        (F.substring("k", 1, 32), F.concat(word, other_word, join), 0),
        (F.concat(d1, F.initcap(d2), F.initcap(pick(DICTIONARY[8:40], 13)), F.initcap(pick(DICTIONARY[3:30], 14))), F.concat(word, other_word, F.lit(" ")), 0),
        (F.concat(F.upper(d1), F.lit("_"), F.substring(digits, 2, 8)), F.concat(word, other_word, F.lit(": ")), 0),
        (F.substring(F.upper(F.concat(F.reverse(d1), F.reverse(d2), d2, d1, F.reverse(d2))), F.lit(1), short + 10), F.concat(F.upper(word), F.upper(F.reverse(d2)), pick(["!! ", " ", ", ", ": "], 15)), 0),
    ]
    which = F.pmod("id", F.lit(len(kinds)))
    case = lambda j: F.coalesce(*(F.when(which == i, x[j] if j < 2 else F.lit((*x, "")[j])) for i, x in enumerate(kinds)))
    return raw.select(case(0).alias("candidate"), case(1).alias("before"), pick(["src/app", "src/main", "web", "config", "tests/unit", "docs/guide"], 8).alias("path"), case(2).alias("secret"), case(3).alias("after"))


def trained_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list[tuple]:
    """Trees as nested tuples: (share of secrets,) at a leaf, else (feature, threshold, left, right)."""
    x = findings.where("candidate is not null and secret in (0, 1)")
    x = x.select(F.col("secret").cast("double").alias("label"), *(c.alias(n) for c, n in zip(features(F.col("candidate"), F.col("before"), F.col("path"), F.col("after") if "after" in x.columns else F.lit("")), FEATURES)))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", featuresCol="x").fit(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(x))

    def read(node) -> tuple:
        if node.numDescendants() == 0:
            stats = list(node.impurityStats().stats())
            return (stats[1] / sum(stats),)
        s = node.split()
        return s.featureIndex(), s.threshold(), read(node.leftChild()), read(node.rightChild())

    return [read(t._call_java("rootNode")) for t in model.trees]


#: The forest of labelled_findings(), which depends on no table; trained once in a driver.
_BY_RULE: list[list[tuple]] = []


def rule_forest(spark: SparkSession) -> list[tuple]:
    if not _BY_RULE:
        _BY_RULE.append(trained_forest(labelled_findings(spark)))
    return _BY_RULE[0]


def scored_by(forest: list[tuple]):
    """Functions (candidate, before, path, after) -> features -> Column: mean share of secrets in the leaves that the trees end in."""

    def column(node: tuple, f: Column) -> Column:
        if len(node) == 1:
            return F.lit(float(node[0]))
        return F.when(f[FEATURES[node[0]]] <= F.lit(float(node[1])), column(node[2], f)).otherwise(column(node[3], f))

    def features_of(candidate: Column, before: Column, path: Column, after: Column) -> Column:
        return F.struct(*(c.cast("double").alias(n) for c, n in zip(features(candidate, before, path, after), FEATURES)))

    def score_of(f: Column) -> Column:
        total = column(forest[0], f)
        for t in forest[1:]:
            total = total + column(t, f)
        return total / len(forest)

    return features_of, score_of


def occurrences(line: Column) -> Column:
    """c, the candidates of a line, and gap, the text before, between and after them; null without candidates."""
    return F.when(line.rlike(CANDIDATE), F.struct(F.regexp_extract_all(line, F.lit(CANDIDATE), 0).alias("c"), F.split(line, CANDIDATE, -1).alias("gap")))


def placed(p: Column) -> Column:
    """(candidate, start, before, after) of each candidate in what occurrences() gave; start counts characters of the line from 0."""
    at = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))
    before = lambda i: F.concat(*(y for k in range(ACROSS, 0, -1) for y in (at(p["gap"], i - k), at(p["c"], i - k))), at(p["gap"], i))
    after = lambda i: F.concat(at(p["gap"], i + 1), *(y for k in range(1, ACROSS + 1) for y in (at(p["c"], i + k), at(p["gap"], i + k + 1))))
    start = lambda i: F.length(F.array_join(F.slice(p["gap"], 1, i + 1), "")) + F.length(F.array_join(F.slice(p["c"], 1, i), ""))
    return F.transform(p["c"], lambda c, i: F.struct(c.alias("candidate"), start(i).alias("start"), F.right(before(i), F.lit(BEFORE)).alias("before"), F.left(after(i), F.lit(AFTER)).alias("after")))


def _scored(docs: DataFrame, path: str, findings: DataFrame | None) -> DataFrame:
    """row (the columns of docs), text, lines, p (occurrences of each line) and secrets: of each line the (candidate, start, before, after, score) of its occurrences.

    Projections one upon the other, so that nothing is computed twice.
    """
    features_of, score_of = scored_by(trained_forest(findings) if findings is not None else rule_forest(docs.sparkSession))
    where = F.col(path) if path in docs.columns else F.lit(None)
    d = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"), where.cast("string").alias("path"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    d = d.withColumn("p", F.transform("lines", occurrences))
    d = d.withColumn("c", F.transform("p", lambda p: F.when(p.isNotNull(), placed(p))))
    own = ("candidate", "start", "before", "after")
    named = lambda c, last: F.struct(*(c[n].alias(n) for n in own), last)
    d = d.withColumn("x", F.transform("c", lambda line: F.transform(line, lambda c: named(c, features_of(c["candidate"], c["before"], F.col("path"), c["after"]).alias("f")))))
    scored = F.transform("x", lambda line: F.transform(line, lambda c: named(c, score_of(c["f"]).alias("score"))))
    return d.select("row", "text", "lines", "p", scored.alias("secrets"))


def scan(docs: DataFrame, path: str = "source", findings: DataFrame | None = None, least: float = THRESHOLD) -> DataFrame:
    """One row per occurrence of a candidate: doc_id, line (from 0), start, candidate, before, after, score, secret."""
    d = _scored(docs.select("doc_id", "text", *([path] if path in docs.columns else [])), path, findings)
    s = d.select("row.doc_id", F.posexplode("secrets").alias("line", "s")).select("doc_id", "line", F.explode("s").alias("s"))
    return s.select("doc_id", "line", "s.start", "s.candidate", "s.before", "s.after", "s.score", (F.col("s.score") >= least).alias("secret"))


def redact(docs: DataFrame, path: str = "source", findings: DataFrame | None = None, least: float = THRESHOLD) -> DataFrame:
    """All rows and columns of docs with the span of each secret in text replaced by MARK, and n_secrets, their number."""
    d = _scored(docs, path, findings)
    n = F.aggregate(F.transform("secrets", lambda line: F.coalesce(F.size(F.filter(line, lambda s: s["score"] >= least)), F.lit(0))), F.lit(0), lambda a, b: a + F.greatest(b, F.lit(0)))
    d = d.withColumn("n", n)
    whole = lambda i: F.array_join(F.zip_with(F.get("p", i)["gap"], F.get("secrets", i), lambda g, s: F.concat(g, F.when(s["score"] >= least, F.lit(MARK)).otherwise(F.coalesce(s["candidate"], F.lit(""))))), "")
    text = F.when(F.col("n") > 0, F.array_join(F.transform("lines", lambda x, i: F.coalesce(whole(i), x)), "\n")).otherwise(F.col("text"))
    keep = [text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    name = "n_secrets"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return d.select(*keep, F.col("n").alias(name))
