"""Toxicity by a logistic classifier that is regularised with counterfactuals.

Features are the words of a text and their beginnings of 4, 5 and 6 letters, each once. The
loss has, besides the labels' cross-entropy, a penalty on the change of the score when an
identity term of a labelled text is swapped for another of its kind: a group's name alone
must not move the score, so neutral mentions aren't taken for attacks. It takes the features
that at least LEAST_DOCS labelled texts have and whose rates in the two classes lie over
LEAST_ERRORS standard errors apart, and all identity terms, however many they are.

Training takes at most per_class labelled rows of each class, those with the smallest hash
of doc_id (documented bound); the prior comes from all labels. The rates of features are
counted by Spark; of each labelled text only the chosen features reach the driver. Every text
is scored whole.

Nulls and odd cases: null or empty text has the score of no features; a null doc_id is
scored and never trained on; rows with a null label are not trained on, and of labels that
contradict each other for one doc_id toxic counts; rows that repeat a doc_id are scored each
by itself; with one class or no labels (as from an empty table) every score is the prior; a
text may be of any length; score() passes all columns through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm import text as tx
from graphmill.llm.op1_packing import text_lists
from graphmill.operators.scratch import Scratch

PER_CLASS, LEAST_DOCS, LEAST_ERRORS = 2000, 3, 2.0
THRESHOLD = 0.7
BEGINNINGS = (4, 5, 6)
#: Terms that name groups of people; a swap stays within a line.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("she", "he"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("trans", "cis"),
    ("immigrants", "natives"), ("immigrant", "native"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("africans", "europeans", "americans", "asians"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden", "atheisten"), ("ausländer", "einheimische"), ("schwarze", "weiße"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs", "athées"), ("noirs", "blancs"), ("étrangers", "français"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos", "ateos"), ("negros", "blancos"), ("extranjeros", "españoles"),
)
_U = np.uint64
_LOW48 = _U((1 << 48) - 1)


def features(texts: list[str], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit feature hashes of all texts, sorted within each, and where each text's start; known: only these (sorted)."""
    c, offs = tx.codes([t.lower() for t in texts])
    s, e = tx.runs(tx.classes()[c] == tx.LETTER, offs) if len(c) else (np.zeros(0, np.int64),) * 2
    doc = np.searchsorted(offs, s, "right") - 1 if len(s) else s
    parts, docs = [], []
    for k in (0, *BEGINNINGS):
        long = e - s > k
        h = tx.mix(tx.hashes(c, s[long], s[long] + k if k else e[long]) + _U(k)) >> _U(16) if len(s) else np.zeros(0, np.uint64)
        d = doc[long]
        if known is not None and len(h):
            hit = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            hit = known[hit] == h if len(known) else np.zeros(len(h), bool)
            h, d = h[hit], d[hit]
        parts.append(h)
        docs.append(d)
    s = np.sort(np.concatenate(docs).astype(np.uint64) << _U(48) | np.concatenate(parts))
    if len(s):
        s = s[np.append(True, s[1:] != s[:-1])]
    return s & _LOW48, np.searchsorted(s, np.arange(len(texts) + 1, dtype=np.uint64) << _U(48))


@dataclass
class Model:
    keys: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        f, at = features(texts, self.keys)
        sums = np.zeros(len(f) + 1)
        np.cumsum(self.weights[np.searchsorted(self.keys, f)], out=sums[1:])
        return 1 / (1 + np.exp(-np.clip(self.bias + sums[at[1:]] - sums[at[:-1]], -500, 500)))


def identity_features() -> np.ndarray:
    """Sorted features of all identity terms."""
    return features([" ".join(t for line in IDENTITY_TERMS for t in line)])[0]


def telling(df: np.ndarray, df1: np.ndarray, n0: float, n1: float) -> np.ndarray:
    """Which features tell the classes apart; df and df1: the texts, and those of label 1, that have each."""
    p1, p0 = (df1 + 0.5) / (n1 + 1), (df - df1 + 0.5) / (n0 + 1)
    z = np.abs(p1 - p0) / np.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0 + 1e-12)
    return (z > LEAST_ERRORS) & (df >= LEAST_DOCS)


def chosen_features(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Sorted features of the labelled texts that the model has weights for."""
    every, inverse = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    df, df1 = np.bincount(inverse, minlength=len(every)), np.bincount(inverse, weights=y[row], minlength=len(every))
    return every[telling(df, df1, len(y) - y.sum(), y.sum()) | np.isin(every, identity_features())]


def fit(rows: list[np.ndarray], swaps: list[tuple[int, np.ndarray]], y: np.ndarray, prior: float, strength: float = 1.0, l2: float = 1e-4, steps: int = 400, keys: np.ndarray | None = None) -> Model:
    """Logistic weights by gradient descent with Adam's step sizes.

    rows: the feature hashes of each labelled text. swaps: (row, the features of that text after a swap).
    keys: the features that get weights, sorted; chosen_features() if not given.
    """
    logit = float(np.log(prior / (1 - prior)))
    if not len(rows) or y.min() == y.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), logit)
    n1, n0 = y.sum(), len(y) - y.sum()
    if keys is None:
        keys = chosen_features(rows, y)

    def matrix(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
        own = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
        hit = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
        return own[hit], at[hit]

    xr, xc = matrix(rows)
    sr, sc = matrix([f for _, f in swaps])
    base = np.array([i for i, _ in swaps], np.int64)
    w, b = np.zeros(len(keys)), 0.0
    m, v = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    for t in range(1, steps + 1):
        margin = b + np.bincount(xr, weights=w[xc], minlength=len(rows))
        r = (1 / (1 + np.exp(-margin)) - y) / len(rows)
        if len(base):
            change = margin[base] - b - np.bincount(sr, weights=w[sc], minlength=len(base))
            push = 2 * strength * change / len(base)
            r_pair = np.bincount(base, weights=push, minlength=len(rows))
            g = np.bincount(xc, weights=(r + r_pair)[xr], minlength=len(keys)) - np.bincount(sc, weights=push[sr], minlength=len(keys))
        else:
            g = np.bincount(xc, weights=r[xr], minlength=len(keys))
        g = np.append(g + l2 * w, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    # the sample has its own share of label 1
    b += logit - float(np.log(n1 / n0))
    return Model(keys, w, float(b))


def swapped(text: str, ordinal: int) -> str | None:
    """The text with each identity term replaced by another of its line, or None if it has none."""
    import re

    lines = {t: line for line in IDENTITY_TERMS for t in line}
    seen = False

    def other(m):
        nonlocal seen
        seen = True
        line = lines[m[0]]
        return line[(line.index(m[0]) + 1 + ordinal % (len(line) - 1)) % len(line)]

    out = re.sub(r"[^\W\d_]+", lambda m: other(m) if m[0] in lines else m[0], text.lower())
    return out if seen else None


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """doc_id, text, y of at most per_class rows of each class; only the bounded choice is broadcast."""
    one = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("y")).where("_id is not null")
    first = lambda y: one.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
    chosen = first(0).unionByName(first(1))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """labels: doc_id and toxic (0 or 1) of the rows that may be learned from."""
    counts = {r["y"]: r["n"] for r in labels.where("toxic in (0, 1)").groupBy(F.col("toxic").alias("y")).agg(F.count("*").alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_lists(batch):
                swaps = [swapped(t, i) for i, t in enumerate(texts)]
                f, at = features(texts)
                g, to = features([s or "" for s in swaps])
                lists = [[x[a:b].astype(np.int64).tolist() for a, b in zip(k[:-1], k[1:])] for x, k in ((f, at), (g, to))]
                lists[1] = [x if s is not None else None for x, s in zip(lists[1], swaps)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), batch.column("y").slice(lo, hi - lo).cast(pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], ["doc_id", "y", "own", "swap"])

    sample = Scratch(docs.sparkSession, "toxicity").keep(labelled_sample(docs, labels, per_class).mapInArrow(work, "doc_id long, y int, own array<long>, swap array<long>"))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = (n1 + 0.5) / (n0 + n1 + 1)
    if not (sizes.get(0) and sizes.get(1)):
        return fit([], [], np.zeros(0), prior)
    # only what may be telling comes to the driver: telling() is applied there, exactly
    stats = sample.select("y", F.explode("own").alias("f")).groupBy("f").agg(F.count("*").alias("df"), F.sum("y").alias("df1")).where(F.col("df") >= LEAST_DOCS)
    apart = F.abs((F.col("df1") + 0.5) / (sizes[1] + 1) - (F.col("df") - F.col("df1") + 0.5) / (sizes[0] + 1))
    error = lambda p, n: p * (1 - p) / n
    spread = F.sqrt(error((F.col("df1") + 0.5) / (sizes[1] + 1), sizes[1]) + error((F.col("df") - F.col("df1") + 0.5) / (sizes[0] + 1), sizes[0]))
    stats = stats.where(apart > 0.999 * LEAST_ERRORS * spread).toArrow()
    f, df, df1 = (stats.column(c).to_numpy() for c in ("f", "df", "df1"))
    keys = np.unique(np.append(f.astype(np.uint64)[telling(df.astype(float), df1.astype(float), sizes[0], sizes[1])], identity_features()))

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for name in ("own", "swap"):
                lists = [None if x is None else np.flatnonzero(np.isin(keys, np.array(x, np.uint64))).tolist() for x in batch.column(name).to_pylist()]
                columns.append(pa.array(lists, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *columns], ["doc_id", "y", "own", "swap"])

    got = sample.mapInArrow(narrowed, "doc_id long, y int, own array<long>, swap array<long>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")]).to_pylist()
    at = lambda x: keys[np.array(x, np.int64)]
    swaps = [(i, at(x["swap"])) for i, x in enumerate(got) if x["swap"] is not None]
    return fit([at(x["own"]) for x in got], swaps, np.array([x["y"] for x in got], float), prior, keys=keys)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of docs, and the score as `name`, which takes the place of a column of that name."""
    from pyspark.sql import types as T

    out = T.StructType([*(f for f in docs.schema.fields if f.name != name), T.StructField(name, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_lists(batch):
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(model.scores(texts))], [*own.schema.names, name])

    return docs.select(*(c for c in docs.columns if c != name)).mapInArrow(work, out)


def remainder(column: str, n: int):
    """crc32 of an id as text, mod n: the folds of the queries."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
