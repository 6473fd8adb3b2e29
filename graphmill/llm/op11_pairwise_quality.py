"""Quality by Bradley-Terry ranking: scores learned from pairs of a better and a worse document.

The score of a document is linear in its features. A pair of a good and a bad document is
lost with probability 1 / (1 + exp(good score - bad score)); training minimises the mean of
its logarithm over the pairs, plus a small square of the weights, so only differences of features
matter and no share of good documents is assumed. That share comes in with the cut: it lies
at the quantile of all learnable labelled documents' scores that leaves as many below it as
have label 0. The score that is returned is 1 / (1 + exp(cut - score)), 0.5 at the cut.

Features are of form, not of words, so they hold for unseen vocabularies: the shares of pairs of
neighbouring character classes, and of words that are distinct, equal to the word before, equal
to the one two before, without a letter, short, long; the numbers of words and of lines for each
word. Each is taken on a logarithmic scale and split over STEPS + 1 overlapping triangles,
so a weight can rise and fall along it.

Training takes at most per_class labelled documents of each label, those with the smallest hash
of doc_id, and PAIRS pairs for each (documented bounds, of documents, and of rows too: a repeated
doc_id counts once, with its smallest text). Everything else sees all rows: the cut is
taken from every labelled document, by counts of scores in steps of 1 / CUT_STEPS. The driver gets
feature vectors of fixed length of the bounded sample and at most 2 * REACH * CUT_STEPS counts.

Nulls and odd cases: null or empty text has the features of no words; a null doc_id is scored
and never learned from; null labels are not learned from, and labels that contradict each other
for one doc_id count as 1; repeated rows are scored each by itself; without labels of both kinds
every score is 0.5; a text may be of any length: one longer than a block is counted in pieces;
an empty table gives no row; raw_scores() passes all other columns through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.llm import text as tx
from graphmill.operators.scratch import Scratch

PER_CLASS, PAIRS = 4000, 8
STEPS, LOWEST = 6, -4.0
CUT_STEPS, REACH = 100, 100
#: Classes of bytes; those of characters beyond ASCII count as small letters.
BLANK, FEED, SMALL, CAPITAL, DIGIT, STOP, SHOUT, SIGN = range(8)
_CLASS = np.full(256, SMALL, np.uint8)
_CLASS[:128] = SIGN
for _chars, _c in ((b"\t\v\f\r ", BLANK), (b"\n", FEED), (bytes(range(97, 123)), SMALL), (bytes(range(65, 91)), CAPITAL), (b"0123456789", DIGIT), (b".,;:?'\"-()", STOP), (b"!", SHOUT)):
    _CLASS[list(_chars)] = _c
_WORD_SHARES = 5
N_VALUES = 64 + _WORD_SHARES + 2
#: Bytes that are handled at once of a text that is longer.
PIECE = 1 << 18


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of pieces of at most PIECE bytes, and the text of each; a text is cut after white space where there is some in the last half of a piece."""
    if (np.diff(offs) <= PIECE).all():
        return offs, np.arange(len(offs) - 1)
    starts, owner = [], []
    for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        while b - a > PIECE:
            starts.append(a)
            owner.append(i)
            gaps = np.flatnonzero(_CLASS[data[a + PIECE // 2 : a + PIECE]] <= FEED)
            a += PIECE // 2 + int(gaps[-1]) + 1 if len(gaps) else PIECE
        starts.append(a)
        owner.append(i)
    return np.array([*starts, offs[-1]], np.int64), np.array(owner, np.int64)


def values(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of N_VALUES numbers from LOWEST to 0 for each text given as UTF-8 bytes."""
    n = len(offs) - 1
    at, owner = pieces(data, offs)
    pairs, words = np.zeros((n, 64)), np.zeros((n, _WORD_SHARES + 1))
    hashes: list[list[np.ndarray]] = [[] for _ in range(n)]
    for lo, hi in tx.blocks(np.diff(at), PIECE):
        part, o = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        doc = owner[lo:hi]
        c = _CLASS[part]
        if len(c) > 1:
            own = np.repeat(np.arange(hi - lo), np.diff(o))
            same = own[1:] == own[:-1]
            key = own[1:] * 64 + (c[:-1].astype(np.int64) << 3 | c[1:])
            np.add.at(pairs, doc, np.bincount(key[same], minlength=(hi - lo) * 64).reshape(-1, 64))
        s, e = tx.runs(c > FEED, o)
        if not len(s):
            continue
        h = tx.hashes(part, s, e)
        own = np.searchsorted(o, s, "right") - 1
        letters = np.concatenate([[0], np.cumsum((c == SMALL) | (c == CAPITAL))])
        flags = np.zeros((_WORD_SHARES, len(s)), bool)
        flags[0, 1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
        flags[1, 2:] = (h[2:] == h[:-2]) & (own[2:] == own[:-2])
        flags[2] = letters[e] == letters[s]
        flags[3], flags[4] = e - s <= 2, e - s > 15
        for k in range(_WORD_SHARES):
            np.add.at(words[:, k], doc, np.bincount(own[flags[k]], minlength=hi - lo))
        np.add.at(words[:, -1], doc, np.bincount(own, minlength=hi - lo))
        cut = np.searchsorted(own, np.arange(hi - lo + 1))
        for k in range(hi - lo):
            hashes[doc[k]].append(h[cut[k] : cut[k + 1]])
    total = np.maximum(words[:, -1], 1)
    distinct = np.array([len(np.unique(np.concatenate(x))) if x else 0 for x in hashes])
    shares = np.concatenate([pairs / np.maximum(pairs.sum(1), 1)[:, None], words[:, :-1] / total[:, None], (distinct / total)[:, None]], 1)
    out = np.log10(shares + 10.0**LOWEST)
    return np.concatenate([np.clip(out, LOWEST, 0), (LOWEST + np.minimum(np.log10(total), -LOWEST))[:, None]], 1)


def spread(v: np.ndarray) -> np.ndarray:
    """Each value as weights of the two steps it lies between: STEPS + 1 columns a value."""
    x = (v - LOWEST) * (STEPS / -LOWEST)
    return np.maximum(0, 1 - np.abs(x[:, :, None] - np.arange(STEPS + 1))).reshape(len(v), -1)


@dataclass
class Ranking:
    weights: np.ndarray

    def raw(self, v: np.ndarray) -> np.ndarray:
        """Scores of rows of values(), within REACH; 0 for all where nothing was learned."""
        # a sum by row, so that a score doesn't hang on the texts beside it
        return np.clip((spread(v) * self.weights).sum(1), -REACH, REACH) if len(self.weights) else np.zeros(len(v))


def preference_pairs(good: int, bad: int, each: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (good, bad): each document of the larger side meets `each` of the other, all of them about equally often."""
    n, other = max(good, bad), min(good, bad)
    i = np.repeat(np.arange(n), each)
    j = (i * each + np.tile(np.arange(each), n) * (1 + other // each)) % other
    return (i, j) if good >= bad else (j, i)


def fit(good: np.ndarray, bad: np.ndarray, l2: float = 1e-4, rounds: int = 300) -> Ranking:
    """Weights of least mean log(1 + exp(bad - good)) over the pairs, by Adam's steps; good, bad: rows of values()."""
    if not len(good) or not len(bad):
        return Ranking(np.zeros(0))
    a, b = preference_pairs(len(good), len(bad))
    x = np.concatenate([spread(good), spread(bad)])
    b = b + len(good)
    w = np.zeros(x.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        s = x @ w
        push = 1 / (1 + np.exp(np.clip(s[a] - s[b], -500, 500))) / len(a)  # how likely each pair is lost
        g = x.T @ (np.bincount(b, weights=push, minlength=len(x)) - np.bincount(a, weights=push, minlength=len(x))) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Ranking(w)


def one_label(labels: DataFrame) -> DataFrame:
    """(_id, y): one row for each labelled doc_id, 1 if any of its labels is."""
    return labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("int").alias("y"))


def cut_at(counts: dict[int, int], below: float) -> float:
    """The score at which the counts by step have `below` scores under it, between the steps that hold scores."""
    left, last = below, None
    for step in sorted(counts):
        if last is not None and left <= 0:
            return (last + step + 1) / 2 / CUT_STEPS
        if left < counts[step] / 2:
            return step / CUT_STEPS
        left -= counts[step]
        last = step
    return (last + 1) / CUT_STEPS if last is not None else 0.0


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Ranking:
    """labels: doc_id and quality (0 or 1) of the rows that may be learned from."""
    one = one_label(labels)
    first = lambda y: one.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
    chosen = F.broadcast(first(0).unionByName(first(1)))
    sample = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).groupBy("_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, v in (x for batch in batches for x in valued(batch)):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * N_VALUES), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([own.column("_id").cast(pa.int64()), own.column("y"), lists], ["id", "y", "v"])

    got = sample.select("_id", "y", "text").mapInArrow(work, "id long, y int, v array<double>").toArrow().sort_by("id")
    y, v = got.column("y").to_numpy(), np.array(got.column("v").to_pylist(), float).reshape(-1, N_VALUES)
    return fit(v[y == 1], v[y == 0])


def valued(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch, of bounded size, with the values of their texts (null: empty)."""
    data, offs = tx.utf8(batch.column("text"))
    for lo, hi in tx.blocks(np.diff(offs)):
        yield batch.slice(lo, hi - lo), values(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])


def raw_scores(docs: DataFrame, ranking: Ranking, name: str = "score") -> DataFrame:
    """All columns of docs, and the score before the cut as `name`, which takes the place of a column of that name. One scan, no shuffle."""
    out = T.StructType([*(f for f in docs.schema.fields if f.name != name), T.StructField(name, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, v in (x for batch in batches for x in valued(batch)):
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(ranking.raw(v))], [*own.schema.names, name])

    return docs.select(*(c for c in docs.columns if c != name)).mapInArrow(work, out)


def quantile_cut(scored: DataFrame, labels: DataFrame, name: str = "score") -> float:
    """The cut over all labelled rows of raw_scores(): their quantile at the share of label 0; 0 without labels of both kinds."""
    per = scored.select("doc_id", name).join(one_label(labels), F.col("doc_id") == F.col("_id")).groupBy(F.floor(F.col(name) * CUT_STEPS).alias("step")).agg(F.count("*").alias("n"), F.count_if(F.col("y") == 0).alias("bad")).collect()
    n, bad = sum(r["n"] for r in per), sum(r["bad"] for r in per)
    return cut_at({r["step"]: r["n"] for r in per}, bad) if 0 < bad < n else 0.0


def with_cut(scored: DataFrame, cut: float, name: str = "score") -> DataFrame:
    """raw_scores() turned into scores from 0 to 1, 0.5 at the cut."""
    return scored.withColumn(name, 1 / (1 + F.exp(F.lit(cut) - F.col(name))))


def judge(docs: DataFrame, labels: DataFrame, name: str = "score", per_class: int = PER_CLASS, pass_on: list[str] | None = None) -> DataFrame:
    """The columns pass_on of docs (all of them if not given) and their score from 0 to 1; they are written once with the raw scores, which the cut and the result read."""
    kept = [c for c in (docs.columns if pass_on is None else pass_on) if c != name]
    raw = Scratch(docs.sparkSession, "ranking").keep(raw_scores(docs, train(docs, labels, per_class), name).select(*kept, name))
    return with_cut(raw, quantile_cut(raw, labels, name), name)
