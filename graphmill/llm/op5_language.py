"""Language of whole texts by n-gram filters whose every slot is a bitmask of languages.

Learning takes the character 4-grams of lower-case letters (runs of other characters count
as one blank) that at least MIN_SHARE of a language's sampled texts have, and OF_BEST of the
share in the language where the gram is commonest, shares being smoothed by one text. They
are put into a bit-sliced Bloom filter: an array of slots with one bit for each language; a
gram sets its language's bit in K slots. The AND of a gram's K slots is the set of all
languages that it was put in for, for one look-up of any number of languages. Per-language
popcounts over a text's grams, less what false positives are expected to add, decide. The
filter has at least 8 slots for each gram of the language with most, however many they are.

Learning takes at most per_language texts of each language, those with the smallest hash of
doc_id (documented bound). Every text is read whole.

Nulls and odd cases: null text or text without a letter is `und` with score 0; letters but
no known gram give the most frequent learned language with score 0; with nothing learned
(as from an empty table) everything is `und`; ties go to the alphabetically first language; a
null doc_id stays null; a text may be of any length; repeated rows are each predicted by
itself; columns besides those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm import text as tx
from graphmill.llm.op1_packing import text_lists

PER_LANGUAGE, MIN_SHARE, OF_BEST = 2000, 0.004, 0.25
LEAST_BITS, K, N = 20, 3, 4
_U = np.uint64


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the 4-grams of all texts, the text of each, and whether each text has a letter."""
    c, offs = tx.codes([t.lower() for t in texts])
    letter = tx.classes()[c] == tx.LETTER
    doc = np.repeat(np.arange(len(texts)), np.diff(offs))
    has = np.bincount(doc[letter], minlength=len(texts)) > 0
    # runs of other characters become one blank
    keep = letter.copy()
    if len(c):
        keep[1:] |= letter[:-1] & ~letter[1:]
        keep[0] = True
    c, doc = np.where(letter, c, 32)[keep].astype(np.uint32), doc[keep]
    if len(c) < N:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    h = np.zeros(len(c) - N + 1, np.uint64)
    for j in range(N):
        h = (h + c[j : len(h) + j].astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    inside = doc[N - 1 :] == doc[: len(h)]
    return tx.mix(h[inside]), doc[: len(h)][inside], has


def slots(h: np.ndarray, size: int) -> list[np.ndarray]:
    """The K slots of each gram in a filter of that many slots, a power of two up to 2**32."""
    out = [h & _U(size - 1), h >> _U(32) & _U(size - 1), tx.mix(h) & _U(size - 1)]
    return [x.astype(np.int64) for x in out]


@dataclass
class Filters:
    languages: list[str]
    masks: np.ndarray  # slots x words of 64 languages
    false: np.ndarray  # false positive rate of each language
    common: int  # most frequent language

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        h, doc, has = grams(texts)
        n = len(texts)
        if not self.languages:
            return ["und"] * n, np.zeros(n)
        a, b, c = slots(h, len(self.masks))
        hits = np.zeros((n, len(self.languages)))
        for word in range(self.masks.shape[1]):
            m = self.masks[:, word]
            both = m[a] & m[b] & m[c]
            for bit in range(min(64, len(self.languages) - 64 * word)):
                hits[:, 64 * word + bit] = np.bincount(doc, weights=((both >> _U(bit)) & _U(1)).astype(float), minlength=n)
        total = np.bincount(doc, minlength=n)[:, None]
        true = np.maximum(0, (hits - total * self.false) / (1 - self.false))
        best, sums = true.argmax(1), true.sum(1)
        score = np.divide(true.max(1), sums, out=np.zeros(n), where=sums > 0)
        best[sums == 0] = self.common
        return [self.languages[i] if ok else "und" for i, ok in zip(best.tolist(), has.tolist())], np.where(has, score, 0.0)


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Filters:
    """docs: doc_id, text and lang of the rows that may be learned from."""
    rows = docs.where("lang is not null and text is not null and doc_id is not null")
    # only ids whose hash is small enough to be chosen, or very nearly, are sorted: some per_language of each language
    present = [(r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not present:
        return Filters([], np.zeros((1 << LEAST_BITS, 1), np.uint64), np.zeros(0), 0)
    near = F.create_map(*(x for k, n in present for x in (F.lit(k), F.lit(min(1 << 40, int((per_language + 8 * per_language**0.5 + 8) / n * (1 << 40)))))))
    small = rows.select("doc_id", "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) <= near[F.col("lang")])
    w = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id")
    chosen = small.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_language).select(F.col("doc_id").alias("_id")).distinct()
    sample = rows.select("doc_id", "lang", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("lang", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_lists(batch):
                lang = batch.column("lang").slice(lo, hi - lo).to_pylist()
                h, doc, _ = grams(texts)
                names = sorted(set(lang))
                of = np.array([names.index(x) for x in lang])
                for i, name in enumerate(names):
                    own = of[doc] == i
                    # once for each text
                    d = np.unique(np.stack([h[own], doc[own].astype(np.uint64)]), axis=1)[0] if own.any() else h[:0]
                    g, n = np.unique(d, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g)), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = sample.mapInArrow(work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sizes = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    of = lambda value: F.create_map(*(x for k, v in sizes.items() for x in (F.lit(k), F.lit(value(v)))))[F.col("lang")]
    share = (F.col("n") + 1) / of(lambda v: v + 2)
    best = F.max(share).over(Window.partitionBy("gram"))
    common = counts.withColumn("of_best", share / best).where((F.col("of_best") >= OF_BEST) & (F.col("n") >= of(lambda v: 1 if v < 20 else max(2, int(np.ceil(MIN_SHARE * v))))))
    kept = common.select("lang", "gram").toArrow()
    place = {x: i for i, x in enumerate(languages)}
    by = np.array([place[x] for x in kept.column("lang").to_pylist()], np.int64)
    most = int(np.bincount(by, minlength=1).max())
    size = 1 << max(LEAST_BITS, (8 * most - 1).bit_length() if most else 0)
    masks = np.zeros((size, -(-len(languages) // 64)), np.uint64)
    false = np.zeros(len(languages))
    gram = kept.column("gram").to_numpy().view(np.uint64) if len(kept) else np.zeros(0, np.uint64)
    for i in range(len(languages)):
        for s in slots(gram[by == i], size):
            masks[s, i // 64] |= _U(1) << _U(i % 64)
        false[i] = ((masks[:, i // 64] >> _U(i % 64)) & _U(1)).mean() ** K
    return Filters(languages, masks, false, place[min((-n, x) for x, n in present if x in place)[1]])


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score of each row; the filters (8 bytes a slot for 64 languages) are sent once to each executor."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            for lo, hi, texts in text_lists(batch):
                lang, score = f.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, lang_pred string, score double")
