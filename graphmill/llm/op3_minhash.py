"""Near-duplicate documents by MinHash with tensored banding.

A document's set has its distinct word shingles. Two collections of M groups of GROUP
minhashes each are made; the key of table (i, j) combines group i of the left with group j
of the right collection, so M * M tables of 2 * GROUP minhashes each cost only
2 * M * GROUP of them. Two sets of Jaccard similarity s meet in no table with probability
1 - (1 - (1 - s**GROUP)**M)**2: with the values below 4e-4 at 0.8. Only ids whose left and
right groups are both shared with another id are put into tables at all.
What meets is compared exactly on full sets (48-bit hashes of shingles), see links.py.

Two different shingles of a document count as one with probability 2**-48 for each pair of
them, so n_shingles of a text of n words is short by one with probability n**2 / 2**49.

Nulls and odd cases: null, empty or blank text has no shingles and is linked with nothing;
a null doc_id has no component and is kept; rows that repeat a doc_id are linked with each
other and have the links of all of them; a text may be of any length; an empty table gives
an empty one; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm import text as tx
from graphmill.llm.links import linked_components, members_of, six_bytes
from graphmill.operators.scratch import Scratch

M, GROUP = 12, 3
HASHES = 2 * M * GROUP
_U = np.uint64
_LOW48 = _U((1 << 48) - 1)


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of n hash functions on 32 bits."""
    x = tx.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95)) >> _U(32)
    return (x[:n] | _U(1)).astype(np.uint32), x[n:].astype(np.uint32)


def minhashes(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n x len(starts) minima over the spans of 64-bit hashes that begin at starts and end at the next."""
    x = (h >> _U(32)).astype(np.uint32)
    a, b = multipliers(n)
    out = np.empty((n, len(starts)), np.uint32)
    v = np.empty_like(x)
    for j in range(n):
        np.multiply(x, a[j], out=v)
        np.add(v, b[j], out=v)
        out[j] = np.minimum.reduceat(v, starts)
    return out


def group_keys(minima: np.ndarray, first: int, size: int) -> np.ndarray:
    """64-bit key of the minima of rows first .. first + size, with the place in it."""
    k = np.full(minima.shape[1], _U((first + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    for j in range(first, first + size):
        k = tx.mix(k ^ minima[j].astype(np.uint64))
    return k.view(np.int64)


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 48-bit shingle hashes of all texts, and where each text's start."""
    h, at = tx.ascii_words(data, offs)
    n = np.diff(at)
    full = np.maximum(n - words + 1, 0)
    doc = np.repeat(np.arange(len(n), dtype=np.uint64), full)
    first = tx.ragged(at[:-1], full)
    g = np.zeros(len(first), np.uint64)
    for j in range(words):
        g = tx.mix(g * _U(0x9E3779B97F4A7C15) + h[first + j] + _U(1))
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(words - 1):
            has = n[short] > j
            whole[has] = tx.mix(whole[has] * _U(0x9E3779B97F4A7C15) + h[at[short[has]] + j] + _U(1))
        g, doc = np.concatenate([g, tx.mix(whole + n[short].astype(np.uint64))]), np.concatenate([doc, short.astype(np.uint64)])
    s = np.sort(doc << _U(48) | g >> _U(16))
    if len(s):
        s = s[np.append(True, s[1:] != s[:-1])]
    return s & _LOW48, np.searchsorted(s, np.arange(len(n) + 1, dtype=np.uint64) << _U(48))


def byte_blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with the bytes of their texts; under 50,000 rows each."""
    data, offs = tx.utf8(batch.column("text"))
    for lo, hi in tx.blocks(np.maximum(np.diff(offs), tx.BLOCK // 50_000)):
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Of each row: doc_id, number of shingles, two hashes of the set, and the group keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in byte_blocks(batch):
                s, at = shingle_sets(data, offs, words)
                n = np.diff(at)
                has = np.flatnonzero(n)
                h1, h2 = set_hashes(s, at)
                keys = np.zeros((hi - lo, 2 * M), np.int64)
                if len(has):
                    minima = minhashes(tx.mix(s + _U(1)), at[:-1][has], HASHES)
                    for i in range(2 * M):
                        keys[has, i] = group_keys(minima, i * GROUP, GROUP)
                offsets = pa.array(np.arange(hi - lo + 1) * M, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(k).ravel())) for k in (keys[:, :M], keys[:, M:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(h1), pa.array(h2), *lists], ["doc_id", "n_shingles", "h1", "h2", "lefts", "rights"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n_shingles long, h1 long, h2 long, lefts array<long>, rights array<long>")


def set_hashes(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; 0 of an empty one."""
    has = np.flatnonzero(np.diff(at))
    h1, h2 = np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1, np.int64)
    if len(has):
        x, starts = tx.mix(s + _U(1)), at[:-1][has]
        h1[has] = np.add.reduceat(x, starts).view(np.int64)
        h2[has] = np.bitwise_xor.reduceat(tx.mix(x), starts).view(np.int64)
    return h1, h2


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, the set's two hashes and its sorted shingle hashes, six bytes each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in byte_blocks(batch):
                s, at = shingle_sets(data, offs, words)
                h1, h2 = set_hashes(s, at)
                raw = s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                items = pa.array([raw[6 * a : 6 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(h1), pa.array(h2), items], ["doc_id", "h1", "h2", "items"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, h1 long, h2 long, items binary")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.keep(signatures(docs, words))
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    # equal sets are one node: the smallest doc_id stands for them; a doc_id with several sets has a node for each
    several = scratch.keep(linkable.select("doc_id", "h1", "h2").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    odd = not several.isEmpty()
    nodes = linkable.select("doc_id", "h1", "h2", "n_shingles")
    if odd:
        nodes = nodes.join(several.withColumn("odd", F.lit(True)), "doc_id", "left").withColumn("id", F.when(F.col("odd"), F.xxhash64("doc_id", "h1", "h2")).otherwise(F.col("doc_id"))).drop("odd")
    else:
        nodes = nodes.withColumn("id", F.col("doc_id"))
    same = nodes.groupBy("h1", "h2", "n_shingles").agg(F.min(F.struct("id", "doc_id")).alias("x")).select("h1", "h2", "n_shingles", "x.id", F.col("x.doc_id").alias("of"))
    same = scratch.keep(same)
    own = linkable.join(same.withColumnRenamed("of", "doc_id"), ["doc_id", "h1", "h2", "n_shingles"]).select("id", "lefts", "rights").dropDuplicates(["id"])
    own = scratch.keep(own)
    shared = scratch.keep(members_of(own.select("id", F.explode(F.concat("lefts", "rights")).alias("key"))))
    hit = shared.join(own.select("id", "lefts"), "id").select("id", "key", F.array_contains("lefts", F.col("key")).alias("left"))
    left, right = hit.where("left").select("id", F.col("key").alias("l")), hit.where("not left").select("id", F.col("key").alias("r"))
    rows = scratch.keep(members_of(left.join(right, "id").select(F.xxhash64("l", "r").alias("key"), "id")))

    def sets_for(ids: DataFrame) -> DataFrame:
        wanted = same.join(ids, "id").select("id", F.col("of").alias("doc_id"), "h1", "h2")
        # a merge join at every size: the ids grow with the corpus
        source = docs.select(F.col("doc_id").cast("long"), "text").join(wanted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
        sets = sets_of(source, words).join(wanted.hint("merge"), ["doc_id", "h1", "h2"])
        return sets.groupBy("id").agg(F.min("items").alias("items"))

    place = nodes.select("doc_id", "h1", "h2", "n_shingles").join(same.drop("of"), ["h1", "h2", "n_shingles"]).select("doc_id", "id").distinct()
    extra = None
    if odd:
        # all sets of one doc_id are linked
        held = place.join(several, "doc_id", "left_semi")
        extra = scratch.keep(held.join(held.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).where("a <> b"))
    parts = linked_components(rows, sets_for, six_bytes, percent, scratch, extra)
    label = place.join(parts.withColumnRenamed("node", "id"), "id", "left").select("doc_id", F.coalesce("component", "id").alias("component_id")).distinct()
    if odd:
        # a component that is named after a hashed id gets its smallest doc_id
        label = label.join(label.groupBy("component_id").agg(F.min("doc_id").alias("least")), "component_id").select("doc_id", F.col("least").alias("component_id")).distinct()
    label = scratch.keep(label)
    scratch.keep_only(signed, label)
    out = signed.select("doc_id", "n_shingles").join(label, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
