"""Vector, full-text and hybrid retrieval, and entity resolution."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from graphmill.functions import columns as c

RRF_K = 60

#: Minhashes of a label and how many make a band; the labels before it, by spelling, that a label meets in a bucket besides its first.
HASHES, ROWS, WINDOW = 128, 5, 16


def vector_search(rows: DataFrame, query_vec: list[float], k: int, vec: str = "embedding") -> DataFrame:
    """The k rows of highest cosine to one vector, which is a literal; top-k by the exact value without a full sort, similarity rounded after."""
    q = F.array(*(F.lit(float(x)) for x in query_vec)).cast("array<double>")
    return rows.withColumn("cosine", c.cosine(F.col(vec), q)).orderBy(F.desc("cosine"), "vec_id").limit(k).withColumn("similarity", F.round("cosine", 4))


def bm25(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of documents with a query term. Only rows of query terms are counted; the corpus statistics are one row."""
    toks = F.filter(F.split(F.lower(F.col(text)), "[^a-z]+"), lambda w: w != "")
    d = docs.select(key, toks.alias("w")).withColumn("dl", F.size("w"))
    stats = d.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = d.select(key, "dl", F.explode(F.filter("w", lambda w: w.isin(*terms))).alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    x = tf.join(F.broadcast(df), "term").join(F.broadcast(stats))  # at most one row for each query term, and one
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return x.groupBy(key).agg(F.sum(idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).alias("score"))


def reciprocal_rank_fusion(vector: DataFrame, text: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """(key, rrf) of the keys in vector(key, rank); text(key, rank) adds to them. Ranks begin at 0."""
    t = text.select(key, F.col("rank").alias("_t"))
    return vector.select(key, F.col("rank").alias("_v")).join(t, key, "left").select(key, (1 / (k + F.col("_v") + 1) + F.coalesce(1 / (k + F.col("_t") + 1), F.lit(0.0))).alias("rrf"))


@pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity (prefix weight 0.1, four characters at most, above 0.7 only)."""

    def one(s: str, t: str) -> float | None:
        if s is None or t is None:
            return None
        if s == t:
            return 1.0
        m, n = len(s), len(t)
        reach = max(max(m, n) // 2 - 1, 0)
        used, hit = [False] * n, []
        for i, ch in enumerate(s):
            for j in range(max(0, i - reach), min(n, i + reach + 1)):
                if not used[j] and t[j] == ch:
                    used[j] = True
                    hit.append(ch)
                    break
        k = len(hit)
        if not k:
            return 0.0
        other = [t[j] for j in range(n) if used[j]]
        half = sum(x != y for x, y in zip(hit, other)) / 2
        jaro = (k / m + k / n + (k - half) / k) / 3
        if jaro <= 0.7:
            return jaro
        prefix = 0
        for x, y in zip(s[:4], t[:4]):
            if x != y:
                break
            prefix += 1
        return jaro + prefix * 0.1 * (1 - jaro)

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def bands(labels: DataFrame, hashes: int = HASHES, rows: int = ROWS) -> DataFrame:
    """(key, label, id): 25 bands of five of 128 minhashes over the 3-shingles of each label without blanks.

    Two labels of similarity 0.7 share a band with probability 0.99, and of 0.5 with 0.55.
    """
    s = c.shingles(F.regexp_replace("label", " ", ""))

    def least(i: int):
        # the function has one parameter: with two, transform() would pass the index as the second
        return F.array_min(F.transform("s", lambda x: F.xxhash64(x, F.lit(i))))

    sig = F.array(*(least(i) for i in range(hashes)))
    x = labels.select("id", "label", s.alias("s")).select("id", "label", sig.alias("m"))
    keys = F.array(*(F.xxhash64(F.lit(i), F.slice("m", i + 1, rows)) for i in range(0, hashes - rows + 1, rows)))
    return x.select(F.explode(keys).alias("key"), "label", "id")


def met_pairs(buckets: DataFrame, window: int = WINDOW) -> DataFrame:
    """(a, b): each id of a bucket with the bucket's first and with the `window` ids before it by spelling.

    Up to window + 1 ids are all pairs of the bucket; a larger bucket is as many rows as ids times
    window, so its pairs don't grow with its square. Buckets are sorted by ranges, so one of any size
    spreads over tasks, each with a first of its own.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, last = None, None, []
        for batch in batches:
            a, b = [], []
            for k, i in zip(batch.column("key").to_pylist(), batch.column("id").to_pylist()):
                if k != key:
                    key, first, last = k, i, [i]
                    continue
                near = last if first in last else [first, *last]
                a += near
                b += [i] * len(near)
                last = [*last, i][-window:]
            yield pa.RecordBatch.from_arrays([pa.array(a, batch.column("id").type), pa.array(b, batch.column("id").type)], ["a", "b"])

    n = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = buckets.schema["id"].dataType.simpleString()
    pairs = buckets.repartitionByRange(n, "key", "label").sortWithinPartitions("key", "label").select("key", "id").mapInArrow(work, f"a {kind}, b {kind}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def blocked_pairs(labels: DataFrame) -> DataFrame:
    """(a, b) of labels(id, label) that meet in a band of minhashes: the blocking of entity resolution. Equal labels are collapsed before."""
    return met_pairs(bands(labels))


def resolve(labels: DataFrame, least: float = 0.92) -> DataFrame:
    """(a, b, score) of label pairs of Jaro-Winkler similarity `least` or more among blocked pairs."""
    p = blocked_pairs(labels)
    j = p.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    return j.withColumn("score", jaro_winkler("la", "lb")).where(F.col("score") >= least).select("a", "b", F.round("score", 4).alias("score"))


def stream_daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Daily calls and errors by tool of a stream (or table) of events with a timestamp ts."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("tool")).agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.col("w.start").alias("day"), "tool", "calls", "errors")


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Ranks from 0 over rows that a limit has bounded before."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


