"""Nearest neighbours by randomly rotated one-bit codes.

Each vector less the centroid is rotated by a fixed random orthogonal matrix; the signs of
its coordinates are its code, one bit each. With two scalars for each vector, its norm and
how well its code points along it, inner products are estimated from the packed bits, a block of
queries at a time: one product with the signs of a chunk of codes. The estimate has an
error bound. For each query, vectors whose upper bound reaches the kth best score so far, or
where there are none the kth best lower bound, are reranked exactly on the original vectors,
in double precision.

The index has every row. It is dealt to partitions of LEAST to PART vectors by row, whatever the
keys are, and each partition gets all queries, in blocks of at most BLOCK, as rows of a
table: nothing goes through the driver but the centroid. A partition returns at most k rows
for a query; those are merged by a window over one query's rows.

Nulls and odd cases: vectors that are null, zero, of another than the usual length or
hold null or non-finite components take no part; null ids take no part; rows that repeat an
id are candidates each by itself but the query's own id is never its neighbour; ties go to
the smaller id; with fewer candidates than k all are returned, with none an empty table;
columns besides the two are ignored. No text takes part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK, BLOCK = 4_096, 256
#: Vectors of a partition: at most, and so many that another one pays.
PART, LEAST = 65_536, 4_096
#: Width of the error bound in standard deviations of the estimate.
WIDTH = 4.0


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same for the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id long, v array<double> of the vectors that take part."""
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(~bad & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def encode_rows(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, norms, and the codes' inner products with the rotated unit vectors."""
    r = (x - centre) @ turn.T
    norm = np.linalg.norm(r, axis=1)
    bits = r > 0
    along = np.abs(r).sum(1) / np.sqrt(x.shape[1]) / np.where(norm > 0, norm, 1)
    return np.packbits(bits, axis=1), norm, np.where(norm > 0, along, 1.0)


class Part:
    """Vectors of one partition, their codes and the scalars of the estimate."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, along: np.ndarray):
        dim = x.shape[1]
        self.ids, self.x, self.codes = ids, x, codes
        self.most = float(np.linalg.norm(x, axis=1).max())
        # <x, q> = <centre, q> + norm * <unit, turned q>, and <unit, q> is about <code, q> / along
        self.scale = (norm / along / np.sqrt(dim)).astype(np.float32)
        # a unit vector's part across its code is sqrt(1 - along^2) long and points anywhere in dim - 1 dimensions
        self.spread = (WIDTH * norm * np.sqrt(np.maximum(1 - along**2, 0)) / along / np.sqrt(max(dim - 1, 1))).astype(np.float32)

    def nearest(self, own: np.ndarray, q: np.ndarray, turned: np.ndarray, base: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each row of q, the vector of id own, ids and scores of its k nearest; base has its inner product with the centre.

        Estimates of a block are one product of the turned queries with the signs that a chunk's codes unpack to.
        """
        length = np.linalg.norm(q, axis=1)
        turned, fine = turned.astype(np.float32), 1e-5 * (1 + length)
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
        for lo in range(0, len(self.ids), CHUNK):
            hi = min(lo + CHUNK, len(self.ids))
            signs = np.unpackbits(self.codes[lo:hi], axis=1, count=q.shape[1]).astype(np.float32) * 2 - 1
            estimate = turned @ (signs * self.scale[lo:hi, None]).T
            slack = np.outer(length, self.spread[lo:hi]).astype(np.float32) + fine[:, None].astype(np.float32)
            bar = np.array([s[-1] - c if len(s) >= k else -np.inf for (_, s), c in zip(best, base)])
            if hi - lo > k + 1:  # one of them may be the query itself
                new = np.flatnonzero(np.isneginf(bar))
                if len(new):
                    bar[new] = np.partition(estimate[new] - slack[new], hi - lo - k - 1, axis=1)[:, hi - lo - k - 1]
            estimate += slack
            bar -= np.where(np.isfinite(bar), 1e-4 * (1 + np.abs(bar)), 0)
            reach = ~(estimate < bar[:, None].astype(np.float32))
            for i in np.flatnonzero(reach.any(axis=1)).tolist():
                best[i] = self._reranked(*best[i], lo + np.flatnonzero(reach[i]), own[i], q[i], length[i], k)
        return best

    def _reranked(self, best_ids: np.ndarray, best: np.ndarray, near: np.ndarray, own: int, q: np.ndarray, length: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of those so far and the rows near, whose scores are exact: of rows that a rounded product leaves within reach of the kth, sums from left to right."""
        near = near[self.ids[near] != own]
        x = self.x[near]
        rough = x @ q
        # both sums of a row err by less than this
        error = 4e-16 * len(q) * length * self.most
        bar = best[-1] if len(best) >= k else -np.inf
        if len(near) > k:
            bar = max(bar, np.partition(rough, len(near) - k)[len(near) - k])
        some = np.flatnonzero(~(rough < bar - 2 * error))
        if not len(some):
            return best_ids, best
        near, x = near[some], x[some]
        exact = np.zeros(len(near))
        for d in range(len(q)):  # from left to right in double precision
            exact += x[:, d] * q[d]
        best_ids, best = np.append(best_ids, self.ids[near]), np.append(best, exact)
        order = np.lexsort((best_ids, -best))[:k]
        return best_ids[order], best[order]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, seed: int = 7, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest rows by inner product. Both tables have key and vec."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec, key)
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = usual["d"]
    rows = rows.where(F.size("v") == dim)
    means = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m")).collect()
    centre = np.array([r["m"] for r in sorted(means, key=lambda r: r["d"])])
    turn = rotation(dim, seed)
    # each partition returns k rows for a query, so few vectors are not dealt to many partitions
    parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-usual["count"] // LEAST)), -(-usual["count"] // PART))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, norm, along = encode_rows(_matrix(batch.column("v"), dim), centre, turn)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(along)], ["part", "vec_id", "v", "code", "norm", "along"])

    # dealt by the row's place, not by its key: copies of an id spread too
    dealt = rows.select(F.pmod(F.hash(F.monotonically_increasing_id()), F.lit(parts)).alias("part"), "vec_id", "v")
    coded = dealt.mapInArrow(index, "part int, vec_id long, v array<double>, code binary, norm double, along double")
    asked = usable(queries, vec, key).where(F.size("v") == dim).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "vec_id", "v")
    asked = asked.select("part", "vec_id", "v", *(F.lit(None).cast(t).alias(n) for n, t in (("code", "binary"), ("norm", "double"), ("along", "double"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at, part = None, None

        def built() -> Part | None:
            if not held:
                return None
            t = pa.Table.from_batches(held).combine_chunks()
            x = np.concatenate([_matrix(c, dim) for c in t.column("v").chunks])
            codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            return Part(t.column("vec_id").to_numpy(), x, codes, t.column("norm").to_numpy(), t.column("along").to_numpy())

        for batch in batches:
            number = batch.column("part").to_numpy()
            query = batch.column("code").is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (query[1:] != query[:-1])))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(number)]):
                b = batch.slice(lo, hi - lo)
                if number[lo] != at:
                    at, held, part = number[lo], [], None
                if not query[lo]:
                    held.append(b)
                    continue
                if part is None:
                    part, held = built(), []
                if part is None:
                    continue
                ids, q = b.column("vec_id").to_numpy(), _matrix(b.column("v"), dim)
                for i in range(0, len(ids), BLOCK):
                    turned, base = q[i : i + BLOCK] @ turn.T, q[i : i + BLOCK] @ centre
                    found = part.nearest(ids[i : i + BLOCK], q[i : i + BLOCK], turned, base, k)
                    sizes = [len(f) for f, _ in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i : i + BLOCK], sizes)), pa.array(np.concatenate([f for f, _ in found])), pa.array(np.concatenate([s for _, s in found]))], ["query_id", "vec_id", "score"])

    both = coded.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", F.col("code").isNull())
    found = both.mapInArrow(work, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
