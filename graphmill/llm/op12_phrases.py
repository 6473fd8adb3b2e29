"""Phrases of two and three words that occur together more often than their parts explain, by language.

A-Z become a-z; `[.,;:!?\\x0A-\\x0D]` end a piece; words are `[^\\x20\\x09]+` of a piece; a phrase
stands within one piece.

1. Texts of one language are put together in blocks of about BLOCK bytes, each with its own
   dictionary, so that a word is a small number and a frequent word is one row for a block, not
   one for each place (encoded_blocks).
2. Words of at least `least` occurrences in their language get dense numbers (dictionary); all
   others break pieces, since no phrase as frequent can hold them. The numbers reach a block by
   a join on its own words: no dictionary is broadcast.
3. The n-grams of a block are fixed-width keys of three numbers of ID_BITS bits. Within a task
   they are sorted and run-length counted over blocks until RUN different ones are held. A mixed
   value of the key deals them to ranges: equal ranges of it hold about equally many keys, however
   frequent the phrases are. Keys travel as packed arrays, one row for a range of a run.
4. Each range, of about RANGE keys, is sorted by radix and run-length counted (counted).
5. Candidates are joined with the counts of their parts; scores are whole numbers of 38 digits.

The best of each language are chosen in levels, so that no task ranks more than `most` rows
of each of FAN groups after the first level.

Nulls and odd cases: null or empty text has no words; a null lang is the language UNKNOWN; doc_id
and other columns are not read, so rows that repeat a doc_id count each; ties go by the order of
the contract, so ranks are gapless; a text may be of any length, and a block grows beyond its size
only by a single longer piece; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm import text as tx
from graphmill.llm.links import binary
from graphmill.operators.scratch import Scratch

LEAST, LONGER_PERCENT, MOST = 10, 50, 2000
UNKNOWN = "und"
BLOCK, RUN, RANGE, FAN = 1 << 20, 1 << 18, 1 << 19, 8
ID_BITS, HALF = 40, 20
_U = np.uint64
_WORD, _BLANK, _STOP = range(3)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 32]] = _BLANK
_CLASS[[10, 11, 12, 13, *b".,;:!?"]] = _STOP
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# blocks


def joined(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The bytes of texts with a line feed after each, which ends a piece."""
    n = np.diff(offs)
    out = np.full(len(data) + len(n), 10, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(n)), n)] = data
    return out


def parts_of(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The bytes in parts of about `most`, cut after the end of a piece; a longer piece stays whole."""
    ends = np.append(np.flatnonzero(_CLASS[data] == _STOP) + 1, len(data))
    at = 0
    while len(data) - at > 2 * most:
        k = int(np.searchsorted(ends, at + most, "right"))
        cut = int(ends[k - 1]) if k and ends[k - 1] > at else int(ends[k])
        if cut == len(data):
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


def numbered_words(data: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a part, the number of each occurrence's word, and which occurrences begin a piece."""
    data = _LOWER[data]
    c = _CLASS[data]
    s, e = tx.runs(c == _WORD, np.array([0, len(data)]))
    if not len(s):
        return pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, bool)
    offs = np.zeros(len(s) + 1, np.int32)
    np.cumsum(e - s, out=offs[1:])
    words = pa.StringArray.from_buffers(len(s), pa.py_buffer(offs), pa.py_buffer(data[c == _WORD])).dictionary_encode()
    piece = np.cumsum(c == _STOP)[s]
    return words.dictionary, words.indices.to_numpy(), np.append(True, piece[1:] != piece[:-1])


def encoded_blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """block, lang, n_words, words (distinct ones), counts (of each), codes (places in words as 32-bit numbers, -1 between pieces)."""
    out = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary())])

    def rows(lang: str, held: list[np.ndarray], number: Iterator[int]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(np.concatenate(held), size):
            words, own, first = numbered_words(part)
            if len(own):
                codes = np.full(len(own) + int(first.sum()), -1, np.int32)
                codes[np.arange(len(own)) + np.cumsum(first)] = own
                one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(kind))
                counts = pa.array(np.bincount(own, minlength=len(words)))
                yield pa.RecordBatch.from_arrays([pa.array([next(number)]), pa.array([lang]), pa.array([len(own)]), one(words, pa.string()), one(counts, pa.int64()), pa.array([codes.tobytes()], pa.binary())], schema=out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        number = iter(range(task, task + (1 << 32)))
        held: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            which = langs.indices.to_numpy(zero_copy_only=False)
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                data = joined(*tx.utf8(batch.column("text").take(pa.array(np.flatnonzero(which == i)))))
                held.setdefault(lang, []).append(data)
                sizes[lang] = sizes.get(lang, 0) + len(data)
            full = list(sizes) if sum(sizes.values()) > 8 * size else [x for x in sizes if sizes[x] >= size]
            for lang in full:
                del sizes[lang]
                yield from rows(lang, held.pop(lang), number)
        for lang, parts in held.items():
            yield from rows(lang, parts, number)

    kept = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text").where("text is not null")
    return kept.mapInArrow(work, "block long, lang string, n_words long, words array<string>, counts array<long>, codes binary")


# dictionary


def dictionary(blocks: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """lang, word, f (occurrences) and id (dense, from 1) of the words with f >= least."""
    every = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f"))
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    found = scratch.keep(every.where(F.col("f") >= least).select("lang", "word", "f", F.spark_partition_id().alias("task"), place.alias("place")))
    before, total = {}, 1
    for r in sorted(found.groupBy("task").count().collect()):  # one row a task
        before[r["task"]], total = total, total + r["count"]
    if total >> ID_BITS:
        raise ValueError("more frequent words than keys have room for")
    first = F.create_map(*(F.lit(x).cast("long") for kv in before.items() for x in kv)) if before else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return found.select("lang", "word", "f", (first[F.col("task").cast("long")] + F.col("place")).alias("id"))


def with_numbers(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """block, codes and the numbers of the block's frequent words: at (places in its own dictionary) and ids."""
    own = blocks.select("block", "lang", F.posexplode("words").alias("at", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
    lists = own.groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("x"))
    return blocks.select("block", "codes").join(lists, "block").select("codes", F.col("x.at").alias("at"), F.col("x.id").alias("ids"))


# keys


def packed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the keys of three numbers."""
    low = _U((1 << HALF) - 1)
    return a << _U(HALF) | b >> _U(HALF), (b & low) << _U(ID_BITS) | c


def mixed(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return tx.mix(hi ^ tx.mix(lo))


def radix_order(*columns: np.ndarray) -> np.ndarray:
    """The order of rows of 64-bit numbers, the first column leading: digits of 16 bits from the last one on, each sorted stably."""
    order = None
    for column in reversed(columns):
        for shift in range(0, 64, 16):
            digit = (column >> _U(shift)).astype(np.uint16)
            if (digit == digit[:1]).all():
                continue
            # numpy sorts 16-bit numbers by radix
            order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(columns[0])) if order is None else order


def run_lengths(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in the order of their mixed value, their summed counts, and the mixed values."""
    if not len(hi):
        return hi, lo, n, hi
    h = mixed(hi, lo)
    order = radix_order(h)
    same = lambda x: x[1:] == x[:-1]
    again = same(hi[order]) & same(lo[order])
    if (same(h[order]) & ~again).any():  # keys of one mixed value
        order = radix_order(h, hi, lo)
        again = same(hi[order]) & same(lo[order])
    start = np.flatnonzero(np.append(True, ~again))
    at = order[start]
    return hi[at], lo[at], np.add.reduceat(n[order], start), h[at]


def block_grams(codes: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the two- and three-word phrases of a block, and their counts."""
    own = np.full(max(int(codes.max(initial=-1)), int(at.max(initial=-1))) + 2, -1, np.int64)  # the last one is for -1
    own[at] = np.arange(len(at))
    x = own[codes]
    m = len(ids)
    two = (x[:-1] >= 0) & (x[1:] >= 0)
    i = np.flatnonzero(two)
    j = np.flatnonzero(two[:-1] & two[1:])
    ids = ids.astype(np.uint64)
    if m >= 1 << 21:  # three places don't fit into 64 bits
        a, b, c = (ids[np.concatenate(p)] for p in ((x[i], x[j]), (x[i + 1], x[j + 1]), (x[i], x[j + 2])))
        c[: len(i)] = 0
        return run_lengths(*packed(a, b, c), np.ones(len(a), np.int64))[:3]
    out = []
    for key in (x[i] * m + x[i + 1], (x[j] * m + x[j + 1]) * m + x[j + 2]):
        key.sort()
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        out.append((key[start], np.diff(np.append(start, len(key)))))
    (k2, n2), (k3, n3) = out
    a, b = np.concatenate([k2 // m, k3 // (m * m)]), np.concatenate([k2 % m, k3 // m % m])
    c = np.concatenate([np.zeros(len(k2), np.uint64), ids[k3 % m]])
    hi, lo = packed(ids[a], ids[b], c)
    return hi, lo, np.concatenate([n2, n3])


def planes(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> bytes:
    """Keys and counts byte by byte of each number, so that what is zero in all compresses to nothing."""
    x = np.stack([hi, lo, n.astype(np.uint64)])
    return np.ascontiguousarray(x.view(np.uint8).reshape(3, len(hi), 8).transpose(0, 2, 1)).tobytes()


def from_planes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.ascontiguousarray(raw.reshape(3, 8, -1).transpose(0, 2, 1)).view(np.uint64)[:, :, 0]
    return x[0], x[1], x[2].astype(np.int64)


def ranges_for(words: int, each: int = RANGE) -> int:
    """Bits of the number of ranges, so that one gets at most about `each` keys: a word begins two phrases."""
    return max(0, (2 * words // each).bit_length())


def dealt_keys(numbered: DataFrame, bits: int, run: int = RUN) -> DataFrame:
    """(part, keys): packed keys and counts by range, of runs of at least `run` different keys of a task."""

    def told(hi, lo, n, h) -> Iterator[pa.RecordBatch]:
        part = (h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        start = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
        end = [*start[1:].tolist(), len(part)]
        for k in range(0, len(start), 64):
            cut = list(zip(start[k : k + 64].tolist(), end[k : k + 64]))
            yield pa.RecordBatch.from_arrays([pa.array(part[start[k : k + 64]]), pa.array([planes(hi[a:b], lo[a:b], n[a:b]) for a, b in cut], pa.binary())], ["part", "keys"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for r in range(batch.num_rows):
                codes = np.frombuffer(batch.column("codes")[r].as_buffer(), np.int32)
                at, ids = (np.asarray(batch.column(c)[r].values.to_numpy(zero_copy_only=False)) for c in ("at", "ids"))
                held.append(block_grams(codes, at, ids))
                if sum(len(x[0]) for x in held) >= 2 * run:
                    one = run_lengths(*map(np.concatenate, zip(*held)))
                    held = [one[:3]]
                    if len(one[0]) >= run:
                        yield from told(*one)
                        held = []
        if held:
            yield from told(*run_lengths(*map(np.concatenate, zip(*held))))

    return numbered.mapInArrow(work, "part long, keys binary")


def counted(keys: DataFrame, least: int = LEAST) -> DataFrame:
    """(hi, lo, a) of the keys that occur at least `least` times: one range after another is held."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def told() -> Iterator[pa.RecordBatch]:
            hi, lo, n, _ = run_lengths(*map(np.concatenate, zip(*held)))
            some = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(x[some].astype(np.int64)) for x in (hi, lo, n)], ["hi", "lo", "a"])

        for batch in batches:
            raw, offs = binary(batch.column("keys"))
            for k, p in enumerate(batch.column("part").to_pylist()):
                if p != part and held:
                    yield from told()
                    held = []
                part = p
                held.append(from_planes(raw[offs[k] : offs[k + 1]]))
        if held:
            yield from told()

    return keys.repartition("part").sortWithinPartitions("part").mapInArrow(work, "hi long, lo long, a long")


# scores


def candidates(grams: DataFrame) -> DataFrame:
    """w1, w2, w3 (0 in phrases of two words) and a."""
    low = lambda c, bits: F.col(c).bitwiseAND((1 << bits) - 1)
    w2 = F.shiftleft(low("hi", HALF), HALF).bitwiseOR(F.shiftright("lo", ID_BITS))
    return grams.select(F.shiftright("hi", HALF).alias("w1"), w2.alias("w2"), low("lo", ID_BITS).alias("w3"), "a")


def scored(phrases: DataFrame, words: DataFrame, percent: int = LONGER_PERCENT) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one covers; phrases: kept rows of candidates()."""
    two, three = phrases.where("w3 = 0").drop("w3"), phrases.where("w3 <> 0")
    inner = three.select(F.explode(F.array(F.struct("w1", "w2", "a"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))).alias("x"))
    longest = inner.groupBy("x.w1", "x.w2").agg(F.max("x.a").alias("longer"))
    word = lambda k: words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"t{k}"), F.col("f").alias(f"f{k}"), *(["lang"] if k == 1 else []))
    dec = lambda c: F.col(c).cast("decimal(38,0)")
    value = lambda l, r: F.expr(f"cast(1000000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(a as decimal(38,0)) div (cast({l} as decimal(38,0)) * cast({r} as decimal(38,0)))")  # noqa: E731, E741

    short = two.join(longest, ["w1", "w2"], "left").where(F.coalesce(100 * dec("longer") < percent * dec("a"), F.lit(True)))
    short = short.join(word(1), "w1").join(word(2), "w2")
    short = short.select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), value("f1", "f2").alias("score"))

    head = two.select("w1", "w2", F.col("a").alias("f12"))
    tail = two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    long = three.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"]).join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
    long = long.withColumn("s1", value("f1", "f23")).withColumn("s2", value("f12", "f3"))
    first = F.col("s1") <= F.col("s2")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    long = long.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", pick("f1", "f12").alias("l"), pick("f23", "f3").alias("r"), pick("s1", "s2").alias("score"))
    return short.unionByName(long)


def best(rows: DataFrame, most: int = MOST, fan: int = FAN) -> DataFrame:
    """The first `most` rows of each language with their rank; ranked within groups first, whose best are ranked again."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    for groups in (fan * fan, fan):
        w = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    w = Window.partitionBy("lang").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)


def mine_phrases(docs: DataFrame, least: int = LEAST, percent: int = LONGER_PERCENT, most: int = MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    scratch = Scratch(docs.sparkSession, "phrases")
    blocks = scratch.keep(encoded_blocks(docs))
    totals = scratch.keep(blocks.groupBy("lang").agg(F.sum("n_words").alias("n")))
    bits = ranges_for(sum(r["n"] for r in totals.agg(F.sum("n").alias("n")).collect() if r["n"]))
    words = dictionary(blocks, scratch, least)
    # written, so that the shuffles of the join are gone when the keys are dealt
    numbered = scratch.keep(with_numbers(blocks, words))
    scratch.drop(blocks)
    phrases = scratch.keep(candidates(counted(dealt_keys(numbered, bits), least)))
    scratch.drop(numbered)
    rows = scratch.keep(scored(phrases, words, percent))
    return best(rows, most).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
