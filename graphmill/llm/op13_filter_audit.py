"""Interaction of five document filters over all orders in which they can be applied.

A: under LEAST_WORDS words. B: 100 * distinct words < LEAST_DISTINCT * words. C: 100 * capital
letters `[A-Z]` > MOST_CAPITALS * code points. D: holds one of `#$%&*|`. E: the text is that of
a smaller doc_id. Words are `[^\\x20\\x09-\\x0D]+` with their case.

E is found by partition refinement. Documents are split by length in code points, then by
the hash of each further block of the text, and classes of a single doc_id are dropped after
every split. Blocks grow by BLOCK_GROWTH, so a text of n characters takes part in log(n) rounds; a
text whose last block is hashed is settled. Of the settled ones the full texts are compared:
they are grouped by text, which Spark combines within tasks before it shuffles, and all
but those of the smallest doc_id of a text fail E. A class of any size is one row for each
task there; in the rounds it is a skewed key of a semi join with a written table, which adaptive
execution splits.

Each document is then five bits; the bits are counted by part, and the 120 orders are read off
these counts, at most 32 for each part.

Nulls and odd cases: null text is empty: no words, so it fails A only (and E); null lang is the
part of the empty string; a row with a null doc_id is neither a copy nor what others are
copies of, and has no labels; rows that repeat a doc_id count each, and are not copies of each
other; contradicting labels of a doc_id count on both sides; texts may be of any length, each is
handled by itself; an empty table gives no row; other columns are not read. Rows that repeat a
doc_id and have different texts that agree in length and in all 64-bit block hashes share one
verdict about E.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.operators.scratch import Scratch

GAP = "[\\x20\\x09-\\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
FILTERS = "ABCDE"
#: Characters of the first block, how much longer each further one is, and how many there are: more than a string can hold.
BLOCK, BLOCK_GROWTH, ROUNDS = 64, 16, 8
_STARTS = [BLOCK * (BLOCK_GROWTH**k - 1) // (BLOCK_GROWTH - 1) for k in range(ROUNDS + 1)]


def with_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), n (code points), h0, h1, ... (block hashes, null beyond the text) and sig, the class after the last block."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.length("text").cast("long"))
    for k in range(ROUNDS):
        block = F.xxhash64(F.substring("text", _STARTS[k] + 1, _STARTS[k + 1] - _STARTS[k]))
        d = d.withColumn(f"h{k}", F.when(F.col("n") > _STARTS[k], block))
    sig = F.col("n")
    for k in range(ROUNDS):
        sig = refined(sig, k)
    return d.withColumn("sig", sig)


def refined(cls: Column, k: int) -> Column:
    """The class of a text after the split by block k; as it was where the text has no such block."""
    return F.when(F.col(f"h{k}").isNull(), cls).otherwise(F.xxhash64(cls, F.col(f"h{k}")))


def candidates(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, sig) of the rows that share length and all block hashes with another doc_id, by one round a block."""
    alive = blocks.where("doc_id is not null").select("doc_id", "n", "sig", *(f"h{k}" for k in range(ROUNDS)), F.col("n").alias("cls"))
    settled = None
    for k in range(ROUNDS + 1):
        if k:
            alive = alive.withColumn("cls", refined(F.col("cls"), k - 1))
        several = scratch.keep(alive.groupBy("cls").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("cls"))
        alive = scratch.keep(alive.join(several, "cls", "left_semi"))
        scratch.drop(several)
        done = alive.where(F.col("n") <= _STARTS[k]).select("doc_id", "sig")
        settled = done if settled is None else settled.unionByName(done)
        alive = alive.where(F.col("n") > _STARTS[k])
        if alive.isEmpty():
            break
    return settled.distinct()


def copies(docs: DataFrame, blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, sig) of the rows whose text a smaller doc_id has; blocks: kept rows of with_blocks."""
    maybe = scratch.keep(candidates(blocks, scratch))
    # a merge join at every size: the candidates grow with the corpus
    texts = with_blocks(docs).select("doc_id", "sig", "text").join(maybe.hint("merge"), ["doc_id", "sig"], "left_semi")
    first = texts.groupBy("sig", "text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "sig")
    return maybe.join(scratch.keep(first), ["doc_id", "sig"], "left_anti")


def failures(docs: DataFrame) -> Column:
    """Bits 0 to 3 for filters A to D, from columns text, _w (words) and n."""
    bits = [
        F.size("_w") < LEAST_WORDS,
        100 * F.size(F.array_distinct("_w")) < LEAST_DISTINCT * F.size("_w"),
        100 * (F.col("n") - F.length(F.regexp_replace("text", "[A-Z]", ""))) > MOST_CAPITALS * F.col("n"),
        F.col("text").rlike("[#$%&*|]"),
    ]
    return sum((b.cast("int") * (1 << i) for i, b in enumerate(bits)), F.lit(0))


def document_masks(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, part and mask of every row: bit i is set if it fails filter i."""
    scratch = scratch or Scratch(docs.sparkSession, "filters")
    names = {c.lower() for c in docs.columns}
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in names else F.lit("")
    d = with_blocks(docs.select(F.struct("doc_id", part.alias("part")).alias("doc_id"), "text"))
    d = d.withColumn("_w", F.array_remove(F.split("text", GAP, -1), ""))
    own = [F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.part").alias("part")]
    rows = scratch.keep(d.select(*own, failures(d).alias("mask"), "n", "sig", *(f"h{k}" for k in range(ROUNDS))))
    gone = copies(docs.select("doc_id", "text"), rows, scratch).withColumn("_copy", F.lit(1 << 4))
    return rows.join(gone, ["doc_id", "sig"], "left").select("doc_id", "part", (F.col("mask") + F.coalesce("_copy", F.lit(0))).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and the number of documents, of good ones and of toxic ones."""
    flag = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(flag("quality").alias("_good"), flag("toxic").alias("_toxic"))
    j = masks.join(known, F.col("doc_id") == F.col("_id"), "left")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long"))
    return j.groupBy("part", "mask").agg(F.count("*").alias("n"), total("_good").alias("good"), total("_toxic").alias("toxic"))


def all_steps(filters: str = FILTERS) -> list[dict]:
    """Every step of every order: o (order), s (step from 1), f (bit of its filter) and b (bits of the filters before)."""
    out = []
    for order in permutations(filters):
        before = 0
        for s, x in enumerate(order, 1):
            bit = 1 << filters.index(x)
            out.append({"o": "".join(order), "s": s, "f": bit, "b": before})
            before |= bit
    return out


def audit(counts: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley from mask_counts."""
    steps = F.from_json(F.lit(json.dumps(all_steps())), "array<struct<o:string,s:int,f:int,b:int>>")
    x = counts.withColumn("x", F.explode(steps)).select("*", "x.*")
    prior, fails = F.col("mask").bitwiseAND(F.col("b")) != 0, F.col("mask").bitwiseAND(F.col("f")) != 0
    total = lambda when, c="n": F.sum(F.when(when, F.col(c)).otherwise(0))
    per = x.groupBy("part", F.col("o").alias("filter_order"), F.col("s").alias("step"), "f").agg(
        total(~prior & ~fails).alias("kept"),
        total(~prior & fails).alias("removed"),
        total(prior & fails).alias("redundant"),
        total(F.col("mask") == F.col("f")).alias("unique_fails"),
        total(~prior & fails, "good").alias("good_lost"),
        total(~prior & fails, "toxic").alias("toxic_lost"),
    )
    return per.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "f"))).drop("f")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of all documents: one row for each part, order and step."""
    scratch = Scratch(docs.sparkSession, "filters")
    return audit(mask_counts(document_masks(docs, scratch), labels))
