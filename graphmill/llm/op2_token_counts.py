"""Exact length histogram of a corpus, and by suffix sums the totals at every context limit.

Nulls and odd cases: null or empty text has length 0; rows with equal text or a null doc_id
count each; a text may be of any length; an empty table gives an empty histogram; columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.op1_packing import BYTE_LEVEL, encoder, text_lists
from graphmill.operators.scratch import Scratch

#: Lengths of one block of the two-level suffix sums.
SPAN = 4096


def document_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of each row."""
    path = path or public_tokenizers.path(BYTE_LEVEL)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo, hi, texts in text_lists(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(enc.counts(texts), pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens and n_docs of each length that occurs; partial counts are made before the shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_totals(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as the context limit, the totals of the corpus at that limit.

    docs_longer and docs_at_least come from suffix sums; kept_tokens is the total when every
    document is cut to the limit, lost_tokens the rest; quantile is the share of documents
    of at most this length. Between two lengths that occur, kept_tokens is linear, so the
    rows answer every limit (see truncated_total).

    The histogram is read twice: pass a written one (see corpus_totals). The sums have two levels: blocks of SPAN lengths are summed each in its own partition,
    and only the totals of the blocks, one row each, meet in one task.
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / SPAN)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    totals = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    over = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = totals.select(
        "block",
        F.coalesce(F.sum("b_docs").over(over), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("b_tokens").over(over), F.lit(0)).alias("tokens_above"),
        F.sum("b_docs").over(every).alias("all_docs"),
        F.sum("b_tokens").over(every).alias("all_tokens"),
    )
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    s = h.withColumn("docs_own", F.sum("n_docs").over(own)).withColumn("tokens_own", F.sum("tokens").over(own)).join(above, "block")
    at_least, longer_tokens = F.col("docs_above") + F.col("docs_own"), F.col("tokens_above") + F.col("tokens_own") - F.col("tokens")
    longer = at_least - F.col("n_docs")
    kept = F.col("all_tokens") - longer_tokens + F.col("n_tokens") * longer
    return s.select(
        "n_tokens",
        "n_docs",
        at_least.alias("docs_at_least"),
        longer.alias("docs_longer"),
        kept.alias("kept_tokens"),
        (F.col("all_tokens") - kept).alias("lost_tokens"),
        F.col("all_tokens").alias("total_tokens"),
        F.col("all_docs").alias("total_docs"),
        F.round((F.col("all_docs") - longer) / F.col("all_docs"), 9).alias("quantile"),
    )


def truncated_total(totals: DataFrame, limit: int) -> DataFrame:
    """One row: the tokens kept when every document is cut to limit, from the nearest length at or below it."""
    below = totals.where(F.col("n_tokens") <= limit).agg(F.max(F.struct("n_tokens", "kept_tokens", "docs_longer")).alias("x"))
    first = totals.agg(F.max("docs_at_least").alias("n"))
    return below.join(first, how="full").select(F.coalesce(F.col("x.kept_tokens") + (F.lit(limit) - F.col("x.n_tokens")) * F.col("x.docs_longer"), F.col("n") * limit, F.lit(0)).alias("kept_tokens"))


def length_at_quantile(totals: DataFrame, q: float) -> DataFrame:
    """One row: the least length that at least the share q of the documents do not exceed, in whole numbers; null without documents."""
    share = Fraction(str(q))
    most = F.col("total_docs").cast("decimal(38,0)") - F.col("docs_longer")
    return totals.where(most * F.lit(share.denominator) >= F.col("total_docs").cast("decimal(20,0)") * F.lit(share.numerator)).agg(F.min("n_tokens").alias("n_tokens"))


def corpus_totals(docs: DataFrame, path: str | None = None) -> DataFrame:
    """context_totals of a table of documents; each text is tokenised once, and the histogram, one row for each length, is written."""
    return context_totals(Scratch(docs.sparkSession, "lengths").keep(length_histogram(document_lengths(docs, path))))
