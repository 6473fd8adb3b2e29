"""Entities that several nodes name are merged: exact labels in one file first, then similar labels anywhere.

One chain: normalised labels, exact merge within a file, an entropy gate, minhash bands,
Jaro-Winkler verification with guards, components, winners, remapped edges.
"""

from __future__ import annotations

import unicodedata
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.functions import columns as c
from graphmill.operators import codegraph, graph
from graphmill.operators.retrieval import blocked_pairs, jaro_winkler
from graphmill.operators.scratch import Scratch

LEAST_ENTROPY, LEAST_SCORE, BONUS, BONUS_LENGTH = 2.5, 92.0, 5.0, 12


@F.pandas_udf(T.StringType())
def folded_label(labels: pd.Series) -> pd.Series:
    """NFKC, case folded, runs of what is neither letter nor digit as one blank."""

    def one(x: str) -> str:
        x = unicodedata.normalize("NFKC", x).casefold()
        return " ".join("".join(ch if ch.isalnum() else " " for ch in x).split())

    return labels.map(one, na_action="ignore")


def verified(score: Column, la: Column, lb: Column, same_community: Column) -> Column:
    """Whether two normalised labels are one entity: no variants of one stem, no short labels that differ, and score enough."""
    bonus = F.when(F.coalesce(same_community, F.lit(False)) & (F.least(F.length(la), F.length(lb)) >= BONUS_LENGTH), BONUS).otherwise(0.0)
    return ~codegraph.variant_pair(la, lb) & ~codegraph.short_label_blocked(la, lb, score) & (score + bonus >= LEAST_SCORE)


def similar_labels(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, target): representatives of similar labels. nodes: id, norm, community, one for each norm."""
    own = scratch.keep(nodes.where(c.entropy(F.col("norm")) >= LEAST_ENTROPY).select("id", F.col("norm").alias("label"), "community"))
    side = lambda k: own.select(F.col("id").alias(k), F.col("label").alias(f"l{k}"), F.col("community").alias(f"c{k}"))
    j = blocked_pairs(own).join(side("a"), "a").join(side("b"), "b").withColumn("score", 100 * jaro_winkler("la", "lb"))
    return j.where(verified(F.col("score"), F.col("la"), F.col("lb"), F.col("ca") == F.col("cb"))).select(F.col("a").alias("source"), F.col("b").alias("target"))


def resolve_entities(nodes: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """remap (old, new) of the nodes that another node stands for.

    nodes: id (text), label, file and, if there is one, repo; communities: id, community. An id that
    comes twice counts once, by its smallest label and file; a null id takes no part; a null or
    empty label is the id. Nodes of one normalised label and file are one entity; of each
    label, the node with the smallest id meets other labels. The winner has no chunk suffix (_c and
    digits), then the shortest id, then the first. Nodes of several repositories raise an error. An
    empty table gives no row.
    """
    if "repo" in nodes.columns:
        codegraph.one_repository(nodes)
    scratch = Scratch(nodes.sparkSession, "entities")
    label = F.when(F.length("label") > 0, F.col("label")).otherwise(F.col("id"))
    n = nodes.where("id is not null").groupBy("id").agg(F.min(F.struct(label.alias("label"), F.coalesce("file", F.lit("")).alias("file"))).alias("x"))
    n = n.select("id", folded_label("x.label").alias("norm"), "x.file").where("norm <> ''")
    n = n.join(communities.select("id", "community"), "id", "left") if communities is not None else n.withColumn("community", F.lit(None).cast("long"))
    n = scratch.keep(n.select("id", "norm", "file", "community"))
    exact = n.join(n.groupBy("norm", "file").agg(F.min("id").alias("target")), ["norm", "file"]).where("id <> target").select(F.col("id").alias("source"), "target")
    first = n.groupBy("norm").agg(F.min_by(F.struct("id", "community"), "id").alias("x")).select("x.id", "norm", "x.community")
    links = scratch.keep(exact.unionByName(similar_labels(first, scratch)))
    return codegraph.winners(graph.components(links), "component", "id")


def deduplicate(nodes: DataFrame, edges: DataFrame, communities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes without those that others stand for, and edges that lead to the winners; loops go."""
    remap = Scratch(nodes.sparkSession, "remap").keep(resolve_entities(nodes, communities))
    kept = nodes.join(remap.select(F.col("old").alias("id")), "id", "left_anti")
    return kept, codegraph.remapped(edges, remap)
