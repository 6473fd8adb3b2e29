"""Writers: guarded graph files, statement text, day-partitioned appends and keyed upserts of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.operators.relational import upsert


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, force: bool = False, least: float = 0.5) -> bool:
    """Writes both tables as one folder that takes the place of the old one, unless the new node count is under `least` of the stored one; True if written."""
    spark = nodes.sparkSession
    recover_folder(spark, path)
    try:
        before = spark.read.parquet(f"{path}/nodes").count()
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        before = 0
    if not force and nodes.count() < least * before:
        return False
    nodes.write.mode("overwrite").parquet(f"{path}.next/nodes")
    edges.write.mode("overwrite").parquet(f"{path}.next/edges")
    swap_folder(spark, path)
    return True


def swap_folder(spark: SparkSession, path: str) -> None:
    """Puts the folder path.next in the place of path: the old one is moved aside first and deleted last. A move that fails is undone and raised."""
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at(f"{path}.next")):
        raise OSError(f"{path}.next is not there")
    there = fs.exists(at(path))
    if there:
        fs.delete(at(f"{path}.before"), True)
        if not fs.rename(at(path), at(f"{path}.before")):
            raise OSError(f"{path} could not be moved aside")
    if not fs.rename(at(f"{path}.next"), at(path)):
        if there:
            fs.rename(at(f"{path}.before"), at(path))
        raise OSError(f"{path}.next could not be moved to its place")
    fs.delete(at(f"{path}.before"), True)


def recover_folder(spark: SparkSession, path: str) -> None:
    """Undoes a swap that died halfway: if path is gone and its older copy is there, that one comes back."""
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at(path)) and fs.exists(at(f"{path}.before")) and not fs.rename(at(f"{path}.before"), at(path)):
        raise OSError(f"{path}.before could not be moved back")


def cypher(edges: DataFrame) -> DataFrame:
    """One MERGE statement per edge, quotes and backslashes escaped."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "\\\\", "\\\\\\\\"), "'", "\\\\'")
    relation = F.upper(F.regexp_replace("relation", "[^A-Za-z0-9_]", "_"))
    return edges.select(F.concat(F.lit("MERGE (a {id: '"), safe("source"), F.lit("'}) MERGE (b {id: '"), safe("target"), F.lit("'}) MERGE (a)-[:"), relation, F.lit("]->(b);")).alias("value"))


def append_daily(events: DataFrame, path: str, ts: str = "ts") -> None:
    events.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").json(path)


def upsert_table(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> None:
    """Rewrites the table at path into a sibling folder and swaps the folders, so that at no time both are gone; what an earlier run has left halfway is undone first."""
    recover_folder(spark, path)
    upsert(spark.read.parquet(path), new, keys).write.mode("overwrite").parquet(f"{path}.next")
    swap_folder(spark, path)
