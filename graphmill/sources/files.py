"""Readers for the file formats that the analyses start from. All but the archive reader are Spark's own readers and functions."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def node_link_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of node-link JSON files; the edge list is called links or edges."""
    node = "id string, label string, file_type string, source_file string, community int"
    edge = "source string, target string, relation string, confidence string, confidence_score double"
    raw = spark.read.schema(f"nodes array<struct<{node.replace(' ', ':').replace(',:', ',')}>>, links array<struct<{edge.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<{edge.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path)
    return raw.select(F.inline("nodes")), raw.select(F.inline(F.coalesce("links", "edges")))


def junit(spark: SparkSession, path: str) -> DataFrame:
    """Cases of JUnit XML files: name, seconds, status (error before failed before skipped before passed)."""
    part = "struct<_message:string>"
    cases = spark.read.format("xml").option("rowTag", "testcase").option("mode", "DROPMALFORMED").schema(f"_name string, _classname string, _time double, error {part}, failure {part}, skipped {part}").load(path)
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("failure").isNotNull(), "failed").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed")
    return cases.select(F.col("_name").alias("name"), F.col("_classname").alias("suite"), F.col("_time").alias("seconds"), status.alias("status"))


def junit_totals(cases: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return cases.agg(F.count("*").alias("total"), *map(count, ("passed", "failed", "error", "skipped")))


def table_markdown(rows: DataFrame, order: list[str], most: int = 200) -> DataFrame:
    """One row: the first `most` rows as a Markdown table, with a note if there are more. The limit bounds what meets."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "\\|", "\\\\|")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in rows.columns)), F.lit(" |"))
    first = rows.orderBy(*order).limit(most).select(F.struct(*order, line.alias("_line")).alias("x"))
    body = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["_line"]), "\n").alias("body"))
    head = F.lit("| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n")
    total = rows.agg(F.count("*").alias("total"))
    note = F.when(F.col("total") > most, F.concat(F.lit("\n("), (F.col("total") - most).cast("string"), F.lit(" more rows)"))).otherwise(F.lit(""))
    return body.join(F.broadcast(total)).select(F.concat(head, "body", note).alias("markdown"))


def commit_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """sha, author, email, date and subject of lines whose fields are divided by U+001F."""
    p = F.split(column, "\x1f", -1)
    names = ("sha", "author", "author_email", "date", "subject")
    return lines.where(F.size(p) >= 5).select(*(F.get(p, F.lit(i)).alias(n) for i, n in enumerate(names)))


def diff_stats(numstat: DataFrame, name_status: DataFrame) -> DataFrame:
    """path, added, deleted (null for binary files) and status, joined on the path."""
    n = F.split("value", "\t", -1)
    count = lambda i: F.get(n, F.lit(i)).try_cast("int")
    left = numstat.select(F.get(n, F.lit(2)).alias("path"), count(0).alias("added"), count(1).alias("deleted")).where("path is not null")
    s = F.split("value", "\t", -1)
    right = name_status.select(F.element_at(s, -1).alias("path"), F.left(F.get(s, F.lit(0)), F.lit(1)).alias("status"))
    return left.join(right, "path", "left")


def working_tree(lines: DataFrame) -> DataFrame:
    """path and state of two-letter status lines."""
    code, path = F.left("value", F.lit(2)), F.substring("value", F.lit(4), F.length("value"))
    state = F.when(code == "??", "untracked").when(code.rlike("U|AA|DD"), "conflicted").when(code.rlike("R"), "renamed").when(F.left(code, F.lit(1)) != " ", "staged").otherwise("unstaged")
    return lines.where(F.length("value") > 3).select(path.alias("path"), state.alias("state"))


def owner_rules(spark: SparkSession, path: str) -> DataFrame:
    """rule, pattern and owners of an ownership file, in order; comments and blank lines are no rules."""
    text = spark.read.option("wholetext", True).text(path)
    lines = text.select(F.posexplode(F.split("value", "\n", -1)).alias("rule", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where("line <> ''")
    p = F.split("line", "\\s+")
    return lines.select("rule", F.get(p, F.lit(0)).alias("pattern"), F.slice(p, F.lit(2), F.size(p)).alias("owners")).where(F.size("owners") > 0)


def conflict_hunks(files: DataFrame) -> DataFrame:
    """path, ours and theirs of each conflict between markers; files: path, content."""
    hunk = "(?s)<{7}[^\\n]*\\n(.*?)={7}\\n(.*?)>{7}"
    both = F.arrays_zip(F.regexp_extract_all("content", F.lit(hunk), 1).alias("ours"), F.regexp_extract_all("content", F.lit(hunk), 2).alias("theirs"))
    return files.select("path", F.posexplode(both).alias("hunk", "x")).select("path", "hunk", "x.ours", "x.theirs")


def rich_text(doc: Column) -> Column:
    """The texts of a rich-text tree in JSON, in order; paragraphs end a line."""
    marked = F.regexp_replace(doc, "\"type\"\\s*:\\s*\"(paragraph|heading)\"", "\"text\":\"\\\\n\"")
    return F.regexp_replace(F.regexp_replace(F.array_join(F.regexp_extract_all(marked, F.lit("\"text\"\\s*:\\s*\"((?:[^\"\\\\]|\\\\.)*)\""), 1), ""), "\\\\n", "\n"), "^\\s+|\\s+$", "")


def zip_entries(files: DataFrame, most: int = 20) -> DataFrame:
    """path, entry, bytes of the first `most` entries of each archive; files: path, content. Unreadable archives give none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        out += [(path, i.filename, i.file_size) for i in z.infolist()[:most] if not i.is_dir()]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(out, columns=["path", "entry", "bytes"])

    return files.select("path", "content").mapInPandas(work, "path string, entry string, bytes long")


def git_dependencies(files: DataFrame) -> DataFrame:
    """path, url and pin of dependencies on repositories in manifests; files: path, content."""
    found = F.regexp_extract_all("content", F.lit("git\\+(?:https?|ssh)://[^\\s\"']+"), 0)
    x = files.select("path", F.explode(found).alias("spec"))
    return x.select("path", F.regexp_replace(F.regexp_extract("spec", "^git\\+([^#@]*(?:@[^/@#]+/[^#@]*)?)", 1), "\\.git$", "").alias("url"), F.nullif(F.regexp_extract("spec", "(?:#|@)([A-Za-z0-9._-]+)$", 1), F.lit("")).alias("pin"))
