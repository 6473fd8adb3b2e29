"""Rules over paths kept as rows: ignore files with re-includes, and the last rule that a path meets.

A rule file in a folder holds for what lies in or under it. The rules of a folder are one row, an
array in their order, so a path meets as many rows as it has folders above it, however many rules
there are. Of all rules that match, the last of the deepest folder decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.operators.scratch import Scratch


def glob_regex(glob: Column) -> Column:
    """A regular expression for what a glob matches: the whole relative path, a beginning of it that ends with a part, or any one part; all below it too.

    * and ? stand for any characters, beyond / as well where the whole path is meant; [ab] and [!ab] for one of a set.
    """
    quoted = F.regexp_replace(glob, r"([.+^$(){}|\\])", r"\\$1")
    quoted = F.regexp_replace(quoted, r"\[!", "[^")
    # a bracket that isn't closed is a character
    quoted = F.regexp_replace(quoted, r"\[(?![^\]]+\])", r"\\[")
    whole = F.regexp_replace(F.regexp_replace(quoted, r"\*+", ".*"), r"\?", ".")
    part = F.regexp_replace(F.regexp_replace(quoted, r"\*+", "[^/]*"), r"\?", "[^/]")
    return F.concat(F.lit("(?s)^(?:"), whole, F.lit("|(?:.*/)?"), part, F.lit(")(?:/.*)?$"))


def rules_of(files: DataFrame) -> DataFrame:
    """(folder, rules) of rule files: folder ('' at the root), content. A rule has glob, negated, anchored, regex.

    Blank lines and lines that begin with # are none; a # after white space begins a remark, \\# is a #;
    blanks at the end go unless escaped; ! before a rule takes back what rules before it ignore; / at the
    beginning anchors it at its folder.
    """
    lines = files.select("folder", F.posexplode(F.split("content", "\r?\n", -1)).alias("rank", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", "^\\s+", "")).where("line <> '' and line not like '#%'")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", "\\s+#+[^\\\\].*$", ""), "\\\\#", "#"), "(?<!\\\\) +$", "")
    lines = lines.withColumn("line", x)
    raw = F.regexp_replace("line", "^!", "")
    lines = lines.select("folder", "rank", F.col("line").startswith("!").alias("negated"), raw.startswith("/").alias("anchored"), F.regexp_replace(raw, "^/+|/+$", "").alias("glob")).where("glob <> ''")
    rule = F.struct("rank", "glob", "negated", "anchored", glob_regex(F.col("glob")).alias("regex"))
    return lines.groupBy("folder").agg(F.array_sort(F.collect_list(rule)).alias("rules"))


def folders_above(path: Column) -> Column:
    """All folders that a relative path lies in, the root ('') first."""
    p = F.split(path, "/")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/")))


def _above(path: Column) -> Column:
    """folders_above; only the root for a path without a folder."""
    return F.when(F.contains(path, F.lit("/")), folders_above(path)).otherwise(F.array(F.lit("")))


def last_rule(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, rule): of the rules that a path meets the last one of the deepest folder; paths without any are left out.

    An anchored rule is held against the path from its own folder, another one against that from the root too.
    """
    x = paths.select("path").distinct().withColumn("folder", F.explode(_above(F.col("path")))).join(rules, "folder")
    inner = F.when(F.col("folder") == "", F.col("path")).otherwise(F.substr("path", F.length("folder") + 2))
    meets = lambda r: F.rlike(inner, r["regex"]) | (~r["anchored"] & F.rlike(F.col("path"), r["regex"]))
    x = x.select("path", F.length("folder").alias("depth"), F.filter("rules", meets).alias("met")).where(F.size("met") > 0)
    return x.groupBy("path").agg(F.max_by(F.element_at("met", -1), "depth").alias("rule"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, ignored) of all paths: a path is ignored if its last rule isn't a re-include, or if a folder above it is ignored, which no re-include below can undo.

    A null path is left out; a path that comes twice is told once.
    """
    scratch = Scratch(paths.sparkSession, "ignored")
    own = scratch.keep(paths.where("path is not null").select("path").distinct())
    steps = own.select("path", F.explode(F.array_union(F.filter(_above(F.col("path")), lambda f: f != ""), F.array("path"))).alias("target"))
    verdict = last_rule(steps.select(F.col("target").alias("path")), rules).where("not rule.negated").select(F.col("path").alias("target"))
    gone = steps.join(verdict, "target", "left_semi").select("path").distinct().withColumn("_gone", F.lit(True))
    return own.join(gone, "path", "left").select("path", F.col("_gone").isNotNull().alias("ignored"))
