"""Readers of repositories, reports and manifests, from tables of lines or of files (path, content, modified, bytes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File endings of each kind of corpus file.
KINDS = {
    "code": "py|js|jsx|ts|tsx|java|go|rs|c|h|cpp|hpp|cs|rb|php|swift|kt|scala|sql|sh",
    "document": "md|rst|txt|adoc|html?",
    "paper": "pdf",
    "image": "png|jpe?g|gif|svg|webp",
}
#: Manifest names and the ecosystem that each stands for.
MANIFESTS = {
    "package.json": "npm",
    "requirements.txt": "pypi",
    "pyproject.toml": "pypi",
    "pom.xml": "maven",
    "build.gradle": "gradle",
    "go.mod": "go",
    "Cargo.toml": "cargo",
    "Gemfile": "rubygems",
    "composer.json": "packagist",
}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def classified(files: DataFrame) -> DataFrame:
    """All columns of files, and kind by the ending: code, document, paper, image, or null."""
    kind = F.lit(None).cast("string")
    for name, endings in KINDS.items():
        kind = F.when(F.lower("path").rlike(f"\\.({endings})$"), name).otherwise(kind)
    return files.withColumn("kind", kind)


def changed_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """path and change (new, changed, unchanged, deleted) of files against manifest(path, modified, digest).

    An equal time of change is enough; else the content's hash decides, and is computed only then.
    """
    m = manifest.select("path", F.col("modified").alias("_was"), F.col("digest").alias("_digest"))
    j = current.select("path", "modified", "content").join(m, "path", "full")
    change = F.when(F.col("_was").isNull() & F.col("_digest").isNull(), "new").when(F.col("modified").isNull(), "deleted").when(F.col("modified") == F.col("_was"), "unchanged").when(F.sha2("content", 256) == F.col("_digest"), "unchanged").otherwise("changed")
    return j.select("path", change.alias("change"))


def blame(lines: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """line, sha, author and text of porcelain blame lines `sha TAB author TAB line TAB text`, within first..last if given."""
    p = F.split("value", "\t", 4)
    rows = lines.where(F.size(p) == 4).select(F.get(p, F.lit(2)).try_cast("int").alias("line"), F.get(p, F.lit(0)).alias("sha"), F.get(p, F.lit(1)).alias("author"), F.get(p, F.lit(3)).alias("text")).where("line is not null")
    return rows.where((F.col("line") >= (first or 1)) & (F.col("line") <= (last or 2**31 - 1)))


def branches(lines: DataFrame) -> DataFrame:
    """name, sha, author and date of ref lines whose fields are divided by U+001F."""
    p = F.split("value", "\x1f", -1)
    return lines.where(F.size(p) >= 4).select(*(F.get(p, F.lit(i)).alias(n) for i, n in enumerate(("name", "sha", "author", "date"))))


def log_rows(commits: DataFrame, limit: int = 50, author: str | None = None, since: str | None = None) -> DataFrame:
    """The newest commits (sha, author, date, ...), at most limit, which is held within 1..500."""
    x = commits
    if author:
        x = x.where(F.lower("author").contains(author.lower()))
    if since:
        x = x.where(F.col("date") >= since)
    return x.orderBy(F.desc("date"), "sha").limit(min(500, max(1, limit)))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header; a byte-order mark before it is no part of the first name."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.lstrip("\ufeff") for c in df.columns))


def mutation_reports(files: DataFrame) -> DataFrame:
    """path, killed, survived and total of mutation reports (path, content): JSON with files and mutants, XML with status, or text."""
    content = F.col("content").cast("string")
    mutant = "struct<status:string>"
    parsed = F.from_json(content, f"struct<files:map<string,struct<mutants:array<{mutant}>>>>")
    listed = F.transform(F.flatten(F.transform(F.map_values(parsed["files"]), lambda f: F.coalesce(f["mutants"], F.array().cast(f"array<{mutant}>")))), lambda m: F.lower(m["status"]))
    in_xml = F.transform(F.regexp_extract_all(content, F.lit("<mutation[^>]*status=['\"]([A-Za-z_]+)"), 1), lambda s: F.lower(s))
    counted = lambda a, s: F.coalesce(F.size(F.filter(a, lambda x: x == s)), F.lit(0))
    in_text = lambda s: F.coalesce(F.regexp_extract(content, f"(?i){s}[^0-9]*([0-9]+)", 1).try_cast("int"), F.lit(0))
    kind = F.when(F.lower("path").endswith(".json"), "json").when(F.lower("path").endswith(".xml"), "xml").otherwise("text")
    n = lambda s: F.when(kind == "json", F.greatest(counted(listed, s), F.lit(0))).when(kind == "xml", counted(in_xml, s)).otherwise(in_text(s))
    return files.select("path", n("killed").alias("killed"), n("survived").alias("survived")).withColumn("total", F.col("killed") + F.col("survived"))


def stack_fingerprint(files: DataFrame) -> DataFrame:
    """ecosystem, manifests and dependencies of the manifests among files (path, content): how many there are and how many names they mention."""
    name = file_name(F.col("path"))
    eco = F.element_at(F.create_map(*(F.lit(x) for kv in MANIFESTS.items() for x in kv)), name)
    content = F.col("content").cast("string")
    body = lambda pattern: F.size(F.array_distinct(F.regexp_extract_all(content, F.lit(pattern), 1)))
    deps = (
        F.when(name.endswith(".json"), body('"([@A-Za-z0-9._/-]+)"\\s*:\\s*"[\\^~><=*]?[0-9*]'))
        .when(name == "pom.xml", body("<artifactId>([^<]+)</artifactId>"))
        .when(name == "go.mod", body("(?m)^\\s*(?:require\\s+)?([a-z0-9.-]+\\.[a-z]+/\\S+)\\s+v"))
        .otherwise(body("(?m)^\\s*['\"]?([A-Za-z][A-Za-z0-9._-]*)['\"]?\\s*(?:[=~<>!]=|=\\s*['\"{])"))
    )
    return files.select(eco.alias("ecosystem"), deps.alias("n")).where("ecosystem is not null").groupBy("ecosystem").agg(F.count("*").alias("manifests"), F.sum("n").alias("dependencies"))


def findings_page(findings: DataFrame, page: int, size: int, most: int = 10_000) -> DataFrame:
    """A page of findings by severity, file and line, with total and truncated; the service shows at most `most`."""
    total = F.broadcast(findings.agg(F.count("*").alias("total")))  # one row
    rank = F.element_at(F.create_map(*(x for i, s in enumerate(("BLOCKER", "CRITICAL", "MAJOR", "MINOR", "INFO")) for x in (F.lit(s), F.lit(i)))), F.col("severity"))
    start = (page - 1) * size
    rows = findings.orderBy(F.coalesce(rank, F.lit(9)), "file", "line").offset(start).limit(max(0, min(size, most - start)))
    return rows.join(total).withColumn("truncated", F.col("total") > most)


def export_memory(entries: DataFrame, path: str) -> None:
    """One JSON object for each entry; import_memory reads them back."""
    entries.write.mode("overwrite").json(path)


def import_memory(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Entries of an export, with the columns of `like`; objects that don't fit are dropped."""
    return spark.read.schema(like.schema).option("mode", "DROPMALFORMED").json(path)


def append_run(cases: DataFrame, run_id: str, path: str) -> None:
    """Appends the cases of one run (name, seconds, status) under its id."""
    cases.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def cluster_report(members: DataFrame, top: int = 5) -> DataFrame:
    """cluster and markdown: of each cluster its size and its first files by degree; members: cluster, file, degree."""
    from graphmill.operators.relational import first_per

    size = members.groupBy("cluster").agg(F.count("*").alias("n"))
    best = first_per(members, ["cluster"], [F.desc("degree"), "file"], "i", top)
    lines = best.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "file"))), lambda x: F.concat(F.lit("- "), x["file"])), "\n").alias("body"))
    return size.join(lines, "cluster").select("cluster", F.concat(F.lit("## "), F.col("cluster").cast("string"), F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), F.col("body")).alias("markdown"))
