"""Findings of a code-quality service that land as pages, trees of measured components, and duplicated lines.

A page is one JSON document: {"total": n, "issues": [{...}, ...]}. A file is a page, or has one on
each line. The data source reads files in parallel, one partition each, and takes filters on its
plain columns, so that rows which a query doesn't want never leave the page.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from graphmill.operators.scratch import Scratch

FORMAT = "finding_pages"
COLUMNS = ("key", "type", "severity", "status", "rule", "file", "author", "assignee", "message")
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS) + ", line long"
#: What a scan takes where its scope doesn't say, and most rows of one; fixed values of the service.
OPEN_STATUSES = ("OPEN", "CONFIRMED", "REOPENED")
HOTSPOT, MOST = "SECURITY_HOTSPOT", 10_000


#: Pages that a file gets at most when they are landed.
PAGES = 100


class _Pages(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _documents(text: str) -> Iterator[object]:
    """The document that a file is, or those that its lines are; what is none, or is cut off, is left out."""
    try:
        yield json.loads(text)
    except ValueError:
        for line in text.split("\n"):
            try:
                yield json.loads(line)
            except ValueError:
                continue


class _PageReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri, self.wanted = uri, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Keeps equality, membership and not-null of text columns; the rest is Spark's."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in COLUMNS and isinstance(f, EqualTo):
                self.wanted.append((name, (f.value,)))
            elif name in COLUMNS and isinstance(f, In):
                self.wanted.append((name, tuple(f.value)))
            elif name in COLUMNS and isinstance(f, IsNotNull):
                self.wanted.append((name, None))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.uri)
        files = store.get_file_info(fs.FileSelector(root, recursive=True))
        return [_Pages(f.path) for f in sorted(files, key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition: _Pages) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.uri)
        with store.open_input_stream(partition.path) as f:
            text = f.read().decode()
        for page in _documents(text):
            if isinstance(page, dict) and page.get("issues"):
                yield self._rows(page["issues"])

    def _rows(self, issues: list) -> pa.RecordBatch:
        rows = [x for x in issues if isinstance(x, dict) and all(x.get(c) is not None and (v is None or x[c] in v) for c, v in self.wanted)]
        line = lambda x: x.get("line") if isinstance(x.get("line"), int) else None
        text_of = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
        return pa.RecordBatch.from_arrays([*(pa.array([text_of(x.get(c)) for x in rows], pa.string()) for c in COLUMNS), pa.array([line(x) for x in rows], pa.int64())], [*COLUMNS, "line"])


class FindingPages(DataSource):
    """spark.read.format("finding_pages").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        path = self.options["path"]
        return _PageReader(path if "://" in path or path.startswith("file:") else f"file://{path}")


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """All findings of the pages in a folder; a page that is no document of the kind gives none."""
    spark.dataSource.register(FindingPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).load(folder)


def in_scope(rows: DataFrame, types: Sequence[str] = (), severities: Sequence[str] = (), statuses: Sequence[str] = (), rules: Sequence[str] = (), author: str | None = None, assignee: str | None = None) -> DataFrame:
    """Findings of a scope, by filters that a source can take. Hotspots are no findings: a scope of them alone is empty."""
    wanted = [x for x in types if x != HOTSPOT]
    if types and not wanted:
        return rows.limit(0)
    rows = rows.where(F.col("status").isin(*(statuses or OPEN_STATUSES)))
    for name, values in (("type", wanted), ("severity", severities), ("rule", rules), ("author", [author] if author else ()), ("assignee", [assignee] if assignee else ())):
        if values:
            rows = rows.where(F.col(name).isin(*values) if len(values) > 1 else F.col(name) == values[0])
    return rows


def hotspots(rows: DataFrame, files: Sequence[str] = (), limit: int = 0) -> DataFrame:
    """Hotspots of a set of files (of all, if none are given), the first `limit` by key, at most MOST."""
    rows = rows.where(F.col("type") == HOTSPOT)
    return (rows.where(F.col("file").isin(*files)) if files else rows).orderBy("key").limit(min(limit or MOST, MOST))


def capped(rows: DataFrame, limit: int = 0) -> DataFrame:
    """The first `limit` rows by key (at most MOST: the report's own bound), with the total and whether some are missing."""
    most = min(limit if limit > 0 else MOST, MOST)
    total = F.broadcast(rows.agg(F.count("*").alias("total")))  # one row
    return rows.orderBy("key").limit(most).join(total).withColumn("truncated", F.col("total") > most)


def tree_totals(components: DataFrame, measures: DataFrame) -> DataFrame:
    """(key, metric, own, total, n): each component's own value of a metric, and the sum and number over the component and all below it.

    components: key, parent (null at a root). measures: key, metric, value. Each component is joined
    with its ancestors by doubling: as many rounds as the logarithm of the depth. A component
    on a cycle of parents, or whose parent isn't there, counts as if the missing part were cut off;
    a component without a value in a metric adds nothing and is told where something below it has one.
    """
    scratch = Scratch(components.sparkSession, "tree")
    own = components.select("key", "parent").where("key is not null").groupBy("key").agg(F.min("parent").alias("parent"))
    known = own.select(F.col("key").alias("parent"))
    up = scratch.keep(own.join(known, "parent").where("key <> parent").select("key", F.col("parent").alias("above"), F.lit(1).cast("long").alias("steps")))
    every = scratch.keep(up)
    n = max(own.count(), 1)
    jump, step = up, 1
    while step < n:
        # those `step` above the ones that are up to `step` away; jump leads exactly `step` up
        far = every.join(jump.select(F.col("key").alias("above"), F.col("above").alias("top")), "above").select("key", F.col("top").alias("above"), (F.col("steps") + step).alias("steps"))
        both = scratch.keep(every.unionByName(far).groupBy("key", "above").agg(F.min("steps").alias("steps")))
        if both.count() == every.count():
            break
        jump = scratch.keep(jump.join(jump.select(F.col("key").alias("above"), F.col("above").alias("top")), "above").select("key", F.col("top").alias("above")))
        every, step = both, 2 * step
    pairs = every.where("key <> above").select("key", "above").unionByName(own.select("key", F.col("key").alias("above")))
    values = measures.where("value is not null").groupBy("key", "metric").agg(F.sum("value").alias("value"))
    total = pairs.join(values, "key").groupBy(F.col("above").alias("key"), "metric").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return total.join(values.withColumnRenamed("value", "own"), ["key", "metric"], "left").select("key", "metric", "own", "total", "n")


def duplicated_lines(blocks: DataFrame, rows: DataFrame, width: int = 64) -> DataFrame:
    """The rows (file, line, ...) that lie in a duplicated block, each with its number of such blocks.

    blocks: file, start, length. A range join by bins: a block is dealt to the bins of `width` lines
    that it touches, a row to its own, so only rows and blocks of one stretch of one file meet.
    """
    bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("length") - 1) / width))
    dealt = blocks.where("length > 0 and start is not null").select("file", "start", (F.col("start") + F.col("length")).alias("_end"), F.explode(bins).alias("_bin"))
    hit = rows.withColumn("_bin", F.floor(F.col("line") / width)).join(dealt.withColumnRenamed("start", "_start"), ["file", "_bin"]).where((F.col("line") >= F.col("_start")) & (F.col("line") < F.col("_end")))
    return hit.groupBy(*rows.columns).agg(F.count("*").alias("n_blocks"))


def rich_text(docs: DataFrame, column: str = "doc") -> DataFrame:
    """docs with `text`: the plain text of a rich-text tree given as JSON, walked to any depth in order.

    The tree is a VARIANT: each round opens the children (content) of the nodes that the round before has
    found, under the path of their places, so the texts come together in the order of the tree. A
    paragraph, heading or list item ends with a line feed; blanks at both ends go. What is no tree,
    or null, gives an empty text. Each document needs a key column `id`.
    """
    scratch = Scratch(docs.sparkSession, "rich")
    get = lambda path, kind: F.try_variant_get("v", f"$.{path}", kind)
    level = docs.select("id", F.array(F.lit(0)).alias("path"), F.try_parse_json(F.col(column)).alias("v")).where("v is not null")
    found = None
    while True:
        node = level.select("id", "path", get("type", "string").alias("type"), get("text", "string").alias("s"), get("content", "variant").cast("string").alias("content"))
        node = scratch.keep(node)
        # a node's own text stands before its children, its line feed after them
        own = node.where("type = 'text'").select("id", "path", "s")
        end = node.where(F.col("type").isin("paragraph", "heading", "listItem")).select("id", F.concat("path", F.array(F.lit(2_147_483_647))).alias("path"), F.lit("\n").alias("s"))
        found = own.unionByName(end) if found is None else found.unionByName(own).unionByName(end)
        children = node.where("content like '[%'")
        if children.isEmpty():
            break
        kids = F.from_json(F.col("content"), "array<variant>")
        level = children.select("id", "path", F.posexplode(kids).alias("i", "v")).select("id", F.concat("path", F.array("i")).alias("path"), "v")
    texts = found.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "s"))), lambda x: x["s"]), "").alias("_t"))
    trimmed: Column = F.regexp_replace(F.coalesce("_t", F.lit("")), "^\\s+|\\s+$", "")
    return docs.join(texts, "id", "left").select(*docs.columns, trimmed.alias("text"))
