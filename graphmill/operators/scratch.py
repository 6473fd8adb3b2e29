"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Settings while a table is written: Arrow batches of bounded bytes, and shuffle files that go once the table is there.
_WRITING = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without one (as in tests) gets /tmp/checkpoints: on a cluster executors would not share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or "file:///tmp/checkpoints"


#: Rows of a task that holds its groups in memory.
DEALT = 200_000


def shares(*tables: DataFrame) -> int:
    """In how many tasks the rows of these tables should be dealt so that a task's share doesn't grow with them."""
    return max(1, -(-sum(t.count() for t in tables) // DEALT))


class Scratch:
    """Written tables of one run. keep() writes and rereads, so later jobs read files that survive lost executors; drop() deletes a table that no later plan reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[str, DataFrame]] = {}
        self.names: dict[str, str | None] = {}
        self.n = 0

    def keep(self, df: DataFrame, buckets: int = 0, by: str = "") -> DataFrame:
        """The written table. Its shuffles are of no more use then, since later plans read the files.

        With buckets it is dealt into so many files by a column, so joins on that column read it without a shuffle.
        """
        self.n += 1
        name = f"scratch_{uuid.uuid4().hex}" if buckets else None
        path = f"{self.root}/{self.n}"
        usual = {k: self.spark.conf.get(k, None) for k in _WRITING}
        for k, v in _WRITING.items():
            self.spark.conf.set(k, v)
        try:
            if name:
                df.write.format("parquet").bucketBy(buckets, by).option("path", path).saveAsTable(name)
            else:
                df.write.parquet(path)
        finally:
            for k, v in usual.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        out = self.spark.table(name) if name else self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path, out  # held, so that its id stays its own
        self.names[path] = name
        return out

    def drop(self, df: DataFrame) -> None:
        path, _ = self.paths.pop(id(df), (None, None))
        if path:
            name = self.names.pop(path)
            if name:
                self.spark.sql(f"drop table if exists {name}")
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def keep_only(self, *kept: DataFrame) -> None:
        """Deletes all tables but these; lazy plans over the others must not be used any more."""
        for _, df in list(self.paths.values()):
            if not any(df is k for k in kept):
                self.drop(df)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of plans whose results have been written: it does so once their plans are garbage."""
        gc.collect()
        self.spark._jvm.System.gc()
