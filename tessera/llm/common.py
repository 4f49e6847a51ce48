"""Shared folders, written stages and row identities."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one that the cluster names in spark.checkpoint.dir.

    Where that is unset and Spark runs on one machine, as in tests, a temporary folder is set.  On a
    cluster it has to be named: its executors share no temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: Rows of an Arrow batch of whole texts, and Spark's own default.
BATCH_ROWS, DEFAULT_ROWS = 1000, "10000"


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's rows of an Arrow batch to BATCH_ROWS, unless the user has set another number than the default.

    Ten thousand long texts at once are what fills an executor's memory outside the heap; batches change no result.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == DEFAULT_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def staged(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the lineage."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables that one operator needs until its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def staged(self, df: DataFrame) -> DataFrame:
        self.paths.append(shared_dir(self.spark))
        return staged(df, self.paths[-1])

    def clear(self) -> None:
        """Deletes them; no table that is read later may depend on one."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for p in self.paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
        self.paths = []


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` as the columns ``own`` and one struct ``row`` of all others, and what brings back its columns in their order.

    Whatever columns an operator adds or uses in between, none of the input's can clash with them.
    """
    names = docs.columns
    others = [F.col(f"`{c}`") for c in names if c not in own]
    row = [F.struct(*others).alias("row")] if others else []

    def unpacked(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c) if c in own else F.col("row").getField(c).alias(c) for c in names])

    return docs.select(*own, *row), unpacked


def free_name(docs: DataFrame, stem: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while stem in taken:
        stem += "_"
    return stem


def bucket_of(column: str, parts: int):
    """crc32 of an id as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string")) % parts
