"""A graph's collections as a partitioned store with idempotent keyed merges.

A row is (collection, key, seq, doc): the document of a node or an edge under its
key.  Rows lie in buckets of (collection, hash of key).  A merge reads only the
buckets that its rows fall in, keeps for each key the row of the greatest seq, and
overwrites just these buckets.  The merged buckets are written aside first and renamed
from there, so a merge that was cut off is finished by the next one, and a batch
that comes again changes nothing: its rows are known by a digest for each bucket,
kept once they are in, and neither dealt nor written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "collection string, key string, seq long, doc string"
BUCKETS = 16
#: New rows of a bucket that are merged by one task; more are merged in slices, each a file
SLICE_ROWS = 250_000


def document_key(prefix: Column, *columns: str) -> Column:
    """A key from a row's content: equal rows have one."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    return F.concat(prefix, F.lit("_"), F.md5(F.concat_ws("\x1f", *text)))


def as_rows(df: DataFrame, collection: str, key: Column, seq: Column, *fields: str) -> DataFrame:
    """(collection, key, seq, doc) of a table."""
    return df.select(F.lit(collection).alias("collection"), key.alias("key"), seq.cast("long").alias("seq"), F.to_json(F.struct(*fields)).alias("doc"))


class GraphStore:
    """Collections under a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.rows_at, self.aside, self.known_at = (f"{path.rstrip('/')}/{x}" for x in ("rows", "aside", "known"))

    def _file(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _there(self, path: str) -> bool:
        at, fs = self._file(path)
        return fs.exists(at)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))

    def _all(self) -> DataFrame:
        schema = f"key string, seq long, doc string, collection string, bucket int"  # noqa: F541
        read = self.spark.read.schema(schema)
        return read.parquet(self.rows_at) if self._there(self.rows_at) else self.spark.createDataFrame([], schema)

    def _move_in(self) -> None:
        """Puts the buckets that lie aside in their places; where none lie aside, or not all, nothing happens."""
        at, fs = self._file(self.aside)
        if self._there(f"{self.aside}/_SUCCESS"):
            path = self.spark._jvm.org.apache.hadoop.fs.Path
            for collection in [x.getPath() for x in fs.listStatus(at) if x.isDirectory()]:
                home = path(path(self.rows_at), collection.getName())
                fs.mkdirs(home)
                for bucket in [x.getPath() for x in fs.listStatus(collection)]:
                    fs.delete(path(home, bucket.getName()), True)
                    if not fs.rename(bucket, path(home, bucket.getName())):
                        raise OSError(f"{bucket} can't be moved to {home}")
            if any(x.getPath().getName().endswith(".parquet") for x in fs.listStatus(at)):  # one table of all buckets
                write = self.spark.read.parquet(f"{self.aside}/*.parquet").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                write.partitionBy("collection", "bucket").parquet(self.rows_at)
        fs.delete(at, True)

    def _unknown(self, new: DataFrame) -> list:
        """(collection, bucket, n, digest) of the buckets whose new rows weren't merged before, of collections times buckets at most."""
        row = [F.xxhash64("key", "seq", "doc"), F.xxhash64("doc", "seq", "key", F.lit("again"))]
        sums = [F.sum(x.cast("decimal(20, 0)")).cast("string") for x in row]
        found = new.groupBy("collection", "bucket").agg(F.count("*").alias("n"), F.md5(F.concat_ws(" ", "collection", "bucket", F.count("*").cast("string"), *sums)).alias("digest")).collect()
        return [x for x in found if not self._there(f"{self.known_at}/{x['digest']}")]

    def merge(self, rows: DataFrame) -> None:
        """Upserts rows (collection, key, seq, doc).  Of one key's rows the greatest seq stays, and of equal ones the greatest doc; null keys are left out."""
        self._move_in()
        new = self._placed(rows.where("key IS NOT NULL AND collection IS NOT NULL"))
        fresh = self._unknown(new)
        if not fresh:
            return
        named = ["collection", "bucket", "key", "seq", "doc"]
        touched = F.broadcast(self.spark.createDataFrame([(x["collection"], x["bucket"]) for x in fresh], "collection string, bucket int"))
        old, new = (x.join(touched, ["collection", "bucket"], "left_semi").select(*named) for x in (self._all(), new))
        # dealt once: a slice holds its keys whole and is written where it was merged
        slices = 1 + max(x["n"] for x in fresh) // SLICE_ROWS
        dealt = old.unionByName(new).withColumn("slice", F.pmod(F.xxhash64("key", F.lit("slice")), F.lit(slices))).repartition("collection", "bucket", "slice")
        latest = dealt.groupBy("collection", "bucket", "slice", "key").agg(F.max(F.struct("seq", "doc")).alias("x"))
        merged = latest.select("collection", "bucket", "key", "x.seq", "x.doc")
        merged.write.mode("overwrite").option("compression", "zstd").partitionBy("collection", "bucket").parquet(self.aside)
        self._move_in()
        for x in fresh:
            at, fs = self._file(f"{self.known_at}/{x['digest']}")
            fs.create(at, True).close()

    def read(self, collection: str | None = None) -> DataFrame:
        """(collection, key, seq, doc); partitions of other collections aren't read."""
        rows = self._all()
        return (rows if collection is None else rows.where(F.col("collection") == collection)).select("collection", "key", "seq", "doc")

    def sync(self, stream: DataFrame, checkpoint: str) -> None:
        """Merges what a stream (collection, key, seq, doc) has brought since the last call."""
        writer = stream.writeStream.foreachBatch(lambda batch, _: self.merge(batch)).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
