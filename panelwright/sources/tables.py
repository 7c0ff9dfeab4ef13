"""Readers and writers."""

from __future__ import annotations

import time
import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVISION_PAYLOAD = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField(
            "observations",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("date", T.StringType()),
                        T.StructField("realtime_start", T.StringType()),
                        T.StructField("realtime_end", T.StringType()),
                        T.StructField("value", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("ingest_seq", T.IntegerType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("region", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("is_reversal", T.IntegerType()),
    ]
)


class Tables:
    """Lazy readers for the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    benchmark = cached_property(lambda self: self.read("benchmark"))
    conversations = cached_property(lambda self: self.read("conversations"))
    customer = cached_property(lambda self: self.read("customer"))
    documents = cached_property(lambda self: self.read("documents"))
    embeddings = cached_property(lambda self: self.read("embeddings"))
    events = cached_property(lambda self: self.read("events"))
    labels = cached_property(lambda self: self.read("labels"))
    lineitem = cached_property(lambda self: self.read("lineitem"))
    nation = cached_property(lambda self: self.read("nation"))
    orders = cached_property(lambda self: self.read("orders"))
    pages = cached_property(lambda self: self.read("pages"))
    part = cached_property(lambda self: self.read("part"))
    region = cached_property(lambda self: self.read("region"))
    supplier = cached_property(lambda self: self.read("supplier"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a declared schema; nothing is inferred."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_events(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Compressed event CSV. One gzip file is one task, so the rows are rebalanced right after the
    scan; adaptive execution picks the number of partitions by their size."""
    return read_csv(spark, path, schema).hint("rebalance")


def write_parquet(df: DataFrame, path: str, sort_by: list[str]) -> None:
    """Key-sorted, zstd-compressed Parquet: range partitions keep min/max statistics selective.

    A row hash behind the keys lets the rows of one hot key spread over several files, which
    stay in key order.
    """
    (
        df.repartitionByRange(*sort_by, F.xxhash64(*df.columns))
        .sortWithinPartitions(*sort_by)
        .write.mode("errorifexists")
        .option("compression", "zstd")
        .parquet(path)
    )


def write_results(results: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder per result table; nested columns have no CSV form and are refused by Spark."""
    for name, df in results.items():
        df.write.mode("errorifexists").option("header", True).csv(f"{folder}/{name}")


def read_shards(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All CSV shards below ``folder`` as one table."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("recursiveFileLookup", True)
        .csv(folder)
    )


def _neutral(name: str, kind: T.DataType) -> Column:
    """Value as text that engines agree on: floats with ten decimals (as they print where they do not fit), times in microseconds."""
    c = F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(c.try_cast("decimal(38,10)").cast("string"), c.cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("string")
    return c.cast("string")


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free fingerprint that other engines can repeat: row count and sums of both halves of a row hash.

    A row's hash is the MD5 of its fields, each ``-`` if NULL, else its UTF-8 length, ``:`` and text. Sums are
    taken in DECIMAL(38,0), which 10^18 rows can not wrap.
    """
    texts = [_neutral(c, df.schema[c].dataType) for c in columns]
    row = F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])
    halves = df.select(F.md5(row.cast("binary")).alias("h"))
    number = lambda text: F.conv(text, 16, 10).cast("decimal(20,0)").cast("decimal(38,0)")
    return halves.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(number(F.substring("h", 1, 16))).cast("string").alias("high_sum"),
        F.sum(number(F.substring("h", 17, 16))).cast("string").alias("low_sum"),
    )


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


CURRENT = "_current"  # names the version that readers take


def _file_system(spark: SparkSession, folder: str):
    """Hadoop's file context of a folder, its Path class and the gateway."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(folder).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    return context, path, jvm


def publish(df: DataFrame, folder: str, grace_seconds: int = 86_400) -> str:
    """Replace a table under its readers, in any session: returns the name of the new version.

    The version is written in full, then a pointer file is renamed over the old one, which is one step for the file
    system: readers find the old version or the new one. A reader that has the old one keeps its files until they have been
    superseded for ``grace_seconds``; unfinished versions of failed writers go then, too. Of two writers the later rename wins.
    """
    spark = df.sparkSession
    version = f"version-{time.time_ns():020d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{version}")
    context, path, jvm = _file_system(spark, folder)
    draft, pointer = path(f"{folder}/{CURRENT}-{uuid.uuid4().hex}"), path(f"{folder}/{CURRENT}")
    fs = draft.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(draft)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, pointer, overwrite)
    _expire(fs, path, folder, _current(spark, folder), grace_seconds)
    return version


def _current(spark: SparkSession, folder: str) -> str:
    _, path, jvm = _file_system(spark, folder)
    pointer = path(f"{folder}/{CURRENT}")
    stream = pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(pointer)
    try:
        return str(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).strip()
    finally:
        stream.close()


def _expire(fs, path, folder: str, current: str, grace_seconds: int) -> None:
    """Deletes versions before the current one whose successor is older than the grace time, in which a writer must finish."""
    statuses = [s for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("version-")]
    names = sorted(s.getPath().getName() for s in statuses)
    now = time.time_ns()
    for name, successor in zip(names, names[1:], strict=False):
        if name < current and now - int(successor.split("-")[1]) >= grace_seconds * 1_000_000_000:
            fs.delete(path(f"{folder}/{name}"), True)


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The version of a published table that is current now; its files stay while it is read."""
    return spark.read.parquet(f"{folder}/{_current(spark, folder)}")


def _blank_to_null(col: Column) -> Column:
    return F.when(~col.isin("", "."), col)


def flatten_revisions(payload: DataFrame) -> DataFrame:
    """Payload rows ``(series_id, count, observations[])`` to the revision history.

    ``.`` is a missing value, a missing end is open (9999-12-31), rows without a release
    start are dropped, and a payload that announces more rows than it carries fails the job.
    """
    announced = F.coalesce(F.col("count"), F.size("observations").cast("long"))
    carried = F.size("observations")
    checked = F.when(
        announced > carried,
        F.raise_error(F.concat(F.lit("truncated revision history for "), F.col("series_id"))).cast(
            payload.schema["observations"].dataType
        ),
    ).otherwise(F.col("observations"))
    rows = payload.select("series_id", F.explode(checked).alias("o"))
    return rows.where(_blank_to_null(F.col("o.realtime_start")).isNotNull()).select(
        "series_id",
        F.to_date("o.date").alias("observation_date"),
        F.to_date("o.realtime_start").alias("realtime_start"),
        F.to_date(F.coalesce(_blank_to_null(F.col("o.realtime_end")), F.lit("9999-12-31"))).alias("realtime_end"),
        _blank_to_null(F.col("o.value")).cast("double").alias("value"),
    )


def read_revision_json(spark: SparkSession, path: str) -> DataFrame:
    """Revision-history JSON payloads, one object per line."""
    return flatten_revisions(spark.read.schema(REVISION_PAYLOAD).json(path))
