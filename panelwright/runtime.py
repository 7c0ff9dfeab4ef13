"""Session defaults and the shared folder that stage tables are written to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Single-machine session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("panelwright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stage_root(spark: SparkSession) -> str:
    """Folder for stage tables: ``spark.checkpoint.dir``, which every executor must see.

    Only a local master may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="panelwright-stage-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def stage_path(spark: SparkSession, kind: str = "stage") -> str:
    """A new path below the shared folder."""
    return os.path.join(stage_root(spark), f"{kind}-{uuid.uuid4().hex}")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage and fixes values that depend on the physical layout, so that a
    lost executor can not change them between two uses.
    """
    spark = df.sparkSession
    path = stage_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def one_task_a_core(df: DataFrame) -> DataFrame:
    """``df`` in at most as many partitions as the session has cores, without a shuffle: for passes that are repeated
    over the same rows and whose every task returns a result of fixed size."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))
