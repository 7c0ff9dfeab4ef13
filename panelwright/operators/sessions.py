"""Sessionization that splits hot users."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.passes import Walk, ordered_pass

# Ship these functions inside the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sessionize(df: DataFrame, key: str, ts: str, tie_break: str, gap_seconds: int) -> DataFrame:
    """Adds ``new_session`` (0/1) and ``session_id`` (running count per key).

    A row opens a session when it is the key's first, when it is more than ``gap_seconds`` after the row before, or when
    either time is unknown. Rows are sorted by (key, time) once, so one user's rows may spread over many tasks.
    """

    def opens(before: dict[str, pa.Array], now: dict[str, pa.Array]) -> np.ndarray:
        elapsed = pc.subtract(pc.cast(now["_us"], pa.int64()), pc.cast(before["_us"], pa.int64()))
        return pc.fill_null(pc.greater(elapsed, gap_seconds * 1_000_000), True).to_numpy(zero_copy_only=False)

    timed = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    walk = Walk([key], opens=opens, opens_on=["_us"])
    seen = ordered_pass(timed, walk, [F.col(ts), F.col(tie_break)])
    return seen.select(*df.columns, F.col("opened").alias("new_session"), F.col("group_number").alias("session_id"))
