"""Reliable checkpoints and broadcasts of a checked size."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder of the session and read again. Where none is set, a temporary one in local mode; on a cluster an error."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


#: A side of unknown size is broadcast only when it was counted and has at most this many narrow rows.
BROADCAST_ROWS = 1_000_000


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else df as it is. The count ends once the bound is passed."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
