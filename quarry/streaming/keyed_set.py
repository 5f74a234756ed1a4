"""The keyed set as a stream: one boolean of state for each key, operations applied in the order of their numbers.

Operations of one key have to arrive in order over the micro-batches; within one they are sorted, so a task holds the
operations of one key in one micro-batch, whose files log_stream bounds. Keys do not see each other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.sources.kept import shared_dir

RESULT = "i bigint, key bigint, op string, present boolean, result boolean"


def replayed(log: DataFrame, initial_below: int) -> DataFrame:
    """A streaming log (i, key, op) with presence and result of each operation; the set starts with the keys below a bound."""

    def apply(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        present = bool(state.get[0]) if state.exists else key[0] < initial_below
        ops = pd.concat(list(frames), ignore_index=True).sort_values("i", kind="stable")
        op = ops["op"].to_numpy()
        insert, change = op == "insert", op != "contains"
        last = np.maximum.accumulate(np.where(change, np.arange(len(op)), -1))  # the last change up to each operation
        after = np.where(last >= 0, insert[last], present)
        before = np.r_[present, after[:-1]]
        result = np.where(insert, ~before, before)
        state.update((bool(after[-1]),))
        yield ops.assign(present=before, result=result)[["i", "key", "op", "present", "result"]]

    return log.groupBy("key").applyInPandasWithState(apply, RESULT, "present boolean", "append", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, stream: DataFrame, name: str, schema: str = RESULT) -> DataFrame:
    """Runs a stream over what is there, into files of the shared folder, and returns them as a table."""
    top = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{top}/rows").option("checkpointLocation", f"{top}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{top}/rows")


def log_stream(spark: SparkSession, path: str, schema, key, op, files: int = 8) -> DataFrame:
    """An operation log read as a stream of files of events, `files` of them in a micro-batch, the oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).select(F.col("event_id").alias("i"), key.alias("key"), op.alias("op"))
