"""The keyed set as a stream of several files gives what the batch replay gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import keyset
from quarry.sources.tables import operation_log
from quarry.streaming import keyed_set


def test_stream_equals_batch(spark, tmp_path):
    log = operation_log(spark, 300, domain=7)
    for k in range(3):  # one micro-batch for each file, in order
        log.filter((F.col("i") >= 100 * k) & (F.col("i") < 100 * (k + 1))).coalesce(1).write.parquet(str(tmp_path / f"log/batch={k}"))
    stream = spark.readStream.schema("i bigint, key bigint, op string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log/batch=*"))
    got = keyed_set.run_available(spark, keyed_set.replayed(stream, 3), "test")
    want = keyset.replay(log, F.col("key") < 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
