"""Measurements as rows: named runs with parameters, wall clock and, of a session, what its tasks took; medians of repetitions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from statistics import median

from pyspark.sql import DataFrame, SparkSession


#: What the stages of a block add up to: name and the stage's own measure.
COUNTERS = {
    "tasks": "numCompleteTasks", "cpu_ns": "executorCpuTime", "run_ms": "executorRunTime", "gc_ms": "jvmGcTime", "input_rows": "inputRecords", "input_bytes": "inputBytes",
    "shuffle_read_bytes": "shuffleReadBytes", "shuffle_write_bytes": "shuffleWriteBytes", "spilled_bytes": "diskBytesSpilled",
}


def counted(spark: SparkSession) -> dict[str, int]:
    """The counters over all stages of the application so far, as its own status store has them."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    found = [stages.apply(i) for i in range(stages.size())]
    return {name: sum(int(getattr(s, measure)()) for s in found) for name, measure in COUNTERS.items()}


class Runs:
    """Collects one row for each measured block; with a session, also what its tasks counted meanwhile."""

    def __init__(self, spark: SparkSession | None = None) -> None:
        self.spark = spark
        self.rows: list[tuple[str, dict[str, str], float, int, dict[str, int]]] = []

    @contextmanager
    def block(self, name: str, scale: int = 1, **params: object) -> Iterator[None]:
        before, began = counted(self.spark) if self.spark else {}, time.perf_counter()
        try:
            yield
        finally:
            took = time.perf_counter() - began
            after = counted(self.spark) if self.spark else {}
            self.rows.append((name, {k: str(v) for k, v in params.items()}, took, scale, {k: after[k] - before[k] for k in after}))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "name string, params map<string,string>, seconds double, scale bigint, counters map<string,bigint>").selectExpr("*", "scale / seconds AS per_second")


def median_seconds(run: Callable[[], object], times: int = 3) -> float:
    taken = []
    for _ in range(times):
        began = time.perf_counter()
        run()
        taken.append(time.perf_counter() - began)
    return median(taken)
