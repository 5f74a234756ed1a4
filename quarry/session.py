"""Session settings shared by the library, the benchmark and the tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "quarry", cores: str | int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; nothing here overrides what a cluster has set."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cores is not None:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "8g"))
            .config("spark.sql.shuffle.partitions", str(conf.pop("shuffle_partitions", "8")))
        )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
