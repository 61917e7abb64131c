"""Local session for tests, checks and benchmarks."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def session(name: str, cpus: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    work = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = (SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', cpus)}]")
             .appName(name)
             .config("spark.driver.memory", memory)
             .config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.warehouse.dir", f"{work}/warehouse")
             .config("spark.checkpoint.dir", f"{work}/checkpoint")
             .config("spark.python.unix.domain.socket.enabled", "true")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
