"""Session construction: UTC, AQE and Arrow on, partitions sized to the cores at hand."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "skein", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter's settings win."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    base = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in base.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where neither PYTHONPATH nor the working folder gives it to them.

    On a cluster it is usually shipped with --py-files; otherwise a zip of it goes out once a session.
    """
    import shutil
    import tempfile
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [Path.cwd().resolve()]
    context = spark.sparkContext
    if root in known or getattr(context, "_skein_shipped", False):
        return
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-skein-')}/skein", "zip", root, "skein")
    context.addPyFile(made)
    context._skein_shipped = True
