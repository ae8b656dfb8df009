"""Session helpers: make this package importable wherever Python workers run, on the cores of one task."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Settings of the libraries under numpy. A task owns spark.task.cpus cores, but they would start a thread for each core of the
#: executor and wait for them busily.
_THREADS = ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS")


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors and hold each worker to its task's cores, once per application. Thread
    numbers that the session sets with spark.executorEnv stay."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    conf = sc.getConf()
    for name in _THREADS:
        if not conf.contains(f"spark.executorEnv.{name}"):
            sc.environment.setdefault(name, conf.get("spark.task.cpus", "1"))
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="graphloom-src-"), "graphloom_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith((".py", ".yaml", ".txt")):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
