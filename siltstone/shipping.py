"""The folder that driver and executors share, and the package as a zip for the executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one if all run on this machine, else an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        base = sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {sc.master})")
        base = tempfile.mkdtemp(prefix="siltstone-shared-")
        sc.setCheckpointDir(base)
    return base


def as_uri(path: str) -> str:
    return path if ":" in path.split("/")[0] else f"file://{os.path.abspath(path)}"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark application, as a zip in the shared folder."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    base = f"{as_uri(shared_dir(spark))}/siltstone"
    fs, path = pafs.FileSystem.from_uri(base)
    fs.create_dir(path, recursive=True)
    name = f"siltstone-{uuid.uuid4().hex}.zip"
    with fs.open_output_stream(f"{path}/{name}") as file:
        file.write(data.getvalue())
    sc.addPyFile(f"{base}/{name}")
    _shipped.add(sc.applicationId)
