"""Making the package known to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Workers import the functions that they run; a cluster need not have the
    package installed.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="basaltine-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as archive:
        for path in root.rglob("*.py"):
            archive.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(name)


def checkpointed(df):
    """A frame whose lineage ends in the shared checkpoint folder.

    The folder is the one that spark.checkpoint.dir names.  Where it is unset
    and all executors are threads of this machine (tests), a new folder of this
    machine is used; on a cluster its absence is an error.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="basaltine-checkpoints-"))
    return df.checkpoint()
