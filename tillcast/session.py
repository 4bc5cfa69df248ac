"""Session construction and lineage cutting.

On a cluster the session is given to us; we only read ``spark.checkpoint.dir``
from it.  Only when that setting is absent (local tests, bench) do we point it
at a fresh scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tillcast", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only if unset."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None)
    try:
        path = path or spark.conf.get("spark.checkpoint.dir")
    except Exception:  # not set in the SQL conf either
        pass
    owner = spark.sparkContext.getCheckpointDir()
    if not path and owner:  # the application has set one itself
        return owner
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tillcast-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if owner is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def ship_sources(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per Spark context.

    Functions that run in tasks are pickled by reference, so executors must be
    able to import them; this is what ``spark-submit --py-files`` would do.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tillcast_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="tillcast-src-"), "tillcast_src.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(out)
    sc._tillcast_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (for written tables)."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder; survives executor loss."""
    return df.checkpoint(eager=eager)
