"""Stored model runs.

A run lies in a folder of its own, named by a digest of the rows and settings that
it was made from, so other rows or settings never find it.  Tables are written to a
folder of the attempt; the manifest, written last, names the attempts that are whole.
Nothing is changed after that: two jobs that make the same run at a time leave two
attempts, and every reader takes the same one.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.session import checkpoint_dir


def digest_of(rows: DataFrame, settings: dict) -> str:
    """Digest of all rows, in any order, and of the settings."""
    cols = sorted(rows.columns)
    h = F.xxhash64(*[F.col(c) for c in cols])
    r = rows.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h),
                 F.sum(F.xxhash64(h).cast("decimal(38,0)"))).first()
    text = json.dumps([rows.select(*cols).schema.simpleString(), [str(x) for x in r], settings], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def _base(spark: SparkSession, digest: str) -> str:
    return os.path.join(checkpoint_dir(spark), "model-runs", digest)


def find(spark: SparkSession, digest: str) -> str | None:
    """Folder of a whole run, or None."""
    try:
        attempt = spark.read.schema("attempt string").parquet(os.path.join(_base(spark, digest), "manifest")).agg(F.min("attempt")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return attempt and os.path.join(_base(spark, digest), attempt)


def save(spark: SparkSession, digest: str, tables: dict[str, DataFrame]) -> str:
    """Write the tables of a run and commit it; returns the folder that readers take."""
    attempt = f"attempt-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(os.path.join(_base(spark, digest), attempt, name))
    spark.createDataFrame([(attempt,)], "attempt string").coalesce(1).write.mode("append").parquet(os.path.join(_base(spark, digest), "manifest"))
    return find(spark, digest)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, name))
