"""Keyed tables with commits (U1, U2, U6, U7, L1, S14): upsert, patch, delete, append and reset.

Rows lie in buckets of their key's hash.  A commit reads and rewrites only the buckets
that it changes, or adds files to them (append); the manifest that it writes last names
the live folders of every bucket, so a commit is seen whole or not at all, and every
earlier version can still be read.  Two writers that start from one version both write
the next manifest; the folder exists for the second one, which fails and may try again.

Changes carry the number of the update (``SEQ``): of several changes to a key the
later ones count, wherever they stand in the input.  A patch names the columns that it
sets (``SET``), so it can set them to NULL.  The changes of a key are folded with
aggregates that combine on the map side, so a key with very many of them is no
burden to one task.
"""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEQ, OP, SET = "_seq", "_op", "_set"
UPSERT, PATCH, DELETE = "upsert", "patch", "delete"
BUCKETS = 32
MANIFEST = "bucket int, folder string"
META = "schema string, keys array<string>, buckets int"


def _marked(rows: DataFrame, seq, op: str, columns: list[str]) -> DataFrame:
    seq = F.lit(seq) if not isinstance(seq, Column) else seq
    return rows.withColumns({SEQ: seq.cast("long"), OP: F.lit(op), SET: F.array(*[F.lit(c) for c in columns]).cast("array<string>")})


def upserts(rows: DataFrame, seq) -> DataFrame:
    """Rows that replace those with their keys, or are added; ``seq`` is a number or a column."""
    return _marked(rows, seq, UPSERT, rows.columns)


def patches(rows: DataFrame, seq, columns: list[str]) -> DataFrame:
    """Keys with new values of ``columns``, NULL included; keys without a row are left out."""
    return _marked(rows, seq, PATCH, columns)


def deletes(rows: DataFrame, seq) -> DataFrame:
    return _marked(rows, seq, DELETE, [])


def folded(changes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key: the last whole change, and of each column the last value with its number."""
    present = set(changes.columns)
    whole = F.col(OP).isin(UPSERT, DELETE)
    aggs = [F.max(F.when(whole, F.struct(F.col(SEQ), F.col(OP)))).alias("_last")]
    for c in values:
        sets = F.array_contains(SET, c) if c in present else F.lit(False)
        v = F.col(c) if c in present else F.lit(None)
        aggs.append(F.max_by(F.struct(F.col(SEQ).alias("seq"), v.alias("v")), F.when(sets, F.col(SEQ))).alias(f"_v_{c}"))
    return changes.groupBy(*keys).agg(*aggs)


def merged(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``target`` after the changes; a patch before the last upsert or delete of its key is void."""
    values = [c for c in target.columns if c not in keys]
    f = folded(changes, keys, values).withColumn("_changed", F.lit(True))
    base = target.withColumn("_base", F.lit(True))
    on = reduce(lambda a, b: a & b, [base[k].eqNullSafe(f[k]) for k in keys])
    j = base.join(f, on, "full_outer")
    last_seq, last_op = F.col(f"_last.{SEQ}"), F.col(f"_last.{OP}")
    stays = F.when(last_op.isNull(), F.coalesce("_base", F.lit(False))).otherwise(last_op == UPSERT)

    def value(c):
        new = F.col(f"_v_{c}")
        fresh = new.isNotNull() & (last_seq.isNull() | (new["seq"] >= last_seq))
        return F.when(fresh, new["v"]).otherwise(F.when(last_op.isNull(), base[c])).alias(c)

    key = lambda k: F.when(F.col("_changed"), f[k]).otherwise(base[k]).alias(k)
    return j.where(stays).select(*[key(c) if c in keys else value(c) for c in target.columns])


class KeyedTable:
    """A table in a shared folder; every method that changes it is one commit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = spark.read.schema(META).parquet(os.path.join(path, "meta")).first()
        self.schema = StructType.fromDDL(meta["schema"])
        self.keys, self.buckets = list(meta["keys"]), meta["buckets"]

    @staticmethod
    def create(spark: SparkSession, path: str, like: DataFrame, keys: list[str], buckets: int = BUCKETS) -> "KeyedTable":
        """An empty table with the columns of ``like``: version 0."""
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
        spark.createDataFrame([(ddl, keys, buckets)], META).coalesce(1).write.parquet(os.path.join(path, "meta"))
        t = KeyedTable(spark, path)
        t._publish(0, [])
        return t

    def version(self) -> int:
        """The last published version."""
        path = os.path.join(self.path, "manifest")
        return self.spark.read.schema(f"{MANIFEST}, version int").parquet(path).agg(F.max("version")).first()[0]

    def _manifest(self, version: int) -> list[tuple[int, str]]:
        """Live folders by bucket; a version without rows has one record without a folder."""
        rows = self.spark.read.schema(MANIFEST).parquet(os.path.join(self.path, "manifest", f"version={version}")).collect()
        return [(r["bucket"], r["folder"]) for r in rows if r["folder"]]

    def _publish(self, version: int, live: list[tuple[int, str]]) -> None:
        """The commit point: fails if another writer publishes this version.

        A writer that dies in here leaves a folder without files, which has to be removed
        before that version can be published.
        """
        (self.spark.createDataFrame(live or [(-1, None)], MANIFEST).coalesce(1)
             .write.mode("error").parquet(os.path.join(self.path, "manifest", f"version={version}")))

    def _rows(self, live: list[tuple[int, str]]) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], self.schema)
        paths = [os.path.join(self.path, "data", folder, f"bucket={b}") for b, folder in live]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self._manifest(self.version() if version is None else version))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame) -> tuple[str, set[int]]:
        """Files by bucket in a folder of their own: (folder, buckets that have rows)."""
        folder = f"commit-{uuid.uuid4().hex}"
        path = os.path.join(self.path, "data", folder)
        # a task for each bucket: one file a bucket, and not one a task and bucket
        rows.select("*", self._bucket()).repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(path)
        try:
            got = self.spark.read.parquet(path).select("bucket").distinct().collect()  # as many as buckets at most
        except AnalysisException as e:  # no file at all
            if e.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
                raise
            got = []
        return folder, {r["bucket"] for r in got}

    def commit(self, *changes: DataFrame) -> int:
        """Apply changes made with ``upserts``, ``patches`` and ``deletes``; returns the new version."""
        version = self.version()
        live = self._manifest(version)
        all_changes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), changes)
        touched = {r["bucket"] for r in all_changes.select(self._bucket()).distinct().collect()}
        old = [x for x in live if x[0] in touched]
        folder, got = self._write(merged(self._rows(old), all_changes, self.keys))
        self._publish(version + 1, [x for x in live if x[0] not in touched] + [(b, folder) for b in sorted(got)])
        return version + 1

    def append(self, rows: DataFrame) -> int:
        """Add rows as they are: nothing is read or rewritten."""
        version = self.version()
        live = self._manifest(version)
        folder, got = self._write(rows.select(*self.schema.names))
        self._publish(version + 1, live + [(b, folder) for b in sorted(got)])
        return version + 1

    def reset(self) -> int:
        """Back to no rows (U7); earlier versions can still be read."""
        version = self.version()
        self._publish(version + 1, [])
        return version + 1

    def compact(self) -> int:
        """One folder per bucket again after many appends."""
        version = self.version()
        live = self._manifest(version)
        many = {b for b, _ in live if sum(x == b for x, _ in live) > 1}
        folder, got = self._write(self._rows([x for x in live if x[0] in many]))
        self._publish(version + 1, [x for x in live if x[0] not in many] + [(b, folder) for b in sorted(got)])
        return version + 1
