"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.session import scratch_path, ship_sources

# the white space of every operator here, as a class for Java and RE2 patterns
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

# bytes: A-Z to a-z and nothing else, and the six white-space bytes
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACES = b" \t\n\x0b\x0c\r"


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per Spark context.

    Unless the session says otherwise, Arrow batches get 2,000 rows: documents
    are long, and a batch is held by the JVM and by Python at the same time.
    """
    if spark.conf.get(ARROW_ROWS, "-1") == "-1":  # not set
        spark.conf.set(ARROW_ROWS, "2000")
    ship_sources(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame) -> Column:
    """All columns of a row as one struct: whatever their names, they meet no others."""
    return F.struct(*[quoted(c).alias(c) for c in docs.columns])


def whole_text(col: Column | str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder, with these Parquet options, and read it back.

    It cuts the lineage: the written table outlives any executor, and, unlike a
    checkpoint, it keeps columnar pruning and true sizes for the planner.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_slices(batches: Iterator[pa.RecordBatch], column: str, max_rows: int = 256,
               max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one slice stay near ``max_bytes``."""
    for b in batches:
        i, n = 0, b.num_rows
        text = b.column(b.schema.get_field_index(column))
        while i < n:
            k = min(max_rows, n - i)
            while k > 1 and text.slice(i, k).nbytes > max_bytes:
                k = max(1, k // 2)
            yield b.slice(i, k)
            i += k


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
