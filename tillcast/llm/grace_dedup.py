"""Exact deduplication by Grace hash partitioning.

Texts are equal when they are identical once all white space is deleted.  Each
map task first merges its own copies, so that a text shared by a third of all
rows reaches the shuffle once per task.  Each shuffle partition then fills an
open-addressing table that compares complete contents; when the contents pass
the memory bound, table and remaining input go to spill files by the next bits
of the hash, and each file is handled the same way.  Spill files are unnamed
temporary files which only the writing task reads: a lost executor costs a
rerun of its tasks and nothing else.

Results for odd input: null text counts as empty; empty and blank texts form one
group; a null ``doc_id`` sorts after all others; of rows that repeat doc_id and
text, exactly one is kept; an empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.llm.common import SPACE, SPACES, packed, row_slices, strings, table, whole_text
from tillcast.llm.registry import query

N_SALTS = 256           # members of one text are joined in so many parts
LOCAL_BYTES = 16 << 20  # contents that a map task holds while it merges its own copies
TABLE_BYTES = 32 << 20  # contents that one bucket may hold before it spills
FAN_OUT_BITS = 4        # each level of spilling uses so many bits: 16 files

REP_SCHEMA = "hash long, content binary, n long, best_len long, best_id long, salts array<int>"
GROUP_SCHEMA = "text_sha256 string, keep_id long, keep_len long, group_size long, salts array<int>"


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (length, id): the longer, then the smaller id, null last."""
    if a[0] != b[0]:
        return a if a[0] > b[0] else b
    if a[1] is None or b[1] is None:
        return b if a[1] is None else a
    return a if a[1] <= b[1] else b


class ContentTable:
    """Open addressing with linear probing over complete contents."""

    def __init__(self):
        self.slots = np.full(1024, -1, np.int64)
        self.rows: list[list] = []  # hash, content, n, (length, id), salts as a bit set or the best row
        self.bytes = 0

    def _slot(self, h: int, content: bytes) -> int:
        mask = len(self.slots) - 1
        i = h & mask
        while (k := self.slots[i]) >= 0:
            row = self.rows[k]
            if row[0] == h and row[1] == content:
                return i
            i = (i + 1) & mask
        return i

    def add(self, h: int, content: bytes, n: int, best: tuple, carried) -> None:
        i = self._slot(h, content)
        k = self.slots[i]
        if k >= 0:
            row = self.rows[k]
            better = _better(row[3], best)
            if isinstance(carried, int):
                row[4] |= carried
            elif better is best:
                row[4] = carried
            row[2] += n
            row[3] = better
            return
        self.slots[i] = len(self.rows)
        self.rows.append([h, content, n, best, carried])
        self.bytes += len(content) + 200
        if 2 * len(self.rows) > len(self.slots):
            self.slots = np.full(4 * len(self.slots), -1, np.int64)
            mask = len(self.slots) - 1
            for k, row in enumerate(self.rows):
                i = row[0] & mask
                while self.slots[i] >= 0:
                    i = (i + 1) & mask
                self.slots[i] = k


def _bits(salts: int) -> list[int]:
    return [i for i in range(N_SALTS) if salts >> i & 1]


def _rep_batches(rows: list[list]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 512):
        part = rows[i:i + 512]
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] - (1 << 63) for r in part], pa.int64()),
            pa.array([r[1] for r in part], pa.binary()),
            pa.array([r[2] for r in part], pa.int64()),
            pa.array([r[3][0] for r in part], pa.int64()),
            pa.array([r[3][1] for r in part], pa.int64()),
            pa.array([_bits(r[4]) for r in part], pa.list_(pa.int32())),
        ], names=["hash", "content", "n", "best_len", "best_id", "salts"])


def merge_local(local_bytes: int):
    """Map side: one record per distinct text among the rows a task holds at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ContentTable()
        for b in row_slices(batches, "text"):
            ids, salts = b.column("doc_id").to_pylist(), b.column("salt").to_pylist()
            for text, doc_id, salt in zip(strings(b, "text"), ids, salts):
                content = text.encode().translate(None, SPACES)
                held.add(xxhash.xxh3_64_intdigest(content), content, 1, (len(text), doc_id), 1 << salt)
            if held.bytes > local_bytes:
                yield from _rep_batches(held.rows)
                held = ContentTable()
        yield from _rep_batches(held.rows)
    return run


def _distinct(records: Iterator[tuple], level: int, table_bytes: int) -> Iterator[list]:
    """Rows of the table over ``records``, by recursive partitioning once they pass the bound."""
    held, files = ContentTable(), None
    last = level * FAN_OUT_BITS >= 60  # no hash bits left to split by
    shift = 60 - level * FAN_OUT_BITS
    for r in records:
        if files is None:
            held.add(*r)
            if held.bytes > table_bytes and not last:
                files = [tempfile.TemporaryFile() for _ in range(1 << FAN_OUT_BITS)]
                for row in held.rows:
                    pickle.dump(tuple(row), files[row[0] >> shift & 15], 5)
                held = None
        else:
            pickle.dump(r, files[r[0] >> shift & 15], 5)
    if files is None:
        yield from held.rows
        return

    def read(f):
        f.seek(0)
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return

    for i, f in enumerate(files):
        with f:
            yield from _distinct(read(f), level + 1, table_bytes)
        files[i] = None


def grace_partition(table_bytes: int):
    """Reduce side: all records of a text are in this partition."""
    def records(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                for r in b.slice(i, 256).to_pylist():
                    salts = 0
                    for s in r["salts"]:
                        salts |= 1 << s
                    yield r["hash"] + (1 << 63), r["content"], r["n"], (r["best_len"], r["best_id"]), salts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[list] = []

        def out():
            return pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in part], pa.string()),
                pa.array([x[1] for x in part], pa.int64()),
                pa.array([x[2] for x in part], pa.int64()),
                pa.array([x[3] for x in part], pa.int64()),
                pa.array([x[4] for x in part], pa.list_(pa.int32())),
            ], names=["text_sha256", "keep_id", "keep_len", "group_size", "salts"])

        for _, content, n, (length, doc_id), salts in _distinct(records(batches), 0, table_bytes):
            part.append([hashlib.sha256(content).hexdigest(), doc_id, length, n, _bits(salts)])
            if len(part) >= 4096:
                yield out()
                part = []
        yield out()
    return run


def content_groups(docs: DataFrame, local_bytes: int = LOCAL_BYTES, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct normalised text: digest, keeper, size, and the salts of its members."""
    reps = _salted(docs).select("doc_id", "text", "salt").mapInArrow(merge_local(local_bytes), REP_SCHEMA)
    return reps.repartition(F.col("hash")).mapInArrow(grace_partition(table_bytes), GROUP_SCHEMA)


def _salted(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"),
                       F.pmod(F.xxhash64("doc_id"), F.lit(N_SALTS)).cast("int").alias("salt"))


def exact_dedup(docs: DataFrame, local_bytes: int = LOCAL_BYTES, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Members meet their group by (digest, salt of doc_id): a group is listed once
    for each salt that its members have, so even a third of all rows being
    copies is spread over ``N_SALTS`` join keys.
    """
    groups = content_groups(docs, local_bytes, table_bytes).withColumn("salt", F.explode("salts")).drop("salts")
    members = _salted(docs).select(
        "doc_id", "salt", F.length("text").cast("long").alias("len"),
        F.sha2(F.regexp_replace("text", f"{SPACE}+", ""), 256).alias("text_sha256"))
    # rows that repeat the keeper's id and length: one of them stays
    twins = Window.partitionBy("text_sha256", "salt", "doc_id", "len").orderBy("doc_id")
    return members.join(groups, ["text_sha256", "salt"]).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("keep_len"))
         & (F.row_number().over(twins) == 1)).alias("kept"),
        "text_sha256")


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Records of the table for whole rows: the best row of a text is carried along."""
    for b in batches:
        for i in range(0, b.num_rows, 128):
            for row in b.slice(i, 128).column(0).to_pylist():
                text = row["text"] or ""
                content = text.encode().translate(None, SPACES)
                yield xxhash.xxh3_64_intdigest(content), content, 1, (len(text), row["doc_id"]), row


def _row_batches(rows: list[list], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 128):
        part = rows[i:i + 128]
        yield pa.RecordBatch.from_arrays([pa.array([r[4] for r in part], kind), pa.array([r[0] - (1 << 63) for r in part], pa.int64())],
                                         names=["row", "hash"])


def best_rows_local(kind: pa.DataType, local_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ContentTable()
        for r in _rows_of(batches):
            held.add(*r)
            if held.bytes > local_bytes // 2:  # a row holds its text once more
                yield from _row_batches(held.rows, kind)
                held = ContentTable()
        yield from _row_batches(held.rows, kind)
    return run


def best_rows(kind: pa.DataType, table_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[list] = []
        for row in _distinct(_rows_of(batches), 0, table_bytes // 2):
            part.append(row)
            if len(part) >= 512:
                yield from _row_batches(part, kind)
                part = []
        yield from _row_batches(part, kind)
    return run


def drop_copies(docs: DataFrame, local_bytes: int = LOCAL_BYTES, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The documents that stay, with all their columns.

    The same tables as in ``exact_dedup``, but the best row itself travels with
    its text, so whole documents are shuffled once and nothing is joined.  A row
    travels as one struct, so its columns may have any names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("row", docs.schema), StructField("hash", LongType())])
    kind = to_arrow_schema(schema).field("row").type
    reps = docs.select(packed(docs).alias("row")).mapInArrow(best_rows_local(kind, local_bytes), schema)
    return reps.repartition("hash").mapInArrow(best_rows(kind, table_bytes), schema).select("row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents),
g AS (
  SELECT *, count(*) OVER (PARTITION BY t) AS group_size,
         first_value(doc_id) OVER (PARTITION BY t ORDER BY len DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM g
"""


@query("op7_exact_dedup", SQL)
def op7_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))
