"""The corpus pipeline: quality, exact copies, near copies, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again for the next.  All but the last return the columns of
``documents``.

Results for odd input, in every stage: an empty table gives an empty result; null and
empty texts are ordinary documents without words (the mixture takes only documents
with words); null ids, and ids that several rows share, are judged row by row, except
that the quality stage, whose verdicts are by id, keeps all rows of an id of which it
keeps one; of rows that tie one stays, of equal rows any; a row travels as one struct,
so columns may have any names, and those that a stage doesn't know pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillcast.llm.common import ship_package, stored, table
from tillcast.llm.grace_dedup import drop_copies
from tillcast.llm.piece_codec import piece_codes
from tillcast.llm.shingle_join import drop_near_duplicates
from tillcast.llm.site_quality import keep_quality
from tillcast.llm.source_mix import mix_documents
from tillcast.session import checkpoint_dir


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    checkpoint_dir(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the site quality classifier keeps."""
    _ready(spark)
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text."""
    _ready(spark)
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five-word shingles, similarity 0.8)."""
    _ready(spark)
    return drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: a row for each document's words that a slot of the schedule takes."""
    _ready(spark)
    return mix_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each row of the mix."""
    _ready(spark)
    import public_tokenizers
    return piece_codes(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("pieces", pieces)]

# the classifier and the piece model have no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    _ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
