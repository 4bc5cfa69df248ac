"""POS / demand CSV ingest.

CSV files are read with every column as a string (no schema inference pass
over the data); headers are normalized; numbers and dates are parsed with
``try_cast`` / ``try_to_timestamp`` so junk becomes NULL instead of failing
the job under ANSI mode.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillcast import fixed
from tillcast.functions.dates import yyyymmdd_to_date
from tillcast.functions.numeric import clean_number
from tillcast.session import scratch_path


SEPARATORS = (",", ";", "\t", "|")


def sniff_separator(spark: SparkSession, path) -> str:
    """The separator occurring most often in the first line (the header); ',' on ties or no header."""
    first = spark.read.text(path).limit(1).collect()          # one line, never the data
    if not first:
        return ","
    head = first[0][0] or ""
    counts = [(head.count(c), -i, c) for i, c in enumerate(SEPARATORS)]
    best = max(counts)
    return best[2] if best[0] > 0 else ","


def read_csv(spark: SparkSession, path, *, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Read one or many CSV files as strings; a leading BOM is stripped from the header.

    ``sep="auto"`` sniffs the separator from the header line.
    """
    if sep == "auto":
        sep = sniff_separator(spark, path)
    df = (spark.read.option("header", True).option("inferSchema", False).option("sep", sep)
          .option("encoding", encoding).option("multiLine", False).csv(path))
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def layout(df: DataFrame) -> str:
    """S2 detection on column names only: 'normalized', 'pos' or an error."""
    lower = {c.strip().lower() for c in df.columns}
    if {"date", "item_id", "demand_qty"} <= lower:
        return "normalized"
    upper = {c.strip().upper() for c in df.columns}
    missing = {"SALES_DE", "LCLAS_CD", "ORDER_CN"} - upper
    if missing:
        raise ValueError(f"Unsupported CSV schema. Missing columns: {sorted(missing)}")
    return "pos"


def load_normalized(df: DataFrame, keep: tuple = ()) -> DataFrame:
    """S3: rename case-insensitively, coerce types, drop rows missing date/item/qty; the columns ``keep`` stay."""
    by_lower = {c.strip().lower(): c for c in df.columns}
    amount = (clean_number(F.col(by_lower["sales_amount"])) if "sales_amount" in by_lower
              else F.lit(None).cast("double"))
    d = F.col(by_lower["date"]).cast("string")
    date = F.coalesce(F.try_to_timestamp(d), F.try_to_timestamp(d, F.lit("yyyyMMdd"))).cast("date")
    out = df.select(
        date.alias("date"),
        F.trim(F.col(by_lower["item_id"]).cast("string")).alias("item_id"),
        F.col(by_lower["demand_qty"]).cast("string").try_cast("double").alias("demand_qty"),
        amount.alias("sales_amount"), *keep,
    )
    return out.dropna(subset=["date", "item_id", "demand_qty"])


def _upper_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().upper() for c in df.columns])


def item_id_column(df: DataFrame):
    """TITLE, else MLSFC_CD-SCLAS_CD, else SALES_CD; blank / 'nan' / 'None' -> NULL."""
    cols = set(df.columns)
    if "TITLE" in cols:
        item = F.trim(F.col("TITLE").cast("string"))
    elif {"MLSFC_CD", "SCLAS_CD"} <= cols:
        item = F.concat(F.coalesce(F.trim(F.col("MLSFC_CD")), F.lit("nan")), F.lit("-"),
                        F.coalesce(F.trim(F.col("SCLAS_CD")), F.lit("nan")))
    elif "SALES_CD" in cols:
        item = F.trim(F.col("SALES_CD").cast("string"))
    else:
        raise ValueError("Cannot infer item_id from csv")
    return F.when(item.isin(*fixed.NULL_ITEM_TOKENS) | item.isNull(), F.lit(None)).otherwise(item)


def quantity_source(df: DataFrame, *, source_col: str | None = None) -> DataFrame:
    """Per source, use ORDER_CN unless none of its values is numeric (then SLE_CO)."""
    keys = [source_col] if source_col else []
    has_sle = "SLE_CO" in df.columns
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(clean_number("ORDER_CN")).alias("numeric_order_cn"),
    )
    choice = (F.when((F.col("numeric_order_cn") == 0) & F.lit(has_sle), F.lit("SLE_CO"))
              .otherwise(F.lit("ORDER_CN")))
    return agg.withColumn("qty_source", choice)


def load_pos(df: DataFrame, *, category: str = fixed.DEFAULT_POS_CATEGORY,
             source_col: str | None = None, by_source: bool = False) -> DataFrame:
    """Tolerant POS loader -> (date, item_id, demand_qty, sales_amount), with ``by_source`` also the source.

    Category match is trimmed and case-insensitive; returns are rows whose
    sales code *contains* the return marker; the date is the first 8
    characters of SALES_DE; the quantity column is inferred per source (S5).
    The rows are read once: both quantity columns are summed by source, day and
    item, and the choice between them is made on those sums, which are written.
    """
    keep = F.col(source_col) if source_col else F.lit(0)
    df = df.select("*", keep.alias("_src"))
    df = _upper_headers(df)
    layout(df)
    rows = df.where(F.upper(F.trim(F.col("LCLAS_CD"))) == category.upper())
    if "SALES_CD" in rows.columns:
        rows = rows.where(~F.coalesce(F.trim(F.col("SALES_CD")).contains(fixed.RETURN_MARKER), F.lit(False)))
    cn = clean_number("ORDER_CN")
    sle = clean_number("SLE_CO") if "SLE_CO" in rows.columns else F.lit(None).cast("double")
    amount = clean_number("PAYMENT_PRICE") if "PAYMENT_PRICE" in rows.columns else F.lit(None).cast("double")
    parsed = rows.select(F.col("_SRC").alias("_src"), yyyymmdd_to_date("SALES_DE").alias("date"), item_id_column(rows).alias("item_id"),
                         cn.alias("cn"), sle.alias("sle"), amount.alias("amount"))
    with_ = lambda c, v: F.sum(F.when(F.col(c).isNotNull(), F.coalesce(v, F.lit(0.0))))
    sums = parsed.groupBy("_src", "date", "item_id").agg(
        F.count("cn").alias("n_cn"), F.sum("cn").alias("q_cn"), with_("cn", F.col("amount")).alias("a_cn"),
        F.count("sle").alias("n_sle"), F.sum("sle").alias("q_sle"), with_("sle", F.col("amount")).alias("a_sle"))
    path = scratch_path(df.sparkSession, "pos-sums")
    sums.write.parquet(path)
    sums = df.sparkSession.read.schema(sums.schema).parquet(path)
    # A source without any number in ORDER_CN counts SLE_CO
    choice = sums.groupBy("_src").agg((F.sum("n_cn") == 0).alias("by_sle")) if "SLE_CO" in rows.columns else (
        sums.select("_src").distinct().withColumn("by_sle", F.lit(False)))
    one = sums.join(choice.withColumnRenamed("_src", "_s"), F.col("_src").eqNullSafe(F.col("_s")))
    pick = lambda x: F.when(F.col("by_sle"), F.col(f"{x}_sle")).otherwise(F.col(f"{x}_cn"))
    got = one.where(F.col("date").isNotNull() & F.col("item_id").isNotNull() & (pick("n") > 0))
    keys = [F.col("_src").alias("source")] if by_source else []
    return (got.groupBy(*keys, "date", "item_id")
               .agg(F.sum(pick("q")).cast("double").alias("demand_qty"), F.coalesce(F.sum(pick("a")), F.lit(0.0)).alias("sales_amount")))


def load_pos_strict(df: DataFrame, *, category: str = fixed.STRICT_POS_CATEGORY) -> DataFrame:
    """Strict loader: exact category, exact return code, hard numeric casts (bad data fails)."""
    rows = df.where((F.col("LCLAS_CD") == category) & (F.col("SALES_CD") != fixed.RETURN_MARKER))
    return (rows.select(F.to_date(F.col("SALES_DE").cast("string"), "yyyyMMdd").alias("date"),
                        F.concat_ws("-", F.col("MLSFC_CD").cast("string"), F.col("SCLAS_CD").cast("string")).alias("item_id"),
                        F.col("ORDER_CN").cast("double").alias("q"),
                        F.col("PAYMENT_PRICE").cast("double").alias("a"))
            .groupBy("date", "item_id")
            .agg(F.sum("q").alias("demand_qty"), F.sum("a").alias("sales_amount")))


def load_daily_demand(df: DataFrame, **kw) -> DataFrame:
    """Dispatch on the detected layout."""
    return load_normalized(df) if layout(df) == "normalized" else load_pos(df, **kw)


def _source_of(path: Column) -> Column:
    """The part files of one written folder are one source, named by the folder."""
    return F.when(path.rlike(r"/part-[^/]*$"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(path)


def candidate_files(spark: SparkSession, pattern: str, *, sample_marker: str = "sample") -> DataFrame:
    """S7 re-aimed: list files of a glob with their metadata, ranked: non-sample first, newest first.

    Uses the file source's hidden ``_metadata`` column, so only file listings
    are touched, not file contents.
    """
    o = Window.orderBy(_preference(sample_marker))
    return _sources(spark, pattern).withColumn("rank", F.row_number().over(o))


def _sources(spark: SparkSession, pattern: str) -> DataFrame:
    """path, modified and length of every candidate."""
    meta = F.col("_metadata")
    files = spark.read.format("binaryFile").load(pattern).select(
        meta["file_path"].alias("path"), meta["file_modification_time"].alias("modified"), meta["file_size"].alias("length"))
    return (files.dropDuplicates(["path"])                      # U5
                 .groupBy(_source_of(F.col("path")).alias("path")).agg(F.max("modified").alias("modified"), F.sum("length").alias("length")))


def _preference(sample_marker: str = "sample") -> Column:
    """Least for the source to try first."""
    return F.struct(F.lower("path").contains(sample_marker).cast("int").alias("sample"), (-F.unix_micros("modified")).alias("age"), F.col("path"))


_FIELDS = ("DATE", "ITEM_ID", "DEMAND_QTY", "SALES_AMOUNT",                                                     # normalized
           "SALES_DE", "LCLAS_CD", "ORDER_CN", "SALES_CD", "MLSFC_CD", "SCLAS_CD", "SLE_CO", "PAYMENT_PRICE", "TITLE")  # POS
_LAYOUTS = {"normalized": ("DATE", "ITEM_ID", "DEMAND_QTY"), "pos": ("SALES_DE", "LCLAS_CD", "ORDER_CN")}
_COMMA = r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"   # outside quotes


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, _COMMA), lambda x: F.replace(F.regexp_replace(F.trim(x), '^"|"$', ""), F.lit('""'), F.lit('"')))


def all_sources(spark: SparkSession, pattern: str, *, category: str = fixed.DEFAULT_POS_CATEGORY) -> DataFrame:
    """S2-S6 for all files of a glob in one plan: (source, date, item_id, demand_qty, sales_amount).

    Files are read as lines, tagged by their source; a source's header is the line that
    names the columns of a layout, so headers may differ between sources.  Sources
    without such a line give no rows.  Quoted fields may hold commas, but no line ends.
    """
    lines = spark.read.text(pattern).select(_source_of(F.col("_metadata.file_path")).alias("source"),
                                            F.ltrim(F.col("value"), F.lit("\ufeff")).alias("line"))
    names = F.transform(_cells(F.col("line")), lambda x: F.upper(F.trim(x)))
    fits = {k: F.forall(F.array(*[F.lit(n) for n in need]), lambda n: F.array_contains(F.col("names"), n)) for k, need in _LAYOUTS.items()}
    heads = (lines.withColumn("names", names).withColumn("layout", F.when(fits["normalized"], "normalized").when(fits["pos"], "pos"))
                  .where(F.col("layout").isNotNull()).groupBy("source").agg(F.min(F.struct("layout", "names", F.col("line").alias("head"))).alias("h")))
    rows = lines.join(heads, "source").where(F.col("line") != F.col("h.head"))
    cells = rows.select("source", "h.layout", "h.names", _cells(F.col("line")).alias("c"))
    at = lambda n: F.when(F.array_contains("names", n), F.get("c", F.array_position("names", F.lit(n)).cast("int") - 1)).alias(n)
    has = lambda *n: F.forall(F.array(*[F.lit(x) for x in n]), lambda x: F.array_contains("names", x))
    part = lambda n: F.coalesce(F.trim(F.col(n)), F.lit("nan"))
    cells = cells.select("source", "layout", "names", *[at(n) for n in _FIELDS])
    # S6 by the columns that a source has
    cells = cells.withColumn("TITLE", F.when(has("TITLE"), F.col("TITLE")).when(has("MLSFC_CD", "SCLAS_CD"), F.concat(part("MLSFC_CD"), F.lit("-"), part("SCLAS_CD")))
                             .otherwise(F.col("SALES_CD"))).drop("names")
    flat = load_normalized(cells.where("layout = 'normalized'").select("DATE", "ITEM_ID", "DEMAND_QTY", "SALES_AMOUNT", "source"), keep=("source",))
    sold = load_pos(cells.where("layout = 'pos'").select("source", *_FIELDS[4:]), category=category, source_col="source", by_source=True)
    return flat.select("source", "date", "item_id", "demand_qty", "sales_amount").unionByName(sold)


def source_verdicts(spark: SparkSession, pattern: str, rows: DataFrame, *, min_days: int = 21) -> DataFrame:
    """Q1 of every candidate in one grouped aggregate: source, place in the order of trial, rows, items, min_item_days, ok and reason."""
    per_item = rows.groupBy("source", "item_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("d"))
    per_source = per_item.groupBy("source").agg(F.sum("n").alias("rows"), F.count("item_id").alias("items"), F.min("d").alias("min_item_days"))
    reason = (F.when(F.coalesce("rows", F.lit(0)) == 0, "no valid rows")
               .when(F.col("min_item_days") < min_days, F.concat(F.lit("insufficient history per item: min_item_days="), F.col("min_item_days").cast("string"))))
    files = _sources(spark, pattern).select(F.col("path").alias("source"), _preference().alias("place"))
    return (files.join(per_source, "source", "left").withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())
                 .select("source", "place", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.coalesce("items", F.lit(0)).cast("long").alias("items"),
                         "min_item_days", "ok", "reason"))


def gated_source(spark: SparkSession, pattern: str, *, min_days: int = 21,
                 category: str = fixed.DEFAULT_POS_CATEGORY) -> tuple[DataFrame, DataFrame]:
    """(daily rows of the best-ranked source that passes the data checks, verdicts of all sources).

    All candidates are loaded by one plan and chosen inside it: neither files nor
    verdicts come to the driver.  Files without a byte are not listed, so they are no
    candidates.
    """
    path = scratch_path(spark, "sources")
    rows = all_sources(spark, pattern, category=category)
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    verdicts = source_verdicts(spark, pattern, rows, min_days=min_days)
    best = verdicts.where("ok").agg(F.min_by("source", "place")).scalar()
    return rows.where(F.col("source") == best).drop("source"), verdicts


def first_valid_source(spark: SparkSession, pattern: str, *, min_rows: int = 1, **load_kw):
    """Try candidate files in rank order; the first whose demand frame passes the checks wins.

    The loop runs over the (bounded) list of candidate files, never over
    data rows.  Returns (daily frame or None, chosen path or None,
    [(path, reason), ...] for skipped sources).
    """
    ranked = candidate_files(spark, pattern).orderBy("rank").select("path").collect()   # file list only
    skipped = []
    for row in ranked:
        path = row["path"]
        try:
            df = load_daily_demand(read_csv(spark, path), **load_kw)
            n = df.limit(min_rows).count()
            if n < min_rows:
                skipped.append((path, "no valid rows"))
                continue
            return df, path, skipped
        except (AnalysisException, ValueError) as e:  # unsupported layout, unreadable file
            skipped.append((path, str(e).splitlines()[0][:200]))
    return None, None, skipped
