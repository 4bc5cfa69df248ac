"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in keyed hash order, form one line of words that is
cut into blocks of ``block_words``.  Slot i of the schedule maps the golden-ratio
point frac(i * phi) through the cumulative targets to a source; the k-th slot of
a source takes its k-th block, starting over after the last block.  Slots beyond
a source's target are void, and a source that the points left short gets its
missing slots at the end, so each source's taken words are its rounded target.

All running sums have two levels (hash bucket, then bucket totals), so a source
with a third of all rows is spread over ``4096`` window groups.

Results for odd input: null text has no words; a null source is a source of its
own, sorted last; documents without words are taken 0 times; rows that repeat an
id each have their own place in the line; an empty table gives an empty result;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.llm.common import SPACE, WORD, packed, stored, table
from tillcast.llm.registry import query

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK_WORDS = 4096
SEED = "mix-1"
PHI = 0.6180339887498949
CELLS = 4096          # cells of [0, 1) through which points meet their source
SLOT_GROUP = 1 << 16  # slots that are ranked together


def document_sizes(docs: DataFrame, seed: str = SEED, more=()) -> DataFrame:
    """doc_id, source, size in words, the key that shuffles documents within a source, and the columns ``more``."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                        key.alias("key"), *more)
            .withColumn("bucket", F.substring("key", 1, 3)))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per source: rk, source, source_size, target.

    The shares of all words go by weight; a target above ``max_passes`` times its
    source is cut there and the rest is shared out again.  The fixed point is
    min(cap, level * weight): sources are ordered by cap / weight, and the level
    is the first one that its own source does not cap.  The windows run over one
    row per source.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "rk")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rk") % len(weights) + 1).cast("int"))
    s = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
         .withColumn("rk", F.row_number().over(by_name) - 1)
         .withColumn("weight", weight)
         .withColumn("cap", (F.col("source_size") * max_passes).cast("double"))
         .withColumn("ratio", F.col("cap") / F.col("weight"))
         .withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
         .withColumn("below", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("level", (F.col("total") - F.col("below")) / F.col("rest"))
         .withColumn("first_free", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rk", "level"))).over(everything)))
    target = F.coalesce(F.least("cap", F.col("first_free.level") * F.col("weight")), F.col("cap"))
    return s.select(F.col("rk").cast("int").alias("rk"), "source", "source_size", target.alias("target"))


def _with_passes(targets: DataFrame, block_words: int) -> DataFrame:
    """Adds words to take, blocks of the source and slots it needs."""
    t = F.round("target").cast("long")
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    size = F.greatest("source_size", F.lit(1))
    return (targets.withColumn("take", t).withColumn("blocks", blocks)
            .withColumn("full", F.floor(F.col("take") / size).cast("long"))
            .withColumn("rem", F.col("take") - F.col("full") * F.col("source_size"))
            .withColumn("need", F.col("full") * F.col("blocks") + F.ceil(F.col("rem") / block_words).cast("long")))


def slot_schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The schedule: slot, rk, epoch, block, words (the part of the block that is taken)."""
    spark = targets.sparkSession
    t = stored(_with_passes(targets, block_words).where("need > 0"), "mix-targets")
    n_slots = t.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    w = Window.orderBy("rk")
    share = (t.withColumn("total", F.sum("take").over(Window.partitionBy()))
             .withColumn("hi", F.sum("take").over(w) / F.col("total"))
             .withColumn("lo", (F.sum("take").over(w) - F.col("take")) / F.col("total"))
             .select("rk", "lo", "hi"))
    cells = share.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.col("hi") * CELLS))))
    x = F.col("slot") * F.lit(PHI)
    slots = (spark.range(n_slots).select(F.col("id").alias("slot")).withColumn("u", x - F.floor(x))
             .withColumn("cell", F.floor(F.col("u") * CELLS)))
    drawn = (slots.join(cells, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
             .select("slot", "rk", F.floor(F.col("slot") / SLOT_GROUP).alias("group")))
    drawn = stored(drawn, "mix-slots")
    counts = drawn.groupBy("rk", "group").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("rk").orderBy("group")) - F.col("n"))
    in_group = F.row_number().over(Window.partitionBy("rk", "group").orderBy("slot")) - 1
    ranked = (drawn.withColumn("in_group", in_group).join(before.drop("n"), ["rk", "group"])
              .select("slot", "rk", (F.col("before") + F.col("in_group")).alias("rank")))
    got = counts.groupBy("rk").agg(F.sum("n").alias("got"))
    short = (t.join(got, "rk", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
             .select("rk", F.explode(F.sequence("got", F.col("need") - 1)).alias("rank"))
             .select((F.lit(n_slots) + F.col("rank")).alias("slot"), "rk", "rank"))
    pos = F.col("epoch") * F.col("source_size") + F.col("block") * block_words
    words = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words, F.col("take") - pos)
    return (ranked.unionByName(short).join(t.select("rk", "blocks", "need", "source_size", "take"), "rk")
            .where("rank < need")
            .withColumn("epoch", F.floor(F.col("rank") / F.col("blocks")).cast("long"))
            .withColumn("block", F.col("rank") % F.col("blocks"))
            .select("slot", "rk", "epoch", "block", words.cast("long").alias("words")))


def document_lines(sizes: DataFrame, targets: DataFrame, ties=()) -> DataFrame:
    """Each document's first word position in its source's line; (rk, bucket, nth) names the row.

    Rows of one id and size stand in the order of the columns ``ties``.
    """
    rows = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    w = Window.partitionBy("rk", "bucket").orderBy("key", "doc_id", "size", *ties)
    totals = rows.groupBy("rk", "bucket").agg(F.sum("size").alias("words"))
    before = (totals.withColumn("before", F.sum("words").over(Window.partitionBy("rk").orderBy("bucket")) - F.col("words"))
              .drop("words"))
    return (rows.withColumn("nth", F.row_number().over(w))
            .withColumn("inside", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
            .join(before, ["rk", "bucket"])
            .withColumn("start", F.col("before") + F.col("inside"))
            .drop("key", "before", "inside"))


def mixture(lines: DataFrame, schedule: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of the mix: slot, epoch, and the words [from_word, to_word) of a document that the slot takes."""
    end = F.col("start") + F.col("size")
    pieces = (lines.where("size > 0")
              .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words),
                                                        F.floor((end - 1) / block_words)))))
    base = F.col("block") * block_words
    return (pieces.join(schedule, ["rk", "block"])
            .withColumn("from_word", F.greatest(F.lit(0), base - F.col("start")))
            .withColumn("to_word", F.least(F.col("size"), base + F.col("words") - F.col("start")))
            .where("from_word < to_word")
            .drop("words"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES,
                block_words: int = BLOCK_WORDS, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source), taken (words), start (in the line)."""
    sizes = stored(document_sizes(docs, seed), "mix-sizes")
    targets = stored(source_targets(sizes, weights, max_passes), "mix-sources")
    lines = stored(document_lines(sizes, targets), "mix-lines")
    taken = (mixture(lines, slot_schedule(targets, block_words), block_words)
             .groupBy("rk", "bucket", "nth").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken")))
    return (lines.join(taken, ["rk", "bucket", "nth"], "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                    "source", "start"))


def _cut_text(takes: str) -> Column:
    """The takes of a row, each with its part of ``text``.

    A part runs from its first word to the first word after it, and a row's own
    ends belong to its first and last words: the parts of a pass add up to the
    text.  The text is split once for all its takes, and only if one cuts it.
    """
    whole = lambda t: (t["from_word"] == 0) & (t["to_word"] == t["size"])
    split = F.regexp_extract_all("text", F.lit(f"(?:^{SPACE}+)?{WORD}{SPACE}*"), F.lit(0))
    words = F.when(F.exists(takes, lambda t: ~whole(t)), split)
    part = lambda w, t: F.array_join(F.slice(w, t["from_word"].cast("int") + 1, (t["to_word"] - t["from_word"]).cast("int")), "")
    cut = lambda w: F.transform(takes, lambda t: F.struct(
        t["slot"].alias("_slot"), t["rk"].alias("_rk"), t["start"].alias("_start"), whole(t).alias("_whole"),
        F.when(whole(t), F.col("text")).otherwise(part(w, t)).alias("_text")))
    return F.element_at(F.transform(F.array(words), cut), 1)


def mix_documents(docs: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES,
                  block_words: int = BLOCK_WORDS, seed: str = SEED) -> DataFrame:
    """The mix itself, in the order of its slots: a row per document that a slot takes words of.

    A row has the columns of its document; ``text`` is cut to the words that the
    slot takes, and ``n_chars``, where there is one, is that of the cut text.  So
    the words of each source are its rounded target.  Rows that repeat an id are
    told apart by a number that is written with them.  Documents without words are
    not taken; an empty table gives no rows; columns may have any names.
    """
    rows = stored(docs.select(packed(docs).alias("doc"), F.monotonically_increasing_id().alias("row")), "mix-rows", compression="zstd")
    flat = rows.select("doc.doc_id", "doc.text", "doc.source", "row", F.xxhash64("doc").alias("tie"))
    sizes = stored(document_sizes(flat, seed, [F.col("tie"), F.col("row")]), "mix-sizes")
    targets = stored(source_targets(sizes, weights, max_passes), "mix-sources")
    lines = stored(document_lines(sizes, targets, ("tie", "row")), "mix-lines")
    takes = (mixture(lines, slot_schedule(targets, block_words), block_words)
             .groupBy("row").agg(F.collect_list(F.struct("slot", "rk", "start", "from_word", "to_word", "size")).alias("takes")))
    # a row per document: never one to broadcast
    out = (rows.join(takes.hint("merge"), "row").withColumn("text", F.col("doc.text"))
               .select("doc", F.explode(_cut_text("takes")).alias("take"))
               .orderBy("take._slot", "take._rk", "take._start"))
    new = {"text": F.col("take._text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("take._whole"), F.col("doc.n_chars")).otherwise(F.char_length("take._text").cast(kind))
    return out.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
b AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk FROM a),
c AS (SELECT *, CAST(CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
             CAST(source_size * 3 AS DOUBLE) AS cap FROM b),
e AS (SELECT *, cap / weight AS ratio, sum(CAST(source_size AS DOUBLE)) OVER () AS total FROM c),
f AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(weight) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM e),
g AS (SELECT level AS free_level FROM f WHERE level <= ratio ORDER BY ratio, rk LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, free_level * weight), cap) AS target FROM f LEFT JOIN g ON true),
u AS (SELECT *, CAST(round(target) AS BIGINT) // greatest(source_size, 1) AS passes,
             CAST(round(target) AS BIGINT) % greatest(source_size, 1) AS rem FROM t),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT p.doc_id, p.size, u.source_size, u.target,
       CAST(u.passes * p.size + greatest(0, least(p.start + p.size, u.rem) - p.start) AS BIGINT) AS taken
FROM p JOIN u ON p.source IS NOT DISTINCT FROM u.source
"""


@query("op3_source_mix", SQL)
def op3_source_mix(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).drop("source", "start")
