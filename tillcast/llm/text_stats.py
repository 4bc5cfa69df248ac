"""Text statistics as Spark expressions: no Python runs on the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import SPACE, WORD, whole_text

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda, an inlined expression would run per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in a window of ``window`` words found twice or more in the same text.

    Windows are compared by a 64-bit hash of their words.  Texts without a
    repeated window, nearly all, need one pass; for the others the windows are
    sorted by hash, and the union of the repeated ones is measured.
    """
    def covered(grams: Column) -> Column:
        keyed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(k: Column) -> Column:
            hit = F.transform(k, lambda x, j: F.when(
                (x["h"] == F.get(k, j - 1)["h"]) | (x["h"] == F.get(k, j + 1)["h"]), x["i"]))
            return F.sort_array(F.filter(hit, lambda x: x.isNotNull()))

        def union(s: Column) -> Column:
            step = F.transform(s, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(s, j + 1) - x, F.lit(window))))
            return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

        return bound(keyed, lambda k: bound(starts(k), union))

    def of_words(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
        found = bound(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0).cast("long")))
        return F.when(F.size(w) > window, found).otherwise(F.lit(0).cast("long"))

    return bound(words, of_words)


def base_stats(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_bang."""
    t = F.col("_text")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    src = docs.select(*keep, whole_text(docs["text"]).alias("_text"))
    names = [c for c in src.columns if c != "_text"]
    return src.select(
        *names,
        F.regexp_count(t, F.lit(WORD)).cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.regexp_extract_all(t, F.lit(WORD), F.lit(0))).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit("!")).cast("long").alias("n_bang"),
    )


def share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def shares() -> dict[str, Column]:
    """Statistics per word, letter or line, which learned rules and classifiers read."""
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "bang_share": share("n_bang", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "mean_word": share("word_chars", "n_words"),
        "n_words": F.col("n_words").cast("double"),
    }


def label_by_document(labels: DataFrame, column: str) -> DataFrame:
    """One label per doc_id: the least of repeated ones; null ids and labels are left out."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
            .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(column).cast("int")).alias("label")))
