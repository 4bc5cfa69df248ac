"""Quality rules: a learned decision list over text statistics.

Spark counts the labelled documents in one pass, by the bin that each statistic
falls in: at most (bins per statistic)^(statistics) cells, whatever the input.
Sequential covering runs over those cells: a conjunction of thresholds grows on
one part of the labels by FOIL gain, is pruned on the other part, and is taken
if it is precise enough there; what it covers is set aside and the next one
grows.  The list becomes one ordered CASE expression.

Results for odd input: null text has no words and fails the base rules; null
ids and labels teach nothing; repeated labels of a document count as the least;
without labels of both kinds the list is empty and keeps what the base rules
keep; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import stored, table
from tillcast.llm.registry import query
from tillcast.llm.text_stats import base_stats, label_by_document, shares

# thresholds that a condition may use, by statistic
EDGES = {
    "symbol_share": [0.01, 0.03, 0.06, 0.12],
    "upper_share": [0.05, 0.12, 0.25, 0.5],
    "bang_share": [0.02, 0.08, 0.2],
    "dup_line_share": [0.05, 0.15, 0.3, 0.5],
    "repeat_share": [0.02, 0.05, 0.1, 0.2],
    "mean_word": [2.5, 4.0, 6.0, 9.0, 12.0],
    "n_words": [10.0, 30.0, 100.0],
}
MIN_PRECISION = 0.97
MIN_COVER = 3
MAX_RULES = 12
MAX_CONDITIONS = 4
MIN_WORDS = 10


@dataclass(frozen=True)
class Condition:
    name: str
    edge: int      # index into the statistic's edges
    above: bool    # value >= edge, else value < edge

    def holds(self, bins: dict[str, np.ndarray]) -> np.ndarray:
        return (bins[self.name] > self.edge) == self.above

    def column(self, edges: dict[str, list[float]]) -> Column:
        v = shares()[self.name]
        at = F.lit(float(edges[self.name][self.edge]))
        return v >= at if self.above else v < at


def labelled_cells(stats: DataFrame, labels: DataFrame, edges: dict[str, list[float]]) -> list:
    """Counts of labelled documents by bins, part (grow or prune) and label."""
    values = shares()
    bins = [sum(((values[n] >= F.lit(float(e))).cast("int") for e in es), F.lit(0)).alias(n) for n, es in edges.items()]
    part = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune")
    return (stats.join(labels, "doc_id").select(*bins, part, (F.col("label") == 0).alias("bad"))
            .groupBy(*edges, "prune", "bad").count().collect())


def learn(cells: list, edges: dict[str, list[float]], min_precision: float = MIN_PRECISION,
          max_rules: int = MAX_RULES) -> list[tuple[Condition, ...]]:
    """Ordered conjunctions that mark bad documents."""
    if not cells:
        return []
    bins = {n: np.array([c[n] for c in cells]) for n in edges}
    w = np.array([c["count"] for c in cells], float)
    prune, bad = np.array([c["prune"] for c in cells]), np.array([c["bad"] for c in cells])
    conditions = [Condition(n, i, above) for n, es in edges.items() for i in range(len(es)) for above in (True, False)]
    holds = {c: c.holds(bins) for c in conditions}
    left = np.ones(len(cells), bool)

    def counts(mask, part):
        m = mask & left & (prune == part)
        return w[m & bad].sum(), w[m & ~bad].sum()

    def mask_of(rule):
        m = np.ones(len(cells), bool)
        for c in rule:
            m &= holds[c]
        return m

    rules: list[tuple[Condition, ...]] = []
    while len(rules) < max_rules:
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS:
            p0, n0 = counts(mask_of(rule), False)
            if not p0 or not n0:
                break
            best, gain = None, 1e-9
            for c in conditions:
                p, n = counts(mask_of(rule) & holds[c], False)
                g = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                if g > gain:
                    best, gain = c, g
            if best is None:
                break
            rule.append(best)

        def worth(r):
            p, n = counts(mask_of(r), True)
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1:
            shorter = max(([c for c in rule if c is not d] for d in rule), key=worth)
            if worth(shorter) < worth(rule):
                break
            rule = shorter
        p, n = counts(mask_of(rule), True)
        pg, ng = counts(mask_of(rule), False)
        if not rule or p + pg < MIN_COVER or p < min_precision * (p + n) or pg < min_precision * (pg + ng):
            break
        rules.append(tuple(rule))
        left &= ~mask_of(rule)
    return rules


def verdict(rules: list[tuple[Condition, ...]], edges: dict[str, list[float]]) -> Column:
    """Number of the first rule that marks the document as bad, 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        hit = F.lit(True)
        for c in rule:
            hit = hit & c.column(edges)
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return F.lit(0) if out is None else out.otherwise(0)


def describe(rules: list[tuple[Condition, ...]], edges: dict[str, list[float]]) -> list[str]:
    return [" and ".join(f"{c.name} {'>=' if c.above else '<'} {edges[c.name][c.edge]:g}" for c in r) for r in rules]


def quality_rules(docs: DataFrame, labels: DataFrame, edges: dict[str, list[float]] | None = None) -> DataFrame:
    """Base statistics, base_failed, the learned list's rule number and kept, for every document."""
    edges = edges or EDGES
    stats = stored(base_stats(docs, [F.col("doc_id").cast("long").alias("doc_id")]), "rule-stats")
    rules = learn(labelled_cells(stats, label_by_document(labels, "quality"), edges), edges)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules, edges))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule"))


@query("op10_quality_rules")
def op10_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
