"""Quality classifier: document evidence under hierarchical site priors.

A logistic model over text statistics, fitted by Spark ML on the labelled
documents, gives each document's evidence.  Its probabilities are summed by path
(here source and language) and by host (here source); sparse hosts shrink toward
the global mean and sparse paths toward their host, with Beta concentrations
estimated by moments (empirical Bayes).  A document's posterior adds its own
evidence to the log-odds of its path's posterior, from which its own share is
taken out first.

Sums by host and path combine on the map side, so a host with a third of all
rows costs one partial row per task.

Results for odd input: null text has no words; a null host or path is one of its
own; null ids and labels teach nothing; repeated labels of a document count as
the least; if the labels are of one kind or none, the model has no evidence and
keeps all; an empty table gives an empty result; of other columns none is read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import packed, stored, table
from tillcast.llm.registry import query
from tillcast.llm.text_stats import base_stats, label_by_document, shares

FEATURES = ["symbol_share", "upper_share", "bang_share", "dup_line_share", "repeat_share", "short", "long_word"]
THRESHOLD = 0.1  # a false reject counts nine times a false keep
PRIOR_BOUNDS = (0.02, 0.98)
MAX_CONCENTRATION = 1e6
MAX_LOGIT = 30.0


def features(docs: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """_id, _host, _path and the model's inputs."""
    stats = base_stats(docs, [docs["doc_id"].cast("long").alias("_id"), docs[host].cast("string").alias("_host"),
                              docs[path].cast("string").alias("_path")])
    s = shares()
    s["short"] = F.exp(-F.col("n_words") / 10.0)
    s["long_word"] = F.greatest(F.lit(0.0), s["mean_word"] - 8.0) / 8.0
    return stats.select("_id", "_host", "_path", *[s[n].cast("double").alias(n) for n in FEATURES])


@dataclass(frozen=True)
class Evidence:
    """Log-odds of a document, and the log-odds of the labelled documents at large."""
    weights: dict[str, float]
    intercept: float
    base: float

    def logit(self) -> Column:
        z = F.lit(float(self.intercept))
        for n, w in self.weights.items():
            z = z + F.lit(float(w)) * F.col(n)
        return F.greatest(F.lit(-MAX_LOGIT), F.least(F.lit(MAX_LOGIT), z))


def fit_evidence(feats: DataFrame, labels: DataFrame) -> Evidence:
    """Logistic regression on all labelled documents; no evidence if the labels are of one kind."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = stored(feats.join(labels, feats["_id"] == labels["doc_id"]).select(*FEATURES, F.col("label").cast("double").alias("label")),
                  "site-train")
    good, n = rows.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    if not n or good in (0, n):
        return Evidence({}, 0.0, 0.0)
    vec = VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(rows)
    m = LogisticRegression(featuresCol="_x", labelCol="label", regParam=1e-4, maxIter=50).fit(vec)
    return Evidence(dict(zip(FEATURES, map(float, m.coefficients))), float(m.intercept), math.log(good / (n - good)))


def concentration(mean: Column, size: Column, center: Column) -> Column:
    """Beta concentration by moments: spread of group means beyond what their sizes explain."""
    within = F.avg(center * (1 - center) / size)
    between = F.greatest(F.avg((mean - center) * (mean - center)) - within, F.lit(1e-6))
    spread = F.greatest(F.avg(center * (1 - center)), F.lit(1e-6))
    return F.least(F.lit(MAX_CONCENTRATION), F.greatest(F.lit(1.0), spread / between - 1))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """_host, _path, sums of the path, the host's shrunk mean and the paths' concentration."""
    paths = stored(scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("_p").alias("s")), "site-paths")
    hosts = stored(paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")), "site-hosts")
    mu = hosts.agg(F.coalesce(F.sum("hs") / F.sum("hn"), F.lit(0.5))).first()[0]
    k_host = hosts.agg(concentration(F.col("hs") / F.col("hn"), F.col("hn"), F.lit(mu))).first()[0] or 1.0
    hosts = hosts.select(F.col("_host").alias("_h"), ((F.lit(k_host * mu) + F.col("hs")) / (F.lit(k_host) + F.col("hn"))).alias("host_mean"))
    joined = paths.join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    k_path = joined.agg(concentration(F.col("s") / F.col("n"), F.col("n"), F.col("host_mean"))).first()[0] or 1.0
    return joined.withColumn("k", F.lit(float(k_path)))


def posterior(feats: DataFrame, evidence: Evidence, sites: DataFrame) -> DataFrame:
    """Adds p_document, p_site (without the document's own share) and p_quality."""
    s = sites.select(F.col("_host").alias("_sh"), F.col("_path").alias("_sp"), "n", "s", "host_mean", "k")
    lo, hi = PRIOR_BOUNDS
    prior = (F.col("k") * F.col("host_mean") + F.col("s") - F.col("p_document")) / (F.col("k") + F.col("n") - 1)
    prior = F.greatest(F.lit(lo), F.least(F.lit(hi), prior))
    logit = F.col("_z") - F.lit(evidence.base) + F.log(F.col("p_site") / (1 - F.col("p_site")))
    return (feats.withColumn("_z", evidence.logit()).withColumn("p_document", 1 / (1 + F.exp(-F.col("_z"))))
            .join(s, F.col("_host").eqNullSafe(F.col("_sh")) & F.col("_path").eqNullSafe(F.col("_sp")))
            .withColumn("p_site", prior)
            .withColumn("p_quality", 1 / (1 + F.exp(-logit))))


def site_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang",
                 threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, p_document, p_site, p_quality, kept."""
    feats = stored(features(docs, host, path), "site-features")
    evidence = fit_evidence(feats, label_by_document(labels, "quality"))
    sites = site_posteriors(feats.withColumn("_p", 1 / (1 + F.exp(-evidence.logit()))))
    return posterior(feats, evidence, sites).select(
        F.col("_id").alias("doc_id"), "p_document", "p_site", "p_quality",
        (F.col("p_quality") >= threshold).alias("kept") if evidence.weights else F.lit(True).alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The documents that the classifier keeps, with all their columns.

    Rows that repeat an id stay if one of them is kept; rows without an id stay.
    Columns may have any names: only ``doc_id``, ``text``, host and path are read.
    """
    verdicts = site_quality(docs, labels, **params)
    gone = (verdicts.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("kept").alias("k"))
            .where(~F.col("k")).select("id"))
    whole = docs.select(packed(docs).alias("row"))
    return whole.join(stored(gone, "site-gone"), F.col("row.doc_id").cast("long") == F.col("id"), "left_anti").select("row.*")


@query("op6_site_quality")
def op6_site_quality(spark, sf_dir):
    return site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
