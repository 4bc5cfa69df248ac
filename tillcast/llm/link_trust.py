"""URL filters: rules, and trust over the host graph for what no rule judges.

Host edges come from the pages' links and from the domain tree (a host and its
parent domain name each other, up to names of ``DOMAIN_LABELS`` labels: names above
a registered domain join hosts of strangers).  Personalised PageRank spreads trust
from hosts with allowed pages along the edges, and distrust from hosts with blocked
pages against them.  A host whose distrust outweighs its trust by the ratio, and is
more than an even share of the walk, is blocked.

Edges are one row per host pair, counted on the map side.  Ranks are the sum of the
walk's steps, (1 - damping) * damping^j of the weight after j of them; a step is one
join and one grouped sum, written out.  Steps are added until what is still on its
way is below the tolerance, which bounds the error of all ranks together.

Results for odd input: a null url or one without '://' has an empty host and
path, no rule and the verdict allow; null html has no links; repeated rows each
give their row and count once each as evidence; a host without edges passes
nothing on; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import stored, table
from tillcast.llm.registry import query

# (rule, verdict): a host with all its subdomains, and the start of the path
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING = 0.85
TOLERANCE = 1e-4  # weight that may be missing from all ranks of a kind together
STORE_EVERY = 4
DOMAIN_LABELS = 2 # labels of the shortest name in the domain tree
RATIO = 2.0       # distrust over trust from which a host is blocked
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?([^"'\s>]+)"""
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWERED)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(rules) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return rule, verdict


def judged_pages(pages: DataFrame, rules) -> DataFrame:
    rule, verdict = matching_rule(rules)
    return (pages.select(F.col("page_id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
            .withColumn("rule", rule).withColumn("ruled", verdict))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, and host to parent domain and back."""
    links = pages.select(url_host(F.col("url")).alias("src"),
                         F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)).alias("_l"))
    full = F.transform("_l", lambda x: F.when(x.startswith("//"), F.concat(F.lit("x:"), x)).otherwise(x))
    hosts = F.array_distinct(F.filter(F.transform(full, url_host), lambda h: h != ""))
    across = (links.select("src", F.explode(hosts).alias("dst")).where("src != '' and src != dst")
              .groupBy("src", "dst").agg(F.count("*").alias("n")))
    names = pages.select(url_host(F.col("url")).alias("h")).where("h != ''").distinct()
    labels = F.split("h", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(labels) - DOMAIN_LABELS), lambda i: F.struct(
        F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("src"),
        F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("dst")))
    up = names.where(F.size(labels) > DOMAIN_LABELS).select(F.explode(chain).alias("e")).select("e.src", "e.dst").distinct()
    tree = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("n", F.lit(1).cast("long"))
    return across.unionByName(tree).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, r): walks from the seeds of each kind; edges (kind, src, dst, share) have shares that sum to 1 by src.

    A walk ends at a host without edges, so a kind's ranks sum to 1 at most.
    """
    # ``on``: weight on its way after the steps so far; ``r``: the rank so far, which an edge to oneself hands on
    hosts = edges.select("kind", F.explode(F.array("src", "dst")).alias("src")).unionByName(seeds.select("kind", F.col("host").alias("src"))).distinct()
    ways = stored(edges.select("kind", "src", "dst", "share", F.lit(0.0).alias("keep")).unionByName(
        hosts.select("kind", "src", F.col("src").alias("dst"), F.lit(0.0).alias("share"), F.lit(1.0).alias("keep"))), "link-ways")
    state = stored(seeds.select("kind", "host", F.col("r").alias("on"), ((1 - F.lit(damping)) * F.col("r")).alias("r")), "link-ranks")
    left = 1.0
    while left > tolerance:
        for _ in range(STORE_EVERY):
            step = state.withColumnRenamed("host", "src").join(ways, ["kind", "src"])
            state = (step.groupBy("kind", F.col("dst").alias("host"))
                         .agg((F.lit(damping) * F.sum(F.col("on") * F.col("share"))).alias("on"), F.sum(F.col("r") * F.col("keep")).alias("r"))
                         .withColumn("r", F.col("r") + (1 - F.lit(damping)) * F.col("on")))
        state = stored(state, "link-ranks")
        left = state.groupBy("kind").agg(F.sum("on").alias("on")).agg(F.coalesce(F.max("on"), F.lit(0.0))).first()[0]
    return state.select("kind", "host", "r")


def host_trust(pages: DataFrame, judged: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) for every host that a seed reaches."""
    links = host_edges(pages)
    kinds = (links.select(F.lit("trust").alias("kind"), "src", "dst", "n")
             .unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")))
    out = kinds.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    edges = stored(kinds.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")), "link-edges")
    marks = (judged.where("ruled is not null").groupBy(F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"), "host")
             .agg(F.count("*").alias("n")))
    sums = marks.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = stored(marks.join(sums, "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("r")), "link-seeds")
    ranks = spread(edges, seeds, damping, tolerance)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("r")).otherwise(0.0)).alias(kind)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def filter_urls(pages: DataFrame, rules=RULES, ratio: float = RATIO, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust (of the host)."""
    judged = stored(judged_pages(pages, rules), "link-pages")
    scores = stored(host_trust(pages, judged, damping, tolerance), "link-trust")
    even = F.lit(1.0 / max(scores.count(), 1))
    scores = scores.select(F.col("host").alias("_h"), "trust", "distrust",
                           ((F.col("distrust") > ratio * F.col("trust")) & (F.col("distrust") > even)).alias("_bad"))
    return (judged.join(scores, F.col("host") == F.col("_h"), "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("ruled", F.when(F.col("_bad"), "block").otherwise("allow")).alias("verdict"),
                    F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))


@query("op5_link_trust")
def op5_link_trust(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"))
