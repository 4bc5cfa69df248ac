"""Centroid clustering by equal-average equal-variance search.

Vectors are integer vectors, and the centroids lie sorted by the sum of their
components (their mean times the length).  A vector starts at the centroid whose
mean is nearest to its own and scans outward on both sides.  With n components,
sums S and deviations V = sqrt(n * sum of squares - S * S),

    n * distance >= (S_x - S_c)^2 + (V_x - V_c)^2

The first term alone ends the scan, as it only grows outward.  Both terms reject
a single centroid; the deviations are floats, so a centroid is rejected only
beyond a margin that covers their rounding.  What is left is compared by its
whole integer distance, so the result is that of a full search, ties included.

Each round is one pass of Arrow tasks over the vectors.  A task adds up its own
vectors by cluster, so that k rows a task go to the shuffle, however many vectors
a cluster has; the k new centroids are the only thing that the driver reads.

Results for odd input: a vector that is null, has another length, or has a null,
NaN, infinite or out-of-range component (integer part of 64 x beyond 2^62) is not
kept; a null ``vec_id`` comes after all others as a starting centroid and gives its
row; repeated rows each give theirs, and rows that tie as starting centroids are
taken in the order of their components; fewer kept vectors than centroids start
fewer of them; an empty table gives an empty result; a distance or inertia beyond
64 bits is null; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import stored, table
from tillcast.llm.registry import query

DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
WIDEST = 1 << 62       # integer components from here on count as not finite
NARROW = 1 << 24       # up to here all products of 64 components fit 64 bits
SLICE_ROWS = 4096      # vectors searched at a time
DIGITS = "decimal(38,0)"


def integer_vectors(rows: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and ``v``, the integer vector, of the rows that are kept."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double") * F.lit(float(scale)))
    sound = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (c < F.lit(float(WIDEST))) & (c >= F.lit(-float(WIDEST))), F.lit(False)))
    return (rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
                .where((F.size("x") == dimensions) & sound)
                .select("vec_id", F.transform("x", lambda c: F.floor(c).cast("long")).alias("v")))


def start_order(vec_id: Column) -> Column:
    """Hex digest by which starting centroids are drawn; null after all."""
    return F.coalesce(F.sha2(F.concat(F.lit("1:"), vec_id.cast("string")).cast("binary"), 256), F.lit("~"))


class MeanOrdered:
    """Centroids in the order of their sums, ready to be searched."""

    def __init__(self, centroids: list[list[int]]):
        big = max((abs(x) for c in centroids for x in c), default=0) > NARROW
        self.numbers = sorted(range(len(centroids)), key=lambda i: (sum(centroids[i]), i))
        rows = [centroids[i] for i in self.numbers]
        self.exact = np.array(rows, object)
        self.narrow = None if big else np.array(rows, np.int64)
        self.order = np.array(self.numbers, np.int64)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and its squared distance, for each row of ``x``."""
        c = self.narrow if x.dtype != object else None
        if c is None:
            x, c = x.astype(object), self.exact
        n, k, width = len(x), len(c), x.shape[1]
        s_x, s_c = x.sum(axis=1), c.sum(axis=1)
        v_x = np.sqrt(np.maximum(width * (x * x).sum(axis=1) - s_x * s_x, 0).astype(float))
        v_c = np.sqrt(np.maximum(width * (c * c).sum(axis=1) - s_c * s_c, 0).astype(float))
        high = np.searchsorted(s_c, s_x)  # next centroid to look at above, and below
        low = high - 1
        best = np.full(n, -1, x.dtype)
        found = np.full(n, -1, np.int64)
        active = np.arange(n)
        while len(active):
            lo, hi = low[active], high[active]
            gap_lo = np.where(lo >= 0, s_x[active] - s_c[np.maximum(lo, 0)], -1)
            gap_hi = np.where(hi < k, s_c[np.minimum(hi, k - 1)] - s_x[active], -1)
            up = (hi < k) & ((lo < 0) | (gap_hi < gap_lo))
            at = np.where(up, hi, lo)
            gap = np.where(up, gap_hi, gap_lo)
            bound = width * best[active]
            # the mean inequality: nothing further out can be nearer, or as near
            on = ((lo >= 0) | (hi < k)) & ((best[active] < 0) | (gap * gap <= bound)).astype(bool)
            active, at, gap, bound, up = active[on], at[on], gap[on], bound[on], up[on]
            low[active[~up]] -= 1
            high[active[up]] += 1
            # the deviation inequality rejects single centroids
            spread = np.abs(v_x[active] - v_c[at])
            margin = 1e-6 * (v_x[active] + v_c[at]) + 1e-3
            least = (gap * gap).astype(float) + np.square(np.maximum(spread - margin, 0.0))
            look = (best[active] < 0).astype(bool) | (least <= bound.astype(float) * (1 + 1e-9) + 1)
            rows, cand = active[look], at[look]
            d = np.square(x[rows] - c[cand]).sum(axis=1)
            nearer = ((best[rows] < 0) | (d < best[rows]) | ((d == best[rows]) & (self.order[cand] < found[rows]))).astype(bool)
            best[rows[nearer]] = d[nearer]
            found[rows[nearer]] = self.order[cand[nearer]]
        return found, best


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for i in range(0, b.num_rows, SLICE_ROWS):
            s = b.slice(i, SLICE_ROWS)
            x = s.column("v").flatten().to_numpy(zero_copy_only=False).reshape(s.num_rows, width)
            wide = len(x) and (int(x.max()) > NARROW or int(x.min()) < -NARROW)
            yield s, x.astype(object) if wide else x


def assigner(centroids: list[list[int]], width: int):
    """Rows (vec_id, cluster, distance) of each vector; a distance beyond 64 bits is null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = MeanOrdered(centroids)
        for s, x in _slices(batches, width):
            cluster, distance = found.search(x)
            yield pa.RecordBatch.from_arrays([
                s.column("vec_id"), pa.array(cluster, pa.int32()),
                pa.array([d if d < 1 << 63 else None for d in distance.tolist()], pa.int64()),
            ], names=["vec_id", "cluster", "distance"])
    return run


def summer(centroids: list[list[int]], width: int):
    """One row (cluster, n, sums in decimal) for each cluster that a task's vectors went to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = MeanOrdered(centroids)
        n = [0] * len(centroids)
        total = [np.array([0] * width, object) for _ in centroids]
        for _, x in _slices(batches, width):
            cluster, _ = found.search(x)
            for c in np.unique(cluster):
                part = x[cluster == c]
                n[c] += len(part)
                total[c] = total[c] + part.sum(axis=0).astype(object)
        seen = [c for c in range(len(centroids)) if n[c]]
        yield pa.RecordBatch.from_arrays([
            pa.array(seen, pa.int32()), pa.array([n[c] for c in seen], pa.int64()),
            pa.array([[str(t) for t in total[c]] for c in seen], pa.list_(pa.string())),
        ], names=["cluster", "n", "total"])
    return run


def recentred(vectors: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """Centroids after one round: componentwise floor of the mean; an empty cluster's stays."""
    parts = vectors.mapInArrow(summer(centroids, width), "cluster int, n long, total array<string>")
    sums = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("total")[i].cast(DIGITS)).alias(f"t{i}") for i in range(width)])
    out = list(centroids)
    for r in sums.collect():  # a row for each centroid at most
        out[r["cluster"]] = [int(r[f"t{i}"]) // r["n"] for i in range(width)]
    return out


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def mean_ordered_kmeans(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS,
                        dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids."""
    vectors = integer_vectors(rows, dimensions, scale)
    first = (vectors.select(start_order(F.col("vec_id")).alias("h"), "v").orderBy("h", "v").limit(clusters).collect())
    centroids = [list(r["v"]) for r in first]
    if not centroids:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where(F.lit(False)), []
    for _ in range(rounds):
        centroids = recentred(vectors, centroids, dimensions)
    # a vector's cluster is needed twice, for its row and for the sums over clusters
    out = stored(vectors.mapInArrow(assigner(centroids, dimensions), "vec_id long, cluster int, distance long"), "kmeans")
    return out, centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256; the frame joined has a row for each centroid."""
    whole = lambda c: F.col(c).cast("string").try_cast("long")
    known = F.count_if(F.col("distance").isNull()) == 0
    sums = (assigned.groupBy("cluster").agg(F.when(known, F.sum(F.col("distance").cast(DIGITS))).alias("s"),
                                            F.count_if(F.col("distance").isNull()).alias("lost")))
    total = sums.agg(F.when(F.sum("lost") == 0, F.sum("s")).alias("t")).select(whole("t").alias("t")).scalar()
    names = assigned.sparkSession.createDataFrame([(i, digest(c)) for i, c in enumerate(centroids)],
                                                  "cluster int, centroid_sha256 string")
    each = sums.join(F.broadcast(names), "cluster").select("cluster", whole("s").alias("cluster_inertia"), "centroid_sha256")
    return (assigned.join(F.broadcast(each), "cluster")
                    .select("vec_id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256"))


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The contract in SQL, with every distance computed."""
    parts = [f"""WITH e AS (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS c
    FROM embeddings WHERE len(embedding) = 64),
  x AS (SELECT vec_id FROM e GROUP BY vec_id HAVING count(*) FILTER (WHERE isfinite(c)) = 64),
  v AS (SELECT vec_id, i, CAST(floor(64 * c) AS BIGINT) AS c FROM e JOIN x USING (vec_id)),
  s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS cluster FROM x
        QUALIFY cluster < {clusters}),
  c0 AS (SELECT s.cluster, v.i, v.c FROM s JOIN v USING (vec_id))"""]
    for r in range(rounds + 1):
        parts.append(f"""  d{r} AS (SELECT v.vec_id, k.cluster, CAST(sum((v.c - k.c) * (v.c - k.c)) AS BIGINT) AS distance
    FROM v JOIN c{r} k ON v.i = k.i GROUP BY v.vec_id, k.cluster),
  a{r} AS (SELECT vec_id, cluster, distance FROM d{r}
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if r < rounds:
            parts.append(f"""  m{r} AS (SELECT a.cluster, v.i, sum(v.c) AS t, count(*) AS n FROM a{r} a JOIN v USING (vec_id) GROUP BY a.cluster, v.i),
  c{r + 1} AS (SELECT k.cluster, k.i, CASE WHEN m.n IS NULL THEN k.c
      ELSE CAST((m.t - ((m.t % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS c
    FROM c{r} k LEFT JOIN m{r} m ON m.cluster = k.cluster AND m.i = k.i)""")
    return ",\n".join(parts) + f""",
  h AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance,
       CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM a{rounds} a JOIN h USING (cluster)"""


@query("op13_centroid_clusters", _sql())
def op13_centroid_clusters(spark, sf_dir):
    """Every kept vector of ``embeddings`` with its cluster, distance, the inertias and its centroid's digest."""
    assigned, centroids = mean_ordered_kmeans(table(spark, sf_dir, "embeddings"))
    return with_inertia(assigned, centroids)
