"""Region gazetteer (S11) and nearest-region lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillcast.session import scratch_path


def regions_from_geojson(spark: SparkSession, path) -> DataFrame:
    """One row per feature: id, name, lat, lon of the first vertex (4 decimals).

    Polygon -> coordinates[0][0]; MultiPolygon -> coordinates[0][0][0].
    Features missing properties or coordinates are skipped.  Coordinates
    are read as JSON text so both geometry shapes share one schema.
    """
    # coordinates declared as a string: the reader keeps the raw JSON text of
    # either nesting depth (Polygon or MultiPolygon); property names vary, so a map
    schema = ("features array<struct<properties: map<string,string>, "
              "geometry: struct<type: string, coordinates: string>>>")
    raw = spark.read.option("multiLine", True).schema(schema).json(path)
    feats = raw.select(F.explode("features").alias("f"))
    props = F.col("f.properties")
    g = feats.select(
        F.coalesce(props["adm_cd"], props["id"]).alias("id"),
        F.coalesce(props["adm_nm"], props["name"]).alias("name"),
        F.col("f.geometry.type").alias("gtype"),
        F.col("f.geometry.coordinates").alias("coords"))
    first = (F.when(F.col("gtype") == "Polygon", F.get_json_object("coords", "$[0][0]"))
             .when(F.col("gtype") == "MultiPolygon", F.get_json_object("coords", "$[0][0][0]")))
    pt = F.from_json(first, "array<double>")
    out = g.select("id", "name", F.round(pt[1], 4).alias("lat"), F.round(pt[0], 4).alias("lon"))
    return out.where(F.col("id").isNotNull() & F.col("name").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def nearest_of(points: list[tuple], x: Column, y: Column) -> Column:
    """J9 for a small fixed reference list: name of the point with the least squared distance.

    ``points`` = [(name, px, py), ...] (a constant, so the lookup is an
    expression: no join).  Ties go to the earlier point.
    """
    arr = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit(float(px)).alias("px"),
                             F.lit(float(py)).alias("py")) for i, (n, px, py) in enumerate(points)])
    scored = F.transform(arr, lambda p: F.struct(
        (F.pow(p["px"] - x, 2) + F.pow(p["py"] - y, 2)).alias("d"), p["i"].alias("i"), p["name"].alias("name")))
    return F.array_min(scored)["name"]


CELL_REGIONS = 16     # regions of a leaf cell at most
SALTS = 16            # parts into which the points of one cell are dealt
MAX_DEPTH = 60


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def region_cells(regions: DataFrame, most: int = CELL_REGIONS) -> tuple[list[DataFrame], DataFrame]:
    """(cells of each level, regions with the leaf cell that they lie in).

    A cell with more than ``most`` regions is split at the middle of its own bounds, so
    a dense city gets small cells and empty land none.  A cell has the bounds of its
    regions and one of them; of regions at one place only the least id counts.
    """
    at = (regions.groupBy("rlat", "rlon").agg(F.min(F.struct("rid", "rname")).alias("r")).select("rlat", "rlon", "r.*").withColumn("cell", F.lit("")))
    levels, leaves = [], None
    for _ in range(MAX_DEPTH):
        at = _stored(at, "region-level")
        cells = _stored(at.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("rlat", "rlon") for k, f in (("min", F.min), ("max", F.max))],
            F.min(F.struct("rid", "rlat", "rlon")).alias("one")).withColumn("leaf", F.col("n") <= most), "region-cells")
        levels.append(cells)
        middle = lambda c: (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2
        placed = at.join(cells.drop("one", "n"), "cell")
        got = placed.where("leaf").select(*at.columns)
        leaves = got if leaves is None else leaves.unionByName(got)
        half = lambda c: F.when(F.col(c) > middle(c), 1).otherwise(0)
        at = placed.where("not leaf").withColumn("cell", F.concat("cell", (2 * half("rlat") + half("rlon")).cast("string"))).select(*at.columns)
        if cells.where("not leaf").isEmpty():
            return levels, leaves
    raise RuntimeError("cells do not part their regions")


def _squared(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a - c) * (a - c) + (b - d) * (b - d)


def nearest_region(points: DataFrame, regions: DataFrame, *, point_id="id", lat="lat", lon="lon", most: int = CELL_REGIONS) -> DataFrame:
    """J9 for a large gazetteer: nearest region by squared degree distance, exact; ties -> lowest region id.

    Points go down the cells of ``region_cells`` level by level.  Of a cell's children a
    point keeps those that may hold something as near as the nearest region that it has
    met, so a far point does not pair with a whole city; leaf cells are compared in full.
    The points of a cell are dealt out to salts, so a cell may hold any share of them.
    Points without coordinates, and all points of an empty gazetteer, give no row.
    """
    deal = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    r = regions.select(F.col("id").alias("rid"), F.col("name").alias("rname"), F.col("lat").cast("double").alias("rlat"),
                       F.col("lon").cast("double").alias("rlon")).where("rlat is not null and rlon is not null")
    levels, leaves = region_cells(r, most)
    p = points.select(F.col(point_id).alias("pid"), F.col(lat).cast("double").alias("plat"), F.col(lon).cast("double").alias("plon"))
    p = p.where("plat is not null and plon is not null").withColumn("row", F.monotonically_increasing_id()).withColumn("salt", F.col("row") % SALTS)
    near = _stored(p.select("*", F.lit("").alias("cell"), F.lit(float("inf")).alias("bound")), "region-points")
    found = None
    for depth, cells in enumerate(levels):
        side = lambda x, c: F.greatest(F.col(f"min_{c}") - x, x - F.col(f"max_{c}"), F.lit(0.0))
        if depth:  # the children of the cells that were kept
            keyed = cells.withColumn("parent", F.expr("left(cell, length(cell) - 1)")).select("*", deal)
            j = near.withColumnRenamed("cell", "parent").join(keyed, ["parent", "salt"])
        else:
            j = near.drop("cell").join(cells.select("*", deal), "salt")
        dy, dx = side(F.col("plat"), "rlat"), side(F.col("plon"), "rlon")
        met = F.min(_squared(F.col("plat"), F.col("plon"), F.col("one.rlat"), F.col("one.rlon"))).over(Window.partitionBy("row"))
        j = j.withColumn("least", dy * dy + dx * dx).withColumn("bound", F.least("bound", met)).where("least <= bound")
        j = _stored(j.select("pid", "row", "salt", "plat", "plon", "cell", "bound", "leaf"), "region-near")
        got = j.where("leaf").drop("leaf")
        found = got if found is None else found.unionByName(got)
        near = j.where("not leaf").drop("leaf")
    d = _squared(F.col("plat"), F.col("plon"), F.col("rlat"), F.col("rlon"))
    pairs = found.join(leaves.select("*", deal), ["cell", "salt"])
    best = pairs.groupBy("row").agg(F.first("pid").alias(point_id), F.min(F.struct(d.alias("d"), "rid", "rname")).alias("b"))
    return best.select(point_id, F.col("b.rid").alias("region_id"), F.col("b.rname").alias("region_name"))


# a JSON object without objects inside, strings read as a whole
_FLAT = r'\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}'
_NUMBER = r"-?[0-9][0-9.eE+-]*"


def regions_from_large_geojson(spark: SparkSession, path) -> DataFrame:
    """S11 for large files, read by many tasks: a FeatureCollection is cut at its ``"Feature"`` marks.

    A task starts at the first mark of its part of the file, and what follows a mark up
    to the next one is one feature.  So ``type`` must be the first or the last member of
    every feature, as writers have it, and properties must be flat; other files are for
    ``regions_from_geojson``.  The rules for rows are the same.
    """
    parts = spark.read.option("lineSep", '"Feature"').text(path).select(F.col("value").alias("f"))
    props = F.from_json(F.regexp_extract("f", r'"properties"\s*:\s*(' + _FLAT + ")", 1), "map<string,string>")
    g = parts.select(props.alias("p"), F.regexp_extract("f", r'"type"\s*:\s*"((?:Multi)?Polygon)"', 1).alias("gtype"),
                     F.regexp_extract("f", r'"coordinates"\s*:\s*([\[\s]+)', 1).alias("open"),
                     *[F.regexp_extract("f", r'"coordinates"\s*:[\[\s]+(' + _NUMBER + r")\s*,\s*(" + _NUMBER + ")", i).alias(c) for i, c in ((1, "x"), (2, "y"))])
    deep = F.length(F.regexp_replace("open", r"\s", ""))
    fits = ((F.col("gtype") == "Polygon") & (deep == 3)) | ((F.col("gtype") == "MultiPolygon") & (deep == 4))
    out = g.where(fits).select(F.coalesce(F.col("p")["adm_cd"], F.col("p")["id"]).alias("id"), F.coalesce(F.col("p")["adm_nm"], F.col("p")["name"]).alias("name"),
                               F.round(F.col("y").try_cast("double"), 4).alias("lat"), F.round(F.col("x").try_cast("double"), 4).alias("lon"))
    return out.where(F.col("id").isNotNull() & F.col("name").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
