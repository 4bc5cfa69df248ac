"""Registered queries: gazetteer files and the nearest region of every customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast import tables
from tillcast.plans.registry import query
from tillcast.session import scratch_path
from tillcast.sources import regions

# suppliers as a gazetteer: most within a city, the others over the peninsula
SQL_GAZETTEER = """gaz AS (SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS id, s_name AS name,
  CASE WHEN s_suppkey % 4 = 0 THEN 33.0::DOUBLE + (s_suppkey % 97) * 0.05::DOUBLE ELSE 37.5::DOUBLE + (s_suppkey % 89) * 0.0002::DOUBLE END AS lat,
  CASE WHEN s_suppkey % 4 = 0 THEN 125.0::DOUBLE + (s_suppkey % 83) * 0.05::DOUBLE ELSE 127.0::DOUBLE + (s_suppkey % 71) * 0.0003::DOUBLE END AS lon FROM supplier)"""


def _gazetteer(spark, d):
    k = F.col("s_suppkey")
    wide = k % 4 == 0
    return tables.read(spark, d, "supplier").select(
        F.concat(F.lit("S"), F.lpad(k.cast("string"), 8, "0")).alias("id"), F.col("s_name").alias("name"),
        F.when(wide, 33.0 + (k % 97) * 0.05).otherwise(37.5 + (k % 89) * 0.0002).alias("lat"),
        F.when(wide, 125.0 + (k % 83) * 0.05).otherwise(127.0 + (k % 71) * 0.0003).alias("lon"))


@query("nearest_region_of_customers", f"""WITH {SQL_GAZETTEER},
p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 37.505::DOUBLE + (c_custkey % 1000) * 0.000001::DOUBLE ELSE 33.0::DOUBLE + (c_custkey % 1000) * 0.0055::DOUBLE END AS lat,
             CASE WHEN c_custkey % 3 = 0 THEN 127.01::DOUBLE + (c_custkey % 1000) * 0.000001::DOUBLE ELSE 125.0::DOUBLE + ((c_custkey * 7919) % 1000) * 0.0045::DOUBLE END AS lon FROM customer),
j AS (SELECT p.id, g.id AS region_id, g.name AS region_name, row_number() OVER (PARTITION BY p.id ORDER BY
        (p.lat - g.lat) * (p.lat - g.lat) + (p.lon - g.lon) * (p.lon - g.lon), g.id) AS rn FROM p, gaz g)
SELECT id, region_id, region_name FROM j WHERE rn = 1""", ops="J9")
def q_nearest_customers(spark, d):
    """Customers, a third of them at one corner, and the nearest of a gazetteer that is dense in one city."""
    k = F.col("id")
    pts = tables.customer_locations(spark, d).select(
        k, F.when(k % 3 == 0, 37.505 + (k % 1000) * 0.000001).otherwise(F.col("lat")).alias("lat"),
        F.when(k % 3 == 0, 127.01 + (k % 1000) * 0.000001).otherwise(F.col("lon")).alias("lon"))
    return regions.nearest_region(pts, _gazetteer(spark, d))


@query("geojson_gazetteer", """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, round(33.0::DOUBLE + (c_custkey % 1000) * 0.0055::DOUBLE, 4) AS lat,
  round(125.0::DOUBLE + ((c_custkey * 7919) % 1000) * 0.0045::DOUBLE, 4) AS lon FROM customer WHERE c_custkey % 7 <> 3""", ops="S11")
def q_geojson(spark, d):
    """Customers' places as polygons and multipolygons in GeoJSON collections, some features without properties; read back in many tasks."""
    c = tables.customer_locations(spark, d).join(tables.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "id")
    corner = F.array("lon", "lat")
    ring = F.array(corner, F.array(F.col("lon") + 0.01, F.col("lat")), F.array(F.col("lon") + 0.01, F.col("lat") + 0.01), corner)
    props = F.when(F.col("id") % 7 != 3, F.create_map(F.lit("adm_cd"), F.col("id").cast("string"), F.lit("adm_nm"), F.col("name"), F.lit("note"), F.lit('a "Quoted", {braced} note')))
    poly, multi = F.to_json(F.array(ring)), F.to_json(F.array(F.array(ring)))
    many = F.col("id") % 2 == 0
    text = F.concat(F.lit('{"type":"Feature","properties":'), F.coalesce(F.to_json(props), F.lit("null")), F.lit(',"geometry":{"type":"'),
                    F.when(many, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'), F.when(many, multi).otherwise(poly), F.lit("}}"))
    # a collection for each hundred customers
    files = c.groupBy(F.floor(F.col("id") / 100).alias("k")).agg(F.array_join(F.collect_list(text), ",").alias("f")).select(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("f"), F.lit("]}")).alias("value"))
    path = scratch_path(spark, "geojson")
    files.write.text(path)
    return regions.regions_from_large_geojson(spark, path)
