"""Distances, nearest venues, districts, grids and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sofralytics.functions import fixed_values as fv
from sofralytics.functions import geo
from sofralytics.functions.numeric import round_to
from sofralytics.operators import places
from sofralytics.plans.adapters import for_spark
from sofralytics.plans.registry import query, rounded

LAT, LNG = 41.0, 28.9


def km_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2))"
    return f"(2 * 6371.0 * atan2(sqrt({a}), sqrt(1 - {a})))"


_KM = km_sql("lat", "lng", f"{LAT}::DOUBLE", f"{LNG}::DOUBLE")


@query("venues_within_radius", "venues_v", sql=f"SELECT restaurant_id FROM venues_v WHERE {_KM} <= 10.0")
def venues_within_radius(t):
    return t.venues_v.filter(geo.within_km(F.col("lat"), F.col("lng"), LAT, LNG, 10.0)).select("restaurant_id")


@query("venue_distances", "venues_v", sql=f"SELECT restaurant_id, {rounded(_KM, 6)} AS distance_km FROM venues_v")
def venue_distances(t):
    km = geo.haversine_km(F.col("lat"), F.col("lng"), F.lit(LAT), F.lit(LNG))
    return t.venues_v.select("restaurant_id", round_to(km, 6).alias("distance_km"))


@query(
    "nearest_to_point",
    "venues_v",
    sql=f"SELECT restaurant_id, {rounded(_KM, 6)} AS distance_km FROM venues_v ORDER BY {_KM}, restaurant_id LIMIT 3",
)
def nearest_to_point(t):
    return places.nearest_to_point(t.venues_v, LAT, LNG, 3).select("restaurant_id", round_to(F.col("distance_km"), 6).alias("distance_km"))


_POINTS = """SELECT c_custkey AS point_id, CAST(40.75 + (c_custkey * 29 % 500) / 1000.0 AS DOUBLE) AS lat,
    CAST(28.55 + (c_custkey * 71 % 650) / 1000.0 AS DOUBLE) AS lng FROM {customer}"""


@query(
    "nearest_venues_per_point",
    "venues_v",
    sql=f""", points AS ({_POINTS.replace('{customer}', 'customer')}),
           pairs AS (SELECT point_id, restaurant_id, {km_sql('p.lat', 'p.lng', 'v.lat', 'v.lng')} AS km FROM points p, venues_v v WHERE v.is_active)
           SELECT point_id, CAST(row_number() OVER (PARTITION BY point_id ORDER BY km, restaurant_id) AS INT) AS rank, restaurant_id,
             {rounded('km', 6)} AS distance_km FROM pairs QUALIFY rank <= 3""",
)
def nearest_venues_per_point(t):
    points = t.spark.sql(for_spark(_POINTS), customer=t.customer)
    out = places.nearest(points, t.venues_v.filter("is_active"), 3)
    return out.withColumn("distance_km", round_to(F.col("distance_km"), 6))


@query(
    "venues_in_box",
    "venues_v",
    sql="SELECT restaurant_id, lat, lng FROM venues_v WHERE lat BETWEEN 40.9 AND 41.05 AND lng BETWEEN 28.7 AND 28.95",
)
def venues_in_box(t):
    return t.venues_v.filter(geo.in_box(F.col("lat"), F.col("lng"), 40.9, 28.7, 41.05, 28.95)).select("restaurant_id", "lat", "lng")


_CENTRES = ", ".join(f"({i}, '{n}', {y}::DOUBLE, {x}::DOUBLE)" for i, (n, y, x) in enumerate(fv.DISTRICT_CENTRES))


@query(
    "nearest_district",
    "venues_v",
    sql=f"""SELECT restaurant_id, arg_min(n, ((lat - y) * (lat - y) + (lng - x) * (lng - x), i)) AS district
           FROM venues_v, (VALUES {_CENTRES}) c(i, n, y, x) GROUP BY restaurant_id""",
)
def nearest_district(t):
    return t.venues_v.select("restaurant_id", geo.nearest_district(F.col("lat"), F.col("lng")).alias("district"))


_ADDRESS = "CASE restaurant_id % 3 WHEN 0 THEN concat('Moda Cad. Kadıköy ', CAST(restaurant_id AS STRING)) WHEN 1 THEN 'Merkez, Fatih' ELSE address END"


@query(
    "venue_district",
    "venues_v",
    sql=f"""SELECT restaurant_id, CASE restaurant_id % 3 WHEN 0 THEN 'kadikoy' WHEN 1 THEN 'fatih' ELSE
             arg_min(n, ((lat - y) * (lat - y) + (lng - x) * (lng - x), i)) END AS district
           FROM venues_v, (VALUES {_CENTRES}) c(i, n, y, x) GROUP BY restaurant_id""",
)
def venue_district(t):
    return t.venues_v.select("restaurant_id", geo.district(F.expr(_ADDRESS), F.col("lat"), F.col("lng")).alias("district"))


@query(
    "grid_counts",
    "venues_v",
    sql=f""", box AS (SELECT min(lat) AS south, min(lng) AS west, (max(lat) - min(lat)) / 14.0::DOUBLE AS dy, (max(lng) - min(lng)) / 14.0::DOUBLE AS dx FROM venues_v),
           snapped AS (SELECT CAST(floor((lat - south) / dy + 0.5) AS INT) AS i, CAST(floor((lng - west) / dx + 0.5) AS INT) AS j, count(*) AS n FROM venues_v, box GROUP BY 1, 2)
           SELECT CAST(a.i AS INT) AS i, CAST(b.j AS INT) AS j, {rounded('south + a.i * dy', 6)} AS lat, {rounded('west + b.j * dx', 6)} AS lng, coalesce(n, 0) AS venues
           FROM box, range(15) a(i), range(15) b(j) LEFT JOIN snapped s ON s.i = a.i AND s.j = b.j""",
)
def grid_counts(t):
    return places.grid_counts(t.venues_v)


_TILE_POINTS = """SELECT CAST(40.80 + (o_custkey % 211) / 5000.0 AS DOUBLE) AS lat, CAST(28.60 + (o_orderkey % 307) / 4000.0 AS DOUBLE) AS lng FROM {orders}"""


def _tile_sql(hot: int, levels: int) -> str:
    high, wide = fv.TILE_SPAN_LAT, fv.TILE_SPAN_LNG
    out = [
        f", pts AS (SELECT lat, lng, count(*) AS w FROM ({_TILE_POINTS.replace('{orders}', 'orders')}) GROUP BY lat, lng)",
        f"r0 AS (SELECT lat, lng, w, {rounded(f'(floor(lat / {high}::DOUBLE + 1e-9) + 0.5) * {high}::DOUBLE', 6)} AS c_lat, {rounded(f'(floor(lng / {wide}::DOUBLE + 1e-9) + 0.5) * {wide}::DOUBLE', 6)} AS c_lng FROM pts)",
        "t0 AS (SELECT c_lat, c_lng, CAST(sum(w) AS BIGINT) AS n FROM r0 GROUP BY 1, 2)",
    ]
    for k in range(1, levels + 1):
        h, w = high * 2.0 ** (1 - k), wide * 2.0 ** (1 - k)
        sy, sx = h / 2 * 0.85, w / 2 * 0.85
        out.append(
            f"""r{k} AS (SELECT DISTINCT * FROM (SELECT lat, lng, w, {rounded(f'c_lat + sy * {sy!r}::DOUBLE', 6)} AS c_lat, {rounded(f'c_lng + sx * {sx!r}::DOUBLE', 6)} AS c_lng
                FROM r{k - 1} SEMI JOIN (SELECT * FROM t{k - 1} WHERE n >= {hot}) USING (c_lat, c_lng), (VALUES (-1.0::DOUBLE), (1.0::DOUBLE)) a(sy), (VALUES (-1.0::DOUBLE), (1.0::DOUBLE)) b(sx))
              WHERE abs(lat - c_lat) <= {h!r}::DOUBLE / 2 + 1e-9 AND abs(lng - c_lng) <= {w!r}::DOUBLE / 2 + 1e-9)"""
        )
        out.append(f"t{k} AS (SELECT c_lat, c_lng, CAST(sum(w) AS BIGINT) AS n FROM r{k} GROUP BY 1, 2)")
    final = " UNION ALL ".join(f"SELECT {fv.BASE_ZOOM + k} AS zoom, c_lat, c_lng, n FROM t{k}" for k in range(levels + 1))
    return ",\n".join(out) + "\n" + final


@query("adaptive_tiles", sql=_tile_sql(100, 6))
def adaptive_tiles(t):
    return places.tile(t.spark.sql(for_spark(_TILE_POINTS), orders=t.orders), 100)


@query(
    "crawl_coverage",
    "bronze_venues_v",
    sql="""SELECT cell, CAST(sum(c) AS BIGINT) AS seen, count(*) AS distinct_venues, CAST(sum(c) - count(*) AS BIGINT) AS repeats FROM
           (SELECT arrival % 7 AS cell, source, source_id, count(*) AS c FROM bronze_venues_v GROUP BY 1, 2, 3) GROUP BY cell""",
)
def crawl_coverage(t):
    return places.coverage(t.bronze_venues_v.withColumn("cell", F.col("arrival") % 7), ["cell"])
