"""Nearest venues, grids, adaptive tiles and crawl coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sofralytics.functions import fixed_values as fv
from sofralytics.functions.geo import haversine_km
from sofralytics.functions.numeric import round_to
from sofralytics.session import ensure_checkpoint_dir

FINEST_CELL = 3.5e-5  # of the earth's radius, some 220 m
EDGE = 1e-9  # degrees of slack, so binary noise does not move a point off a tile's border
LEVELS = 17  # the finest cell doubled 16 times exceeds the earth's diameter
CELL = ["level", "cx", "cy", "cz"]


def nearest_to_point(venues: DataFrame, lat: float, lng: float, k: int) -> DataFrame:
    """The k venues closest to one point: a per-task top-k, then one merge."""
    distance = haversine_km(F.col("lat"), F.col("lng"), F.lit(lat), F.lit(lng))
    return venues.filter(distance.isNotNull()).withColumn("distance_km", distance).orderBy("distance_km", "restaurant_id").limit(k)


def _celled(rows: DataFrame, lat: str, lng: str) -> DataFrame:
    """The rows with the cubic cell of their point on the unit sphere, for each row's ``level``."""
    y, x = F.radians(lat), F.radians(lng)
    size = F.lit(FINEST_CELL) * F.pow(F.lit(2.0), F.col("level"))
    at = {"cx": F.cos(y) * F.cos(x), "cy": F.cos(y) * F.sin(x), "cz": F.sin(y)}
    return rows.withColumns({c: F.floor(v / size).cast("long") for c, v in at.items()})


def _around(cells: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Each cell with the cells at these offsets (``nx, ny, nz``) that the sphere's surface passes through."""
    listed = F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip("xyz", o, strict=True)]) for o in offsets])
    near = cells.withColumn("o", F.explode(listed)).select(*CELL, *[(F.col(f"c{c}") + F.col(f"o.{c}")).alias(f"n{c}") for c in "xyz"])
    size = F.lit(FINEST_CELL) * F.pow(F.lit(2.0), F.col("level"))
    low = [F.greatest(F.col(f"n{c}"), -F.col(f"n{c}") - 1, F.lit(0)) for c in "xyz"]  # nearest to the centre, in cells
    high = [F.greatest(F.abs(F.col(f"n{c}")), F.abs(F.col(f"n{c}") + 1)) for c in "xyz"]
    square = lambda parts: sum(((p.cast("double") * size) * (p.cast("double") * size) for p in parts), F.lit(0.0))
    return near.filter((square(low) <= 1.0 + EDGE) & (square(high) >= 1.0 - EDGE))


def nearest(points: DataFrame, venues: DataFrame, k: int) -> DataFrame:
    """Exact k nearest venues of every point, without comparing every pair.

    ``points``: point_id, lat, lng; ``venues``: restaurant_id, lat, lng.  Points and venues lie in cubic cells of doubling
    sizes around the unit sphere, so neither the antimeridian nor the poles are an edge.  A point takes the smallest size
    at which the 3x3x3 cells around its own hold k venues; the k-th distance cannot exceed that block's far corner, so
    only cells within that reach are met.  Which cells are near which is found once a cell, not once a point.
    Venues sharing one location beyond the k lowest ids can never be among the results and are left out of the join.
    """
    spot = Window.partitionBy("lat", "lng").orderBy("restaurant_id")
    places = (
        venues.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
        .select("restaurant_id", "lat", "lng")
        .withColumn("_rn", F.row_number().over(spot))
        .filter(F.col("_rn") <= k)
        .select("restaurant_id", F.col("lat").alias("v_lat"), F.col("lng").alias("v_lng"))
    )
    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    held = _celled(places.withColumn("level", F.explode(levels)), "v_lat", "v_lng")
    held = held.select("restaurant_id", "v_lat", "v_lng", "level", *[F.col(f"c{c}").alias(f"n{c}") for c in "xyz"])
    met = ["level", "nx", "ny", "nz"]
    counts = held.groupBy(*met).agg(F.count("*").alias("n"))

    asked = points.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select("point_id", "lat", "lng")
    tall = _celled(asked.withColumn("level", F.explode(levels)), "lat", "lng")
    block = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
    blocks = _around(tall.select(*CELL).distinct(), block).join(counts, met).groupBy(*CELL).agg(F.sum("n").alias("n")).filter(F.col("n") >= k)
    level = F.coalesce(F.min(F.when(F.col("n").isNotNull(), F.col("level"))), F.lit(LEVELS - 1)).alias("level")
    chosen = _celled(tall.join(blocks, CELL, "left").groupBy("point_id", "lat", "lng").agg(level), "lat", "lng")

    steps = range(-4, 5)
    gap = lambda d: max(abs(d) - 1, 0) ** 2
    # The far corner of the block is 2 sqrt(3) cells away at most.
    reach = [(x, y, z) for x in steps for y in steps for z in steps if gap(x) + gap(y) + gap(z) <= 12]
    near = _around(chosen.select(*CELL).distinct(), reach).join(held, met).select(*CELL, "restaurant_id", "v_lat", "v_lng")
    pairs = chosen.join(near, CELL).withColumn("distance_km", haversine_km(F.col("lat"), F.col("lng"), F.col("v_lat"), F.col("v_lng")))
    order = Window.partitionBy("point_id").orderBy("distance_km", "restaurant_id")
    return (
        pairs.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("point_id", "rank", "restaurant_id", "distance_km")
    )


def grid_counts(venues: DataFrame, size: int = fv.GRID_SIZE) -> DataFrame:
    """Regular size x size grid over the venues' bounding box with the venues nearest to each node.

    The box is one aggregate row; nodes come from sequences, counts from one map-side combined
    aggregation, so nodes without venues stay in the result with 0.
    """
    box = venues.agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"))
    last = float(size - 1)
    steps = box.withColumns({"dy": (F.col("north") - F.col("south")) / last, "dx": (F.col("east") - F.col("west")) / last})
    nodes = steps.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    nodes = nodes.select(
        "i", "j", round_to(F.col("south") + F.col("i") * F.col("dy"), 6).alias("lat"), round_to(F.col("west") + F.col("j") * F.col("dx"), 6).alias("lng")
    )
    frame = steps.select(F.struct("south", "west", "dy", "dx").alias("b")).scalar()
    rows = venues.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).withColumn("b", frame)
    index = lambda v, low, d: F.when(d > 0, F.floor((v - low) / d + 0.5)).otherwise(F.lit(0)).cast("int")
    counts = rows.groupBy(
        index(F.col("lat"), F.col("b.south"), F.col("b.dy")).alias("i"), index(F.col("lng"), F.col("b.west"), F.col("b.dx")).alias("j")
    ).agg(F.count("*").alias("n"))
    return nodes.join(counts, ["i", "j"], "left").select("i", "j", "lat", "lng", F.coalesce("n", F.lit(0)).cast("long").alias("venues"))


def tile(points: DataFrame, hot: int = fv.TILE_HOT_COUNT, base_zoom: int = fv.BASE_ZOOM, max_zoom: int = fv.MAX_ZOOM) -> DataFrame:
    """Tiles with their point counts: a tile holding at least ``hot`` points splits 2x2 with overlap.

    ``points``: lat, lng.  Points are first reduced to (location, weight), so a crowded spot is one row.
    Each level assigns the points of hot tiles to the overlapping children they fall in and counts again,
    until nothing is hot or ``max_zoom`` is reached.  Between levels the rows are checkpointed to the shared
    folder, which keeps the plan short and survives lost executors.
    """
    ensure_checkpoint_dir(points.sparkSession)
    weighted = points.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).groupBy("lat", "lng").agg(F.count("*").alias("w"))
    span = lambda zoom: (fv.TILE_SPAN_LAT * 2.0 ** (fv.BASE_ZOOM - zoom), fv.TILE_SPAN_LNG * 2.0 ** (fv.BASE_ZOOM - zoom))
    high, wide = span(base_zoom)
    rows = weighted.select(
        "lat", "lng", "w",
        round_to((F.floor(F.col("lat") / high + EDGE) + 0.5) * high, 6).alias("c_lat"),
        round_to((F.floor(F.col("lng") / wide + EDGE) + 0.5) * wide, 6).alias("c_lng"),
    )
    result = None
    for zoom in range(base_zoom, max_zoom + 1):
        counts = rows.groupBy("c_lat", "c_lng").agg(F.sum("w").alias("n"))
        level = counts.select(F.lit(zoom).alias("zoom"), "c_lat", "c_lng", "n")
        result = level if result is None else result.unionByName(level)
        if zoom == max_zoom:
            break
        crowded = counts.filter(F.col("n") >= hot).select("c_lat", "c_lng")
        high, wide = span(zoom)
        step_lat, step_lng = high / 2 * (1 - fv.TILE_OVERLAP), wide / 2 * (1 - fv.TILE_OVERLAP)
        sign = F.array(F.lit(-1.0), F.lit(1.0))
        children = (
            rows.join(crowded, ["c_lat", "c_lng"], "left_semi")
            .withColumn("sy", F.explode(sign))
            .withColumn("sx", F.explode(sign))
            .select(
                "lat", "lng", "w",
                round_to(F.col("c_lat") + F.col("sy") * step_lat, 6).alias("c_lat"),
                round_to(F.col("c_lng") + F.col("sx") * step_lng, 6).alias("c_lng"),
            )
            .filter((F.abs(F.col("lat") - F.col("c_lat")) <= high / 2 + EDGE) & (F.abs(F.col("lng") - F.col("c_lng")) <= wide / 2 + EDGE))
            .distinct()
        )
        rows = children.checkpoint()
        if rows.isEmpty():
            break
    return result


def coverage(visits: DataFrame, cell: list[str]) -> DataFrame:
    """Per cell: records seen, distinct venues and repeats."""
    per_venue = visits.groupBy(*cell, "source", "source_id").agg(F.count("*").alias("c"))
    return per_venue.groupBy(*cell).agg(
        F.sum("c").alias("seen"), F.count("*").alias("distinct_venues"), (F.sum("c") - F.count("*")).alias("repeats")
    )
