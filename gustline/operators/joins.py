"""Spatial and temporal joins between stations, weather reports and readings.

No join here is a cross join. Points meet through the cubes of ``functions.geo.cell``, so the work
follows the number of near points, and no side carries a broadcast hint: Spark broadcasts a side when
its known or measured size is under the threshold and shuffles (splitting skewed keys) otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo
from ..session import materialize
from .ranking import top_per_group

BASE_CELL_M = 1000.0
LEVELS = 15  # 1 km, 2 km, ... 16,384 km: the last spans the globe
FINE_LEVELS = 10  # 500 m down to 1 m, only around kilometre cells that hold many points
DENSE = 32  # a cell with so many times the points asked for is searched at the fine levels too
BOUNDED = 12  # levels whose cubes are too small to hold both the earth's centre and a point on its surface
QUERIES = 4096  # points that one task looks for at a time
FEW = 16_384  # queries and points up to which Spark chooses joins and tasks by the size of their rows
_CUBE = ["_x", "_y", "_z"]


def _around(cube: Sequence[Column]) -> Column:
    """The 27 cubes around a cube, itself included."""
    offsets = F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)])
    x, y, z = cube
    return F.flatten(F.flatten(F.transform(offsets, lambda dx: F.transform(offsets, lambda dy: F.transform(
        offsets, lambda dz: F.struct((x + dx).alias("_x"), (y + dy).alias("_y"), (z + dz).alias("_z")))))))


def station_pairs(stations: DataFrame, radius_m: float, key: str = "station_id",
                  lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Ordered pairs of distinct, not co-located stations up to ``radius_m`` apart.

    Columns src, dst, dist_m and the displacement (north, east) from src to dst. The geometry is
    static: compute it once and join readings to it. A radius of at least the extent of the network
    gives every pair, whose number grows with the square of the stations.
    """
    at = stations.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(key).alias("id"), F.col(lat).alias("la"), F.col(lon).alias("lo"))
    cube = geo.cell(F.col("la"), F.col("lo"), radius_m)
    left = at.select(F.col("id").alias("src"), F.col("la").alias("la1"), F.col("lo").alias("lo1"),
                     F.inline(_around(cube)))
    right = at.select(F.col("id").alias("dst"), F.col("la").alias("la2"), F.col("lo").alias("lo2"),
                      *[c.alias(n) for n, c in zip(_CUBE, cube)])
    points = [F.col(c) for c in ("la1", "lo1", "la2", "lo2")]
    north, east = geo.north_east_m(*points)
    return (
        left.join(right, _CUBE)
        .select("src", "dst", geo.haversine_m(*points).alias("dist_m"), north.alias("north"), east.alias("east"))
        .filter((F.col("src") != F.col("dst")) & (F.col("dist_m") > 0) & (F.col("dist_m") <= radius_m))
    )


def nearest_k(queries: DataFrame, points: DataFrame, k: int, query_id: str, point_id: str,
              by: Sequence[str] = (), exclude_self: bool = False,
              lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Exact ``k`` nearest points of every query among the points with equal ``by``; ties by id.

    Each query searches at its own scale: the finest cube size at which its own cube already holds
    ``k`` points bounds the distance of the k-th neighbour by the cube's diagonal, and the 27 cubes of
    twice that size contain everything closer. So queries in dense places look at small cubes and
    remote ones at large cubes; crowded kilometres and those around them are cut down to a metre. Of points at one and the same place only the first ``k`` ids can be
    answers, so copies of a place do not multiply. Points beyond that diagonal are dropped before any are ranked.

    Queries and points are stored, because several steps read them. Each brings many more rows than its own, so beyond ``FEW`` of them
    tasks follow the number of queries and no side is broadcast, small as their files may be.
    """
    by, need = list(by), k + int(exclude_self)
    usable = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    pts = points.filter(usable).select(*by, F.col(point_id).alias("_pid"),
                                       F.col(lat).alias("_pla"), F.col(lon).alias("_plo"))
    pts = materialize(top_per_group(pts, [*by, "_pla", "_plo"], [F.col("_pid")], need))
    size = lambda level: F.lit(BASE_CELL_M) * F.pow(F.lit(2.0), level)
    cubes = lambda la, lo: [c.alias(n) for n, c in zip(_CUBE, geo.cell(F.col(la), F.col(lo), size(F.col("_level"))))]
    kilometre = pts.withColumn("_level", F.lit(0)).select("*", *cubes("_pla", "_plo"))
    crowded = kilometre.groupBy(*by, *_CUBE).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > DENSE * need)
    zone = crowded.select(*by, F.inline(_around([F.col(c) for c in _CUBE]))).distinct().withColumn("_fine", F.lit(True))
    deepest = F.when(F.col("_fine"), F.lit(-FINE_LEVELS)).otherwise(F.lit(0))
    leveled = kilometre.join(zone, [*by, *_CUBE], "left").drop("_level", *_CUBE).select(
        "*", F.explode(F.sequence(deepest, F.lit(LEVELS - 1))).alias("_level")).drop("_fine").select("*", *cubes("_pla", "_plo"))
    levels = F.explode(F.sequence(F.lit(-FINE_LEVELS), F.lit(LEVELS - 1))).alias("_level")
    at = [*by, "_level", *_CUBE]
    dense = leveled.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= need).drop("_n")
    qs = materialize(queries.filter(usable).select(*by, F.col(query_id).alias("_qid"),
                                                   F.col(lat).alias("_qla"), F.col(lon).alias("_qlo")))
    n_queries = qs.count()
    ids = pts.groupBy(*by, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    known = ids.agg(F.sum("_n").alias("n"), F.max(F.when(F.col("_pid").isNull(), 2).otherwise(F.col("_n"))).alias("most")).first()
    many = max(n_queries, known["n"] or 0) > FEW
    single = not exclude_self or (known["most"] or 0) < 2  # an id at several places may leave fewer others in a cube than counted
    shuffled = lambda df: df.hint("merge") if many else df
    own = qs.select("*", levels).select("*", *cubes("_qla", "_qlo"))
    scale = own.join(shuffled(dense.withColumn("_dense", F.lit(True))), at, "left").groupBy(*by, "_qid", "_qla", "_qlo").agg(
        F.min(F.when(F.col("_dense"), F.col("_level"))).alias("_fit"))
    diagonal = size(F.col("_fit")) * F.lit(3.0 ** 0.5)
    reach = geo.arc_m(diagonal) * F.lit(1 + 1e-9) + F.lit(1e-3)  # and the rounding of coordinates
    probes = scale.withColumns({"_level": F.coalesce(F.least(F.col("_fit") + 1, F.lit(LEVELS - 1)), F.lit(LEVELS - 1)),
                                "_reach": F.when((F.col("_fit") < BOUNDED) & F.lit(single), reach)})
    probes = probes.select(*by, "_qid", "_qla", "_qlo", "_reach", "_level", F.inline(
        _around(geo.cell(F.col("_qla"), F.col("_qlo"), size(F.col("_level"))))))
    if many:
        probes = probes.repartition(-(-n_queries // QUERIES) or 1, *at)
    found = probes.join(shuffled(leveled), at).withColumn(
        "dist_m", geo.haversine_m(*[F.col(c) for c in ("_qla", "_qlo", "_pla", "_plo")]))
    found = found.filter(F.col("_reach").isNull() | F.isnan("dist_m") | (F.col("dist_m") <= F.col("_reach"))).select(*by, "_qid", "_pid", "dist_m")
    if exclude_self:
        found = found.filter(F.col("_qid") != F.col("_pid"))
    best = top_per_group(found, [*by, "_qid"], [F.col("dist_m"), F.col("_pid")], k)
    return best.select(*by, F.col("_qid").alias(query_id), F.col("_pid").alias(
        point_id if point_id != query_id else "neighbor_id"), "dist_m")


def nearest_met(targets: DataFrame, stations: DataFrame, met: DataFrame, values: Sequence[str],
                hour: str = "hour", k: int = 8) -> DataFrame:
    """Append the report of the nearest weather station that has one for the same hour.

    ``targets``: station_id, hour; ``met``: met_id, hour, lat, lon, values, one row per id and hour. A
    report counts at the place it names, so a weather station may move. The ``k`` nearest places of each
    station are found once and their reports joined on (place, hour). Hours at which no report came from
    any of them, if there are such hours, are searched among all reports of those hours. No report at all leaves nulls.
    """
    keys = ["station_id", hour]
    report = F.struct("met_id", *values).alias("_report")
    met = met.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("_place", F.concat_ws("|", "lat", "lon"))
    places = met.select("_place", "lat", "lon").distinct()
    static = nearest_k(stations, places, k, "station_id", "_place")
    close = materialize(met.join(static, "_place").groupBy(*keys).agg(F.min_by(report, F.struct("dist_m", "met_id")).alias("_report")))
    missed = materialize(targets.select(*keys).distinct().join(close, keys, "left_anti").join(
        stations.select("station_id", "lat", "lon"), "station_id"))
    if not missed.isEmpty():
        then = met.join(missed.select(hour).distinct(), hour, "left_semi")
        other = nearest_k(missed, then, 1, "station_id", "met_id", by=[hour]).join(
            then.select("met_id", hour, *values), ["met_id", hour]).select(*keys, report)
        close = close.unionByName(other)
    return targets.join(close, keys, "left").select("*", "_report.*").drop("_report")


def met_as_of(met: DataFrame, values: Sequence[str], until: Column, hour: str = "hour") -> DataFrame:
    """Latest report per weather station and hour, of whatever age, from its first hour to ``until``.

    ``nearest_met`` on the result is the nearest station among all that have reported so far.
    """
    from . import series
    met = met.withColumn("_report", F.struct("lat", "lon", *values)).select("met_id", hour, "_report")
    filled = series.fill(series.hourly_spine(met, ["met_id"], hour, until), ["met_id"], hour, ["_report"])
    return filled.select("met_id", hour, "_report.*")


def neighbour_readings(readings: DataFrame, edges: DataFrame, value: str = "pm25", hour: str = "hour") -> DataFrame:
    """Readings of each station's neighbours: (station_id, hour, neighbor_id, value, geometry)."""
    return readings.select(F.col("station_id").alias("src"), hour, value).join(edges, "src").select(
        F.col("dst").alias("station_id"), hour, F.col("src").alias("neighbor_id"), value, "dist_m", "north", "east")


def with_defaults(left: DataFrame, right: DataFrame, on: Sequence[str], defaults: dict[str, float]) -> DataFrame:
    """Left join of ``right`` whose missing values become the default."""
    joined = left.join(right.select(*on, *defaults), list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def fill_missing_from(left: DataFrame, right: DataFrame, on: Sequence[str], col: str, other: str) -> DataFrame:
    """Left join that only replaces nulls of ``col``."""
    return left.join(right.select(*on, other), list(on), "left").withColumn(
        col, F.coalesce(F.col(col), F.col(other))).drop(other)


def known_stations(df: DataFrame, stations: DataFrame, role: str | None = None) -> DataFrame:
    """Rows of registered stations (of one role)."""
    registry = stations if role is None else stations.filter(F.col("role") == role)
    return df.join(registry.select("station_id"), "station_id", "left_semi")


def latest_by_station(predictions: DataFrame, alerts: DataFrame) -> DataFrame:
    """Latest prediction next to the latest alert; either may be missing."""
    return predictions.join(alerts, "station_id", "full_outer")
