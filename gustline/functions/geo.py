"""Column functions for station geometry and wind."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    chord = F.sin(half_dlat) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_dlon) ** 2
    return 2.0 * EARTH_RADIUS_M * F.asin(F.sqrt(chord))


def arc_m(chord_m) -> Column:
    """Great-circle distance of points whose straight distance is ``chord_m``."""
    return 2.0 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), chord_m / (2.0 * EARTH_RADIUS_M)))


def north_east_m(lat1, lon1, lat2, lon2) -> tuple[Column, Column]:
    """Displacement (north, east) in metres from point 1 to point 2, flat at the mean latitude."""
    north = EARTH_RADIUS_M * F.radians(lat2 - lat1)
    east = EARTH_RADIUS_M * F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return north, east


def wind_u(speed, direction, dir_scale: float = 1.0) -> Column:
    """Component paired with north. ``dir_scale=10`` for directions in tens of degrees."""
    return speed * F.cos(F.radians(direction * dir_scale))


def wind_v(speed, direction, dir_scale: float = 1.0) -> Column:
    """Component paired with east."""
    return speed * F.sin(F.radians(direction * dir_scale))


def alignment(north, east, u, v) -> Column:
    """Cosine between a displacement and the wind; 0 when calm."""
    speed = F.hypot(u, v)
    return F.when(speed > 0, F.try_divide(north * u + east * v, F.hypot(north, east) * speed)).otherwise(0.0)


def edge_weight(dist_m, align) -> Column:
    """Inverse distance, raised linearly down-wind and damped exponentially up-wind."""
    base = 1.0 / (dist_m + 1e-5)
    return base * F.when(align > 0, 1.0 + align).otherwise(F.exp(align))


def cell(lat, lon, size_m) -> list[Column]:
    """Cube of edge ``size_m`` holding the point, in earth-centred coordinates.

    Unlike degree cells these have the same size everywhere and no seam at the date line or the
    poles. Two points closer than ``size_m`` are in the same or in adjacent cubes.
    """
    phi, lam = F.radians(lat), F.radians(lon)
    x = EARTH_RADIUS_M * F.cos(phi) * F.cos(lam)
    y = EARTH_RADIUS_M * F.cos(phi) * F.sin(lam)
    z = EARTH_RADIUS_M * F.sin(phi)
    return [F.floor(x / size_m), F.floor(y / size_m), F.floor(z / size_m)]
