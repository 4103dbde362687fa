"""Geometry as Column expressions. All of them give NULL for a NULL coordinate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waygrid.config import EARTH_METERS, EARTH_MILES


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_MILES) -> Column:
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = F.pow(half(lat1, lat2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(half(lon1, lon2), 2)
    # least() skips NULL, so that a missing point must be kept apart from the clamp
    return F.when(h.isNotNull(), 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h))))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine(lat1, lon1, lat2, lon2, EARTH_METERS)


def bearing_signed(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from 1 to 2, over -180 to 180."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.degrees(F.atan2(y, x))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from 1 to 2, over 0 to 360."""
    return F.pmod(bearing_signed(lat1, lon1, lat2, lon2) + 360, F.lit(360.0))


def angle_diff(a: Column, b: Column) -> Column:
    """0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.when(d.isNotNull(), F.least(d, 360 - d))


def bearing_change(now: Column, before: Column) -> Column:
    """Size of the turn: |((now - before + 180) mod 360) - 180|."""
    return F.abs(F.pmod(now - before + 180, F.lit(360.0)) - 180)


def pixel_bearing(cx: Column, width: Column) -> Column:
    """Bearing of a pixel column in an equirectangular frame, from the camera's front."""
    return F.pmod(cx / width * 360, F.lit(360.0))


#: Where the regions of a panorama look, in degrees from the front.
REGIONS = {"front": 0.0, "left": 270.0, "right": 90.0, "back": 180.0}


def region_bearing(camera_bearing: Column, region: Column) -> Column:
    offset = F.create_map(*[F.lit(x) for kv in REGIONS.items() for x in kv])
    return F.pmod(camera_bearing + F.coalesce(F.element_at(offset, region), F.lit(0.0)), F.lit(360.0))


def bbox_distance(height: Column, frame_height: Column, object_height: float = 1.7) -> Column:
    """Metres to an object by its share of the frame's height, to 2 digits, half to even; NULL if it has none."""
    return F.bround(F.lit(object_height) / F.when(height > 0, height / frame_height), 2)


def centroid(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, (y1 + y2) / 2


def destination(lat: Column, lon: Column, bearing_deg: Column, meters: Column) -> tuple[Column, Column]:
    """Point at a distance and bearing on the sphere (within 0.5 % of the ellipsoid)."""
    d, b, p = meters / F.lit(EARTH_METERS), F.radians(bearing_deg), F.radians(lat)
    to = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    east = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(to))
    return F.degrees(to), F.degrees(F.radians(lon) + east)


def cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size)).cast("long")


def planar(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in degrees."""
    return F.sqrt(F.pow(lat2 - lat1, 2) + F.pow(lon2 - lon1, 2))


def in_range(lat: Column, lon: Column) -> Column:
    """Whether a coordinate is one: neither NULL nor NaN, and within the globe."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def nonzero(lat: Column, lon: Column) -> Column:
    """Drops the (0, 0) that some writers put for a missing position: neither may be 0."""
    return F.coalesce((lat != 0) & (lon != 0), F.lit(False))
