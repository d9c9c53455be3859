"""Coordinates: WGS84 to metres around a reference and back, drawings to pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorwise.functions.rings import point

#: The ellipsoid and the coefficients of the meridian's length.
RADIUS, E2 = 6378137.0, 6.69437999e-3
C00, C02, C04, C06, C08, C22, C44, C46, C48, C66, C68, C88 = 1.0, 0.25, 0.046875, 0.01953125, 0.01068115234375, 0.75, 0.46875, 0.01302083333333333333, 0.00712076822916666666, 0.36458333333333333333, 0.00569661458333333333, 0.3076171875
DEGREE = 17.45329252e-3

_R = (
    C00 - E2 * (C02 + E2 * (C04 + E2 * (C06 + E2 * C08))),
    E2 * (C22 - E2 * (C04 + E2 * (C06 + E2 * C08))),
    E2**2 * (C44 - E2 * (C46 + E2 * C48)),
    E2**3 * (C66 - E2 * C68),
    E2**4 * C88,
)


def _meridian(lat, sin, cos):
    s2 = sin * sin
    return lat * _R[0] - cos * sin * (s2 * (s2 * (s2 * _R[4] + _R[3]) + _R[2]) + _R[1])


def to_metres(reference_lat: Column, reference_lon: Column, lat: Column, lon: Column) -> Column:
    """(x, y) in metres east and north of the reference, a polyconic projection."""
    phi, origin, dlon = lat * DEGREE, reference_lat * DEGREE, (lon - reference_lon) * DEGREE
    start = _meridian(origin, F.sin(origin), F.cos(origin))
    sin, cos = F.sin(phi), F.cos(phi)
    m = F.when(F.abs(sin) > 1e-10, cos / F.sqrt(1 - E2 * sin * sin) / sin).otherwise(0.0)
    east = F.when(F.abs(phi) < 1e-10, dlon).otherwise(m * F.sin(dlon * sin))
    north = F.when(F.abs(phi) < 1e-10, -start).otherwise(_meridian(phi, sin, cos) - start + m * (1 - F.cos(dlon * sin)))
    return point(east * RADIUS, north * RADIUS)


def _forward(lat0, lon0, lat, lon):
    phi, dlon = lat * DEGREE, (lon - lon0) * DEGREE
    start = _meridian(lat0 * DEGREE, np.sin(lat0 * DEGREE), np.cos(lat0 * DEGREE))
    sin, cos = np.sin(phi), np.cos(phi)
    m = np.where(np.abs(sin) > 1e-10, cos / np.sqrt(1 - E2 * sin * sin) / np.where(sin == 0, 1, sin), 0.0)
    flat = np.abs(phi) < 1e-10
    east = np.where(flat, dlon, m * np.sin(dlon * sin))
    north = np.where(flat, -start, _meridian(phi, sin, cos) - start + m * (1 - np.cos(dlon * sin)))
    return east * RADIUS, north * RADIUS


@F.pandas_udf(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
def to_wgs84(reference_lat: pd.Series, reference_lon: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
    """The inverse, by Newton steps with a numeric derivative until 1e-6 m."""
    lat0, lon0, east, north = (s.to_numpy(dtype=float) for s in (reference_lat, reference_lon, x, y))
    lat, lon = lat0 + north / 111_000, lon0 + east / (111_000 * np.cos(np.radians(lat0)))
    for _ in range(20):
        fx, fy = _forward(lat0, lon0, lat, lon)
        if np.all(np.nan_to_num(np.hypot(fx - east, fy - north)) < 1e-6):
            break
        h = 1e-6
        ax, ay = _forward(lat0, lon0, lat + h, lon)
        bx, by = _forward(lat0, lon0, lat, lon + h)
        a, b, c, d = (ax - fx) / h, (bx - fx) / h, (ay - fy) / h, (by - fy) / h
        det = a * d - b * c
        ex, ey = east - fx, north - fy
        lat, lon = lat + (ex * d - ey * b) / det, lon + (a * ey - c * ex) / det
    return pd.DataFrame({"lat": lat, "lon": lon})


def pixel_to_metres(px: Column, py: Column, origin_x: Column | float, origin_y: Column | float, resolution: Column | float) -> Column:
    """Pixels have y down."""
    return point((px - origin_x) * resolution, (F.lit(origin_y) - py) * resolution if isinstance(origin_y, (int, float)) else (origin_y - py) * resolution)


def drawing_to_pixel(x: Column, y: Column, bounds: Column) -> Column:
    """A drawing's point in an image whose longer side takes the whole size; y is flipped."""
    width, height = bounds["max_x_padded"] - bounds["min_x_padded"], bounds["max_y_padded"] - bounds["min_y_padded"]
    scale = F.when(width >= height, bounds["svg_width_px"] / width).otherwise(bounds["svg_height_px"] / height)
    return point((x - bounds["min_x_padded"]) * scale, bounds["svg_height_px"] - (y - bounds["min_y_padded"]) * scale)


def padded_bounds(min_x: Column, min_y: Column, max_x: Column, max_y: Column, padding: float = 0.03, size: int = 4000) -> Column:
    """Bounds grown by a share of the longer side, and the image's size with ``size`` on its longer side."""
    pad = F.greatest(max_x - min_x, max_y - min_y) * padding
    width, height = max_x - min_x + 2 * pad, max_y - min_y + 2 * pad
    longer = F.greatest(width, height)
    return F.struct((min_x - pad).alias("min_x_padded"), (min_y - pad).alias("min_y_padded"), (max_x + pad).alias("max_x_padded"), (max_y + pad).alias("max_y_padded"), F.round(width / longer * size).alias("svg_width_px"), F.round(height / longer * size).alias("svg_height_px"))
