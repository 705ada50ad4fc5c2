"""Movement tracks: lengths, summaries, simplification, and points near a place."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.geo import bounding_box, haversine_km


def with_steps(points: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """``points`` (lat, lon) with step_km, the way from the point before; 0 for the first."""
    w = Window.partitionBy(*by).orderBy(order)
    step = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return points.withColumn("step_km", F.coalesce(step, F.lit(0.0)))


def track_stats(points: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """n_points, distance_km, max_elevation (null if no point has one), first and last of the order column."""
    return with_steps(points, by, order).groupBy(*by).agg(
        F.count("*").alias("n_points"), F.sum("step_km").alias("distance_km"), F.max("ele").alias("max_elevation"), F.min(order).alias("first"), F.max(order).alias("last")
    )


def nearby(points: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """``points`` within ``km`` of a place, with distance_km; a box is filtered first, which scans can push down."""
    boxed = points.where(bounding_box(F.col("lat"), F.col("lon"), lat, lon, km))
    far = haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return boxed.withColumn("distance_km", far).where(F.col("distance_km") <= km)


def simplified(xy: np.ndarray, epsilon: float) -> np.ndarray:
    """Which points Douglas and Peucker's method keeps: ends, and where a point is farther than epsilon off its chord."""
    keep = np.zeros(len(xy), bool)
    if len(xy):
        keep[[0, -1]] = True
    spans = [(0, len(xy) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        chord, rest = xy[b] - xy[a], xy[a + 1 : b] - xy[a]
        length = float(np.hypot(*chord))
        off = np.abs(chord[0] * rest[:, 1] - chord[1] * rest[:, 0]) / length if length else np.hypot(rest[:, 0], rest[:, 1])
        most = int(np.argmax(off))
        if off[most] > epsilon:
            middle = a + 1 + most
            keep[middle] = True
            spans += [(a, middle), (middle, b)]
    return keep


def simplify(points: DataFrame, by: str, order: str, epsilon: float = 1e-4) -> DataFrame:
    """``points`` (lat, lon) without those that lie within epsilon degrees of the simplified track."""

    def thin(group):
        group = group.sort_values(order)
        return group[simplified(group[["lat", "lon"]].to_numpy(float), epsilon)]

    return points.groupBy(by).applyInPandas(thin, points.schema)
