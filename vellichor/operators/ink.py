"""Pen strokes: arrays of points (x, y)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def kept_points(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Places of the points that a line simplified within tolerance keeps: the farthest from the chord, again on both sides."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    parts = [(0, len(points) - 1)]
    while parts:
        a, b = parts.pop()
        if b - a < 2:
            continue
        chord, between = points[b] - points[a], points[a + 1 : b] - points[a]
        length = np.hypot(*chord)
        away = np.abs(chord[0] * between[:, 1] - chord[1] * between[:, 0]) / length if length else np.hypot(between[:, 0], between[:, 1])
        k = int(away.argmax())
        if away[k] > tolerance:
            keep[a + 1 + k] = True
            parts += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.flatnonzero(keep)


def simplified(strokes: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(id, points) with fewer points."""

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for points in batch["points"]:
                xy = np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2)
                out.append([points[k] for k in kept_points(xy, tolerance)] if len(xy) > 2 else list(points))
            yield pd.DataFrame({"id": batch["id"], "points": out})

    return strokes.select("id", "points").mapInPandas(thin, f"id long, points {POINTS}")


def quantised(points: Column, height: float = 1000.0) -> Column:
    """Points moved to the origin and scaled to a height, as a flat array of integers."""
    left, top = F.array_min(F.transform(points, lambda p: p.x)), F.array_min(F.transform(points, lambda p: p.y))
    span = F.array_max(F.transform(points, lambda p: p.y)) - top
    scale = F.when(span > 0, height / span).otherwise(F.lit(1.0))
    return F.flatten(F.transform(points, lambda p: F.array(F.round((p.x - left) * scale).cast("int"), F.round((p.y - top) * scale).cast("int"))))


def svg_path(flat: Column) -> Column:
    """Path of a flat array of coordinates."""
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1), lambda i: F.concat(F.when(i == 0, "M").otherwise("L"), F.get(flat, i * 2), F.lit(" "), F.get(flat, i * 2 + 1)))
    return F.array_join(pairs, "")


def touches(points: Column, x: Column, y: Column, reach: float) -> Column:
    """Does a stroke come within reach of a place?"""
    return F.exists(points, lambda p: F.pow(p.x - x, 2) + F.pow(p.y - y, 2) <= reach * reach)


def is_strike(points: Column, least: float = 24.0, flat: float = 0.35) -> Column:
    """A stroke across text: long, flat, and hardly longer than its width."""
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    width, height = F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)
    steps = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points)), lambda a, b: F.sqrt(F.pow(a.x - b.x, 2) + F.pow(a.y - b.y, 2)))
    length = F.aggregate(steps, F.lit(0.0), lambda sum_, d: sum_ + d)
    return (F.size(points) >= 2) & (width >= least) & (height <= width * flat) & (length <= width * 1.5)


def is_valid(strokes: Column, most: int = 40_000) -> Column:
    """Ink: some strokes, each of an even number of coordinates, at least one point, not too many in all."""
    even = F.forall(strokes, lambda s: (F.size(s) >= 2) & (F.size(s) % 2 == 0))
    return (F.size(strokes) > 0) & even & (F.aggregate(strokes, F.lit(0), lambda n, s: n + F.size(s)) <= most)
