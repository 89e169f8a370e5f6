"""A map camera (x, y, zoom) as column expressions: screen = (world - centre) * zoom + middle of the screen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp_zoom(zoom: Column, least: float, most: float) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), zoom))


def wheel_zoom(zoom: Column, delta: Column, speed: float = 0.0015) -> Column:
    """Equal turns of the wheel multiply the zoom by equal factors."""
    return F.exp(F.log(zoom) - delta * speed)


def zoom_about(centre: Column, anchor: Column, zoom: Column, new: Column) -> Column:
    """The centre (one axis) that keeps the world point ``anchor`` where it is on the screen."""
    return anchor - (anchor - centre) * zoom / new


def fit(low: Column, high: Column, screen: float, margin: float, least: float, most: float) -> tuple[Column, Column]:
    """(centre, zoom) of one axis that shows low..high inside the margins."""
    room = F.greatest(F.lit(1.0), F.lit(screen - 2 * margin))
    return (low + high) / 2, clamp_zoom(room / F.greatest(high - low, F.lit(1e-9)), least, most)


def damp(now: Column, goal: Column, seconds: Column, half_life: float = 0.08) -> Column:
    """Approach that doesn't depend on the frame rate: half of the way is left after each half-life."""
    return goal + (now - goal) * F.pow(F.lit(0.5), seconds / half_life)


def pinch_zoom(zoom: Column, before: Column, after: Column) -> Column:
    """The zoom that makes two fingers' distance follow the world; fingers in one place change nothing."""
    return F.when((before > 1e-6) & (after > 1e-6), zoom * after / before).otherwise(zoom)


def keep_inside(centre: Column, zoom: Column, world: float, screen: float) -> Column:
    """The centre (one axis) nearest to the given one that shows no more outside of the world than needed."""
    half = F.lit(screen / 2) / zoom
    return F.when(half * 2 >= world, F.lit(world / 2)).otherwise(F.greatest(half, F.least(F.lit(world) - half, centre)))
