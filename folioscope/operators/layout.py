"""Layout operators: sunflower targets, grid neighbours, enclosing circles and packing."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import numbers
from folioscope.operators.scan import scan
from folioscope.session import find_package, materialize

#: Fixed layout constants.
DENSITY, BLEND, MAX_SHIFT, PAPER_GAP, LABEL_GAP = 0.58, 0.06, math.pi / 18, 8.0, 9.0
GOLDEN = math.pi * (3 - math.sqrt(5))
BLOCK = 4096  # ranks that one task runs through
MARGIN, CANVAS_STEP, OUTER_GAP, TOLERANCE, MOBILITY = 14.0, 8.0, 16.0, 1e-3, 0.25


def sunflower(points: DataFrame, label_width: float = 120, label_height: float = 34, scale: float = 1.0) -> DataFrame:
    """(group, id, angle, target): prefix-stable targets of each group's members in ``rank`` order.

    ``points(group, id, rank, x, y, radius)``, x and y relative to the group's centre, ranks whole numbers. Area accumulates, angles step by
    the golden angle and lean a little toward the member's own direction.
    """
    grown = F.col("radius") + PAPER_GAP * scale / 2
    running = {"index": ("count", F.lit(1)), "area": ("sum", math.pi * grown * grown)}
    df = scan(points, ["group"], ["rank", "id"], running, block=F.floor(F.col("rank") / BLOCK)).withColumn("index", F.col("index") - 1)
    phase = numbers.direction(F.col("group").cast("string"), F.lit("compact"))
    df = df.withColumn("compact", phase + F.col("index") * numbers.GOLDEN_ANGLE)
    own = F.when(F.hypot("x", "y") > 1e-9, F.atan2("y", "x")).otherwise(F.col("compact"))
    lean = numbers.clamp(numbers.fold_angle(own - F.col("compact")) * BLEND, -MAX_SHIFT, MAX_SHIFT)
    df = df.withColumn("angle", F.col("compact") + lean)
    clear = F.col("radius") + LABEL_GAP * scale
    leave = lambda half, d: F.when(F.abs(d) > 1e-9, (half + clear) / F.abs(d)).otherwise(F.lit(float("inf")))
    out = F.least(leave(F.lit(label_width / 2), F.cos("angle")), leave(F.lit(label_height / 2), F.sin("angle")))
    target = F.greatest(F.sqrt(F.col("area") / (math.pi * DENSITY)), out)
    return df.select("group", "id", "angle", target.alias("target"))


def grid_neighbours(points: DataFrame, radius: float) -> DataFrame:
    """(a, b, distance) of pairs nearer than ``radius``: each point meets the nine cells about its own, so the join is
    an equi-join on the cell and work follows the number of near pairs."""
    cell = lambda c: F.floor(F.col(c) / radius)
    home = points.select("id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    near = home.select("id", "x", "y", "cx", "cy", F.explode(step).alias("dx")).select("*", F.explode(step).alias("dy"))
    near = near.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    pairs = home.join(near, ["cx", "cy"]).where("id < b")
    distance = F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))
    return pairs.select(F.col("id").alias("a"), "b", distance.alias("distance")).where(F.col("distance") < radius)


def principal_axis_ratio(rows: DataFrame) -> DataFrame:
    """(group, ratio): root of the ratio of the covariance's eigenvalues."""
    m = rows.groupBy("group").agg(F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    half = F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, F.lit(2.0)) + F.col("xy") * F.col("xy"))
    mean = (F.col("xx") + F.col("yy")) / 2
    return m.select("group", F.sqrt((mean + half) / F.greatest(mean - half, F.lit(1e-12))).alias("ratio"))


def canvas(circles: DataFrame, width: float, height: float) -> DataFrame:
    """One row: canvas grown in steps of eight to hold all circles with a margin, and the shift into it."""
    ends = circles.agg(
        F.min(F.col("x") - F.col("radius") - MARGIN).alias("x0"), F.max(F.col("x") + F.col("radius") + MARGIN).alias("x1"),
        F.min(F.col("y") - F.col("radius") - MARGIN).alias("y0"), F.max(F.col("y") + F.col("radius") + MARGIN).alias("y1"),
    )
    grow = lambda need, asked: F.greatest(F.lit(float(asked)), F.ceil(need / CANVAS_STEP) * CANVAS_STEP)
    w, h = grow(F.col("x1") - F.col("x0"), width), grow(F.col("y1") - F.col("y0"), height)
    shift = lambda lo, hi, size: F.greatest(-lo, F.least(F.lit(0.0), size - hi))
    return ends.select(w.alias("width"), h.alias("height"), shift(F.col("x0"), F.col("x1"), w).alias("dx"), shift(F.col("y0"), F.col("y1"), h).alias("dy"))


def _about_two(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Smallest circle (x, y, radius) about two circles, neither of which holds the other."""
    d = math.hypot(b[0] - a[0], b[1] - a[1])
    if d <= abs(a[2] - b[2]):
        return None
    radius = (d + a[2] + b[2]) / 2
    part = (radius - a[2]) / d
    return np.array([a[0] + (b[0] - a[0]) * part, a[1] + (b[1] - a[1]) * part, radius])


def _about_three(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Circles that touch three circles from outside. With s the radius less a's, the differences of the three equations
    are linear in the centre; putting that into a's own equation leaves a quadratic in s, solved without cancellation."""
    d = np.stack([b - a, c - a])
    det = d[0, 0] * d[1, 1] - d[0, 1] * d[1, 0]
    if abs(det) < 1e-14 * max(1e-300, float(np.abs(d[:, :2]).max()) ** 2):
        return []
    k = (d[:, 0] ** 2 + d[:, 1] ** 2 - d[:, 2] ** 2) / 2
    inverse = np.array([[d[1, 1], -d[0, 1]], [-d[1, 0], d[0, 0]]]) / det
    slope, start = inverse @ d[:, 2], inverse @ k
    qa, qb, qc = slope @ slope - 1, slope @ start, start @ start
    root = qb * qb - qa * qc
    if root < 0:
        return []
    q = -(qb + math.copysign(math.sqrt(root), qb))
    found = ([q / qa] if abs(qa) > 1e-300 else []) + ([qc / q] if q else [])
    return [np.array([*(a[:2] + slope * s + start), a[2] + s]) for s in found if s >= 0]


def _smallest(bodies: np.ndarray, must: int) -> tuple[list[int], np.ndarray]:
    """Of at most four bodies, the smallest circle about all of them and the bodies it rests on, ``must`` among them."""
    best: tuple[list[int], np.ndarray] | None = None
    others = [i for i in range(len(bodies)) if i != must]
    options = [((must,), bodies[must])]
    options += [((must, i), c) for i in others if (c := _about_two(bodies[must], bodies[i])) is not None]
    options += [((must, i, j), c) for i, j in itertools.combinations(others, 2) for c in _about_three(bodies[must], bodies[i], bodies[j])]
    for ids, c in options:
        over = (np.hypot(bodies[:, 0] - c[0], bodies[:, 1] - c[1]) + bodies[:, 2]).max() - c[2]
        if over <= 1e-11 * max(1.0, c[2]) and (best is None or c[2] < best[1][2]):
            best = [*ids], c
    if best is None:  # rounding only: the widest option, grown to hold all
        ids, c = max(options, key=lambda o: o[1][2])
        best = [*ids], np.append(c[:2], (np.hypot(bodies[:, 0] - c[0], bodies[:, 1] - c[1]) + bodies[:, 2]).max())
    return best


def enclosing_circle(x: np.ndarray, y: np.ndarray, r: np.ndarray | None = None) -> tuple[float, float, float]:
    """Smallest circle (x, y, radius) about points or circles, exact to rounding.

    A circle rests on three bodies at most. Whenever a body sticks out, the farthest one joins them and the smallest circle about these
    four at most is worked out directly; its radius grows each time, so the search ends. Coordinates are scaled to the bodies' extent.
    """
    if not len(x):
        return 0.0, 0.0, 0.0
    bodies = np.stack([x, y, np.zeros(len(x)) if r is None else r], 1).astype(float)
    middle = np.append((bodies[:, :2].min(0) + bodies[:, :2].max(0)) / 2, 0.0)
    scale = float(max(np.abs(bodies[:, :2] - middle[:2]).max(), bodies[:, 2].max()))
    if scale == 0:
        return float(middle[0]), float(middle[1]), 0.0
    bodies = (bodies - middle) / scale
    held = [int(bodies[:, 2].argmax())]
    c = bodies[held[0]]
    while True:
        reach = np.hypot(bodies[:, 0] - c[0], bodies[:, 1] - c[1]) + bodies[:, 2]
        far = int(reach.argmax())
        if reach[far] <= c[2] * (1 + 1e-14) + 1e-14 or far in held:
            break
        ids = [*held, far]
        rest, wider = _smallest(bodies[ids], len(ids) - 1)
        if wider[2] <= c[2]:
            break
        held, c = [ids[k] for k in rest], wider
    radius = max(float(c[2]), float(reach[far]))
    return float(c[0] * scale + middle[0]), float(c[1] * scale + middle[1]), radius * scale


def enclosing_circles(points: DataFrame) -> DataFrame:
    """(group, n, x, y, radius), exact. A circle is made from few points of a group, at first its extremes in 256
    directions; then each group's farthest point outside its circle joins them, until no group has one (a point counts as
    outside beyond 1e-9 of the radius, and the radius ends at the farthest point). The points that a circle is made from are all that one task sees of a group."""
    points = materialize(points.select("group", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "circle-points")
    turns = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: i * F.lit(2 * math.pi / 256))
    spread = points.select("group", "x", "y", F.explode(turns).alias("turn"))
    along = F.col("x") * F.cos("turn") + F.col("y") * F.sin("turn")
    far = spread.groupBy("group", "turn").agg(F.max(F.struct(along.alias("along"), "x", "y")).alias("p")).select("group", "p.x", "p.y")
    held = materialize(far.distinct(), "circle-support")
    kind = "group int, x double, y double, radius double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        c = enclosing_circle(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float))
        return pd.DataFrame({"group": [pdf["group"].iloc[0]], "x": [c[0]], "y": [c[1]], "radius": [c[2]]})

    while True:
        find_package(held.sparkSession)
        circles = materialize(held.groupBy("group").applyInPandas(one, kind), "circles")
        about = circles.select("group", F.col("x").alias("cx"), F.col("y").alias("cy"), "radius")
        gone = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
        last = points.join(about, "group").groupBy("group", "radius").agg(F.max(F.struct(gone.alias("gone"), "x", "y")).alias("p"))
        last = materialize(last.select("group", "radius", "p.*"), "circle-farthest")
        out = last.where(F.col("gone") > F.col("radius") * (1 + 1e-9) + 1e-12).select("group", "x", "y")
        more = materialize(out.join(held, ["group", "x", "y"], "left_anti"), "circle-more")
        if more.isEmpty():
            break
        held = materialize(held.union(more), "circle-support")
    sizes = points.groupBy("group").agg(F.count("*").alias("n"))
    ends = last.select("group", F.greatest("radius", "gone").alias("radius"))  # the last bits too: no point is outside
    return circles.drop("radius").join(ends, "group").join(sizes, "group").select("group", "n", "x", "y", "radius")


def relax(x: np.ndarray, y: np.ndarray, r: np.ndarray, gap: float, mobility: np.ndarray | None = None, steps: int = 5000) -> tuple[np.ndarray, np.ndarray, float]:
    """Pushes overlapping circles apart until none overlaps by more than the tolerance; (x, y, largest overlap)."""
    x, y = x.astype(float).copy(), y.astype(float).copy()
    m = np.ones(len(x)) if mobility is None else mobility
    i, j = np.triu_indices(len(x), 1)
    worst = 0.0
    for _ in range(steps):
        dx, dy = x[j] - x[i], y[j] - y[i]
        d = np.hypot(dx, dy)
        apart = np.where(d < 1e-9)[0]
        dx[apart], dy[apart], d[apart] = np.cos(apart + 1.0), np.sin(apart + 1.0), 1.0
        over = r[i] + r[j] + gap - np.where(np.isin(np.arange(len(d)), apart), 0.0, d)
        worst = float(over.max(initial=0.0))
        if worst <= TOLERANCE / 2:
            break
        hit = over > 0
        a, b = i[hit], j[hit]
        share = over[hit] / (m[a] + m[b]) / d[hit]
        np.add.at(x, a, -share * dx[hit] * m[a])
        np.add.at(y, a, -share * dy[hit] * m[a])
        np.add.at(x, b, share * dx[hit] * m[b])
        np.add.at(y, b, share * dy[hit] * m[b])
    return x, y, max(0.0, worst)


def close_pairs(x: np.ndarray, y: np.ndarray, reach: float, block: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j nearer than ``reach`` (and some others), about ``block`` at a time: each point meets the
    cells of size ``reach`` about its own. Memory follows the block, not the number of pairs."""
    cx, cy = np.floor(x / reach).astype(np.int64), np.floor(y / reach).astype(np.int64)
    cx, cy = cx - cx.min(), cy - cy.min()
    high = int(cy.max()) + 3
    cell = cx * high + cy
    order = np.argsort(cell.astype(np.uint16) if cell.max() < 1 << 16 else cell, kind="stable")  # short ones by radix
    ranked = cell[order]
    dense = int(ranked[-1]) < 16 * len(cell) + (1 << 16)  # then a table of where each cell begins
    firsts = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=int(ranked[-1]) + high + 2))]) if dense else None
    for step in (0, 1, high - 1, high, high + 1):  # itself and half of its neighbours; the others find it
        if dense:
            start, end = firsts[ranked + step], firsts[ranked + step + 1]
        else:
            start, end = np.searchsorted(ranked, ranked + step), np.searchsorted(ranked, ranked + step, "right")
        if not step:
            start = np.arange(1, len(order) + 1)
        n = np.maximum(end - start, 0)
        upto = np.concatenate([[0], np.cumsum(n)])
        for low in range(0, int(upto[-1]), block):
            last = min(low + block, int(upto[-1]))
            a0, a1 = np.searchsorted(upto, [low, last - 1], "right") - 1
            times = np.minimum(upto[a0 + 1 : a1 + 2], last) - np.maximum(upto[a0 : a1 + 1], low)
            i = np.repeat(order[a0 : a1 + 1], times)
            j = order[np.arange(low, last) + np.repeat((start - upto[:-1])[a0 : a1 + 1], times)]
            yield np.minimum(i, j), np.maximum(i, j)


def relax_near(x: np.ndarray, y: np.ndarray, r: np.ndarray, gap: float, steps: int = 5000) -> tuple[np.ndarray, np.ndarray, float]:
    """``relax`` for groups of any size: the same moves, over near pairs only, which are all that can overlap. Overlaps left
    after ``steps`` are undone by widening the whole layout about its mean, so none stays above the tolerance."""
    x, y = x.astype(float).copy(), y.astype(float).copy()
    reach, worst = float(2 * r.max() + gap), 0.0
    if reach <= 0:
        return x, y, 0.0
    even, limit = r.min() == r.max(), reach**2 * (1 + 1e-9) + 1e-17
    for step in itertools.count(1):
        mx, my, worst, ratio = np.zeros(len(x)), np.zeros(len(x)), 0.0, 1.0
        for i, j in close_pairs(x, y, reach):
            dx, dy = x[j] - x[i], y[j] - y[i]
            near = np.flatnonzero(dx * dx + dy * dy < (limit if even else (r[i] + r[j] + gap) ** 2 * (1 + 1e-9) + 1e-17))  # the only ones to overlap
            i, j, dx, dy = i[near], j[near], dx[near], dy[near]
            d = np.hypot(dx, dy)
            over = r[i] + r[j] + gap - d
            same = np.where(d < 1e-9)[0]
            angle = i[same] * GOLDEN + j[same]
            dx[same], dy[same], d[same] = np.cos(angle), np.sin(angle), 1.0
            worst = max(worst, float(over.max(initial=0.0)))
            ratio = max(ratio, float(((d + over) / d).max(initial=1.0)) if not len(same) else math.inf)
            hit = over > 0
            a, b, share = i[hit], j[hit], over[hit] / 2 / d[hit]
            for move, part in ((mx, share * dx[hit]), (my, share * dy[hit])):
                move += np.bincount(b, part, len(x)) - np.bincount(a, part, len(x))
        if worst <= TOLERANCE / 2:
            break
        if step >= steps and ratio < 2:
            x, y = x.mean() + (x - x.mean()) * ratio, y.mean() + (y - y.mean()) * ratio
        else:
            x, y = x + mx, y + my
    return x, y, worst


def pack(points: DataFrame, gap: float = PAPER_GAP) -> DataFrame:
    """(group, id, x, y, overlap): members of each group moved apart, groups independent of one another.

    A group is an island of one map and is packed by one task, by near pairs, in memory that follows the number of members.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "id"]).reset_index(drop=True)
        x, y, worst = relax_near(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["radius"].to_numpy(float), gap)
        return pd.DataFrame({"group": pdf["group"], "id": pdf["id"], "x": x, "y": y, "overlap": worst})

    find_package(points.sparkSession)
    return points.groupBy("group").applyInPandas(one, "group int, id long, x double, y double, overlap double")


#: Fixed values of spiral placement: tries, first radius and its step, turn, flattening, share of the first anchor, distance to
#: other places, and the borders.
TRIES, FIRST, GROWTH, TURN, FLAT, OWN, APART, BORDERS = 72, 2.5, 0.55, 2.399963, 0.78, 0.78, 4.6, (4.0, 96.0)


def spiral_place(seed: str, anchors: list[tuple[float, float]], taken: list[tuple[float, float]]) -> tuple[float, float]:
    """The first free one of a spiral's places, whose start angle comes from a digest of the id. It winds about the first
    anchor, drawn toward the mean of the others if there are any."""
    own, rest = np.array(anchors[0], float), np.array(anchors[1:], float).reshape(-1, 2)
    centre = OWN * own + (1 - OWN) * rest.mean(0) if len(rest) else own
    tenths = int(hashlib.sha256(seed.encode()).hexdigest()[:12], 16) % 3600
    k = np.arange(TRIES)
    turn, reach = math.radians(tenths / 10) + TURN * k, FIRST + GROWTH * k
    places = np.clip(np.stack([centre[0] + reach * np.cos(turn), centre[1] + FLAT * reach * np.sin(turn)], 1), *BORDERS)
    others = np.array(taken, float).reshape(-1, 2)
    nearest = np.hypot(*(places[:, None] - others[None]).transpose(2, 0, 1)).min(1, initial=math.inf)
    free = np.flatnonzero(nearest >= APART)
    if not len(free):
        raise ValueError(f"no free place for {seed}")
    x, y = places[free[0]]
    return round(float(x), 2), round(float(y), 2)


def overlap_column(d: Column, r1: Column, r2: Column, gap: float = OUTER_GAP) -> Column:
    return F.greatest(F.lit(0.0), r1 + r2 + gap - d)


def exit_columns(dx: Column, dy: Column, half_width: float, half_height: float, clear: Column) -> Column:
    """struct<x, y>: the shortest move that takes a circle, at (dx, dy) from a rectangle's centre, to the distance ``clear`` from
    it; 0 if it is clear. A centre inside leaves by the nearest side, the first of left, right, top and bottom among equals."""
    ox = dx - numbers.clamp(dx, -half_width, half_width)
    oy = dy - numbers.clamp(dy, -half_height, half_height)
    out = F.hypot(ox, oy)
    part = F.when(out < clear, (clear - out) / out).otherwise(0.0)
    ways = [(F.lit(half_width) + clear + dx, -1.0, 0.0), (F.lit(half_width) + clear - dx, 1.0, 0.0), (F.lit(half_height) + clear + dy, 0.0, -1.0), (F.lit(half_height) + clear - dy, 0.0, 1.0)]
    least = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(k).alias("k"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, (d, x, y) in enumerate(ways)]))
    inside = F.struct((least["d"] * least["x"]).alias("x"), (least["d"] * least["y"]).alias("y"))
    return F.when(out > 1e-6, F.struct((ox * part).alias("x"), (oy * part).alias("y"))).otherwise(inside)
