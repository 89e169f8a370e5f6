"""Two-level map layout: members of an island are relaxed about their targets, islands are enclosed in circles, circles are
packed on a canvas that grows to hold them.

Forces are sums over arrays of near pairs. An island is one group of one map and fits a task; the packing of a map sees one
row an island.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators import layout, validate
from folioscope.operators.scan import scan
from folioscope.session import find_package

#: Fixed schedule, strengths and distances of the layout.
INNER_STEPS, INNER_CLEANUP, INNER_ALPHA, INNER_PULL, INNER_MOST = 260, 1200, (0.92, 0.34), 0.085, 4.5
OUTER_STEPS, OUTER_CLEANUP, OUTER_ALPHA, OUTER_MOST = 300, 5000, (0.94, 0.35), 8.0
PUSH, SOFT, RANGE, OLDER, LABEL_PUSH, LABEL_SHARE = 0.68, 0.035, 16.0, 0.04, 0.74, 0.18
ANCHOR, FIRM_ANCHOR, COHESION, CENTRE = 0.05, 0.1, 0.006, 0.0018
OUTER_PUSH, OUTER_SOFT, OUTER_RANGE = 0.72, 0.025, 24.0
PADDING, FIRM_PADDING = 24.0, 12.0


def exit_vectors(dx: np.ndarray, dy: np.ndarray, half_width: float, half_height: float, clear: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shortest moves that take circles, at (dx, dy) from a rectangle's centre, to the distance ``clear`` from it; 0 for
    those that are clear. A centre inside leaves by the nearest side."""
    ox, oy = dx - np.clip(dx, -half_width, half_width), dy - np.clip(dy, -half_height, half_height)
    out = np.hypot(ox, oy)
    outside = out > 1e-6
    part = np.where(outside & (out < clear), (clear - out) / np.where(outside, out, 1.0), 0.0)
    sides = np.stack([half_width + clear + dx, half_width + clear - dx, half_height + clear + dy, half_height + clear - dy])
    side = sides.argmin(0)
    least = np.where(outside, 0.0, sides.min(0))
    return ox * part + least * ((side == 1) * 1.0 - (side == 0)), oy * part + least * ((side == 3) * 1.0 - (side == 2))


def relax_island(
    x: np.ndarray, y: np.ndarray, r: np.ndarray, tx: np.ndarray, ty: np.ndarray, width: float, height: float, scale: float = 1.0
) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """(x, y, label x, label y, largest overlap) of one island's circles, given oldest first, about a label of that size.

    A target pulls each circle, near ones repel softly, overlaps push the later circle nearly alone, so that what is there
    stays put; then overlaps only. Overlaps that the schedule leaves are undone by ``layout.relax_near`` and by lifting circles off the label.
    """
    at = np.stack([x, y]).astype(float)
    label, target, gap = np.zeros(2), np.stack([tx, ty]), layout.PAPER_GAP * scale
    clear = r + layout.LABEL_GAP * scale

    def forces(soft: float, alpha: float) -> tuple[np.ndarray, np.ndarray, float]:
        move, worst = np.zeros_like(at), 0.0
        reach = float(2 * r.max(initial=0.0) + gap + RANGE * scale)
        for i, j in layout.close_pairs(at[0], at[1], reach) if len(r) > 1 else ():
            delta = at[:, j] - at[:, i]
            d = np.hypot(*delta)
            same = d < 1e-6
            delta[:, same] = np.stack([np.cos(i[same] + 2.4 * j[same]), np.sin(i[same] + 2.4 * j[same])])
            d[same] = 1.0
            want = r[i] + r[j] + gap
            worst = max(worst, float((want - d).max(initial=0.0)))
            force = PUSH * np.maximum(0, want - d) + soft * np.maximum(0, want + RANGE * scale - np.maximum(d, want))
            for k in (0, 1):
                push = force * alpha * delta[k] / d
                move[k] += np.bincount(j, push * (1 - OLDER), len(r)) - np.bincount(i, push * OLDER, len(r))
        away = np.stack(exit_vectors(at[0] - label[0], at[1] - label[1], width / 2, height / 2, clear))
        worst = max(worst, float(np.hypot(*away).max(initial=0.0)))
        shift = away * LABEL_PUSH * alpha
        return move + shift * (1 - LABEL_SHARE), -shift.sum(1) * LABEL_SHARE, worst

    for alpha in np.linspace(*INNER_ALPHA, INNER_STEPS):
        move, label_move, _ = forces(SOFT, alpha)
        at += np.clip(move + (target - at) * INNER_PULL, -INNER_MOST, INNER_MOST)
        label += np.clip(label_move, -INNER_MOST, INNER_MOST)
    worst = 0.0
    for _ in range(INNER_CLEANUP):
        move, label_move, worst = forces(0.0, 1.0)
        if worst <= layout.TOLERANCE / 2:
            break
        at += np.clip(move, -INNER_MOST, INNER_MOST)
        label += np.clip(label_move, -INNER_MOST, INNER_MOST)
    if worst > layout.TOLERANCE:
        px, py, _ = layout.relax_near(at[0], at[1], r, gap)
        away = np.stack(exit_vectors(px - label[0], py - label[1], width / 2, height / 2, clear))
        if np.hypot(*away).max(initial=0.0) > layout.TOLERANCE:  # the label goes below all circles
            label = np.array([px.mean(), float((py + clear).max()) + height / 2])
        at = np.stack([px, py])
        worst = forces(0.0, 1.0)[2]
    return at[0], at[1], float(label[0]), float(label[1]), worst


def pack_circles(x: np.ndarray, y: np.ndarray, r: np.ndarray, firm: np.ndarray, width: float, height: float, gap: float = layout.OUTER_GAP) -> tuple[np.ndarray, np.ndarray, float]:
    """(x, y, largest overlap) of a map's circles: pulled to where they were, to one another and to the centre, pushed
    apart; a firm one moves a quarter as readily. Then overlaps only, without walls."""
    at, home = np.stack([x, y]).astype(float), np.stack([x, y]).astype(float)
    size, mobility = np.array([[width], [height]]), np.where(firm, layout.MOBILITY, 1.0)
    margin = np.minimum(size / 2, r + layout.MARGIN)
    i, j = np.triu_indices(len(r), 1)
    at = np.clip(at, margin, size - margin)
    for alpha in np.linspace(*OUTER_ALPHA, OUTER_STEPS):
        move = (home - at) * np.where(firm, FIRM_ANCHOR, ANCHOR) + (at.mean(1, keepdims=True) - at) * COHESION + (size / 2 - at) * CENTRE
        delta = at[:, j] - at[:, i]
        d = np.hypot(*delta)
        same = d < 1e-6
        delta[:, same] = np.stack([np.cos(i[same] + 2.4 * j[same]), np.sin(i[same] + 2.4 * j[same])])
        d[same] = 1.0
        want = r[i] + r[j] + gap
        force = alpha * (OUTER_PUSH * np.maximum(0, want - d) + OUTER_SOFT * np.maximum(0, want + OUTER_RANGE - np.maximum(d, want)))
        share = mobility[j] / (mobility[i] + mobility[j])
        for k in (0, 1):
            push = force * delta[k] / d
            move[k] += np.bincount(j, push * share, len(r)) - np.bincount(i, push * (1 - share), len(r))
        at = np.clip(at + np.clip(move, -OUTER_MOST, OUTER_MOST), margin, size - margin)
    return layout.relax(at[0], at[1], r, gap, mobility, OUTER_CLEANUP)


INNER = "map string, group int, kind string, id long, x double, y double, radius double, overlap double"
OUTER = "map string, group int, x double, y double, radius double, content double, drift double, width double, height double, overlap double"


def arrange(members: DataFrame, islands: DataFrame, width: float = 1160.0, height: float = 780.0) -> tuple[DataFrame, DataFrame]:
    """(points, circles) of every map.

    ``members(map, group, id, rank, x, y, radius)`` are relative to their island, ``islands(map, group, x, y, label_width,
    label_height, firm)``. Points are (map, group, kind, id, x, y, radius) with kind paper or label, on the map; circles add their content's
    radius, how far they drifted, the canvas and the largest overlap.
    """
    aimed = layout.sunflower(members.select(F.struct("map", "group").alias("group"), "id", "rank", "x", "y", "radius"))
    keyed = members.join(aimed.select("group.map", "group.group", "id", "angle", "target"), ["map", "group", "id"])
    sized = keyed.join(islands.select("map", "group", "label_width", "label_height"), ["map", "group"])

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "id"])
        head = pdf.iloc[0]
        tx, ty = pdf["target"] * np.cos(pdf["angle"]), pdf["target"] * np.sin(pdf["angle"])
        r = pdf["radius"].to_numpy(float)
        x, y, lx, ly, worst = relax_island(tx.to_numpy(), ty.to_numpy(), r, tx.to_numpy(), ty.to_numpy(), head["label_width"], head["label_height"])
        corners = np.array([(lx + a * head["label_width"] / 2, ly + b * head["label_height"] / 2) for a in (-1, 1) for b in (-1, 1)])
        cx, cy, whole = layout.enclosing_circle(np.append(x, corners[:, 0]), np.append(y, corners[:, 1]), np.append(r, np.zeros(4)))
        rows = [("paper", i, a - cx, b - cy, q) for i, a, b, q in zip(pdf["id"], x, y, r)]
        rows += [("label", -1, lx - cx, ly - cy, 0.0), ("island", -1, cx, cy, whole)]
        out = pd.DataFrame(rows, columns=["kind", "id", "x", "y", "radius"])
        return out.assign(map=head["map"], group=head["group"], overlap=worst)[[f.strip().split(" ")[0] for f in INNER.split(",")]]

    find_package(sized.sparkSession)
    placed = sized.groupBy("map", "group").applyInPandas(inner, INNER)
    rings = placed.where("kind = 'island'").select("map", "group", F.col("x").alias("dx"), F.col("y").alias("dy"), F.col("radius").alias("content"))
    anchors = rings.join(islands, ["map", "group"])

    def outer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group")
        firm = pdf["firm"].to_numpy(bool)
        ax, ay = (pdf["x"] + pdf["dx"]).to_numpy(), (pdf["y"] + pdf["dy"]).to_numpy()
        r = pdf["content"].to_numpy() + np.where(firm, FIRM_PADDING, PADDING)
        x, y, worst = pack_circles(ax, ay, r, firm, width, height)
        drift, size = np.hypot(x - ax, y - ay), []
        for at, least in ((x, width), (y, height)):
            low, high = (at - r).min() - layout.MARGIN, (at + r).max() + layout.MARGIN
            size.append(max(least, np.ceil((high - low) / layout.CANVAS_STEP) * layout.CANVAS_STEP))
            at += max(-low, min(0.0, size[-1] - high))
        return pd.DataFrame(
            {"map": pdf["map"], "group": pdf["group"], "x": x, "y": y, "radius": r, "content": pdf["content"], "drift": drift,
             "width": size[0], "height": size[1], "overlap": worst}
        )

    circles = anchors.groupBy("map").applyInPandas(outer, OUTER)
    spot = circles.select("map", "group", F.col("x").alias("cx"), F.col("y").alias("cy"))
    points = placed.where("kind <> 'island'").join(spot, ["map", "group"]).select(
        "map", "group", "kind", "id", (F.col("x") + F.col("cx")).alias("x"), (F.col("y") + F.col("cy")).alias("y"), "radius", "overlap"
    )
    return points, circles


def in_geometry_order(bodies: DataFrame) -> DataFrame:
    """Bodies by x, then y, then radius: the order in which equal sets give equal circles."""
    return bodies.orderBy("x", "y", "radius")


def geometry_places(bodies: DataFrame) -> DataFrame:
    """``bodies(id, x, y, radius)`` with ``place``, from 1 in the order of ``in_geometry_order``, then by id; no task sorts them all."""
    return scan(bodies, [], ["x", "y", "radius", "id"], {"place": ("count", F.lit(1))})


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def geometry_violations(members: DataFrame, islands: DataFrame) -> DataFrame:
    """(rule, key, detail) of members and islands that can't be laid out: ids empty or repeated, coordinates or sizes not
    finite or below 0, ranks below 0 or repeated, an island unknown."""
    bad_member = ~(finite("x") & finite("y") & finite("radius")) | (F.col("radius") < 0) | ~(F.coalesce("rank", F.lit(-1)) >= 0)
    size = F.least("label_width", "label_height")
    bad_island = ~(finite("x") & finite("y") & finite("label_width") & finite("label_height")) | (size < 0)
    lost = members.join(islands.select("map", "group").distinct(), ["map", "group"], "left_anti")
    return validate.together(
        validate.rule(members, "member geometry", F.coalesce(bad_member, F.lit(True)), "id", F.concat_ws(",", "x", "y", "radius", "rank")),
        validate.rule(islands, "island geometry", F.coalesce(bad_island, F.lit(True)), "group", F.concat_ws(",", "x", "y", "label_width", "label_height")),
        validate.duplicates(members, "member id", ["map", "id"]),
        validate.duplicates(members.where("rank is not null"), "member rank", ["map", "rank"]),
        validate.duplicates(islands, "island id", ["map", "group"]),
        validate.rule(members, "empty id", F.col("id").isNull(), "group", F.col("rank")),
        validate.rule(lost, "unknown island", F.lit(True), "id", F.col("group")),
    )
