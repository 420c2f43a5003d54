"""Spatial predicates on GeoJSON text, as Column expressions; no Python runs on the rows.

Points, multi-points, line strings, polygons and multi-polygons are read into rings of positions. The geometry
given in the query is a literal, so its edges are unrolled into the expression's arrays. ``geometry`` columns
are planar, in the units of the coordinates; ``geography`` distances are metres on a sphere. Anything that isn't
such a geometry is null and matches nothing.
"""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8


def as_geometry(value: Any) -> dict:
    """A GeoJSON object from a dict or its text."""
    out = json.loads(value) if isinstance(value, str) else value
    if not isinstance(out, dict) or "type" not in out or "coordinates" not in out:
        raise ValueError("a GeoJSON geometry is needed")
    return out


def rings(geometry: dict) -> tuple[list[list[list[float]]], bool]:
    """(lists of positions, whether they bound an area)."""
    kind, c = geometry["type"], geometry["coordinates"]
    lists = {"Point": lambda: [[c]], "MultiPoint": lambda: [[p] for p in c], "LineString": lambda: [c], "MultiLineString": lambda: c, "Polygon": lambda: c, "MultiPolygon": lambda: [r for p in c for r in p]}
    if kind not in lists:
        raise ValueError(f"unsupported geometry {kind}")
    return [[[float(x) for x in p[:2]] for p in ring] for ring in lists[kind]()], kind.endswith("Polygon")


def column_rings(column: Column) -> tuple[Column, Column]:
    """The same of a column: array<array<array<double>>> and a boolean."""
    kind = F.get_json_object(column, "$.type")
    raw = F.get_json_object(column, "$.coordinates")
    point, line, area, many = "array<double>", "array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"
    out = (
        F.when(kind == "Point", F.array(F.array(F.from_json(raw, point))))
        .when(kind == "MultiPoint", F.transform(F.from_json(raw, line), lambda p: F.array(p)))
        .when(kind == "LineString", F.array(F.from_json(raw, line)))
        .when(kind.isin("Polygon", "MultiLineString"), F.from_json(raw, area))
        .when(kind == "MultiPolygon", F.flatten(F.from_json(raw, many)))
    )
    return out, kind.isin("Polygon", "MultiPolygon")


def _edges_literal(lists) -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for ring in lists for a, b in zip(ring, ring[1:] or ring, strict=False)]


def _edges(lists: Column) -> Column:
    """All edges as structs x1 y1 x2 y2; a single position is an edge of no length."""

    def of(ring: Column) -> Column:
        last = F.greatest(F.size(ring) - 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(ring[i - 1][0].alias("x1"), ring[i - 1][1].alias("y1"), F.coalesce(F.get(ring, i)[0], ring[i - 1][0]).alias("x2"), F.coalesce(F.get(ring, i)[1], ring[i - 1][1]).alias("y2")))

    return F.flatten(F.transform(lists, of))


def _literal_edges(edges) -> Column:
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(e, ("x1", "y1", "x2", "y2"), strict=True)]) for e in edges])


def _inside(x: Column, y: Column, edges: Column) -> Column:
    """Whether a position lies inside the area (even-odd rule), borders apart."""
    crossings = F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    return F.size(crossings) % 2 == 1


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _on(e: Column, x, y) -> Column:
    return (_turn(e["x1"], e["y1"], e["x2"], e["y2"], x, y) == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))


def _meet(a: Column, b: Column) -> Column:
    """Whether two edges share a position."""
    d1, d2 = _turn(a["x1"], a["y1"], a["x2"], a["y2"], b["x1"], b["y1"]), _turn(a["x1"], a["y1"], a["x2"], a["y2"], b["x2"], b["y2"])
    d3, d4 = _turn(b["x1"], b["y1"], b["x2"], b["y2"], a["x1"], a["y1"]), _turn(b["x1"], b["y1"], b["x2"], b["y2"], a["x2"], a["y2"])
    crossing = (d1 * d2 < 0) & (d3 * d4 < 0)
    return crossing | _on(a, b["x1"], b["y1"]) | _on(a, b["x2"], b["y2"]) | _on(b, a["x1"], a["y1"]) | _on(b, a["x2"], a["y2"])


def intersects(column: Column, value: Any) -> Column:
    lists, area = rings(as_geometry(value))
    fixed = _literal_edges(_edges_literal(lists))
    own, own_area = column_rings(column)
    edges = _edges(own)
    x0, y0 = (F.lit(v) for v in lists[0][0])
    touch = F.exists(edges, lambda a: F.exists(fixed, lambda b: _meet(a, b)))
    within_own = own_area & _inside(x0, y0, edges)
    within_fixed = F.exists(own, lambda r: _inside(r[0][0], r[0][1], fixed)) if area else F.lit(False)
    return F.when(own.isNotNull(), touch | within_own | within_fixed)


def within(column: Column, value: Any) -> Column:
    """No position outside the area, and not all on its border."""
    lists, area = rings(as_geometry(value))
    own, _ = column_rings(column)
    if not area:
        return F.when(own.isNotNull(), F.lit(False))
    fixed = _literal_edges(_edges_literal(lists))
    positions = F.flatten(own)
    border = lambda p: F.exists(fixed, lambda e: _on(e, p[0], p[1]))
    all_in = F.forall(positions, lambda p: border(p) | _inside(p[0], p[1], fixed))
    middle = F.transform(_edges(own), lambda e: F.array((e["x1"] + e["x2"]) / 2, (e["y1"] + e["y2"]) / 2))
    return F.when(own.isNotNull(), all_in & F.forall(middle, lambda p: border(p) | _inside(p[0], p[1], fixed)) & F.exists(F.concat(positions, middle), lambda p: _inside(p[0], p[1], fixed) & ~border(p)))


def _planar(e: Column, x, y) -> Column:
    """Distance of a position from an edge."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / length))).otherwise(F.lit(0.0))
    return F.hypot(x - (e["x1"] + t * dx), y - (e["y1"] + t * dy))


def _great_circle(x1, y1, x2, y2) -> Column:
    a = F.pow(F.sin(F.radians(y2 - y1) / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def d_within(column: Column, value: Any, distance: float, geography: bool = False) -> Column:
    geometry = as_geometry(value)
    if not isinstance(distance, (int, float)) or isinstance(distance, bool) or not math.isfinite(distance) or distance < 0:
        raise ValueError("distance must be a number of 0 or more")
    lists, _ = rings(geometry)
    own, _ = column_rings(column)
    points = [p for ring in lists for p in ring]
    if geography:  # between positions; edges of both sides count by their ends
        near = F.exists(F.flatten(own), lambda p: F.least(*([_great_circle(p[0], p[1], F.lit(x), F.lit(y)) for x, y in points] * (2 if len(points) == 1 else 1))) <= distance)
        return F.when(own.isNotNull(), near)
    fixed, edges = _literal_edges(_edges_literal(lists)), _edges(own)
    near = F.exists(F.flatten(own), lambda p: F.exists(fixed, lambda e: _planar(e, p[0], p[1]) <= distance))
    for x, y in points:
        near = near | _near_edge(edges, x, y, distance)
    return F.when(own.isNotNull(), near | intersects(column, geometry))


def _near_edge(edges: Column, x: float, y: float, distance: float) -> Column:
    return F.exists(edges, lambda e: _planar(e, F.lit(x), F.lit(y)) <= distance)
