"""Predicates and selections."""

from __future__ import annotations

import json
import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pulseframe.functions.scalar import canonical_name, finite_or_null, parse_number_locale, within_range
from pulseframe.operators.neighbours import cell_index
from pulseframe.operators.ranking import global_row_number, smallest_per_group
from pulseframe.schema import PROTECTED_EXACT

_COMPARE = {"=": "__eq__", "!=": "__ne__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}


def _number(text: str) -> float:
    text = text.strip()
    value = float(text.replace(",", ".") if "," in text and "." not in text else text)
    if not math.isfinite(value):
        raise ValueError("enter a finite number")
    return value


def rule_condition(rule: dict) -> Column:
    """Boolean Column of one rule ``{"field", "op", "text"}``; false for a missing value."""
    value = finite_or_null(rule["field"])
    op, text = rule["op"], str(rule.get("text", ""))
    if op == "missing":
        return value.isNull()
    if op == "finite":
        return value.isNotNull()
    if op == "codes":
        codes = [_number(t) for t in re.split(r"[,;\s]+", text) if t]
        if not codes or any(not 0 <= c <= 255 or c != int(c) for c in codes):
            raise ValueError("class codes are integers in 0..255")
        hit = value.isin(*codes)
    elif op == "range":
        bounds = [_number(t) for t in text.split(";")]
        if len(bounds) != 2 or bounds[0] > bounds[1]:
            raise ValueError("an interval is written minimum;maximum")
        hit = value.between(*bounds)
    elif op in _COMPARE:
        hit = getattr(value, _COMPARE[op])(_number(text))
    else:
        raise ValueError(f"unknown operator {op!r}")
    return F.coalesce(hit, F.lit(False))


def select_points(df: DataFrame, rules: list[dict] | str) -> DataFrame:
    """Rows that satisfy every rule (a list or its JSON text)."""
    rules = json.loads(rules) if isinstance(rules, str) else rules
    if not rules:
        raise ValueError("add at least one rule")
    return df.where(reduce(lambda a, b: a & b, [rule_condition(r) for r in rules]))


def review_status(ground: Column, rules: dict[str, tuple[float, float]]) -> Column:
    """0 for ground or when every inclusive range holds, else 1 (missing fails)."""
    inside = [within_range(finite_or_null(c), lo, hi) for c, (lo, hi) in rules.items()]
    if not inside:
        return F.lit(0)
    return F.when(F.coalesce(ground, F.lit(False)), 0).when(reduce(lambda a, b: a & b, inside), 0).otherwise(1)


def range_review(df: DataFrame, rules: dict[str, tuple[float, float]], ground: str = "is_ground") -> DataFrame:
    return df.withColumn("review_status", review_status(F.col(ground), rules))


def refine_proposal(df: DataFrame, rules: dict[str, tuple[float, float]], *, ground: str = "is_ground",
                    proposal: str = "proposal", proposed: str = "proposed_class") -> DataFrame:
    """A proposal that fails the ranges is withdrawn: proposal 0 and class 1."""
    reviewed = range_review(df, rules, ground)
    failed = (F.col(proposal) == 1) & (F.col("review_status") == 1)
    return reviewed.withColumns({proposal: F.when(failed, 0).otherwise(F.col(proposal)),
                                 proposed: F.when(failed, 1).otherwise(F.col(proposed))})


def polygon_condition(polygon: list[tuple[float, float]], x: Column, y: Column) -> Column:
    """Even-odd rule with boundary and vertices included; under three vertices nothing."""
    if len(polygon) < 3:
        return F.lit(False)
    on_edge, crossings = F.lit(False), F.lit(0)
    for (ax, ay), (bx, by) in zip([polygon[-1], *polygon[:-1]], polygon):
        cross = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
        tolerance = 1e-9 * max(1.0, math.hypot(bx - ax, by - ay))
        on_edge = on_edge | ((F.abs(cross) <= tolerance)
                             & x.between(min(ax, bx) - 1e-9, max(ax, bx) + 1e-9)
                             & y.between(min(ay, by) - 1e-9, max(ay, by) + 1e-9))
        if ay != by:
            straddles = (F.lit(ay) > y) != (F.lit(by) > y)
            left = x < F.lit(bx - ax) * (y - ay) / F.lit(by - ay) + ax
            crossings = crossings + F.when(straddles & left, 1).otherwise(0)
    return F.coalesce(on_edge | (crossings % 2 == 1), F.lit(False))


def in_polygon(df: DataFrame, polygon: list[tuple[float, float]], x: str = "x", y: str = "y") -> DataFrame:
    # The bounding box comes first: it reaches the scan as a plain range filter.
    if len(polygon) >= 3:
        xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
        df = df.where(F.col(x).between(min(xs) - 1e-9, max(xs) + 1e-9) & F.col(y).between(min(ys) - 1e-9, max(ys) + 1e-9))
    return df.where(polygon_condition(polygon, F.col(x), F.col(y)))


def in_polygons(df: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """``(point_id, polygon_id)`` for many polygons given as ``polygon_id, seq, px, py``.

    A polygon is one row with its edges and is listed in the grid cells of its
    bounding box; a point meets only the polygons of its own cell.
    """
    order = Window.partitionBy("polygon_id").orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = rings.withColumns({"ax": F.coalesce(F.lag("px").over(order), F.last("px").over(whole)),
                               "ay": F.coalesce(F.lag("py").over(order), F.last("py").over(whole))})
    polygons = edges.groupBy("polygon_id").agg(
        F.collect_list(F.struct("ax", "ay", "px", "py")).alias("edges"),
        *[f(f"p{a}").alias(f"{n}_{a}") for a in "xy" for n, f in (("lo", F.min), ("hi", F.max))]).where(F.size("edges") >= 3)

    def covered(axis: str):
        return F.explode(F.sequence(F.floor((F.col(f"lo_{axis}") - 1e-9) / cell), F.floor((F.col(f"hi_{axis}") + 1e-9) / cell)))

    listed = polygons.withColumn("bc", covered("x")).withColumn("br", covered("y"))
    pts = df.select("point_id", "x", "y", F.floor(F.col("x") / cell).alias("bc"), F.floor(F.col("y") / cell).alias("br"))
    on_edge = ("abs((x - e.ax) * (e.py - e.ay) - (y - e.ay) * (e.px - e.ax)) <= 1e-9D * greatest(1.0D, hypot(e.px - e.ax, e.py - e.ay))"
               " AND x BETWEEN least(e.ax, e.px) - 1e-9D AND greatest(e.ax, e.px) + 1e-9D"
               " AND y BETWEEN least(e.ay, e.py) - 1e-9D AND greatest(e.ay, e.py) + 1e-9D")
    crossed = "(e.ay > y) <> (e.py > y) AND x < (e.px - e.ax) * (y - e.ay) / nullif(e.py - e.ay, 0.0D) + e.ax"
    inside = f"exists(edges, e -> {on_edge}) OR size(filter(edges, e -> {crossed})) % 2 = 1"
    box = "x BETWEEN lo_x - 1e-9D AND hi_x + 1e-9D AND y BETWEEN lo_y - 1e-9D AND hi_y + 1e-9D"
    return pts.join(listed, ["bc", "br"]).where(box).where(inside).select("point_id", "polygon_id")


def view_basis(view: str, *, normal: tuple[float, float, float] = (0.0, 1.0, 0.0),
               yaw: float = -math.pi / 4, pitch: float = math.pi / 6):
    """``(right, up)`` unit vectors of a named camera."""
    # The axis-aligned cameras.
    fixed = {
        "top": ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0)),
        "bottom": ((-1.0, 0.0, 0.0), (0.0, 1.0, 0.0)),
        "front": ((1.0, 0.0, 0.0), (0.0, 0.0, 1.0)),
        "back": ((-1.0, 0.0, 0.0), (0.0, 0.0, 1.0)),
        "right": ((0.0, 1.0, 0.0), (0.0, 0.0, 1.0)),
        "left": ((0.0, -1.0, 0.0), (0.0, 0.0, 1.0)),
    }
    if view in fixed:
        return fixed[view]
    if view in ("section_front", "section_back"):
        side = 1.0 if view == "section_front" else -1.0
        # A section across an axis: 0 and 1 stand upright, 2 lies flat and is seen from above or below.
        if normal == (0.0, 0.0, 1.0):
            return (side, 0.0, 0.0), (0.0, 1.0, 0.0)
        if abs(normal[2]) > 1e-12 or math.hypot(normal[0], normal[1]) < 1e-12:
            raise ValueError("a section's normal is an axis or lies in the plane")
        return (side * normal[1], -side * normal[0], 0.0), (0.0, 0.0, 1.0)
    if view == "orbit":
        sin, cos = math.sin, math.cos
        return (-sin(yaw), cos(yaw), 0.0), (-cos(yaw) * sin(pitch), -sin(yaw) * sin(pitch), cos(pitch))
    raise ValueError(f"unknown view {view!r}")


def section_axis(axis: int) -> tuple[float, float, float]:
    """Normal of a section across axis 0 (x), 1 (y) or 2 (z)."""
    if axis not in (0, 1, 2):
        raise ValueError("section axes are 0, 1 and 2")
    return tuple(1.0 if i == axis else 0.0 for i in range(3))


def project(df: DataFrame, view: str, center: tuple[float, float, float] = (0.0, 0.0, 0.0), **camera) -> DataFrame:
    """Add screen coordinates ``u, v`` of a camera looking at ``center``."""
    right, up = view_basis(view, **camera)

    def along(axis):
        return reduce(lambda a, b: a + b, [(F.col(n) - c) * w for n, c, w in zip("xyz", center, axis)])

    return df.withColumns({"u": along(right), "v": along(up)})


def oblique_normal(angle: float) -> tuple[float, float, float]:
    """Normal of a vertical section turned by ``angle`` radians."""
    return -math.sin(angle), math.cos(angle), 0.0


def section_slab(df: DataFrame, normal: tuple[float, float, float], centre: float, thickness: float) -> DataFrame:
    """Rows within half the thickness of the plane ``normal . p = centre``."""
    if thickness < 0:
        raise ValueError("thickness must not be negative")
    distance = F.col("x") * normal[0] + F.col("y") * normal[1] + F.col("z") * normal[2] - centre
    return df.where(F.abs(distance) <= thickness / 2.0)


def wand(df: DataFrame, seed_id: int, radius: float, field: str | None = None, tolerance: float = 0.0) -> DataFrame:
    """Rows in the sphere around the seed point whose field is close to the seed's."""
    names = ["x", "y", "z"] + ([field] if field else [])
    seed = df.where(F.col("point_id") == seed_id).select(*[F.col(n).alias(f"_{n}") for n in names]).first()
    if seed is None:
        raise ValueError(f"no point {seed_id}")
    d2 = reduce(lambda a, b: a + b, [(F.col(a) - seed[f"_{a}"]) * (F.col(a) - seed[f"_{a}"]) for a in "xyz"])
    box = reduce(lambda a, b: a & b, [F.col(a).between(seed[f"_{a}"] - radius * (1 + 1e-9), seed[f"_{a}"] + radius * (1 + 1e-9)) for a in "xyz"])
    hit = box & (d2 <= radius * radius)
    if field:
        if seed[f"_{field}"] is None:
            return df.limit(0)
        hit = hit & (F.abs(finite_or_null(field) - float(seed[f"_{field}"])) <= tolerance)
    return df.where(hit)


def combine_selection(current: DataFrame, hit: DataFrame, mode: str) -> DataFrame:
    """Selections are sets of ``point_id``: new, add or subtract."""
    current, hit = current.select("point_id"), hit.select("point_id")
    if mode == "new":
        return hit.distinct()
    if mode == "add":
        return current.union(hit).distinct()
    if mode == "subtract":
        return current.join(hit, "point_id", "left_anti").distinct()
    raise ValueError(f"unknown mode {mode!r}")


def thin_percent(df: DataFrame, percent: int, order: tuple[str, ...] = ("point_id",)) -> DataFrame:
    """Systematic sample of exactly ``ceil(n * percent / 100)`` rows, evenly spread in order."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is 1..100")
    if percent == 100:
        return df
    ranked = global_row_number(df.select("point_id", *[c for c in order if c != "point_id"]), order)
    # Row i is kept when the running quota reaches a new whole number.
    kept = ranked.where(F.expr(f"(row_number * {percent} + {100 - percent}) div 100"
                               f" > ((row_number - 1) * {percent} + {100 - percent}) div 100"))
    return df.join(kept.select("point_id"), "point_id", "left_semi")


def confidence_filter(df: DataFrame, threshold: float, prediction: str = "pred_class",
                      confidence: str = "confidence") -> DataFrame:
    value = finite_or_null(confidence)
    return df.where(finite_or_null(prediction).isNotNull() & value.isNotNull() & (value >= threshold))


_TEXT_MATCH = {
    "contains": lambda a, q: F.contains(a, q),
    "not_contains": lambda a, q: ~F.contains(a, q),
    "starts": lambda a, q: F.startswith(a, q),
    "ends": lambda a, q: F.endswith(a, q),
    "=": lambda a, q: a == q,
    "!=": lambda a, q: a != q,
}


def protected_field(name: Column) -> Column:
    """Names the workflow owns: own outputs, class, return metadata, source index."""
    return canonical_name(name).isin(*PROTECTED_EXACT, "originalcloudindex")


def search_fields(stats: DataFrame, field: str, op: str, query: str) -> DataFrame:
    """Columns (rows of a field statistics table) that match by text or by a statistic."""
    if not query.strip():
        return stats
    if field in ("name", "status"):
        status = (F.when(protected_field(F.col("field")), "Protected")
                  .when(F.col("finite").isNull(), "Not analysed")
                  .when(F.col("finite") == 0, "Empty").otherwise("Contains values"))
        actual = F.lower(F.col("field") if field == "name" else status)
        return stats.where(_TEXT_MATCH[op](actual, F.lower(F.lit(query))))
    total = F.col("finite") + F.col("missing")
    actual = {"minimum": F.col("minimum"), "maximum": F.col("maximum"), "mean": F.col("mean"),
              "valid": F.col("finite").cast("double"), "missing": F.col("missing").cast("double"),
              "missing_percent": F.when(total > 0, 100.0 * F.col("missing") / total).otherwise(0.0)}[field]
    expected = parse_number_locale(F.lit(query))
    return stats.where(F.coalesce(getattr(actual, _COMPARE[op])(expected), F.lit(False)))


# Two primes below 2**31; products of two residues stay below 2**62.
MIX_PRIMES = (2147483647, 2147483629)
MIX_DOMAIN = MIX_PRIMES[0] * MIX_PRIMES[1]


def mix(*columns, seed: int = 0) -> Column:
    """Portable pseudo-random integer in [0, MIX_DOMAIN), about 2**62 values.

    Used wherever a repeatable order is needed that any SQL engine reproduces.  Two lanes, each
    folding the columns in by multiplications of the state with its own shift modulo a prime: not
    linear, so another seed is another order and not a rotation of the same one.
    """
    lanes = []
    for lane, p in enumerate(MIX_PRIMES):
        h = F.lit((seed * 7919 + 12345 + lane) % p).cast("long")
        for c in columns:
            c = (c if isinstance(c, Column) else F.col(c)).cast("long")
            h = (h + F.pmod(c, F.lit(p)) + 1000003) % p
            h = (h * ((h + 48271 + lane) % p)) % p
        h = (h + 69621) % p
        lanes.append((h * ((h + 16807) % p)) % p)
    return lanes[0] * MIX_PRIMES[1] + lanes[1]


def sample_random(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``min(n, rows)`` rows in a repeatable random order."""
    keyed = df.withColumn("_mix", mix("point_id", seed=seed))
    return smallest_per_group(keyed, [], "_mix", "point_id", n).drop("_mix")


def sample_grid(df: DataFrame, size: float, seed: int = 0) -> DataFrame:
    """One representative row per cubic cell (the first in a repeatable order)."""
    cells = [cell_index(a, size).alias(f"c{a}") for a in "xyz"]
    order = F.struct(mix("point_id", seed=seed).alias("m"), F.col("point_id").alias("i"))
    keep = df.groupBy(*cells).agg(F.min(order).alias("first")).select(F.col("first.i").alias("point_id"))
    return df.join(keep, "point_id", "left_semi")
