"""Multi-scale neighbourhood features: one radius join, one set of sums per ring.

Three engines give the same sums.  Where neighbourhoods are small, units of space are walked tile by tile ("tiles"); where there are few pairs in
all, cells are 3-D or other columns are summed as well, pairs are joined and summed up in generated code ("pairs").  Where neighbourhoods are
dense, and wherever percentiles are asked for, units of space are summed over a pyramid of cells (``pyramid``).

Pairs are found once at the largest radius.  Each pair belongs to exactly one
ring (the smallest requested radius that holds it), so it updates one group of
partial sums; a radius then adds up its rings.  All moments are taken relative
to the query point, which keeps full precision at survey coordinates and makes
the query itself contribute nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pulseframe.functions.eigen import eigenvalue_stages, leading_stages, normal_stages, run_stages
from pulseframe.functions.scalar import EPSILON
from pulseframe.operators import neighbours as nb, pyramid
from pulseframe.schema import feature_column

SHAPE = ("eigenvalue_1", "eigenvalue_2", "eigenvalue_3", "eigenvalues_sum", "pca_1", "pca_2", "linearity",
         "planarity", "sphericity", "anisotropy", "omnivariance", "eigenentropy", "surface_variation",
         "normal_change_rate")
NORMAL = ("verticality", "normal_x", "normal_y", "normal_z", "normal_z_absolute", "dip", "dip_direction",
          "roughness", "signed_roughness")
CURVATURE = ("mean_curvature", "gaussian_curvature")
HEIGHT = ("z_minimum", "z_maximum", "z_range", "z_mean", "z_standard_deviation", "z_above_minimum",
          "z_below_maximum", "z_relative_to_mean")
# The percentile descriptors and their probabilities.
QUANTILES = {"z_percentile_10": 0.10, "z_percentile_25": 0.25, "z_median": 0.50,
             "z_percentile_75": 0.75, "z_percentile_90": 0.90}
SOURCE_STATS = ("source_count", "source_minimum", "source_maximum", "source_range", "source_mean",
                "source_standard_deviation")
SOURCE_QUANTILES = {"source_percentile_10": 0.10, "source_percentile_25": 0.25, "source_median": 0.50,
                    "source_percentile_75": 0.75, "source_percentile_90": 0.90}
DESCRIPTORS = (("neighbor_count", "density_2d", "density_3d") + SHAPE + NORMAL + CURVATURE
               + ("moment_order_1", "barycenter_offset_ratio") + HEIGHT + tuple(QUANTILES))

FIRST = ("x", "y", "z")
SECOND = ("xx", "xy", "xz", "yy", "yz", "zz")
# Sums a local quadric needs whichever axis turns out to be the height: every
# monomial up to degree four in two of the axes, and xyz.
QUADRIC = tuple("x" * a + "y" * b + "z" * c for a, b, c in product(range(5), repeat=3)
                if 3 <= a + b + c <= 4 and (0 in (a, b, c) or (a, b, c) == (1, 1, 1)))
# Candidates per query from which the pyramid is used.
DENSE = 1_000
# Candidate pairs in all from which tiles repay the start of their workers.
TILED_PAIRS = 2_000_000


def _curvature_kernel(radius: float):
    """Batched least-squares quadric: sums in, absolute curvatures at the query out."""
    first, second = list(FIRST), list(SECOND)
    names = first + second + list(QUADRIC)
    exponents = {name: tuple(name.count(a) for a in "xyz") for name in names}
    slot = {v: i for i, v in enumerate(exponents.values())}

    def solve(n: np.ndarray, sums: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray]:
        u, v = (height + 1) % 3, (height + 2) % 3
        terms = [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)]

        def total(i: int, j: int, k: int) -> np.ndarray:
            e = [0, 0, 0]
            e[u], e[v], e[height] = i, j, k
            return n if not any(e) else sums[:, slot[tuple(e)]]

        a = np.empty((len(n), 6, 6))
        b = np.empty((len(n), 6, 1))
        for r, (ri, rj) in enumerate(terms):
            b[:, r, 0] = total(ri, rj, 1)
            for c, (ci, cj) in enumerate(terms):
                a[:, r, c] = total(ri + ci, rj + cj, 0)
        with np.errstate(all="ignore"):
            scale = np.sqrt(np.einsum("nii->ni", a))
            ok = np.isfinite(scale).all(1) & (scale > 0).all(1)
            unit = a / np.where(ok[:, None, None], scale[:, :, None] * scale[:, None, :], 1.0)
            ok &= np.linalg.eigvalsh(np.where(ok[:, None, None], unit, np.eye(6)))[:, 0] > 1e-12
        safe = np.where(ok[:, None, None], unit, np.eye(6))
        rhs = np.where(ok[:, None], b[:, :, 0] / np.where(scale > 0, scale, 1.0), 0.0)
        coef = np.linalg.solve(safe, rhs[:, :, None])[:, :, 0] / np.where(scale > 0, scale, 1.0)
        # Sums were scaled to the unit ball: derivatives rescale by the radius.
        fx, fy = coef[:, 1], coef[:, 2]
        fxx, fxy, fyy = 2 * coef[:, 3] / radius, coef[:, 4] / radius, 2 * coef[:, 5] / radius
        q = 1 + fx * fx + fy * fy
        gauss = np.abs(fxx * fyy - fxy * fxy) / (q * q)
        mean = np.abs((1 + fx * fx) * fyy - 2 * fx * fy * fxy + (1 + fy * fy) * fxx) / (2 * np.sqrt(q) * q)
        ok &= np.isfinite(gauss) & np.isfinite(mean)
        return np.where(ok, mean, np.nan), np.where(ok, gauss, np.nan)

    schema = T.StructType([T.StructField("mean", T.DoubleType()), T.StructField("gauss", T.DoubleType())])

    @F.pandas_udf(schema)
    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        n = frame["n"].to_numpy("float64")
        axis = frame["axis"].fillna(-1).to_numpy("int64")
        sums = frame[names].to_numpy("float64")
        mean = np.full(len(n), np.nan)
        gauss = np.full(len(n), np.nan)
        for height in range(3):
            rows = np.flatnonzero((axis == height) & (n >= 6))
            if len(rows):
                mean[rows], gauss[rows] = solve(n[rows], sums[rows], height)
        out = pd.DataFrame({"mean": mean, "gauss": gauss})
        return out.astype(object).where(out.notna(), None)

    return kernel, names


def compute_features(points: DataFrame, radii, descriptors=DESCRIPTORS, *, sources: dict[str, tuple[str, ...]] | None = None,
                     core: Column | None = None, support: DataFrame | None = None, carry: tuple[str, ...] = (),
                     dims: int | None = None, plan: nb.NeighbourPlan | None = None,
                     max_candidates: int | None = None,
                     max_block_rows: int = nb.MAX_BLOCK_ROWS, engine: str | None = None) -> DataFrame:
    """Features of every (core) point: one row per query, column ``<descriptor>_r<radius>``.

    ``core`` restricts the queries while all rows stay support.  ``support`` gives
    the rows to search when ``points`` itself is costly to derive; it must hold
    every queried point (and the source columns).  ``sources`` maps
    another column to the source statistics wanted of it.  ``carry`` columns come
    along unchanged, which saves joining the result back to the points.  A ``plan``
    made for the same support and largest radius saves the counting pass.  ``engine``
    is "tiles", "pairs" or "pyramid", by default what the density and the descriptors call for;
    percentiles need the pyramid, and tiles have no sources.
    """
    radii = sorted({float(r) for r in radii})
    wanted = list(dict.fromkeys(descriptors))
    unknown = set(wanted) - set(DESCRIPTORS)
    if unknown:
        raise ValueError(f"unknown descriptors: {sorted(unknown)}")
    sources = {k: tuple(dict.fromkeys(v)) for k, v in (sources or {}).items()}
    for column, stats in sources.items():
        bad = set(stats) - set(SOURCE_STATS) - set(SOURCE_QUANTILES)
        if bad:
            raise ValueError(f"unknown statistics of {column}: {sorted(bad)}")
    need_curve = bool(set(wanted) & set(CURVATURE))
    need_moment = "moment_order_1" in wanted
    need_normal = need_curve or need_moment or bool(set(wanted) & set(NORMAL))
    need_pca = need_normal or bool(set(wanted) & set(SHAPE))
    need_first = need_pca or bool({"barycenter_offset_ratio", "z_mean", "z_standard_deviation", "z_relative_to_mean"} & set(wanted))
    need_zrange = bool({"z_minimum", "z_maximum", "z_range", "z_above_minimum", "z_below_maximum"} & set(wanted))
    need_zlist = bool(set(wanted) & set(QUANTILES))

    need_ranks = need_zlist or any(set(stats) & set(SOURCE_QUANTILES) for stats in sources.values())
    if engine not in (None, "tiles", "pairs", "pyramid") or (engine in ("tiles", "pairs") and need_ranks) or (engine == "tiles" and sources):
        raise ValueError("engine is 'tiles', 'pairs' or 'pyramid', percentiles need the pyramid, and tiles have no sources")

    support = points if support is None else support
    summed = {"max_block_rows": min(max_block_rows, pyramid.MAX_UNIT_ROWS), "max_unit_pairs": pyramid.MAX_UNIT_PAIRS, "spatial": True}
    by_cells = need_ranks or engine == "pyramid"
    if plan is None:
        limits = summed if by_cells else {"max_block_rows": max_block_rows} | ({"dense": DENSE, "dense_limits": summed} if engine is None else {})
        plan = nb.plan_neighbourhood(support, radii[-1], dims, max_candidates, **limits)
        by_cells = by_cells or (engine is None and plan.spatial)
    by_tiles = engine == "tiles" or (engine is None and not by_cells and not sources and plan.dims == 2 and TILED_PAIRS <= plan.pairs <= DENSE * plan.rows)
    carried = {f.name: f for f in points.schema.fields if f.name in carry and f.name not in ("point_id", "z")}
    queries = nb.as_queries(points if core is None else points.where(core), *carried)
    moments = (FIRST if need_first else ()) + (
        SECOND if need_pca else (("zz",) if "z_standard_deviation" in wanted else ())) + (QUADRIC if need_curve else ())
    named = {(d, r): feature_column(d, r) for d in wanted for r in radii}
    flags = _Needs(need_curve, need_moment, need_normal, need_pca, need_first)
    if by_cells or by_tiles:
        out = pyramid.neighbourhood_sums(
            queries, nb.as_support(support, *sources), plan, radii, moments, radii[-1] if need_curve else 1.0, few=by_tiles, z_range=need_zrange,
            z_quantiles={n: p for n, p in QUANTILES.items() if n in wanted}, sources={c: {n: p for n, p in SOURCE_QUANTILES.items() if n in stats} for c, stats in sources.items()})
    else:
        out = _paired_sums(queries, nb.as_support(support, *sources), plan, radii, moments, need_curve, need_zrange, carried, sources)
    out = _describe(out, radii, wanted, named, flags)
    out = _describe_sources(out, radii, sources)
    return out.select(F.col("q_id").alias("point_id"),
                      *[F.col(f"q_{c}").alias(c) for c in carry if c != "point_id"],
                      *[F.col(feature_column(d, r)) for r in radii for d in wanted],
                      *[F.col(feature_column(s, r, c)) for r in radii for c, stats in sources.items() for s in stats])


def _paired_sums(queries: DataFrame, support: DataFrame, plan: nb.NeighbourPlan, radii, moments, need_curve: bool, need_zrange: bool, carried, sources) -> DataFrame:
    """Sums of every query's pairs, by radius."""
    pairs = nb.paired(queries, support, plan)
    pairs = pairs.withColumn("other", F.col("q_id") != F.col("s_id"))
    if len(radii) > 1:
        inner = " ".join(f"WHEN d2 <= {r * r!r}D THEN {i}" for i, r in enumerate(radii[:-1]))
        pairs = pairs.withColumn("ring", F.expr(f"CASE {inner} ELSE {len(radii) - 1} END"))

    def monomial(name: str) -> Column:
        scale = f" * {1.0 / radii[-1]!r}D" if need_curve else ""
        return F.expr(" * ".join(f"(d{axis}{scale})" for axis in name))

    other = F.col("other")
    sums = [F.coalesce(F.sum(F.when(other, 1).otherwise(0)), F.lit(0)).alias("n")]
    sums += [F.coalesce(F.sum(monomial(m)), F.lit(0.0)).alias("s_" + m) for m in moments]
    if need_zrange:
        sums += [F.min(F.when(other, F.col("s_z"))).alias("zlo"), F.max(F.when(other, F.col("s_z"))).alias("zhi")]
    for i, column in enumerate(sources):
        value = F.when(other, F.col("s_" + column).cast("double"))
        value = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
        sums += [F.count(value).alias(f"v{i}_n"), F.avg(value).alias(f"v{i}_m"), F.var_pop(value).alias(f"v{i}_v"),
                 F.min(value).alias(f"v{i}_lo"), F.max(value).alias(f"v{i}_hi")]
    # Fixed-width carried columns ride in the aggregate, others in the key.
    in_key = [f"q_{n}" for n, f in carried.items() if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    in_agg = ["q_z"] + [f"q_{n}" for n in carried if f"q_{n}" not in in_key]
    keys = [*plan.unit, "q_id", *in_key]
    ring_key = ["ring"] if len(radii) > 1 else []
    grouped = pairs.groupBy(*keys, *ring_key).agg(*sums, *[F.max(c).alias(c) for c in in_agg])

    out = _merge_rings(grouped, keys, in_agg, len(radii), moments, need_zrange, sources)
    return _merged_sources(out, len(radii), sources)


def _merge_rings(grouped: DataFrame, keys, carried, rings: int, moments, need_zrange: bool, sources) -> DataFrame:
    """Rings to radii.  The partitioning is the one of the pairs, so nothing is shuffled."""
    if rings == 1:
        out = [F.col(c) for c in keys + carried] + [F.col("n").alias("n_0")]
        out += [F.col("s_" + m).alias(f"s0_{m}") for m in moments]
        if need_zrange:
            out += [F.col("zlo").alias("zlo_0"), F.col("zhi").alias("zhi_0")]
        for i in range(len(sources)):
            out += [F.col(f"v{i}_{s}").alias(f"v{i}_{s}_0") for s in ("n", "lo", "hi")]
            out.append(F.struct(*[F.col(f"v{i}_{s}").alias(s) for s in "nmv"]).alias(f"v{i}_ring0"))
        return grouped.select(*out)

    def inside(k: int, column: str) -> Column:
        return F.when(F.col("ring") <= k, F.col(column))

    per = [F.max(c).alias(c) for c in carried]
    for k in range(rings):
        per.append(F.coalesce(F.sum(inside(k, "n")), F.lit(0)).alias(f"n_{k}"))
        per += [F.coalesce(F.sum(F.when(F.col("ring") <= k, F.col("s_" + m)).otherwise(0.0)), F.lit(0.0)).alias(f"s{k}_{m}") for m in moments]
        if need_zrange:
            per += [F.min(inside(k, "zlo")).alias(f"zlo_{k}"), F.max(inside(k, "zhi")).alias(f"zhi_{k}")]
        for i in range(len(sources)):
            per += [F.sum(inside(k, f"v{i}_n")).alias(f"v{i}_n_{k}"),
                    F.min(inside(k, f"v{i}_lo")).alias(f"v{i}_lo_{k}"),
                    F.max(inside(k, f"v{i}_hi")).alias(f"v{i}_hi_{k}"),
                    F.max(F.when(F.col("ring") == k, F.struct(*[F.col(f"v{i}_{s}").alias(s) for s in "nmv"]))).alias(f"v{i}_ring{k}")]
    return grouped.groupBy(*keys).agg(*per)


def _merged_sources(df: DataFrame, rings: int, sources) -> DataFrame:
    """Mean and deviation of each radius: rings merge by the parallel variance rule."""
    if not sources:
        return df
    count = range(rings)

    def merged(i: int, k: int, term: str) -> str:
        return " + ".join(f"coalesce({term.replace('@', f'v{i}_ring{j}')}, 0.0D)" for j in range(k + 1))

    df = df.selectExpr("*", *[f"({merged(i, k, '@.n * @.m')}) / nullif(v{i}_n_{k}, 0) AS v{i}_mean_{k}"
                              for i in range(len(sources)) for k in count])
    return df.selectExpr("*", *[
        f"sqrt(({merged(i, k, f'@.n * (@.v + (@.m - v{i}_mean_{k})*(@.m - v{i}_mean_{k}))')}) / nullif(v{i}_n_{k}, 0))"
        f" AS v{i}_std_{k}" for i in range(len(sources)) for k in count])


@dataclass(frozen=True)
class _Needs:
    curve: bool
    moment: bool
    normal: bool
    pca: bool
    first: bool


def _describe(df: DataFrame, radii, wanted, named, need: _Needs) -> DataFrame:
    """Add the descriptors of every radius, one projection per stage for all radii."""
    unit = repr(radii[-1] if need.curve else 1.0) + "D"  # monomials may be divided by the largest radius
    scale2 = f"({unit}*{unit})"
    count = range(len(radii))
    # One division per radius; everything after it is free of NULLs until the descriptors are masked.
    df = df.selectExpr("*", *[f"coalesce(try_divide(1.0D, n_{k}), 0.0D) AS w{k}" for k in count])
    if need.first:
        df = df.selectExpr("*", *[f"s{k}_{a} * w{k} * {unit} AS m{k}_{a}" for k in count for a in FIRST])
    if need.pca:
        df = df.selectExpr("*", *[f"s{k}_{s} * w{k} * {scale2} - m{k}_{s[0]}*m{k}_{s[1]} AS c{k}_{s}"
                                  for k in count for s in SECOND])
        df = run_stages(df, [eigenvalue_stages(f"c{k}_", f"l{k}_") for k in count])
        df = df.selectExpr("*", *[f"l{k}_1 + l{k}_2 + l{k}_3 AS sum{k}" for k in count])
    if need.normal:
        df = run_stages(df, [normal_stages(f"c{k}_", f"l{k}_", f"n{k}_") for k in count])
        df = df.selectExpr("*", *[f"-(m{k}_x*n{k}_x + m{k}_y*n{k}_y + m{k}_z*n{k}_z) + 0.0D AS off{k}" for k in count])
    if need.moment:
        df = run_stages(df, [leading_stages(f"c{k}_", f"l{k}_", f"e{k}_") for k in count])
        df = df.selectExpr("*", *[
            f"m{k}_x*(n{k}_y*e{k}_z - n{k}_z*e{k}_y) + m{k}_y*(n{k}_z*e{k}_x - n{k}_x*e{k}_z)"
            f" + m{k}_z*(n{k}_x*e{k}_y - n{k}_y*e{k}_x) AS t{k}" for k in count])
        df = df.selectExpr("*", *[f"n_{k}*(l{k}_2 + t{k}*t{k}) AS t2{k}" for k in count])
    if need.curve:
        kernel, sums = _curvature_kernel(radii[-1])
        curves = {}
        for k in count:
            axis = F.expr(f"CASE WHEN n_{k} < 6 THEN NULL WHEN abs(n{k}_y) > greatest(abs(n{k}_x), abs(n{k}_z))"
                          f" THEN 1 WHEN abs(n{k}_x) > abs(n{k}_z) THEN 0 ELSE 2 END")
            curves[f"curve{k}"] = kernel(F.struct(F.col(f"n_{k}").alias("n"), axis.alias("axis"),
                                                  *[F.col(f"s{k}_{m}").alias(m) for m in sums]))
        df = df.withColumns(curves)
    texts = []
    for k, r in enumerate(radii):
        for name in wanted:
            texts.append(f"{_descriptor_text(name, k, r, scale2)} AS {named[name, r]}")
    return df.selectExpr("*", *texts)


def _descriptor_text(name: str, k: int, r: float, scale2: str) -> str:
    l1, l2, l3, total = f"l{k}_1", f"l{k}_2", f"l{k}_3", f"sum{k}"

    def ratio(a: str, b: str) -> str:
        return f"CASE WHEN abs({b}) > {EPSILON!r}D THEN ({a}) / {b} END"

    def entropy(v: str) -> str:
        return f"coalesce(CASE WHEN {v} > 0 THEN {v} * ln({v}) END, 0.0D)"

    if name in QUANTILES:
        return f"zq{k}_{name}"
    text = {
        "neighbor_count": f"double(n_{k})",
        "density_2d": f"n_{k} / {math.pi * r * r!r}D",
        "density_3d": f"n_{k} / {4.0 / 3.0 * math.pi * r ** 3!r}D",
        "eigenvalue_1": l1, "eigenvalue_2": l2, "eigenvalue_3": l3, "eigenvalues_sum": total,
        "pca_1": ratio(l1, total), "pca_2": ratio(l2, total),
        "linearity": ratio(f"{l1} - {l2}", l1), "planarity": ratio(f"{l2} - {l3}", l1),
        "sphericity": ratio(l3, l1), "anisotropy": ratio(f"{l1} - {l3}", l1),
        "omnivariance": f"cbrt({l1}*{l2}*{l3})",
        "eigenentropy": f"-({entropy(l1)} + {entropy(l2)} + {entropy(l3)}) + 0.0D",
        "surface_variation": ratio(l3, total), "normal_change_rate": ratio(l3, total),
        "verticality": f"1.0D - abs(n{k}_z)", "normal_x": f"n{k}_x", "normal_y": f"n{k}_y", "normal_z": f"n{k}_z",
        "normal_z_absolute": f"abs(n{k}_z)", "dip": f"degrees(acos(least(1.0D, n{k}_z)))",
        "dip_direction": f"pmod(degrees(atan2(n{k}_x, n{k}_y)) + 360.0D, 360.0D)",
        "roughness": f"abs(off{k})", "signed_roughness": f"off{k}",
        "mean_curvature": f"curve{k}.mean", "gaussian_curvature": f"curve{k}.gauss",
        "moment_order_1": f"CASE WHEN t2{k} > {EPSILON!r}D THEN n_{k}*(n_{k}*t{k}*t{k}) / t2{k} END",
        "barycenter_offset_ratio": f"sqrt(m{k}_x*m{k}_x + m{k}_y*m{k}_y + m{k}_z*m{k}_z) / {r!r}D",
        "z_minimum": f"zlo_{k}", "z_maximum": f"zhi_{k}", "z_range": f"zhi_{k} - zlo_{k}",
        "z_mean": f"q_z + m{k}_z", "z_relative_to_mean": f"-m{k}_z + 0.0D",
        "z_standard_deviation": f"sqrt(greatest(0.0D, s{k}_zz * w{k} * {scale2} - m{k}_z*m{k}_z))",
        "z_above_minimum": f"q_z - zlo_{k}", "z_below_maximum": f"zhi_{k} - q_z",
    }[name]
    if name in SHAPE or name in NORMAL or name == "moment_order_1":
        return f"CASE WHEN n_{k} >= 3 THEN {text} END"
    if name in HEIGHT or name == "barycenter_offset_ratio":
        return f"CASE WHEN n_{k} > 0 THEN {text} END"
    return text


def _describe_sources(df: DataFrame, radii, sources) -> DataFrame:
    """Statistics of other columns over the neighbours."""
    if not sources:
        return df
    texts = []
    for i, (column, stats) in enumerate(sources.items()):
        for k, r in enumerate(radii):
            forms = {"source_count": f"double(coalesce(v{i}_n_{k}, 0))", "source_minimum": f"v{i}_lo_{k}",
                     "source_maximum": f"v{i}_hi_{k}", "source_range": f"v{i}_hi_{k} - v{i}_lo_{k}",
                     "source_mean": f"v{i}_mean_{k}", "source_standard_deviation": f"v{i}_std_{k}"}
            texts += [f"{forms.get(s, f'v{i}_{s}_{k}')} AS `{feature_column(s, r, column)}`" for s in stats]
    return df.selectExpr("*", *texts)
