"""Radius suggestions and rule-based vegetation labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from pulseframe.functions.scalar import clamp, finite_or_null
from pulseframe.operators.ranking import exact_quantiles
from pulseframe.schema import feature_column

# Result categories of the vegetation rules.
UNCERTAIN, VEGETATION, OTHER_SURFACE, GROUND, EXCLUDED = 0, 1, 2, 3, 4
# Classes the vegetation rules leave alone (noise, water, temporal exclusion).
EXCLUDED_CODES = (7, 9, 18, 22)
FINE_VARIATION = 0.035


def vegetation_radii(profile: DataFrame, k: int = 16, fine_limit: float = 0.25) -> DataFrame:
    """Add ``radius_fine, radius_mid, radius_coarse`` from ``spacing, density, maximum``."""
    target = float(max(8, min(128, k)))
    fine = max(0.05, min(0.5, fine_limit))
    spacing = F.when(F.col("spacing") > 0, F.col("spacing")).otherwise(0.1)
    spacing = F.coalesce(spacing, F.lit(0.1))
    raw = F.when(F.col("density") > 0, F.sqrt(F.lit(target / math.pi) / F.col("density"))).otherwise(math.sqrt(target) * spacing)
    top = clamp(F.coalesce(F.col("maximum"), F.lit(1.0)), 0.2, 3.0)
    df = profile.withColumns({"_top": top, "_raw": raw})
    r = F.greatest(F.lit(0.05), F.least(F.lit(fine), F.col("_top") / 4, F.col("_raw")))
    return df.withColumn("radius_fine", r).withColumns({
        "radius_mid": 2 * F.col("radius_fine"), "radius_coarse": F.least(F.col("_top"), 4 * F.col("radius_fine"))}).drop("_top", "_raw")


def observation(df: DataFrame, radii) -> Column:
    """Array with one struct (count, planarity, scattering, variation, roughness ratio) per radius."""
    def one(r):
        return F.struct(F.col(feature_column("neighbor_count", r)).alias("count"), F.col(feature_column("planarity", r)).alias("planarity"),
                        F.col(feature_column("sphericity", r)).alias("scattering"), F.col(feature_column("surface_variation", r)).alias("variation"),
                        (F.col(feature_column("roughness", r)) / r).alias("roughness_ratio"))
    return F.array(*[one(r) for r in radii])


def _valid(o: str, minimum) -> str:
    return (f"({o}.count >= {minimum} AND {o}.planarity IS NOT NULL AND {o}.scattering IS NOT NULL"
            f" AND {o}.variation IS NOT NULL AND {o}.roughness_ratio IS NOT NULL)")


def adapt_thresholds(observed: DataFrame, preset: int = 1, minimum: int = 12) -> DataFrame:
    """One row of thresholds from exact quantiles of all valid observations (column ``scales``).

    Preset 0 is cautious (factor 1.15), 1 neutral, 2 eager (0.85).
    """
    obs = observed.select(F.explode("scales").alias("o")).where(F.expr(_valid("o", minimum)))
    factor = {0: 1.15, 1: 1.0, 2: 0.85}[preset]
    # name, quantile, default, lowest, highest, scale
    wanted = (("planarity", 0.70, 0.5, 0.40, 0.65, 1.0), ("scattering", 0.55, 0.12, 0.08, 0.25, factor),
              ("variation", 0.55, 0.04, 0.025, 0.08, factor), ("roughness_ratio", 0.55, 0.06, 0.03, 0.12, factor))
    q = {r.field: r for r in exact_quantiles(obs.select(*[F.col(f"o.{w[0]}").alias(w[0]) for w in wanted]), [w[0] for w in wanted], [0.55, 0.70]).collect()}
    values = []
    for name, p, default, low, high, scale in wanted:
        v = q[name].q1 if p == 0.70 else q[name].q0
        values.append(max(low, min(high, default if v is None else v)) * scale)
    return observed.sparkSession.createDataFrame(
        [(*values, 0.25 if preset == 0 else 0.15, minimum, preset)],
        "planar double, scattering double, variation double, roughness_ratio double, near_ground double, minimum_neighbors int, preset int")


def threshold_rows(df: DataFrame) -> DataFrame:
    """The rows thresholds are learned from: no ground, none of the excluded classes."""
    keep = ~F.coalesce(F.col("is_ground"), F.lit(False)) & ~F.coalesce(F.col("classification").isin(*EXCLUDED_CODES), F.lit(False))
    return df.where(keep)


def vegetation_decide(df: DataFrame, thresholds: dict, *, ground: str = "is_ground", code: str = "classification",
                      hag: str = "hag", multiple: Column | None = None) -> DataFrame:
    """Ordered rules over three scales (array ``scales``): add ``category, reason, evidence``.

    ``thresholds`` holds planar, scattering, variation, roughness_ratio, near_ground,
    minimum_neighbors and preset.
    """
    t = thresholds
    planar = f"o.planarity >= {t['planar']!r}D AND o.variation <= {FINE_VARIATION}D"
    votes = (f"(CAST(o.scattering >= {t['scattering']!r}D AS INT) + CAST(o.variation >= {t['variation']!r}D AS INT)"
             f" + CAST(o.roughness_ratio >= {t['roughness_ratio']!r}D AS INT))")
    ok = _valid("o", t["minimum_neighbors"])
    multi = F.lit(False) if multiple is None else F.coalesce(multiple, F.lit(False))
    df = df.withColumns({
        "_g": F.coalesce(F.col(ground), F.lit(False)), "_h": finite_or_null(hag), "_multi": multi,
        "_ok": F.expr(f"transform(filter(scales, o -> {ok}), o -> struct(({planar}) AS plane, {votes} AS votes,"
                      f" o.planarity < {t['planar']!r}D AS loose, (o.scattering >= {t['scattering']!r}D OR"
                      f" o.variation >= {t['variation']!r}D) AS dispersed))"),
        "_first": F.expr(f"{ok.replace('o.', 'scales[0].')}")})
    df = df.selectExpr(
        "*", "size(_ok) AS _n", "get(_ok, 0) AS _fine",
        "size(filter(_ok, o -> o.plane)) AS _planes", "size(filter(_ok, o -> o.votes >= 2 AND o.loose)) AS _volume",
        "aggregate(_ok, 0.0D, (a, o) -> a + o.votes / 3.0D) AS _score")
    supported = "_n >= 2" + (" AND _first" if t["preset"] == 0 else "")
    excluded = f"coalesce({code} IN ({', '.join(map(str, EXCLUDED_CODES))}), false)"
    early = f"_g OR {excluded} OR coalesce(_h < 0, false)"
    return df.selectExpr(
        "*", "CASE WHEN _g THEN 1"
        f" WHEN {excluded} THEN 2 WHEN _h < 0 THEN 3 WHEN NOT ({supported}) THEN 4 WHEN _fine.plane THEN 5"
        f" WHEN _h < {t['near_ground']!r}D THEN 6 WHEN _volume >= 2 AND _fine.dispersed AND _fine.loose THEN 7"
        " WHEN _planes >= 2 THEN 8 ELSE 9 END AS reason",
        f"CASE WHEN {early} OR NOT ({supported}) THEN 0.0D ELSE"
        " greatest(0.0D, least(1.0D, _score / _n + CASE WHEN _multi THEN 0.03D ELSE 0.0D END)) END AS evidence").selectExpr(
        "*", f"CASE reason WHEN 1 THEN {GROUND} WHEN 2 THEN {EXCLUDED} WHEN 7 THEN {VEGETATION} WHEN 8 THEN {OTHER_SURFACE}"
        f" WHEN 5 THEN CASE WHEN _planes >= 2 THEN {OTHER_SURFACE} ELSE {UNCERTAIN} END ELSE {UNCERTAIN} END AS category"
    ).drop("_g", "_h", "_multi", "_ok", "_first", "_n", "_fine", "_planes", "_volume", "_score")


def height_class(hag: Column, low: float = 2.0, medium: float = 5.0) -> Column:
    """Vegetation class by height: 3, 4 or 5; 1 when the height is missing."""
    return F.when(hag.isNull(), 1).when(hag <= low, 3).when(hag <= medium, 4).otherwise(5)


def score_threshold(df: DataFrame, threshold: float, score: str = "score", ground: str = "is_ground",
                    code: str = "classification") -> DataFrame:
    """Add ``score_class``: ground 3, excluded classes 4, score at least the threshold 1, else 0."""
    return df.withColumn("score_class", F.when(F.coalesce(F.col(ground), F.lit(False)), 3)
                         .when(F.col(code).isin(*EXCLUDED_CODES), 4)
                         .when(finite_or_null(score) >= threshold, 1).otherwise(0))


def suggest_radii_neighbours(profile: DataFrame, counts=(8, 16, 32, 64, 128), minimum: float = 0.0, maximum: float = 0.0) -> DataFrame:
    """Radii holding a target number of neighbours on a plane: add array ``radii``.

    Needs ``density_2d, extent_x, extent_y``.  Without a maximum, a quarter of the
    smaller extent caps them; near-equal radii are kept once.
    """
    cap = "least(extent_x, extent_y) * 0.25D" if maximum == 0 else f"{float(maximum)!r}D"
    cap = f"(CASE WHEN {cap} > 0 THEN {cap} ELSE double('inf') END)"
    raw = ", ".join(f"least({cap}, greatest({float(minimum)!r}D, sqrt({float(k) / math.pi!r}D / density_2d)))" for k in counts if k)
    return profile.selectExpr("*", f"filter(array_sort(array({raw})), r -> r > 0) AS _r").selectExpr(
        "*", "filter(_r, (r, i) -> i = 0 OR abs(r - get(_r, i - 1)) > 1e-9D * greatest(1.0D, r)) AS radii").drop("_r")


def suggest_radii_series(profile: DataFrame, maximum_count: int = 8) -> DataFrame:
    """1-2-5 series from four times the spacing to min(extent / 4, 256 spacings): add ``radii``.

    Needs ``spacing, density_2d, extent_x, extent_y``.
    """
    df = profile.selectExpr("*", "CASE WHEN spacing > 0 THEN spacing WHEN density_2d > 0 THEN 1.0D / sqrt(density_2d) END AS _s")
    df = df.selectExpr("*", "greatest(4.0D * _s, 0.05D) AS _low").selectExpr("*", "pow(10.0D, floor(log10(_low))) AS _mag")
    df = df.selectExpr("*", "_mag * CASE WHEN _low / _mag <= 1 THEN 1.0D WHEN _low / _mag <= 2 THEN 2.0D WHEN _low / _mag <= 5 THEN 5.0D"
                       " ELSE 10.0D END AS _first")
    df = df.selectExpr("*", "least(least(extent_x, extent_y) / 4.0D, greatest(_first, 256.0D * _s)) * 1.000001D AS _top")
    series = "flatten(transform(sequence(0, 5), e -> transform(array(1.0D, 2.0D, 5.0D), m -> m * pow(10.0D, floor(log10(_low)) + e))))"
    return df.selectExpr("*", f"CASE WHEN _s > 0 AND least(extent_x, extent_y) > 0 THEN slice(filter({series},"
                         f" r -> r >= _first * 0.999999D AND r <= _top), 1, {maximum_count}) ELSE array() END AS radii"
                         ).drop("_s", "_low", "_mag", "_first", "_top")


def suggest_radii_preset(profile: DataFrame, minimum: float, maximum: float, use_returns: bool = True) -> DataFrame:
    """Radii for 16, 64 and 256 neighbours with last-return support, to the millimetre: add ``radii``.

    Needs ``density_2d, extent_x, extent_y, valid_return_fraction, last_return_fraction``.
    """
    share = "CASE WHEN valid_return_fraction >= 0.9D THEN greatest(0.25D, least(1.0D, last_return_fraction)) ELSE 1.0D END" if use_returns else "1.0D"
    df = profile.selectExpr("*", f"density_2d * {share} AS _d", f"least({float(maximum)!r}D, least(extent_x, extent_y) / 4.0D) AS _u")
    low = f"{float(minimum)!r}D"
    raw = ", ".join(f"greatest({low}, least(_u, floor(greatest({low}, least(_u, sqrt({k / math.pi!r}D / _d))) * 1000.0D + 0.5D) / 1000.0D))"
                    for k in (16.0, 64.0, 256.0))
    return df.selectExpr("*", f"CASE WHEN density_2d > 0 AND _u >= {low} THEN array_distinct(array({raw})) ELSE array() END AS radii").drop("_d", "_u")


def vegetation_vector(df: DataFrame, fine: float, coarse: float) -> DataFrame:
    """27 derived inputs of the vegetation model and ``supported`` (both counts at least 12)."""
    if not 0 < fine < coarse <= 3:
        raise ValueError("two ordered radii up to 3 are needed")
    texts = []

    def col(name, r):
        return feature_column(name, r)

    for r in (fine, coarse):
        texts += [f"{col(n, r)} AS {col('v_' + n, r)}" for n in ("planarity", "sphericity", "surface_variation", "linearity", "normal_z_absolute", "barycenter_offset_ratio")]
        texts += [f"{col(n, r)} / {r!r}D AS {col('v_' + n + '_over_radius', r)}" for n in ("roughness", "z_range", "z_standard_deviation")]
        sv, total = col("surface_variation", r), col("eigenvalues_sum", r)
        texts.append(f"sqrt(CASE WHEN {sv} * {total} > 0 THEN {sv} * {total} ELSE {sv} * {total} * 0.0D END) / {r!r}D AS {col('v_plane_rms_over_radius', r)}")
        shares = [col("pca_1", r), col("pca_2", r), sv]
        terms = " + ".join(f"{s} * ln(CASE WHEN {s} > 1e-12D THEN {s} WHEN {s} IS NOT NULL THEN 1e-12D END)" for s in shares)
        texts.append(f"-({terms}) / {math.log(3.0)!r}D AS {col('v_normalized_eigenentropy', r)}")
    na, nb = col("neighbor_count", fine), col("neighbor_count", coarse)
    texts.append(f"ln(greatest({nb}, 1.0D) / greatest({na}, 1.0D)) / {math.log(coarse / fine)!r}D AS v_support_growth_dimension")
    texts += [f"{col(n, coarse)} - {col(n, fine)} AS v_{n}_coarse_minus_fine" for n in ("planarity", "sphericity", "surface_variation", "normal_z_absolute")]
    return df.selectExpr("*", *texts, f"{na} >= 12 AND {nb} >= 12 AS supported")
