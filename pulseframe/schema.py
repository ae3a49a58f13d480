"""Reserved names, class catalogue and the column-name convention for features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

POINT_COLUMNS = ("point_id", "x", "y", "z")

# Names the label operators own; they may not be dropped by a user.
PROTECTED_EXACT = (
    "classification", "returnnumber", "numberofreturns", "pointid", "x", "y", "z",
    "originalclass", "workingclass", "trustedclass", "isground", "hag", "predclass",
    "confidence", "clusterid",
)

# The published class codes of the LAS 1.4 R16 specification.
ASPRS_NAMES = {
    0: "Created, never classified",
    1: "Unclassified",
    2: "Ground",
    3: "Low vegetation",
    4: "Medium vegetation",
    5: "High vegetation",
    6: "Building",
    7: "Low point (noise)",
    9: "Water",
    10: "Rail",
    11: "Road surface",
    13: "Wire - guard (shield)",
    14: "Wire - conductor (phase)",
    15: "Transmission tower",
    16: "Wire-structure connector",
    17: "Bridge deck",
    18: "High noise",
    19: "Overhead structure",
    20: "Ignored ground",
    21: "Snow",
    22: "Temporal exclusion",
}
# User-definable codes 64..75 (archaeology) and 128..131 (structures).
CUSTOM_NAMES = {
    64: "Archaeological structure",
    65: "Archaeological wall",
    66: "Collapsed archaeological wall",
    67: "Archaeological terrace",
    68: "Archaeological mound",
    69: "Archaeological ditch",
    70: "Archaeological embankment",
    71: "Archaeological platform",
    72: "Archaeological road / path",
    73: "Archaeological stone concentration",
    74: "Possible archaeology",
    75: "Uncertain archaeology",
    128: "Roof",
    129: "Vertical wall",
    130: "Utility pole",
    131: "Wire / cable",
}


def class_name_of(code: int) -> str:
    """Name of one class code: standard, reserved below 64, custom or user definable."""
    if code in ASPRS_NAMES:
        return ASPRS_NAMES[code]
    if code < 64:
        return "Reserved"
    return CUSTOM_NAMES.get(code, "User definable")


def class_catalogue(spark: SparkSession) -> DataFrame:
    """The 256-row class dimension: ``code, class_name, is_reserved``."""
    names = F.create_map(*[F.lit(v) for kv in {**ASPRS_NAMES, **CUSTOM_NAMES}.items() for v in kv])
    code = F.col("id").cast("int")
    known = F.try_element_at(names, code)
    return spark.range(256).select(
        code.alias("code"),
        F.coalesce(known, F.when(code < 64, "Reserved").otherwise("User definable")).alias("class_name"),
        (known.isNull() & (code < 64)).alias("is_reserved"),
    )


def radius_tag(radius: float) -> str:
    """``0.5`` -> ``r0p5``: the suffix a feature column carries for its radius."""
    return "r" + format(float(radius), ".12g").replace(".", "p").replace("-", "m")


def feature_column(descriptor: str, radius: float, source: str | None = None) -> str:
    """Column name of a feature key ``(descriptor, radius[, source column])``."""
    stem = f"{descriptor}_{source}" if source else descriptor
    return f"{stem}_{radius_tag(radius)}"
