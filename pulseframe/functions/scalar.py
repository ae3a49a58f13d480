"""Column helpers: missing values, names, keys, numbers, ratios."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: spacing of doubles at 1.0; a smaller denominator makes a ratio missing.
EPSILON = 2.220446049250313e-16

# Name fragments that betray a column derived from labels.
LABEL_TOKENS = (
    "class", "label", "training", "prediction", "confidence", "cluster",
    "groundmask", "groundpreview", "vegetationscore", "reviewstatus",
)


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def finite_or_null(value) -> Column:
    """NaN and both infinities become NULL, the one missing value used inside."""
    c = as_column(value).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, NULL when the denominator vanishes."""
    return F.when(F.abs(denominator) > EPSILON, numerator / denominator)


def within_range(value: Column, low: float, high: float) -> Column:
    """Inclusive interval test that is false, never NULL, for a missing value."""
    return F.coalesce(value.between(low, high), F.lit(False))


def canonical_name(value) -> Column:
    """Lower case with blanks and underscores removed."""
    return F.regexp_replace(F.lower(as_column(value)), "[ _]", "")


def alphanumeric_name(value) -> Column:
    return F.regexp_replace(F.lower(as_column(value)), "[^a-z0-9]", "")


def feature_key_parse(value) -> Column:
    """``planarity@0.5`` -> struct(descriptor, radius); radius NULL when malformed."""
    c = as_column(value)
    return F.struct(
        F.substring_index(c, "@", 1).alias("descriptor"),
        F.when(F.instr(c, "@") > 0, F.substring_index(c, "@", -1).try_cast("double")).alias("radius"),
    )


def parse_number_locale(value) -> Column:
    """Number from text; a lone comma is a decimal mark.  NULL unless finite."""
    text = F.trim(as_column(value))
    dotted = F.when(F.contains(text, F.lit(",")) & ~F.contains(text, F.lit(".")),
                    F.replace(text, F.lit(","), F.lit("."))).otherwise(text)
    return finite_or_null(dotted.try_cast("double"))


def preferred_125(value) -> Column:
    """Smallest 1-2-5 preferred number at or above ``value``; 0 unless positive."""
    c = as_column(value).cast("double")
    magnitude = F.pow(F.lit(10.0), F.floor(F.log10(c)).cast("double"))
    lead = c / magnitude
    step = F.when(lead <= 1, 1.0).when(lead <= 2, 2.0).when(lead <= 5, 5.0).otherwise(10.0)
    return F.coalesce(F.when((c > 0) & (c < float("inf")), step * magnitude), F.lit(0.0))


def encode_field_key(value) -> Column:
    """Stable input key of a named field: ``sf:`` and the percent-encoded name."""
    encoded = F.replace(F.url_encode(as_column(value)), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("sf:"), encoded)


def decode_field_key(value) -> Column:
    """Name inside an ``sf:`` key, NULL for any other text."""
    c = as_column(value)
    return F.when(F.startswith(c, F.lit("sf:")), F.try_url_decode(F.substr(c, F.lit(4))))


def is_label_derived(value) -> Column:
    """True for a field name that leaks labels into training input."""
    return canonical_name(value).rlike("|".join(LABEL_TOKENS))


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low,
                      F.least(F.lit(high) if not isinstance(high, Column) else high, value))
