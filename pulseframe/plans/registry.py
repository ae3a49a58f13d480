"""The registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseframe.plans import views

QueryFunction = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFunction] = {}
ORACLES: dict[str, str] = {}

# Named inputs of the check SQL.
INPUTS = {"pts": views.DUCK_POINTS, "lab": views.DUCK_LABELLED, "scene": views.DUCK_SCENE}


def query(name: str, sql: str | None = None, *inputs: str):
    """Register a query; ``sql`` may start with ``name AS (...),`` parts of its own after the inputs."""
    def add(function: QueryFunction) -> QueryFunction:
        if name in QUERIES:
            raise KeyError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_inputs(sql, *inputs)
        return function
    return add


def with_inputs(sql: str, *inputs: str) -> str:
    parts = [f"{n} AS ({INPUTS[n]})" for n in inputs]
    body = sql.strip()
    recursive = "RECURSIVE " if "/*recursive*/" in body else ""
    if body.upper().startswith("WITH "):
        return f"WITH {recursive}" + ",\n".join([*parts, body[5:]])
    return (f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else "") + body


# Rounding both engines carry out with identical floating-point steps; the odd
# offset keeps decimal ties away from the cut.
def r(value: Column | str, digits: int = 6) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    scale = float(10 ** digits)
    return F.floor(c * scale + 0.4142135) / scale + 0.0


def d(text: str, digits: int = 6) -> str:
    """The same rounding as SQL text."""
    scale = f"{10 ** digits}.0::DOUBLE"
    return f"(floor(({text}) * {scale} + 0.4142135::DOUBLE) / {scale} + 0.0::DOUBLE)"
