"""Closed-form eigen decomposition of a symmetric 3x3 matrix as SQL expressions.

Everything stays inside generated JVM code.  Eigenvalues come from the
trigonometric solution of the characteristic cubic, eigenvectors from the
longest cross product of two rows of ``A - lambda I``.

A *stage* is a list of ``expression AS name`` texts evaluated together.  Each
function returns its stages in order, so that several matrices (one per
radius) can share one projection per stage.
"""

from __future__ import annotations

import math

Stages = list[list[str]]
SIGN_FLOOR = 1e-10


def _norm2(v) -> str:
    return f"({v[0]}*{v[0]} + {v[1]}*{v[1]} + {v[2]}*{v[2]})"


def _cross(a, b):
    return (f"({a[1]})*({b[2]}) - ({a[2]})*({b[1]})", f"({a[2]})*({b[0]}) - ({a[0]})*({b[2]})",
            f"({a[0]})*({b[1]}) - ({a[1]})*({b[0]})")


def _rows(c: str, lam: str):
    return ((f"{c}xx - {lam}", f"{c}xy", f"{c}xz"), (f"{c}xy", f"{c}yy - {lam}", f"{c}yz"),
            (f"{c}xz", f"{c}yz", f"{c}zz - {lam}"))


def eigenvalue_stages(c: str, lam: str) -> Stages:
    """Stages that add ``{lam}1 >= {lam}2 >= {lam}3`` for the matrix ``{c}xx .. {c}zz``.

    Values are clamped at zero (a covariance has no negative ones).  Inputs must
    not be NULL and neither are the results: arithmetic free of null checks makes
    much shorter generated code.  Callers mask rows where the matrix has no meaning.
    """
    m, p, h = f"{lam}m", f"{lam}p", f"{lam}h"
    xx, yy, zz = f"({c}xx - {m})", f"({c}yy - {m})", f"({c}zz - {m})"
    xy, xz, yz = f"{c}xy", f"{c}xz", f"{c}yz"
    turn = repr(2.0 * math.pi / 3.0) + "D"
    third, sixth = repr(1.0 / 3.0) + "D", repr(1.0 / 6.0) + "D"
    return [
        [f"({c}xx + {c}yy + {c}zz) * {third} AS {m}"],
        [f"sqrt(({xx}*{xx} + {yy}*{yy} + {zz}*{zz} + 2.0D*({xy}*{xy} + {xz}*{xz} + {yz}*{yz})) * {sixth}) AS {p}"],
        [f"acos(greatest(-1.0D, least(1.0D, coalesce(try_divide({xx}*({yy}*{zz} - {yz}*{yz})"
         f" - {xy}*({xy}*{zz} - {yz}*{xz}) + {xz}*({xy}*{yz} - {yy}*{xz}), 2.0D*{p}*{p}*{p}), 0.0D))))"
         f" * {third} AS {h}"],
        [f"greatest(0.0D, {m} + 2.0D*{p}*cos({h})) AS {lam}1", f"greatest(0.0D, {m} + 2.0D*{p}*cos({h} + {turn})) AS {lam}3"],
        # Rounding may push the middle value outside; it lies between the others.
        [f"greatest({lam}3, least({lam}1, 3.0D*{m} - {lam}1 - {lam}3)) AS {lam}2"],
    ]


def _crosses(c: str, lam: str, tag: str) -> tuple[list[str], list[str]]:
    """Texts of the three row cross products and of their squared lengths."""
    rows = _rows(c, lam)
    parts, norms = [], []
    for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        parts += [f"{text} AS {tag}{k}{axis}" for text, axis in zip(_cross(rows[a], rows[b]), "xyz")]
        norms.append(f"{_norm2([f'{tag}{k}{axis}' for axis in 'xyz'])} AS {tag}{k}n")
    return parts, norms


def normal_stages(c: str, lam: str, out: str) -> Stages:
    """Stages that add ``{out}x, {out}y, {out}z``: unit vector of the smallest eigenvalue.

    It points to +Z, then +Y, then +X.  For a repeated smallest eigenvalue any
    perpendicular of the leading axis is an eigenvector; a fixed one is taken so
    that results do not depend on row order.
    """
    t, v, l3 = f"{out}t", f"{out}v", f"{lam}3"
    parts, norms = _crosses(c, l3, t)
    rows = _rows(c, l3)
    lengths = [f"{t}r{i}" for i in range(3)]
    row_norms = [f"{_norm2(tuple(f'({e})' for e in r))} AS {n}" for r, n in zip(rows, lengths)]
    best = f"greatest({t}0n, {t}1n, {t}2n)"
    longest = f"greatest({', '.join(lengths)})"
    axis = [f"CASE WHEN {lengths[0]} = {longest} THEN {rows[0][i]} WHEN {lengths[1]} = {longest} THEN {rows[1][i]}"
            f" ELSE {rows[2][i]} END AS {t}a{x}" for i, x in enumerate("xyz")]
    a = [f"{t}a{x}" for x in "xyz"]
    # Project +Z off the axis unless the axis leans to +Z; then project +X.
    upright = f"abs({a[2]}) <= greatest(abs({a[0]}), abs({a[1]}))"
    dot = f"CASE WHEN {upright} THEN {a[2]} ELSE {a[0]} END"
    fallback = [f"CASE WHEN {_norm2(a)} = 0 THEN {1.0 if x == 'z' else 0.0}D ELSE"
                f" (CASE WHEN {upright} THEN {1.0 if x == 'z' else 0.0}D ELSE {1.0 if x == 'x' else 0.0}D END)"
                f" * {_norm2(a)} - ({dot})*{t}a{x} END" for x in "xyz"]
    chosen = [f"CASE WHEN {t}flat THEN {f} WHEN {t}0n = {t}best THEN {t}0{x} WHEN {t}1n = {t}best THEN {t}1{x}"
              f" ELSE {t}2{x} END AS {v}{x}" for f, x in zip(fallback, "xyz")]
    # Components below the rounding of the cross product count as zero for the sign rule.
    u = f"{out}u"
    flip = (f"({u}z < -{SIGN_FLOOR}D OR (abs({u}z) <= {SIGN_FLOOR}D AND ({u}y < -{SIGN_FLOOR}D"
            f" OR (abs({u}y) <= {SIGN_FLOOR}D AND {u}x < 0))))")
    return [
        parts + row_norms,
        norms + axis,
        [f"{best} AS {t}best", f"{best} <= 1e-28D * {lam}1*{lam}1*{lam}1*{lam}1 AS {t}flat"],
        chosen,
        [f"coalesce(try_divide(1.0D, sqrt({_norm2([v + x for x in 'xyz'])})), 0.0D) AS {v}s"],
        [f"{v}{x}*{v}s AS {u}{x}" for x in "xyz"],
        [f"CASE WHEN {flip} THEN -1.0D ELSE 1.0D END AS {u}s"],
        [f"{u}{x}*{u}s + 0.0D AS {out}{x}" for x in "xyz"],
    ]


def leading_stages(c: str, lam: str, out: str) -> Stages:
    """Stages that add a unit vector of the largest eigenvalue (sign not fixed)."""
    t = f"{out}t"
    parts, norms = _crosses(c, f"{lam}1", t)
    return [
        parts,
        norms,
        [f"greatest({t}0n, {t}1n, {t}2n) AS {t}best"],
        [f"coalesce(try_divide(1.0D, sqrt({t}best)), 0.0D) AS {t}s"],
        [f"(CASE WHEN {t}0n = {t}best THEN {t}0{x} WHEN {t}1n = {t}best THEN {t}1{x} ELSE {t}2{x} END) * {t}s AS {out}{x}" for x in "xyz"],
    ]


def run_stages(df, stages: list[Stages]):
    """Evaluate several stage lists side by side, one projection per depth."""
    for depth in range(max((len(s) for s in stages), default=0)):
        texts = [text for s in stages if depth < len(s) for text in s[depth]]
        df = df.selectExpr("*", *texts)
    return df
