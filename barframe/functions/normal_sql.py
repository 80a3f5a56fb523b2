"""The normal-distribution formulas of functions.normal as SQL text, for checking statements."""

from barframe.functions import normal as N


def _poly(coef: tuple[float, ...], x: str) -> str:
    out = repr(coef[0]) + "::DOUBLE"
    for c in coef[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def cdf(x: str) -> str:
    a = f"abs({x})"
    near = f"exp(-({x}) * ({x}) / 2) * {_poly(N.CDF_NUM, a)} / {_poly(N.CDF_DEN, a)}"
    return f"(CASE WHEN {x} > 0 THEN 1 - {near} WHEN {a} > 37 THEN 0 ELSE {near} END)"


def two_sided_p(z: str) -> str:
    return f"(2 * {cdf(f'(-abs({z}))')})"


def ppf_start(p: str) -> str:
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - ({p})))"
    q = f"(({p}) - 0.5)"
    r = f"({q} * {q})"
    return (
        f"(CASE WHEN {p} < {N.INV_TAIL} THEN {_poly(N.INV_C, low)} / {_poly(N.INV_D, low)} "
        f"WHEN {p} > 1 - {N.INV_TAIL} THEN -{_poly(N.INV_C, high)} / {_poly(N.INV_D, high)} "
        f"ELSE {_poly(N.INV_A, r)} * {q} / {_poly(N.INV_B, r)} END)"
    )
