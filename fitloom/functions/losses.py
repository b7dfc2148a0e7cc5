"""Robust losses rho(z) of squared scaled residuals, as expressions with their first two derivatives."""

from __future__ import annotations

from . import expr as E

Z = E.var("z")
#: linear, soft_l1, huber, cauchy, arctan
RHO = {
    "linear": Z,
    "soft_l1": 2 * (E.sqrt(1 + Z) - 1),
    "huber": E.where(Z < 1, Z, 2 * E.sqrt(Z) - 1),
    "cauchy": E.log(1 + Z),
    "arctan": E.atan(Z),
}


def loss(which) -> tuple:
    """(rho, rho', rho'') of a name or of an expression in z."""
    rho = RHO[which] if isinstance(which, str) else which
    first = E.diff(rho, "z")
    return rho, first, E.diff(first, "z")
