"""Which way a fit runs, by its size in rows and bytes."""

from __future__ import annotations

from ..operators.grouped import GROUP_ROWS
from ..operators.normal import LOCAL_ROWS

MEMORY = 64 << 20  # bytes that a fit may take on the driver
WIDE = 1000  # parameters beyond which no k x k array is made


def estimate(n: int, k: int, variables: int = 1) -> dict:
    """Bytes of the points, of a full Jacobian (made only where rows are summed on the driver) and of the sums."""
    return {"data": n * (variables + 2) * 8, "jacobian": n * k * 8, "sums": 8 * (k * (k + 1) // 2 + k + 4)}


def plan(n: int, k: int, groups: int = 1, least_chunk_success: bool = False, variables: int = 1, memory: int = MEMORY) -> str:
    """local: rows fetched once, if points and Jacobian fit `memory`; aggregate: one aggregate per step; wide: no k x k array,
    where the sums don't fit `memory` or there are over WIDE parameters; grouped: solver per key; chunked: fits
    per chunk, merged."""
    size = estimate(n, k, variables)
    if groups > 1:
        return "grouped" if n / groups <= GROUP_ROWS and (size["data"] + size["jacobian"]) / groups <= memory else "aggregate"
    if k > WIDE or size["sums"] > memory:
        return "wide"
    if least_chunk_success:
        return "chunked"
    return "local" if n <= LOCAL_ROWS and size["data"] + size["jacobian"] <= memory else "aggregate"
