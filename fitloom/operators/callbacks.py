"""Callbacks between iterations: (iteration, cost, theta, info)."""

from __future__ import annotations

import math
import sys
import time

from .solve import Stop


class Chain:
    def __init__(self, *calls):
        self.calls = calls

    def __call__(self, *a):
        for c in self.calls:
            c(*a)


def stopped_at(costs: list, patience: int, min_delta: float) -> int | None:
    """Place of the cost at which a history stops: the first after which `patience` finite costs in a row did not fall
    by more than min_delta below the best that had."""
    best = last = None
    for i, c in enumerate(costs):
        if not math.isfinite(c):
            continue
        if best is None or c < best - min_delta:
            best, last = c, 0
        else:
            last += 1
            if last >= patience:
                return i
    return None


class EarlyStopping:
    """Ends a fit whose costs, as far as they are finite, no longer improve; see stopped_at()."""

    def __init__(self, patience: int = 10, min_delta: float = 1e-6):
        self.patience, self.min_delta, self.costs = patience, min_delta, []

    def __call__(self, iteration, cost, theta, info):
        self.costs.append(float(cost))
        if stopped_at(self.costs, self.patience, self.min_delta) is not None:
            raise Stop


class Telemetry:
    """Counts of events by name and the costs at which they came, for reports of hybrid fits and searches."""

    def __init__(self):
        self.events: list = []

    def record(self, name: str, **values) -> None:
        self.events.append((name, values))

    def __call__(self, iteration, cost, theta, info):
        self.record("iteration", iteration=iteration, cost=float(cost), g_norm=float(info.get("g_norm", math.nan)))

    def summary(self) -> dict:
        """count by name, and of iterations the first and last cost and the share of steps that lowered it."""
        names = [n for n, _ in self.events]
        costs = [v["cost"] for n, v in self.events if n == "iteration"]
        down = [b < a for a, b in zip(costs, costs[1:])]
        return {"counts": {n: names.count(n) for n in dict.fromkeys(names)}, "first": costs[0] if costs else None, "last": costs[-1] if costs else None, "falling": sum(down) / len(down) if down else None}


class IterationLog:
    """One line per iteration to a stream."""

    def __init__(self, stream=None, every: int = 1):
        self.stream, self.every, self.began = stream or sys.stderr, every, time.time()

    def __call__(self, iteration, cost, theta, info):
        if iteration % self.every == 0:
            print(f"{iteration}\t{cost:.10g}\t{info['g_norm']:.3g}\t{time.time() - self.began:.2f}", file=self.stream)
