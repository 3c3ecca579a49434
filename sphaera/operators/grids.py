"""The parameter grids an experiment runs by default, for a table of n samples and d features."""

from __future__ import annotations

import math
from typing import Any

from sphaera.operators.harness import counts_and_ratios, grid, neighbour_count

SEEDS = (1, 2, 3)
NMI_AVERAGE = "geometric"

# The published grids of the algorithms.
PURITY = (0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
GLOBAL_SHARES = (0.25, 0.50, 0.75)
LOCAL_SHARES = (0.05, 0.10, 0.25, 0.50, 0.75)
SPREAD_NEIGHBOURS = (5, 10)
GRAPH_NEIGHBOURS = (3, 5, 10)
VALUE_SHARES = (0.1, 0.5, 0.9)
REDUNDANCY = (0.0, 0.1, 0.3, 0.5, 0.7)
STABILITY = (0.001, 0.01, 0.05, 0.1, 0.3, 0.5, 0.7, 0.9)
FI_RATIOS = (0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05)
PB_PERCENTILES = (1, 5, 10, 20, 25, 30)


def _steps(first: int, last: int, by: float) -> list[float]:
    return [round(i * by, 6) for i in range(first, last + 1)]


def default_grid(name: str, n: int, d: int, anchors: int | None = None) -> list[dict[str, Any]]:
    """All settings of one algorithm; values that coincide for n and d come once."""
    near = sorted({neighbour_count(k, n) for k in SPREAD_NEIGHBOURS})
    graph = sorted({neighbour_count(k, n) for k in GRAPH_NEIGHBOURS})

    def local(p1: int, counts: range | tuple[int, ...] = (), shares: tuple[float, ...] = LOCAL_SHARES) -> list[int]:
        return [p for p in counts_and_ratios(counts, shares, p1) if p < p1] or [p1]

    def nested(p1s: tuple[int, ...], rest: dict[str, Any], **of_local: Any) -> list[dict[str, Any]]:
        return [s for p1 in p1s for s in grid({"p1": [p1], "p2": local(p1, **of_local), **rest})]

    if name == "plgb_fsc":
        return nested(counts_and_ratios((), (0.75,), d), {"theta": PURITY}, counts=range(4, 201, 4), shares=())
    family: dict[str, Any] = {"theta": PURITY, "neighbours": near}
    if name == "my_v2":
        return grid({"limit": STABILITY, **family, "graph_neighbours": sorted({neighbour_count(k, n) for k in SPREAD_NEIGHBOURS}), "share": (0.5,)})
    if name in ("my_v0", "my_v1", "my_v3", "my_v4"):
        if name != "my_v0":
            family |= {"graph_neighbours": graph, "share": VALUE_SHARES}
        if name == "my_v3":
            family |= {"penalty": REDUNDANCY}
        return nested(counts_and_ratios((), GLOBAL_SHARES, d), family)
    pojg = {"gamma": _steps(0, 20, 0.05), "delta": _steps(4, 10, 0.1)}
    simple: dict[str, dict[str, Any]] = {
        "gb_pojg_gbdpc": pojg,
        "gb_pojg_gbsc": pojg | {"sigma": [*range(1, 11), *range(20, 201, 10)]},
        "gbsc": {"sigma": [1.0]},
        "sagbc": {"tau": _steps(1, 4, 0.1), "neighbours": [4, 5, 6], "scale": _steps(15, 30, 0.1)},
        "m3w": {"neighbours": list(range(5, 31)), "levels": list(range(2, 13))},
        "gb_dbscan": {"ratio": _steps(1, 100, 0.01)},
        "fi_gbhc": {"ratio": FI_RATIOS},
        "pb_gbhc": {"percentile": [q / 100 for q in PB_PERCENTILES]},
        "egbdpm": {"k_neighbors": list(range(2, 11))},
        "agc_ild": {"anchors": [2**p for p in range(5, 13) if 2**p <= n] or [2 ** int(math.log2(max(n, 2)))], "beta": [10.0**p for p in range(-5, 5)]},
    }
    if name == "mgagc":
        root = math.isqrt(anchors or n)
        return grid({"near": list(range(1, max(root, 2), max(root // 10, 2))), "beta": [b / 100 for b in range(1, 21, 2)]})
    return grid(simple.get(name, {}))
