"""The clusterers by name, with their parameters and the labels they give."""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from sphaera.clusterers import anchor_clusterers as a
from sphaera.clusterers import ball_clusterers as b
from sphaera.clusterers import graph_clusterers as g
from sphaera.operators import scaling

Fit = Callable[..., DataFrame]

_COUNTS = ("anchors", "anchors_near", "graph_neighbours", "k_neighbors", "levels", "min_points", "near", "neighbours", "rounds", "sample_size", "p1", "p2")
# Parameter: least, most, and whether the least itself is allowed.
_RANGES: dict[str, tuple[float, float, bool]] = {
    "theta": (0, 1, False), "delta": (0, 1, False), "ratio": (0, math.inf, False), "percentile": (0, 1, False), "tau": (0, 1, False), "share": (0, 1, True), "core_share": (0, 1, True), "stop": (0, 1, True),
    "small": (0, 1, True), "gamma": (0, math.inf, True), "limit": (0, math.inf, True), "penalty": (0, math.inf, True), "gap": (0, math.inf, True), "tolerance": (0, math.inf, True), "beta": (0, math.inf, False),
    "sigma": (0, math.inf, False), "scale": (0, math.inf, False), "weight": (0, math.inf, False), "expand": (0, math.inf, False), "factor": (0, math.inf, False), "noise": (0, math.inf, True),
}


def check_parameters(name: str, parameters: dict[str, Any]) -> None:
    """Raises TypeError for counts that are no whole numbers and numbers that are none, ValueError for values out of range.

    None stands for a value chosen from the data. Two projections must be nested, and the anchors of the balanced tree a power of two.
    """
    for p, value in parameters.items():
        if value is None or p == "skip_first":
            continue
        if isinstance(value, bool) or not isinstance(value, int | float) or p in _COUNTS and not isinstance(value, int):
            raise TypeError(f"{name}: {p} must be a {'whole ' if p in _COUNTS else ''}number")
        least, most, closed = (1, math.inf, True) if p in _COUNTS else _RANGES.get(p, (-math.inf, math.inf, True))
        if p == "ratio" and name == "gb_dbscan":
            most = 1
        if not math.isfinite(value) or not (least <= value <= most) or value == least and not closed:
            raise ValueError(f"{name}: {p} must lie in {'[' if closed else '('}{least}, {most}]")
    p1, p2 = parameters.get("p1"), parameters.get("p2")
    if p1 is not None and p2 is not None and p2 > p1:
        raise ValueError(f"{name}: p2 must not exceed p1")
    if name == "agc_ild" and parameters.get("anchors") is not None and (parameters["anchors"] < 2 or parameters["anchors"] & (parameters["anchors"] - 1)):
        raise ValueError("agc_ild: anchors must be a power of two, 2 at least")


@dataclass(frozen=True)
class Clusterer:
    """One clusterer; ``counts`` tells whether k is given, detected or an upper bound."""

    name: str
    fit: Fit
    counts: str
    seeded: bool

    def parameters(self) -> dict[str, Any]:
        """Defaults of the parameters besides samples, k and seed."""
        return {n: p.default for n, p in inspect.signature(self.fit).parameters.items() if n not in ("samples", "k", "seed")}

    def run(self, samples: DataFrame, k: int, seed: int = 1, **parameters: Any) -> DataFrame:
        """(sample_id, label); raises for unknown or impossible parameters and unusable samples."""
        unknown = set(parameters) - set(self.parameters())
        if unknown:
            raise ValueError(f"{self.name} has no parameters {sorted(unknown)}")
        check_parameters(self.name, parameters)
        n = scaling.validate(samples)["n_samples"]
        if self.counts == "given" and not 2 <= k <= n:
            raise ValueError(f"k must lie between 2 and {n}")
        return self.fit(samples.select("sample_id", "features"), k, seed=seed, **parameters)


_ALL = [
    ("plgb_fsc", a.plgb_fsc, "given", True),
    ("my_v0", a.my_v0, "given", True),
    ("my_v1", a.my_v1, "given", True),
    ("my_v2", a.my_v2, "given", True),
    ("my_v3", a.my_v3, "given", True),
    ("my_v4", a.my_v4, "given", True),
    ("gb_pojg_gbdpc", b.gb_pojg_gbdpc, "given", False),
    ("gb_pojg_gbsc", b.gb_pojg_gbsc, "given", True),
    ("gbsc", b.gbsc, "given", True),
    ("sagbc", g.sagbc, "detected", True),
    ("gbct", b.gbct, "given", True),
    ("dpeak_nard", g.dpeak_nard, "detected", False),
    ("dbscan_nard", g.dbscan_nard, "detected", False),
    ("dadc_nard", g.dadc_nard, "detected", False),
    ("hcdc_nard", g.hcdc_nard, "detected", False),
    ("m3w", g.m3w, "detected", False),
    ("gb_dp", b.gb_dp, "given", True),
    ("gb_dbscan", g.gb_dbscan, "detected", False),
    ("mgagc", a.mgagc, "aimed at", True),
    ("fi_gbhc", b.fi_gbhc, "at most", False),
    ("pb_gbhc", b.pb_gbhc, "at most", False),
    ("egbdpm", b.egbdpm, "given", True),
    ("agc_ild", a.agc_ild, "given", True),
]
CLUSTERERS = {name: Clusterer(name, fit, counts, seeded) for name, fit, counts, seeded in _ALL}


def register(name: str, fit: Fit, counts: str = "given", seeded: bool = True) -> None:
    """Add a clusterer of one's own: fit(samples, k, seed=..., **parameters) -> (sample_id, label)."""
    CLUSTERERS[name] = Clusterer(name, fit, counts, seeded)
