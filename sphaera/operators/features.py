"""Feature scores: mutual information, discernibility, probability-density membership and graph importance.

Long tables (sample_id, f, v) carry one row an entry; every score is an aggregate by feature, so features are
independent groups and partial sums are made before the shuffle. Constant columns get no correlation and score
last. Null values take no part.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sphaera.operators.windows import EPS

NODES = 96


def _bin(v: Column, lo: Column, width: Column, bins: int) -> Column:
    return F.when(width > 0, F.least(F.floor((v - lo) / width) + 1, F.lit(bins))).otherwise(F.lit(1)).cast("int")


def histogram2d(rows: DataFrame, a: str, b: str, bins: int) -> DataFrame:
    """(i, j, n): counts in ``bins`` x ``bins`` equal cells, numbered from 1; the last cell is closed."""
    r = rows.agg(F.min(a).alias("la"), ((F.max(a) - F.min(a)) / bins).alias("wa"), F.min(b).alias("lb"), ((F.max(b) - F.min(b)) / bins).alias("wb"))
    cell = rows.crossJoin(F.broadcast(r)).select(_bin(F.col(a), F.col("la"), F.col("wa"), bins).alias("i"), _bin(F.col(b), F.col("lb"), F.col("wb"), bins).alias("j"))
    return cell.groupBy("i", "j").agg(F.count("*").alias("n"))


def mutual_information(long: DataFrame, label: str, bins: int) -> DataFrame:
    """(f, mi): information in nats that the binned values of each feature have about the label."""
    r = long.groupBy("f").agg(F.min("v").alias("lo"), ((F.max("v") - F.min("v")) / bins).alias("w"))
    h = long.join(r, "f").groupBy("f", _bin(F.col("v"), F.col("lo"), F.col("w"), bins).alias("i"), F.col(label).alias("y")).agg(F.count("*").alias("n"))
    a = h.groupBy("f", "i").agg(F.sum("n").alias("a"))
    b = h.groupBy("f", "y").agg(F.sum("n").alias("b"))
    t = h.groupBy("f").agg(F.sum("n").alias("t"))
    term = F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))
    return h.join(a, ["f", "i"]).join(b, ["f", "y"]).join(t, "f").groupBy("f").agg(F.sum(term).alias("mi"))


def weighted_information(long: DataFrame, label: str, weight: str, bins: int) -> DataFrame:
    """(f, mi): as ``mutual_information``, over quantile bins and weighted samples."""
    q = long.groupBy("f").agg(F.percentile("v", F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("edges"))
    cell = long.join(q, "f").select("f", F.size(F.filter("edges", lambda e: e < F.col("v"))).alias("i"), F.col(label).alias("y"), F.col(weight).alias("n"))
    h = cell.groupBy("f", "i", "y").agg(F.sum("n").alias("n"))
    a = h.groupBy("f", "i").agg(F.sum("n").alias("a"))
    b = h.groupBy("f", "y").agg(F.sum("n").alias("b"))
    t = h.groupBy("f").agg(F.sum("n").alias("t"))
    term = F.when(F.col("n") > 0, F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).otherwise(F.lit(0.0))
    return h.join(a, ["f", "i"]).join(b, ["f", "y"]).join(t, "f").groupBy("f").agg(F.sum(term).alias("mi"))


def correlations(samples: DataFrame) -> DataFrame:
    """(a, b, r) for features a < b: moments of all pairs are made within each row, then summed by pair."""
    both = samples.select(F.explode(F.flatten(F.transform("features", lambda v, i: F.transform("features", lambda w, j: F.struct(i.alias("a"), j.alias("b"), v.alias("v"), w.alias("w")))))).alias("p"))
    pairs = both.select("p.*").where("a < b")
    return pairs.groupBy("a", "b").agg(F.corr("v", "w").alias("r"))


def discernibility(samples: DataFrame) -> DataFrame:
    """(f, std, independence): sample deviation, and 1 less the mean absolute correlation with other features."""
    r = correlations(samples)
    both = r.select(F.col("a").alias("f"), "r").unionAll(r.select(F.col("b").alias("f"), "r"))
    independence = both.groupBy("f").agg((1 - F.avg(F.abs("r"))).alias("independence"))
    std = samples.select(F.posexplode("features").alias("f", "v")).groupBy("f").agg(F.stddev_samp("v").alias("std"))
    return std.join(independence, "f")


def dispersion_weights(long: DataFrame, beta: float) -> DataFrame:
    """(f, dispersion, weight): squared deviation from the cluster means and weights as its power -1/(beta-1)."""
    mean = long.groupBy("label", "f").agg(F.avg("v").alias("m"))
    d = long.join(mean, ["label", "f"]).groupBy("f").agg(F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))).alias("dispersion"))
    powered = d.withColumn("q", F.pow(F.greatest("dispersion", F.lit(EPS)), -1.0 / (beta - 1.0)))
    return powered.withColumn("weight", F.col("q") / F.sum("q").over(Window.partitionBy())).drop("q")


def pdmf_parts(spread: DataFrame) -> DataFrame:
    """(sample_id, f, spread_term, mu) from local spreads: clarity of a value's place and its centrality."""
    z = spread.groupBy("f").agg(F.greatest(F.max("left"), F.max("right"), F.lit(EPS)).alias("s"), F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    side = lambda c: F.exp(-1 / F.exp(F.col(c) / F.col("s")))
    mu = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.abs(F.col("v") - F.col("m")) / (F.col("sd") + EPS)))
    return spread.join(z, "f").select("sample_id", "f", (side("left") + side("right")).alias("spread_term"), mu.alias("mu"))


@lru_cache(maxsize=4)
def shape_entropy(lo: float = -1.0, hi: float = 1.0, points: int = 513) -> tuple[np.ndarray, np.ndarray]:
    """Grid and values of the mean binary entropy of a normal step shifted by mu, by Gauss-Legendre nodes."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    t = np.tan(math.pi * ((x + 1) / 2) - math.pi / 2)
    grid = np.linspace(lo, hi, points)
    cdf = np.vectorize(lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2))))(t[None, :] - grid[:, None])
    cdf = np.clip(cdf, 1e-300, 1 - 1e-16)
    h = -(cdf * np.log(cdf) + (1 - cdf) * np.log1p(-cdf))
    return grid, (h * (w / 2)).sum(1)


def shape_column(mu: Column, lo: float = -1.0, hi: float = 1.0, points: int = 513) -> Column:
    """The tabulated shape entropy at ``mu``, interpolated between grid points, in the JVM."""
    _, values = shape_entropy(lo, hi, points)
    table = F.array(*[F.lit(float(v)) for v in values])
    at = (mu - lo) / (hi - lo) * (points - 1)
    base = F.least(F.floor(at), F.lit(points - 2))
    i = base.cast("int")
    return F.element_at(table, i + 1) + (at - base) * (F.element_at(table, i + 2) - F.element_at(table, i + 1))


def pdmf_intensity(spread: DataFrame) -> DataFrame:
    """(sample_id, f, intensity): log weight of each value by probability-density membership."""
    h0 = float(np.interp(0.0, *shape_entropy()))
    p = pdmf_parts(spread)
    e = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), shape_column(F.col("mu")) * F.col("spread_term") / (2 * h0)))
    return p.select("sample_id", "f", F.log1p(-e).alias("intensity"))


def edge_similarity(edges: DataFrame, long: DataFrame) -> DataFrame:
    """(a, b, f, s): how alike the two ends of each edge are in each feature."""
    i = long.select(F.col("sample_id").alias("a"), "f", F.col("v").alias("va"))
    j = long.select(F.col("sample_id").alias("b"), "f", F.col("v").alias("vb"))
    return edges.select("a", "b").join(i, "a").join(j, ["b", "f"]).select("a", "b", "f", F.exp(-F.abs(F.col("va") - F.col("vb"))).alias("s"))


def membership_similarity(edges: DataFrame, spread: DataFrame, share: float) -> DataFrame:
    """(a, b, f, s): value similarity with weight ``share``, and that of spreads and centrality with the rest."""
    h0 = float(np.interp(0.0, *shape_entropy(-2.0, 2.0, 1025)))
    z = spread.groupBy("f").agg(F.greatest(F.max("left"), F.max("right"), F.lit(EPS)).alias("s"))
    parts = spread.join(pdmf_parts(spread).select("sample_id", "f", "mu"), ["sample_id", "f"]).join(z, "f")
    parts = parts.select("sample_id", "f", F.struct("v", F.exp(F.col("left") / F.col("s")).alias("l"), F.exp(F.col("right") / F.col("s")).alias("r"), "mu").alias("p"))
    i = parts.select(F.col("sample_id").alias("a"), "f", F.col("p").alias("x"))
    j = parts.select(F.col("sample_id").alias("b"), "f", F.col("p").alias("y"))
    gap = lambda c: F.exp(-F.abs(F.col(f"x.{c}") - F.col(f"y.{c}")))
    shape = shape_column(F.col("x.mu") - F.col("y.mu"), -2.0, 2.0, 1025)
    value = share * gap("v") + (1 - share) * (gap("l") + gap("r")) * shape / (2 * h0)
    return edges.select("a", "b").join(i, "a").join(j, ["b", "f"]).select("a", "b", "f", value.alias("s"))


def graph_importance(similarity: DataFrame) -> DataFrame:
    """(f, importance): change of the mean graph when a feature is left out, relative to the graph."""
    g = similarity.groupBy("a", "b").agg(F.avg("s").alias("g"), F.count("*").alias("p"))
    t = g.agg(F.sum(F.col("g") * F.col("g")).alias("t"))
    d = similarity.join(g, ["a", "b"]).groupBy("f").agg(F.sum((F.col("s") - F.col("g")) * (F.col("s") - F.col("g"))).alias("d"), F.max("p").alias("p"))
    scale = F.greatest(F.col("p") - 1, F.lit(1))
    return d.crossJoin(F.broadcast(t)).select("f", (F.col("d") / (scale * scale * (F.col("t") + EPS))).alias("importance"))
