"""External clustering metrics from the contingency table of true and predicted labels.

The table is a map-side aggregate of classes times clusters; the relational metrics are sums over it. Matching
and the adjustment of mutual information work on that table on the driver, behind a check of its size.
Labels of -1 are an ordinary cluster. Rows with a null label are not counted. An empty table gives null metrics.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CELLS = 4_000_000
NAMES = ("acc", "nmi", "ari", "ami", "f_measure", "macro_f1", "pairwise_f1", "fmi", "purity", "rand_index")


def contingency(labels: DataFrame) -> DataFrame:
    """(y, label, n) of (y, label) rows."""
    return labels.where("y is not null and label is not null").groupBy("y", "label").agg(F.count("*").alias("n"))


def _sums(table: DataFrame) -> DataFrame:
    """One row: n and the sums of squares of cells, classes and clusters, and the entropies."""
    n2 = lambda c: F.sum(F.col(c) * F.col(c))
    h = lambda c: F.sum(F.col(c) * F.ln(F.col(c)))
    cells = table.agg(F.sum("n").alias("n"), n2("n").alias("cells2"), h("n").alias("cells_h"))
    rows = table.groupBy("y").agg(F.sum("n").alias("a")).agg(n2("a").alias("rows2"), h("a").alias("rows_h"))
    cols = table.groupBy("label").agg(F.sum("n").alias("b")).agg(n2("b").alias("cols2"), h("b").alias("cols_h"))
    return cells.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(cols))


def pair_counts(table: DataFrame) -> DataFrame:
    """One row: pairs together in both, in the classes only, in the clusters only, in neither."""
    c = F.col
    total = c("n") * (c("n") - 1) / 2
    tp = (c("cells2") - c("n")) / 2
    fn = (c("rows2") - c("cells2")) / 2
    fp = (c("cols2") - c("cells2")) / 2
    return _sums(table).select(tp.alias("tp"), fn.alias("fn"), fp.alias("fp"), (total - tp - fn - fp).alias("tn"))


def pair_metrics(table: DataFrame) -> DataFrame:
    """One row: pairwise_f1, rand_index, ari, fmi."""
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    total = tp + fn + fp + tn
    pairwise = F.when(2 * tp + fp + fn == 0, 1.0).otherwise(2 * tp / (2 * tp + fp + fn))
    rand = F.when(total == 0, 1.0).otherwise((tp + tn) / total)
    ari = F.when((fn == 0) & (fp == 0), 1.0).otherwise(2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)))
    fmi = F.when((tp + fp == 0) | (tp + fn == 0), 0.0).otherwise(tp / F.sqrt((tp + fp) * (tp + fn)))
    return pair_counts(table).select(pairwise.alias("pairwise_f1"), rand.alias("rand_index"), ari.alias("ari"), fmi.alias("fmi"))


def purity(table: DataFrame) -> DataFrame:
    """One row: share of samples in the most frequent class of their cluster."""
    best = table.groupBy("label").agg(F.max("n").alias("m"), F.sum("n").alias("s"))
    return best.agg((F.sum("m") / F.sum("s")).alias("purity"))


def f_measure(table: DataFrame) -> DataFrame:
    """One row: class-size weighted best F of each class over the clusters."""
    rows = table.groupBy("y").agg(F.sum("n").alias("a"))
    cols = table.groupBy("label").agg(F.sum("n").alias("b"))
    f = 2 * F.col("n") / (F.col("a") + F.col("b"))
    best = table.join(rows, "y").join(cols, "label").groupBy("y", "a").agg(F.max(f).alias("f"))
    return best.agg((F.sum(F.col("a") * F.col("f")) / F.sum("a")).alias("f_measure"))


def information(table: DataFrame) -> DataFrame:
    """One row: entropies of classes and clusters and their mutual information, in nats."""
    c, n = F.col, F.col("n")
    hy = F.ln(n) - c("rows_h") / n
    hl = F.ln(n) - c("cols_h") / n
    mi = F.ln(n) + (c("cells_h") - c("rows_h") - c("cols_h")) / n
    clip = lambda v: F.greatest(v, F.lit(0.0))
    return _sums(table).select(clip(hy).alias("h_true"), clip(hl).alias("h_pred"), clip(mi).alias("mi"))


def nmi(table: DataFrame, average: str = "arithmetic") -> DataFrame:
    """One row: mutual information over the min, geometric, arithmetic or max mean of the entropies."""
    hy, hl = F.col("h_true"), F.col("h_pred")
    mean = {"min": F.least(hy, hl), "geometric": F.sqrt(hy * hl), "arithmetic": (hy + hl) / 2, "max": F.greatest(hy, hl)}[average]
    tiny = F.lit(1e-12)
    value = F.when((hy <= tiny) & (hl <= tiny), 1.0).when(mean <= tiny, 0.0).otherwise(F.col("mi") / mean)
    return information(table).select(value.alias("nmi"))


def collect_table(table: DataFrame) -> tuple[np.ndarray, list, list]:
    """The contingency matrix, true and predicted labels; refuses more than ``MAX_CELLS`` cells."""
    size = table.agg(F.countDistinct("y"), F.countDistinct("label")).first()
    if size[0] * size[1] > MAX_CELLS:
        raise ValueError(f"{size[0]} classes and {size[1]} clusters are too many to match")
    rows = table.collect()
    true, pred = sorted({r.y for r in rows}), sorted({r.label for r in rows})
    m = np.zeros((len(true), len(pred)), np.int64)
    for r in rows:
        m[true.index(r.y), pred.index(r.label)] = r.n
    return m, true, pred


def best_matching(profit: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of greatest total profit: shortest augmenting paths with potentials."""
    flip = profit.shape[0] > profit.shape[1]
    cost = -(profit.T if flip else profit).astype(float)
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        slack, came = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, bool)
        row, last = i, -1
        while True:
            reduced = cost[row] - u[row] - v
            better = ~done & (reduced < slack)
            slack[better], came[better] = reduced[better], last
            j = int(np.argmin(np.where(done, np.inf, slack)))
            step = slack[j]
            used = np.nonzero(done)[0]
            u[i] += step
            u[owner[used]] += step
            v[used] -= step
            slack[~done] -= step
            done[j] = True
            last = j
            if owner[j] < 0:
                break
            row = owner[j]
        while last >= 0:
            before = came[last]
            owner[last] = i if before < 0 else owner[before]
            last = before
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return [(j, i) if flip else (i, j) for i, j in pairs]


_SMALL = np.cumsum(np.concatenate([[0.0], np.log(np.arange(1, 4096))]))


def log_factorial(k: np.ndarray | int) -> np.ndarray:
    """ln k!, from a short table and Stirling's series beyond it."""
    k = np.asarray(k)
    x = np.maximum(k, len(_SMALL) - 1).astype(float)
    series = x * np.log(x) - x + np.log(2 * np.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(k < len(_SMALL), _SMALL[np.minimum(k, len(_SMALL) - 1)], series)


def expected_information(a: np.ndarray, b: np.ndarray) -> float:
    """Expected mutual information of random labellings with the given class and cluster sizes.

    A cell's count is hypergeometric; counts further than 45 deviations and 100 from its mean have a probability that no double holds.
    """
    n = int(a.sum())
    total = 0.0
    for x in a.tolist():
        for y in b.tolist():
            mean, spread = x * y / n, math.sqrt(max(x * y / n * (n - x) / n * (n - y) / max(1, n - 1), 0.0))
            low, high = max(1, x + y - n, math.floor(mean - 45 * spread - 100)), min(x, y, math.ceil(mean + 45 * spread + 100))
            k = np.arange(low, high + 1)
            if not len(k):
                continue
            lg = log_factorial
            p = np.exp(lg(x) + lg(y) + lg(n - x) + lg(n - y) - lg(n) - lg(k) - lg(x - k) - lg(y - k) - lg(n - x - y + k))
            total += float((k / n * np.log(n * k / (x * y)) * p).sum())
    return total


def matched_metrics(m: np.ndarray) -> dict[str, float]:
    """acc, macro_f1 and ami of a contingency matrix.

    Unmatched clusters become classes of their own; a class no sample is mapped to has an F of 0.
    """
    n = m.sum()
    pairs = best_matching(m)
    acc = sum(m[i, j] for i, j in pairs) / n
    to = dict((j, i) for i, j in pairs)
    scores = [2 * m[i, j] / (m[i].sum() + m[:, j].sum()) for i, j in pairs]
    missing = m.shape[0] - len({i for i, _ in pairs})
    own = sum(1 for j in range(m.shape[1]) if j not in to)
    macro = sum(scores) / (len(scores) + missing + own)
    a, b = m.sum(1), m.sum(0)
    plogp = lambda c: float(-(c / n * np.log(c / n)).sum())
    ha, hb = plogp(a), plogp(b)
    i, j = np.nonzero(m)
    mi = float((m[i, j] / n * np.log(n * m[i, j] / (a[i] * b[j]))).sum())
    if len(a) == len(b) == 1 or len(a) == len(b) == n:
        ami = 1.0
    else:
        emi = expected_information(a, b)
        gap = (ha + hb) / 2 - emi
        gap = min(gap, -np.finfo(float).eps) if gap < 0 else max(gap, np.finfo(float).eps)
        ami = (mi - emi) / gap
    return {"acc": float(acc), "macro_f1": float(macro), "ami": float(ami)}


def evaluate(labels: DataFrame, average: str = "arithmetic") -> DataFrame:
    """One row with the ten metrics of (y, label) rows."""
    spark = labels.sparkSession
    table = contingency(labels).cache()
    try:
        m, _, _ = collect_table(table)
        if not m.size:
            raise ValueError("no labelled samples")
        joined = table.agg(F.sum("n").alias("n")).first().n
        parts = {"nmi": nmi(table, average).first().nmi, "purity": purity(table).first().purity, "f_measure": f_measure(table).first().f_measure}
        parts |= pair_metrics(table).first().asDict() | matched_metrics(m)
    finally:
        table.unpersist()
    assert joined == m.sum() and all(math.isfinite(v) for v in parts.values())
    return spark.createDataFrame([tuple(float(parts[k]) for k in NAMES)], ", ".join(f"{k} double" for k in NAMES))
