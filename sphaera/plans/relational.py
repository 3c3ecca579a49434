"""Queries of the relational operators, each with its SQL.

Values are rounded to six places before they are compared; ids break ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sphaera.functions.vectors import norm, position_of_max
from sphaera.operators import balls, distance, features, metrics, scaling, windows
from sphaera.session import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NEIGHBOURS = 5


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(c: str, name: str | None = None):
    return F.round(c, 6).alias(name or c)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaling.as_samples(tables(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Shared parts of the SQL.
S = "s AS (SELECT vec_id AS sample_id, CAST(embedding AS DOUBLE[]) AS x, label AS y FROM embeddings)"
LONG = f"{S}, l AS (SELECT sample_id, y, unnest(range(len(x))) AS f, unnest(x) AS v FROM s)"
PAIRS = f"{S}, p AS (SELECT a.sample_id AS a, b.sample_id AS b, list_distance(a.x, b.x) AS d FROM s a JOIN s b ON a.sample_id <> b.sample_id)"
KNN = f"{PAIRS}, k AS (SELECT a, b, d, CAST(row_number() OVER (PARTITION BY a ORDER BY d, b) AS INTEGER) AS rank FROM p QUALIFY rank <= {NEIGHBOURS})"
CENTERS = f"{LONG}, c AS (SELECT y, f, avg(v) AS m FROM l GROUP BY y, f), cc AS (SELECT y, list(m ORDER BY f) AS c FROM c GROUP BY y)"
BALLS = f"""{CENTERS}, d AS (SELECT s.sample_id, s.y AS ball, cc.c AS center, list_distance(s.x, cc.c) AS d FROM s JOIN cc ON s.y = cc.y),
b AS (SELECT ball, any_value(center) AS center, count(*) AS size, avg(d) AS avg_radius, max(d) AS max_radius, sum(d) AS sum_radius, stddev_pop(d) AS std_radius FROM d GROUP BY ball)"""
PRED = f"""{CENTERS}, n AS (SELECT s.sample_id, s.y, cc.y AS label FROM s, cc QUALIFY row_number() OVER (PARTITION BY s.sample_id ORDER BY list_distance(s.x, cc.c), cc.y) = 1),
t AS (SELECT y, label, count(*) AS n FROM n GROUP BY y, label),
ra AS (SELECT y, sum(n) AS a FROM t GROUP BY y), cb AS (SELECT label, sum(n) AS b FROM t GROUP BY label),
m AS (SELECT sum(n) AS n, sum(n * n) AS c2, (SELECT sum(a * a) FROM ra) AS r2, (SELECT sum(b * b) FROM cb) AS k2 FROM t),
pc AS (SELECT (c2 - n) / 2 AS tp, (r2 - c2) / 2 AS fn, (k2 - c2) / 2 AS fp, n * (n - 1) / 2 - (c2 - n) / 2 - (r2 - c2) / 2 - (k2 - c2) / 2 AS tn FROM m),
h AS (SELECT (SELECT -sum(a / n * ln(a / n)) FROM ra) AS hy, (SELECT -sum(b / n * ln(b / n)) FROM cb) AS hl,
  (SELECT sum(t.n / m.n * ln(t.n * m.n / (a * b))) FROM t JOIN ra USING (y) JOIN cb USING (label)) AS mi FROM m)"""


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, y, label): the nearest class mean."""
    s = samples(spark, sf_dir)
    means = balls.centers(s.withColumnRenamed("y", "ball")).select(F.col("ball").cast("long").alias("sample_id"), F.col("center").alias("features"))
    near = distance.knn_join(s, means, 1, skip_same=False)
    return s.join(near, s["sample_id"] == near["a"]).select("sample_id", "y", F.col("b").cast("int").alias("label"))


def labelled_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).withColumnRenamed("y", "ball")


@query("q_dataset_stats", f"""WITH {S} SELECT count(*) AS n_samples, CAST(min(len(x)) AS INTEGER) AS min_width, CAST(max(len(x)) AS INTEGER) AS max_width,
count(DISTINCT y) AS n_classes, count(*) FILTER (len(list_filter(x, lambda v: NOT isfinite(v))) > 0) AS n_not_finite FROM s""")
def q_dataset_stats(spark, sf_dir):
    return scaling.dataset_stats(samples(spark, sf_dir))


@query("q_dataset_catalog", """SELECT d.dataset_name, count(DISTINCT sample_id) AS n_samples, count(DISTINCT CASE WHEN y >= 0 THEN y END) AS n_classes, max(len(x)) AS width
FROM dataset d WHERE x IS NOT NULL GROUP BY d.dataset_name""")
def q_dataset_catalog(spark, sf_dir):
    d = tables(spark, sf_dir, "dataset").where("x is not null")
    return d.groupBy("dataset_name").agg(F.countDistinct("sample_id").alias("n_samples"), F.countDistinct(F.when(F.col("y") >= 0, F.col("y"))).alias("n_classes"), F.max(F.size("x").cast("long")).alias("width"))


@query("q_minmax", f"""WITH {LONG}, r AS (SELECT f, min(v) AS lo, max(v) AS hi FROM l GROUP BY f)
SELECT sample_id, CAST(l.f AS INTEGER) AS f, round((v - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 6) AS v FROM l JOIN r USING (f)""")
def q_minmax(spark, sf_dir):
    return rounded(scaling.long_form(scaling.min_max(samples(spark, sf_dir))), "v")


@query("q_lineitem_ranges", """SELECT 0 AS f, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem UNION ALL SELECT 1, min(l_extendedprice), max(l_extendedprice) FROM lineitem
UNION ALL SELECT 2, min(l_discount), max(l_discount) FROM lineitem UNION ALL SELECT 3, min(l_tax), max(l_tax) FROM lineitem""")
def q_lineitem_ranges(spark, sf_dir):
    li = tables(spark, sf_dir, "lineitem").select(F.lit(0).cast("long").alias("sample_id"), F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("features"))
    return scaling.column_ranges(li)


@query("q_local_minmax", f"""WITH {LONG} SELECT sample_id, CAST(f AS INTEGER) AS f, round((v - min(v) OVER w) / CASE WHEN max(v) OVER w > min(v) OVER w THEN max(v) OVER w - min(v) OVER w ELSE 1 END, 6) AS v
FROM l WINDOW w AS (PARTITION BY y, f)""")
def q_local_minmax(spark, sf_dir):
    s = samples(spark, sf_dir)
    long = s.select("sample_id", "y", F.posexplode("features").alias("f", "v"))
    r = long.groupBy("y", "f").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    return long.join(r, ["y", "f"]).select("sample_id", "f", F.round((F.col("v") - F.col("lo")) / width, 6).alias("v"))


@query("q_feature_projection", f"WITH {S} SELECT sample_id, round(x[8], 6) AS f0, round(x[4], 6) AS f1, round(x[2], 6) AS f2 FROM s")
def q_feature_projection(spark, sf_dir):
    p = scaling.project_features(samples(spark, sf_dir), [7, 3, 1])
    return p.select("sample_id", *[F.round(F.col("features")[i], 6).alias(f"f{i}") for i in range(3)])


@query("q_constant_mask", f"WITH {LONG} SELECT CAST(f AS INTEGER) AS f, max(v) > min(v) AS varies FROM l GROUP BY f")
def q_constant_mask(spark, sf_dir):
    return scaling.column_ranges(samples(spark, sf_dir)).select("f", (F.col("hi") > F.col("lo")).alias("varies"))


@query("q_label_encode", "SELECT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code FROM part")
def q_label_encode(spark, sf_dir):
    return scaling.encode_labels(tables(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand")


@query("q_one_hot_class", f"WITH {S} SELECT sample_id, list_position(x, list_max(x)) - 1 AS class FROM s")
def q_one_hot_class(spark, sf_dir):
    return samples(spark, sf_dir).select("sample_id", position_of_max(F.col("features")).cast("int").alias("class"))


@query("q_l2_norms", f"WITH {S} SELECT sample_id, round(sqrt(list_inner_product(x, x)), 6) AS norm FROM s")
def q_l2_norms(spark, sf_dir):
    return samples(spark, sf_dir).select("sample_id", F.round(norm(F.col("features")), 6).alias("norm"))


def _knn(spark, sf_dir):
    return distance.knn(samples(spark, sf_dir), NEIGHBOURS)


@query("q_knn5", f"WITH {KNN} SELECT a, b, round(d, 6) AS d, rank FROM k")
def q_knn5(spark, sf_dir):
    return rounded(_knn(spark, sf_dir), "d")


@query("q_mutual_knn", f"WITH {KNN} SELECT x.a, x.b, round(x.d, 6) AS d FROM k x JOIN k y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def q_mutual_knn(spark, sf_dir):
    return rounded(distance.mutual_edges(_knn(spark, sf_dir)), "d")


@query("q_union_knn_edges", f"WITH {KNN} SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM k")
def q_union_knn_edges(spark, sf_dir):
    return distance.union_edges(_knn(spark, sf_dir))


@query("q_local_scale", f"WITH {KNN} SELECT a, round(max(d), 6) AS scale FROM k GROUP BY a")
def q_local_scale(spark, sf_dir):
    return rounded(distance.local_scale(_knn(spark, sf_dir)), "scale")


@query("q_rknn_density", f"WITH {KNN}, c AS (SELECT a, max(d) AS s FROM k GROUP BY a) SELECT b, round(sum(exp(-d * d / (s * s))), 6) AS density FROM k JOIN c USING (a) GROUP BY b")
def q_rknn_density(spark, sf_dir):
    return rounded(distance.reverse_density(_knn(spark, sf_dir)), "density")


@query("q_lambda_estimate", f'WITH {KNN} SELECT round(avg(d) + stddev_pop(d), 6) AS "lambda" FROM k')
def q_lambda_estimate(spark, sf_dir):
    return rounded(distance.link_threshold(_knn(spark, sf_dir)), "lambda")


@query("q_shared_neighbours", f"WITH {KNN} SELECT x.a, y.a AS b, count(*) AS shared FROM k x JOIN k y ON x.b = y.b AND x.a < y.a GROUP BY x.a, y.a")
def q_shared_neighbours(spark, sf_dir):
    return distance.shared_neighbours(_knn(spark, sf_dir))


@query("q_two_hops", f"WITH {KNN} SELECT a, b FROM k UNION SELECT x.a, y.b FROM k x JOIN k y ON x.b = y.a WHERE x.a <> y.b")
def q_two_hops(spark, sf_dir):
    return distance.two_hops(_knn(spark, sf_dir))


@query("q_knn_components", f"""WITH RECURSIVE {KNN}, e AS (SELECT x.a, x.b FROM k x JOIN k y ON x.a = y.b AND x.b = y.a),
reach(node, component) USING KEY (node) AS (
  SELECT DISTINCT a AS node, a AS component FROM e
  UNION
  SELECT e.b AS node, min(r.component) AS component FROM reach r JOIN e ON e.a = r.node JOIN recurring.reach o ON o.node = e.b WHERE r.component < o.component GROUP BY e.b
) SELECT node, component FROM reach""")
def q_knn_components(spark, sf_dir):
    from sphaera.operators.graph import connected_components

    return connected_components(distance.mutual_edges(_knn(spark, sf_dir)))


ANCHORS = 20
GRAPH = f"""{S}, a AS (SELECT sample_id AS anchor_id, x AS ax FROM s ORDER BY sample_id LIMIT {ANCHORS}),
g AS (SELECT sample_id, anchor_id, list_distance(x, ax) AS d FROM s, a QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY d, anchor_id) <= 3),
w AS (SELECT *, greatest(exp(-d * d / (2 * power((SELECT avg(d) FROM g), 2))), 2.220446049250313e-16) AS w FROM g)"""


def _graph(spark, sf_dir):
    s = samples(spark, sf_dir)
    return distance.anchor_graph(s, s.orderBy("sample_id").limit(ANCHORS), 3)


@query("q_sample_anchor_graph", f"WITH {GRAPH} SELECT sample_id, anchor_id, round(d, 6) AS d, round(w, 6) AS w FROM w")
def q_sample_anchor_graph(spark, sf_dir):
    return rounded(_graph(spark, sf_dir), "d", "w")


@query("q_transfer_cut_gram", f"""WITH {GRAPH}, t AS (SELECT sample_id, sum(w) AS deg FROM w GROUP BY sample_id)
SELECT l.anchor_id AS a, r.anchor_id AS b, round(sum(l.w / deg * r.w), 6) AS w FROM w l JOIN t USING (sample_id) JOIN w r USING (sample_id) GROUP BY l.anchor_id, r.anchor_id""")
def q_transfer_cut_gram(spark, sf_dir):
    return rounded(distance.anchor_gram(_graph(spark, sf_dir)), "w")


@query("q_ball_stats", f"""WITH {BALLS} SELECT ball, b.size, round(b.avg_radius, 6) AS avg_radius, round(max_radius, 6) AS max_radius, round(sum_radius, 6) AS sum_radius,
(SELECT count(*) FROM d WHERE d.ball = b.ball AND d.d <= b.avg_radius) AS num_in_ball, round(std_radius, 6) AS std_radius, round(b.size / sum_radius, 6) AS mean_density,
round(b.size / (max_radius * max_radius * b.avg_radius), 6) AS peak_density, round(b.avg_radius * (1 + std_radius / (b.avg_radius + 1e-10)), 6) AS quality FROM b""")
def q_ball_stats(spark, sf_dir):
    b = balls.with_density(balls.ball_stats(labelled_balls(spark, sf_dir))).drop("center")
    return rounded(b, "avg_radius", "max_radius", "sum_radius", "std_radius", "mean_density", "peak_density", "quality")


@query("q_pseudo_purity", "WITH n AS (SELECT vec_id % 23 AS ball, label, count(*) AS n FROM embeddings GROUP BY 1, 2) SELECT ball, round(max(n) / sum(n), 6) AS purity FROM n GROUP BY ball")
def q_pseudo_purity(spark, sf_dir):
    m = samples(spark, sf_dir).withColumn("ball", F.col("sample_id") % 23)
    return rounded(balls.pseudo_purity(m, "y"), "purity")


@query("q_farthest_from_center", f"WITH {BALLS} SELECT ball, max_by(sample_id, (d, -sample_id)) AS farthest FROM d GROUP BY ball")
def q_farthest_from_center(spark, sf_dir):
    return balls.farthest_two(labelled_balls(spark, sf_dir)).select("ball", F.col("p.sample_id").alias("farthest"))


@query("q_range_overlap", f"WITH {BALLS} SELECT x.ball AS a, y.ball AS b, round(list_distance(x.center, y.center), 6) AS d FROM b x JOIN b y ON x.ball < y.ball AND list_distance(x.center, y.center) <= (x.avg_radius + y.avg_radius) / 2")
def q_range_overlap(spark, sf_dir):
    b = balls.ball_stats(labelled_balls(spark, sf_dir)).select(F.col("ball").alias("ball_id"), "center", (F.col("avg_radius") / 2).alias("radius"))
    return rounded(distance.overlaps(b), "d")


HIGHER = f"""{BALLS}, o AS (SELECT ball, center, size / (max_radius * max_radius * avg_radius) AS density, row_number() OVER (ORDER BY size / (max_radius * max_radius * avg_radius) DESC, ball) AS rank FROM b),
q AS (SELECT x.ball, x.rank, x.density, y.ball AS parent, list_distance(x.center, y.center) AS d FROM o x LEFT JOIN o y ON y.rank < x.rank QUALIFY row_number() OVER (PARTITION BY x.ball ORDER BY d, y.rank) = 1)"""


def _higher(spark, sf_dir):
    b = balls.with_density(balls.ball_stats(labelled_balls(spark, sf_dir)))
    return distance.nearest_denser(b.select(F.col("ball").alias("ball_id"), "center", F.col("peak_density").alias("density")))


@query("q_nearest_higher", f"WITH {HIGHER} SELECT ball AS ball_id, CAST(rank AS INTEGER) AS rank, round(coalesce(d, (SELECT max(d) FROM q)), 6) AS delta, parent FROM q")
def q_nearest_higher(spark, sf_dir):
    return rounded(_higher(spark, sf_dir), "delta").drop("density")


@query("q_decision_values", f"WITH {HIGHER} SELECT ball AS ball_id, round(density * coalesce(d, (SELECT max(d) FROM q)), 6) AS decision FROM q ORDER BY decision DESC, rank LIMIT 3")
def q_decision_values(spark, sf_dir):
    v = _higher(spark, sf_dir).withColumn("decision", F.round(F.col("density") * F.col("delta"), 6))
    return v.orderBy(F.col("decision").desc(), "rank").limit(3).select("ball_id", "decision")


SPREAD = f"""{LONG}, w AS (SELECT sample_id, f, v, v - avg(v) OVER (PARTITION BY f ORDER BY v, sample_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a,
avg(v) OVER (PARTITION BY f ORDER BY v, sample_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) - v AS b FROM l),
sp AS (SELECT sample_id, f, v, greatest(coalesce(a, b, 0), 2.220446049250313e-16) AS sl, greatest(coalesce(b, a, 0), 2.220446049250313e-16) AS sr FROM w)"""


@query("q_local_spread", f'WITH {SPREAD} SELECT sample_id, CAST(f AS INTEGER) AS f, round(v, 6) AS v, round(sl, 6) AS "left", round(sr, 6) AS "right" FROM sp')
def q_local_spread(spark, sf_dir):
    return rounded(windows.local_spread(scaling.long_form(samples(spark, sf_dir)), 5), "v", "left", "right")


@query("q_pdmf_clarity", f"""WITH {SPREAD}, z AS (SELECT f, greatest(max(sl), max(sr)) AS s, avg(v) AS m, stddev_pop(v) AS sd FROM sp GROUP BY f)
SELECT sample_id, CAST(f AS INTEGER) AS f, round((exp(-1 / exp(sl / s)) + exp(-1 / exp(sr / s))) / 2, 6) AS clarity, round(greatest(-1, least(1, 1 - abs(v - m) / (sd + 2.220446049250313e-16))), 6) AS mu FROM sp JOIN z USING (f)""")
def q_pdmf_clarity(spark, sf_dir):
    c = features.pdmf_parts(windows.local_spread(scaling.long_form(samples(spark, sf_dir)), 5))
    return c.select("sample_id", "f", F.round(F.col("spread_term") / 2, 6).alias("clarity"), F.round("mu", 6).alias("mu"))


@query("q_prefix_sum", f"WITH {LONG} SELECT sample_id, CAST(f AS INTEGER) AS f, round(v, 6) AS v, round(sum(v) OVER (PARTITION BY f ORDER BY v, sample_id ROWS UNBOUNDED PRECEDING), 6) AS prefix FROM l")
def q_prefix_sum(spark, sf_dir):
    return rounded(windows.prefix_sum(scaling.long_form(samples(spark, sf_dir))), "v", "prefix")


@query("q_rank_norm", f"WITH {LONG}, s2 AS (SELECT f, round(stddev_pop(v), 9) AS score FROM l GROUP BY f) SELECT CAST(f AS INTEGER) AS f, round(1 - (row_number() OVER (ORDER BY score DESC, f) - 1) / (count(*) OVER () - 1), 6) AS rank_score FROM s2")
def q_rank_norm(spark, sf_dir):
    sc = scaling.long_form(samples(spark, sf_dir)).groupBy("f").agg(F.round(F.stddev_pop("v"), 9).alias("score"))
    return rounded(windows.rank_norm(sc, "f", "score"), "rank_score").drop("score")


INTENSITY = f"{LONG}, i AS (SELECT sample_id, f, ln(1 - least(0.999999, abs(v))) AS e FROM l), t AS (SELECT sample_id, sum(e) AS t FROM i GROUP BY sample_id)"


def _intensity(spark, sf_dir):
    return scaling.long_form(samples(spark, sf_dir)).select("sample_id", "f", F.ln(1 - F.least(F.lit(0.999999), F.abs("v"))).alias("intensity"))


@query("q_leave_one_out_entropy", f"""WITH {INTENSITY}, we AS (SELECT ln(sum(exp(t))) - sum(exp(t) * t) / sum(exp(t)) AS e FROM t),
r AS (SELECT f, t - e AS r FROM i JOIN t USING (sample_id)), z AS (SELECT f, max(r) AS m FROM r GROUP BY f),
le AS (SELECT f, ln(sum(exp(r - m))) - sum(exp(r - m) * (r - m)) / sum(exp(r - m)) AS e FROM r JOIN z USING (f) GROUP BY f)
SELECT CAST(f AS INTEGER) AS f, round((SELECT e FROM we) - e, 6) AS score FROM le""")
def q_leave_one_out_entropy(spark, sf_dir):
    return rounded(windows.leave_one_out(_intensity(spark, sf_dir)), "score")


@query("q_prefix_entropy", f"""WITH {INTENSITY}, g AS (SELECT f + 1 AS rank, sum(e) OVER (PARTITION BY sample_id ORDER BY f) AS t FROM i), z AS (SELECT rank, max(t) AS m FROM g GROUP BY rank),
c AS (SELECT rank, ln(sum(exp(t - m))) - sum(exp(t - m) * (t - m)) / sum(exp(t - m)) AS e FROM g JOIN z USING (rank) GROUP BY rank)
SELECT CAST(rank AS INTEGER) AS rank, round(e, 6) AS entropy, round(abs(e - (SELECT max_by(e, rank) FROM c)) / abs((SELECT max_by(e, rank) FROM c)), 6) AS loss FROM c""")
def q_prefix_entropy(spark, sf_dir):
    i = _intensity(spark, sf_dir)
    order = i.select("f").distinct().select("f", (F.col("f") + 1).cast("int").alias("rank"))
    return rounded(windows.prefix_entropy(i, order), "entropy", "loss")


@query("q_percentile_iqr", f"WITH {LONG} SELECT round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.95), 6) AS p95 FROM l")
def q_percentile_iqr(spark, sf_dir):
    return rounded(windows.percentiles(scaling.long_form(samples(spark, sf_dir)), "v", [0.25, 0.5, 0.75, 0.95]), "p25", "p50", "p75", "p95")


@query("q_half_split", f"WITH {S}, r AS (SELECT sample_id, y AS ball, round(x[1], 9) AS score FROM s) SELECT ball, sample_id, CASE WHEN row_number() OVER (PARTITION BY ball ORDER BY score, sample_id) <= floor(count(*) OVER (PARTITION BY ball) / 2) THEN 0 ELSE 1 END AS half FROM r")
def q_half_split(spark, sf_dir):
    m = labelled_balls(spark, sf_dir).select("ball", "sample_id", F.round(F.col("features")[0], 9).alias("score"))
    return windows.half_split(m, "ball", "score", "sample_id").drop("score")


@query("q_median_split", f"WITH {S}, r AS (SELECT sample_id, y AS ball, round(x[1], 9) AS score FROM s), m AS (SELECT ball, median(score) AS m FROM r GROUP BY ball) SELECT ball, sample_id, CASE WHEN score <= m THEN 0 ELSE 1 END AS half FROM r JOIN m USING (ball)")
def q_median_split(spark, sf_dir):
    m = labelled_balls(spark, sf_dir).select("ball", "sample_id", F.round(F.col("features")[0], 9).alias("score"))
    return windows.median_split(m, "ball", "score").drop("score")


@query("q_core_balls", f"WITH {BALLS} SELECT ball, round(max_radius, 6) AS max_radius FROM b WHERE max_radius <= (SELECT max_radius FROM b ORDER BY max_radius, ball LIMIT 1 OFFSET greatest(CAST(floor((SELECT count(*) FROM b) * 0.6) AS BIGINT), 1) - 1)")
def q_core_balls(spark, sf_dir):
    b = balls.ball_stats(labelled_balls(spark, sf_dir)).select("ball", "max_radius")
    return rounded(windows.core_balls(b, "max_radius", 0.6), "max_radius")


@query("q_border_filter", f"WITH {KNN}, c AS (SELECT a, max(d) AS s FROM k GROUP BY a), e AS (SELECT b, round(sum(exp(-d * d / (s * s))), 9) AS density FROM k JOIN c USING (a) GROUP BY b), o AS (SELECT density, row_number() OVER (ORDER BY density, b) AS r, count(*) OVER () AS n FROM e) SELECT b, round(density, 6) AS density FROM e WHERE density > (SELECT density FROM o WHERE r = floor(n * 0.1) + 1)")
def q_border_filter(spark, sf_dir):
    d = distance.reverse_density(_knn(spark, sf_dir)).withColumn("density", F.round("density", 9))
    return rounded(windows.border_filter(d, "density", 0.1), "density")


@query("q_histogram2d", f"""WITH {S}, v AS (SELECT x[1] AS a, y AS b FROM s), r AS (SELECT min(a) AS la, (max(a) - min(a)) / 10 AS wa, min(b) AS lb, (max(b) - min(b)) / 10 AS wb FROM v)
SELECT CAST(least(floor((a - la) / wa) + 1, 10) AS INTEGER) AS i, CAST(least(floor((b - lb) / wb) + 1, 10) AS INTEGER) AS j, count(*) AS n FROM v, r GROUP BY 1, 2""")
def q_histogram2d(spark, sf_dir):
    v = samples(spark, sf_dir).select(F.col("features")[0].alias("a"), F.col("y").cast("double").alias("b"))
    return features.histogram2d(v, "a", "b", 10)


@query("q_mutual_info", f"""WITH {LONG}, r AS (SELECT f, min(v) AS lo, (max(v) - min(v)) / 10 AS w FROM l GROUP BY f), h AS (SELECT f, least(floor((v - lo) / w) + 1, 10) AS i, y, count(*) AS n FROM l JOIN r USING (f) GROUP BY ALL),
a AS (SELECT f, i, sum(n) AS a FROM h GROUP BY f, i), b AS (SELECT f, y, sum(n) AS b FROM h GROUP BY f, y), n AS (SELECT f, sum(n) AS t FROM h GROUP BY f)
SELECT CAST(f AS INTEGER) AS f, round(sum(n / t * ln(n * t / (a * b))), 6) AS mi FROM h JOIN a USING (f, i) JOIN b USING (f, y) JOIN n USING (f) GROUP BY f""")
def q_mutual_info(spark, sf_dir):
    long = samples(spark, sf_dir).select("sample_id", "y", F.posexplode("features").alias("f", "v"))
    return rounded(features.mutual_information(long, "y", 10), "mi")


@query("q_feature_correlation", f"WITH {LONG} SELECT CAST(a.f AS INTEGER) AS a, CAST(b.f AS INTEGER) AS b, round(corr(a.v, b.v), 6) AS r FROM l a JOIN l b ON a.sample_id = b.sample_id AND a.f < b.f GROUP BY a.f, b.f")
def q_feature_correlation(spark, sf_dir):
    return rounded(features.correlations(samples(spark, sf_dir)), "r")


@query("q_discernibility", f"""WITH {LONG}, c AS (SELECT a.f AS a, b.f AS b, abs(corr(a.v, b.v)) AS r FROM l a JOIN l b ON a.sample_id = b.sample_id AND a.f <> b.f GROUP BY a.f, b.f), sd AS (SELECT f, stddev_samp(v) AS s FROM l GROUP BY f)
SELECT CAST(f AS INTEGER) AS f, round(s, 6) AS std, round(1 - avg(r), 6) AS independence FROM sd JOIN c ON c.a = f GROUP BY f, s""")
def q_discernibility(spark, sf_dir):
    return rounded(features.discernibility(samples(spark, sf_dir)), "std", "independence")


@query("q_dispersion_weights", f"""WITH {CENTERS}, d AS (SELECT l.f, sum((v - m) * (v - m)) AS d FROM l JOIN c ON c.y = l.y AND c.f = l.f GROUP BY l.f), p AS (SELECT f, d, power(d, -0.5) AS q FROM d)
SELECT CAST(f AS INTEGER) AS f, round(d, 6) AS dispersion, round(q / sum(q) OVER (), 6) AS weight FROM p""")
def q_dispersion_weights(spark, sf_dir):
    long = samples(spark, sf_dir).select("sample_id", F.col("y").alias("label"), F.posexplode("features").alias("f", "v"))
    return rounded(features.dispersion_weights(long, 3.0), "dispersion", "weight")


@query("q_graph_importance", f"""WITH {KNN}, e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM k), l AS (SELECT sample_id, unnest(range(len(x))) AS f, unnest(x) AS v FROM s),
z AS (SELECT e.a, e.b, i.f, exp(-abs(i.v - j.v)) AS s FROM e JOIN l i ON i.sample_id = e.a JOIN l j ON j.sample_id = e.b AND j.f = i.f), g AS (SELECT a, b, avg(s) AS g, count(*) AS p FROM z GROUP BY a, b), t AS (SELECT sum(g * g) AS t FROM g)
SELECT CAST(f AS INTEGER) AS f, round(sum((s - g) * (s - g)) / ((any_value(p) - 1) * (any_value(p) - 1) * ((SELECT t FROM t) + 2.220446049250313e-16)) * 1e6, 4) AS importance_ppm FROM z JOIN g USING (a, b) GROUP BY f""")
def q_graph_importance(spark, sf_dir):
    s = samples(spark, sf_dir)
    edges = distance.union_edges(distance.knn(s, NEIGHBOURS))
    sim = features.edge_similarity(edges, scaling.long_form(s))
    return features.graph_importance(sim).select("f", F.round(F.col("importance") * 1e6, 4).alias("importance_ppm"))


@query("q_contingency", f"WITH {PRED} SELECT y, label, n FROM t")
def q_contingency(spark, sf_dir):
    return metrics.contingency(predicted(spark, sf_dir))


@query("q_purity", f"WITH {PRED} SELECT round(sum(m) / sum(b), 6) AS purity FROM (SELECT label, max(n) AS m, sum(n) AS b FROM t GROUP BY label)")
def q_purity(spark, sf_dir):
    return rounded(metrics.purity(metrics.contingency(predicted(spark, sf_dir))), "purity")


@query("q_f_measure", f"WITH {PRED}, f AS (SELECT y, a, max(2 * n / (a + b)) AS f FROM t JOIN ra USING (y) JOIN cb USING (label) GROUP BY y, a) SELECT round(sum(a * f) / sum(a), 6) AS f_measure FROM f")
def q_f_measure(spark, sf_dir):
    return rounded(metrics.f_measure(metrics.contingency(predicted(spark, sf_dir))), "f_measure")


@query("q_pair_metrics", f"""WITH {PRED} SELECT round(2 * tp / (2 * tp + fp + fn), 6) AS pairwise_f1, round((tp + tn) / (tp + fn + fp + tn), 6) AS rand_index,
round(2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)), 6) AS ari, round(tp / sqrt((tp + fp) * (tp + fn)), 6) AS fmi FROM pc""")
def q_pair_metrics(spark, sf_dir):
    return rounded(metrics.pair_metrics(metrics.contingency(predicted(spark, sf_dir))), "pairwise_f1", "rand_index", "ari", "fmi")


def _nmi(average: str, mean: str) -> None:
    @query(f"q_nmi_{average}", f"WITH {PRED} SELECT round(mi / {mean}, 6) AS nmi FROM h")
    def q(spark, sf_dir):
        return rounded(metrics.nmi(metrics.contingency(predicted(spark, sf_dir)), average), "nmi")


for _a, _m in (("min", "least(hy, hl)"), ("geometric", "sqrt(hy * hl)"), ("arithmetic", "((hy + hl) / 2)"), ("max", "greatest(hy, hl)")):
    _nmi(_a, _m)


@query("q_all_metrics")
def q_all_metrics(spark, sf_dir):
    return rounded(metrics.evaluate(predicted(spark, sf_dir)), *metrics.NAMES)


@query("q_nearest_class_mean", f"WITH {PRED} SELECT sample_id, y, label FROM n")
def q_nearest_class_mean(spark, sf_dir):
    return predicted(spark, sf_dir)


@query("q_set_operations", "SELECT o_custkey AS k, 'both' AS kind FROM orders INTERSECT SELECT c_custkey, 'both' FROM customer WHERE c_acctbal > 5000 UNION ALL (SELECT c_custkey, 'never' FROM customer EXCEPT SELECT o_custkey, 'never' FROM orders)")
def q_set_operations(spark, sf_dir):
    o = tables(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    c = tables(spark, sf_dir, "customer")
    rich = c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    both = o.intersect(rich).select("k", F.lit("both").alias("kind"))
    return both.unionAll(c.select(F.col("c_custkey").alias("k")).exceptAll(o.distinct()).distinct().select("k", F.lit("never").alias("kind")))
