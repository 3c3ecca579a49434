"""Queries of the rules that balls, anchors and features are chosen by."""

from __future__ import annotations

from pyspark.sql import functions as F

from sphaera.operators import balls, distance, features, scaling, windows
from sphaera.plans import relational as r
from sphaera.plans.relational import BALLS, CENTERS, GRAPH, INTENSITY, KNN, LONG, S, Query, rounded, samples

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("q_noise_balls", f"WITH {BALLS} SELECT ball, size, size < 2 OR size / max_radius < 0.95 * (SELECT avg(size / max_radius) FROM b) AS noise FROM b")
def q_noise_balls(spark, sf_dir):
    return balls.noise_balls(balls.ball_stats(r.labelled_balls(spark, sf_dir)), 0.95).select("ball", "size", "noise")


@query("q_stop_split", "WITH n AS (SELECT vec_id % 101 AS ball, label, count(*) AS n FROM embeddings GROUP BY 1, 2) SELECT ball, sum(n)::BIGINT AS size, round(max(n) / sum(n), 6) AS purity, sum(n) < 2 OR (max(n) / sum(n) >= 0.5 AND sum(n) < 8) AS stops FROM n GROUP BY ball")
def q_stop_split(spark, sf_dir):
    return rounded(balls.stop_split(samples(spark, sf_dir).withColumn("ball", F.col("sample_id") % 101), "y", 0.5), "purity")


@query("q_label_scatter", f"WITH {BALLS} SELECT d.sample_id, CAST(row_number_ AS INTEGER) AS label FROM d JOIN (SELECT ball, row_number() OVER (ORDER BY size DESC, ball) AS row_number_ FROM b) USING (ball)")
def q_label_scatter(spark, sf_dir):
    from pyspark.sql import Window

    m = r.labelled_balls(spark, sf_dir)
    size = m.groupBy("ball").agg(F.count("*").alias("size"))
    label = size.select("ball", F.row_number().over(Window.orderBy(F.col("size").desc(), "ball")).alias("label"))
    return m.select("sample_id", "ball").join(label, "ball").select("sample_id", "label")


@query("q_weighted_radius", f"WITH {GRAPH} SELECT anchor_id, round(sum(w * d) / sum(w), 6) AS radius, count(*) AS covered FROM w GROUP BY anchor_id")
def q_weighted_radius(spark, sf_dir):
    return rounded(balls.cover_radius(r._graph(spark, sf_dir)), "radius")


@query("q_shared_cover", f"WITH {GRAPH} SELECT x.anchor_id AS a, y.anchor_id AS b, count(*) AS shared FROM w x JOIN w y ON x.sample_id = y.sample_id AND x.anchor_id < y.anchor_id GROUP BY 1, 2")
def q_shared_cover(spark, sf_dir):
    g = r._graph(spark, sf_dir).select("sample_id", F.col("anchor_id").alias("a"))
    return g.join(g.withColumnRenamed("a", "b"), "sample_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


@query("q_natural_neighbours", f"WITH {KNN} SELECT a, b FROM k INTERSECT SELECT b, a FROM k")
def q_natural_neighbours(spark, sf_dir):
    k = r._knn(spark, sf_dir).select("a", "b")
    return k.intersect(k.select(F.col("b").alias("a"), F.col("a").alias("b")))


@query("q_reverse_counts", f"WITH {KNN} SELECT s.sample_id, count(k.a) AS n FROM s LEFT JOIN k ON k.b = s.sample_id GROUP BY s.sample_id")
def q_reverse_counts(spark, sf_dir):
    n = r._knn(spark, sf_dir).groupBy(F.col("b").alias("sample_id")).agg(F.count("*").alias("n"))
    return samples(spark, sf_dir).select("sample_id").join(n, "sample_id", "left").select("sample_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("q_label_confidence", f"""WITH {CENTERS}, o AS (SELECT s.sample_id AS a, list_distance(s.x, cc.c) AS d, row_number() OVER (PARTITION BY s.sample_id ORDER BY list_distance(s.x, cc.c), cc.y) AS rank FROM s, cc)
SELECT a, round((max(d) - min(d)) / (max(d) + min(d)), 6) AS confidence FROM o WHERE rank <= 2 GROUP BY a""")
def q_label_confidence(spark, sf_dir):
    s = samples(spark, sf_dir)
    means = balls.centers(s.withColumnRenamed("y", "ball")).select(F.col("ball").cast("long").alias("sample_id"), F.col("center").alias("features"))
    return rounded(balls.label_confidence(distance.knn_join(s, means, 2, skip_same=False)), "confidence")


@query("q_top_features", f"WITH {LONG} SELECT CAST(f AS INTEGER) AS f FROM l GROUP BY f ORDER BY round(stddev_samp(v), 9) DESC, f LIMIT 10")
def q_top_features(spark, sf_dir):
    d = scaling.long_form(samples(spark, sf_dir)).groupBy("f").agg(F.round(F.stddev_samp("v"), 9).alias("std"))
    return d.orderBy(F.col("std").desc(), "f").limit(10).select("f")


@query("q_first_feasible", f"""WITH {INTENSITY}, g AS (SELECT f + 1 AS rank, sum(e) OVER (PARTITION BY sample_id ORDER BY f) AS t FROM i), z AS (SELECT rank, max(t) AS m FROM g GROUP BY rank),
c AS (SELECT rank, ln(sum(exp(t - m))) - sum(exp(t - m) * (t - m)) / sum(exp(t - m)) AS e FROM g JOIN z USING (rank) GROUP BY rank), o AS (SELECT rank, round(abs(e - (SELECT max_by(e, rank) FROM c)) / abs((SELECT max_by(e, rank) FROM c)), 9) AS loss FROM c)
SELECT CAST(coalesce(min(rank) FILTER (loss <= 0.002), max(rank)) AS INTEGER) AS rank FROM o""")
def q_first_feasible(spark, sf_dir):
    i = r._intensity(spark, sf_dir)
    order = i.select("f").distinct().select("f", (F.col("f") + 1).cast("int").alias("rank"))
    return windows.first_feasible(windows.prefix_entropy(i, order).withColumn("loss", F.round("loss", 9)), 0.002)


@query("q_edge_similarity", f"""WITH {KNN}, e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM k)
SELECT e.a, e.b, round(list_avg(list_transform(list_zip(i.x, j.x), lambda p: exp(-abs(p[1] - p[2])))), 6) AS s FROM e JOIN s i ON i.sample_id = e.a JOIN s j ON j.sample_id = e.b""")
def q_edge_similarity(spark, sf_dir):
    s = samples(spark, sf_dir)
    sim = features.edge_similarity(distance.union_edges(distance.knn(s, r.NEIGHBOURS)), scaling.long_form(s))
    return sim.groupBy("a", "b").agg(F.round(F.avg("s"), 6).alias("s"))


@query("q_weighted_cost", f"""WITH {CENTERS}, d AS (SELECT l.f, sum((v - m) * (v - m)) AS d FROM l JOIN c ON c.y = l.y AND c.f = l.f GROUP BY l.f), w AS (SELECT f, d, power(d, -0.5) / (SELECT sum(power(d, -0.5)) FROM d) AS w FROM d)
SELECT round(sum(power(w, 3) * d), 6) AS cost FROM w""")
def q_weighted_cost(spark, sf_dir):
    long = samples(spark, sf_dir).select("sample_id", F.col("y").alias("label"), F.posexplode("features").alias("f", "v"))
    return features.dispersion_weights(long, 3.0).agg(F.round(F.sum(F.pow("weight", F.lit(3.0)) * F.col("dispersion")), 6).alias("cost"))


@query("q_distinct_rows", f"WITH {S} SELECT y AS ball, count(DISTINCT x) AS n FROM s GROUP BY y")
def q_distinct_rows(spark, sf_dir):
    return r.labelled_balls(spark, sf_dir).groupBy("ball").agg(F.countDistinct("features").alias("n"))


@query("q_sorted_thirds", f"WITH {S} SELECT y AS ball, round(quantile_cont(x[1], 0.25), 6) AS p25, round(quantile_cont(x[1], 0.5), 6) AS p50, round(quantile_cont(x[1], 0.75), 6) AS p75 FROM s GROUP BY y")
def q_sorted_thirds(spark, sf_dir):
    v = r.labelled_balls(spark, sf_dir).select("ball", F.col("features")[0].alias("v"))
    return v.groupBy("ball").agg(*[F.round(F.percentile("v", p), 6).alias(f"p{round(p * 100)}") for p in (0.25, 0.5, 0.75)])


@query("q_pdmf_scores")
def q_pdmf_scores(spark, sf_dir):
    """Entropy that each feature's absence costs, over the scaled table."""
    spread = windows.local_spread(scaling.long_form(scaling.min_max(samples(spark, sf_dir))), 5)
    return rounded(windows.leave_one_out(features.pdmf_intensity(spread)), "score")


@query("q_membership_graph")
def q_membership_graph(spark, sf_dir):
    """Graph importance by values, spreads and centrality, over the scaled table."""
    s = scaling.min_max(samples(spark, sf_dir))
    spread = windows.local_spread(scaling.long_form(s), 5)
    return features.graph_importance(features.membership_similarity(distance.mutual_edges(distance.knn(s, 5)), spread, 0.5))
