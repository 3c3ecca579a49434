"""Queries of the llm operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sphaera.llm import contamination, knn_tree, similarity_clusters, text_quality, tokenizer, top_n
from sphaera.session import tables


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_clusters.cluster_chain(tables(spark, sf_dir, "dataset"), tables(spark, sf_dir, "dataset_catalog"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_clusters.describe_clusters(tables(spark, sf_dir, "dataset"), tables(spark, sf_dir, "dataset_catalog"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n.best_settings(tables(spark, sf_dir, "grid_summary")).select("grid_id", "rank_no")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_tree.neighbour_pairs(tables(spark, sf_dir, "dataset"), tables(spark, sf_dir, "dataset_catalog"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_corpus(tables(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaked_items(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality.not_prose(tables(spark, sf_dir, "documents"))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality.text_statistics(tables(spark, sf_dir, "documents")).drop("kind")


QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters, "p4_found": p4_found, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found, "p8_statistics": p8_statistics}

_USABLE = """
usable AS (
  SELECT d.sample_id, d.dataset_name, d.x, c.similar_within AS r
  FROM dataset d JOIN dataset_catalog c USING (dataset_name)
  WHERE d.x IS NOT NULL AND len(d.x) = c.n_features AND len(list_filter(d.x, lambda v: v IS NULL OR NOT isfinite(v))) = 0
  QUALIFY row_number() OVER (PARTITION BY d.sample_id ORDER BY d.loaded_at DESC) = 1
),
near AS (
  SELECT a.sample_id AS a, b.sample_id AS b, list_distance(a.x, b.x) AS d
  FROM usable a JOIN usable b ON a.dataset_name = b.dataset_name AND a.sample_id <> b.sample_id
  WHERE list_distance(a.x, b.x) <= a.r
)"""

_COMMON = ", ".join(f"'{w}'" for w in sorted(text_quality.COMMON))
_ENDS = ", ".join("'" + c.replace("'", "''") + "'" for c in text_quality.END)

SQL = {
    "p8_statistics": f"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+') AS words,
    list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|\\r|\\n'), lambda l: regexp_replace(l, '[\\s\\p{{Z}}\\x1c-\\x1f\\x85]+$', '')), lambda l: length(l) > 0) AS lines,
    length(regexp_replace(t, '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+', '', 'g')) AS solid
  FROM d
),
c AS (
  SELECT doc_id, CAST(length(t) AS BIGINT) AS chars, solid, CAST(len(words) AS BIGINT) AS n, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS letters,
    len(list_filter(words, lambda x: x <> 'A' AND lower(x) IN ({_COMMON}))) AS common,
    CAST(len(lines) AS BIGINT) AS n_lines, len(list_filter(lines, lambda l: l[-1] IN ({_ENDS}))) AS ends
  FROM w
)
SELECT doc_id, chars AS n_chars_counted, n AS n_words,
  CASE WHEN n > 0 THEN round(letters / n, 6) END AS mean_word_length,
  CASE WHEN chars > 0 THEN round((solid - letters) / chars, 6) END AS symbol_ratio,
  n_lines,
  CASE WHEN n_lines > 0 THEN round(ends / n_lines, 6) END AS end_punctuation_share,
  CASE WHEN n > 0 THEN round(common / n, 6) END AS common_word_share
FROM c""",
    "p4_found": """
WITH last AS (
  SELECT DISTINCT grid_id, dataset, algorithm, success_runs, acc_mean, nmi_mean, f_measure_mean, runtime_seconds_mean, summarised_at
  FROM grid_summary
  QUALIFY rank() OVER (PARTITION BY grid_id ORDER BY summarised_at DESC) = 1
),
ranked AS (
  SELECT grid_id, row_number() OVER (
    PARTITION BY dataset, algorithm
    ORDER BY acc_mean DESC,
      CASE WHEN isnan(nmi_mean) THEN NULL ELSE nmi_mean END DESC NULLS LAST,
      CASE WHEN isnan(f_measure_mean) THEN NULL ELSE f_measure_mean END DESC NULLS LAST,
      CASE WHEN isnan(runtime_seconds_mean) THEN NULL ELSE runtime_seconds_mean END ASC NULLS LAST,
      grid_id) AS rank_no
  FROM last
  WHERE success_runs = 3 AND acc_mean IS NOT NULL AND NOT isnan(acc_mean)
)
SELECT grid_id, CAST(rank_no AS INTEGER) AS rank_no FROM ranked WHERE rank_no <= 3""",
    "p5_found": f"""
WITH {_USABLE},
best AS (SELECT a, b FROM near QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 5)
SELECT DISTINCT least(a, b) AS sample_a, greatest(a, b) AS sample_b FROM best""",
    "p1_found": f"""
WITH RECURSIVE {_USABLE},
reach(node, low) USING KEY (node) AS (
  SELECT sample_id AS node, sample_id AS low FROM usable
  UNION
  SELECT n.b AS node, min(r.low) AS low
  FROM reach r JOIN near n ON n.a = r.node JOIN recurring.reach o ON o.node = n.b
  WHERE r.low < o.low
  GROUP BY n.b
),
sized AS (SELECT node, low, count(*) OVER (PARTITION BY low) AS size FROM reach),
chain AS (SELECT node AS sample_a, lead(node) OVER (PARTITION BY low ORDER BY node) AS sample_b FROM sized WHERE size >= 3)
SELECT sample_a, sample_b FROM chain WHERE sample_b IS NOT NULL""",
}
