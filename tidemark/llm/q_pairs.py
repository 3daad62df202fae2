"""Queries on pairs: near-duplicates, nearest neighbours, largest products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import neardup, threshold, vptree
from tidemark.llm.common import read


def op7_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op6_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of those whose id is divisible by 50."""
    return vptree.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 rows of largest integer product with those whose id is divisible by 50."""
    return threshold.largest_products(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

QUERIES = {"op6_vantage_point_trees": op6_vantage_point_trees, "op7_weighted_minhash": op7_weighted_minhash, "op12_threshold_top_k": op12_threshold_top_k}
ORACLES = {"op12_threshold_top_k": OP12_SQL}
