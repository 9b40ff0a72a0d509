"""Top-k search against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rowmill.llm import topk
from rowmill.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, rank int"


def searched(df, k=5):
    rows = df.where(topk.usable(F.col("embedding"))).select("vec_id", topk.quantized(F.col("embedding")).alias("v"))
    return sorted(tuple(r) for r in topk.top_k(rows, F.col("vec_id") % 50 == 0, k).collect())


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 50 == 0:
            near = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in ok if c != q)[:k]
            out += [(q, rank, c, -score) for rank, (score, c) in enumerate(near, 1)]
    return sorted(out)


@pytest.fixture
def small_index(monkeypatch):
    monkeypatch.setattr(topk, "RING_ROWS", 20)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "EXPAND", (1, 3, None))


def clustered(n, width=6, seed=0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(8)]
    return [(i, [float(f"{c + rng.gauss(0, 0.1):.3f}") for c in rng.choice(centres)], 0) for i in range(n)]


def test_clustered_vectors(spark, small_index):
    import numpy as np

    rows = [(i, [float(np.float32(x)) for x in v], r) for i, v, r in clustered(1500)]
    assert searched(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)


def test_odd_vectors(spark, small_index):
    odd = [(0, None, 0), (50, [None, 1.0], 0), (100, [float("nan"), 1.0], 0), (150, [float("inf")], 0), (200, [], 0), (250, [1.0], 0), (300, [1.0, 2.0, -3.5], 0), (None, [1.0, 1.0], 0), (301, [1.0, 2.0], 0)]
    assert searched(spark.createDataFrame(odd, SCHEMA)) == brute(odd)
    assert searched(spark.createDataFrame([], SCHEMA)) == []
    assert searched(spark.createDataFrame([(50, [1.0], 0)], SCHEMA)) == []


def test_ties_and_one_vector_in_a_third_of_all_rows(spark, small_index):
    rows = clustered(600, seed=4)
    rows = [(i, [0.5] * 6 if i % 3 == 0 else [round(x * 4) / 4 for x in v], 0) for i, v, _ in rows]
    assert searched(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_large_components_are_exact_and_stop_at_64_bits(spark):
    rows = [(i, [float(i * 2**16), -3.0], 0) for i in range(120)]
    assert searched(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_a_repeated_id_is_no_candidate_of_itself(spark):
    rows = [(50, [1.0], 0), (50, [1.0], 0), (1, [2.0], 0), (1, [2.0], 0)]
    assert searched(spark.createDataFrame(rows, SCHEMA)) == [(50, 1, 1, 256 * 512), (50, 2, 1, 256 * 512)]


def test_query_equals_all_pairs(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(tuple(r) for r in QUERIES["op1_pivot_distance_top_k"](spark, sf_dir).collect()) == brute(rows)


def test_most_annuli_are_left_out_when_clusters_are_clear(spark, small_index):
    """The triangle inequality prunes: pairs searched are far fewer than all."""
    rows = spark.createDataFrame(clustered(1200, seed=9), SCHEMA)
    v = rows.select("vec_id", topk.quantized(F.col("embedding")).alias("v"))
    _, _, annuli, pivots = topk.build_index(v, 6, 1200, 2**12)
    assert len(pivots) == 4 and len(annuli["n"]) > 8 and annuli["n"].sum() == 1200


def test_scores_beyond_64_bits_stop_there(spark):
    assert searched(spark.createDataFrame([(50, [1e30], 0), (1, [1e30], 0), (2, [-1e30], 0)], SCHEMA)) == [(50, 1, 1, 2**63 - 1), (50, 2, 2, -(2**63))]
