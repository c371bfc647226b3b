"""The subspace iteration against the dense decomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.operators import graph as G
from codeloom.operators.spectral import subspace_embedding


def table(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def by_id(df):
    return np.array([r["vector"] for r in sorted(df.collect(), key=lambda r: r["id"])], float)


def test_equals_the_dense_one_up_to_signs(spark):
    # cliques of distinct sizes, joined in a chain: leading singular values stand apart
    pairs, start = [], 0
    for size in (14, 10, 7, 5):
        pairs += [(start + i, start + j) for i in range(size) for j in range(i)] + [(start, start + size)]
        start += size
    e = table(spark, pairs + pairs[:9] + [(3, 3), (None, 3)])
    dense, got = by_id(G.structural_embedding(e.na.drop(), 4)), by_id(subspace_embedding(e, 4, rounds=20))
    assert dense.shape == got.shape
    for c in range(4):
        assert min(np.abs(dense[:, c] - got[:, c]).max(), np.abs(dense[:, c] + got[:, c]).max()) <= 1


def test_small_graphs_are_padded(spark):
    rows = subspace_embedding(table(spark, [(1, 2), (2, 3), (3, 1)]), 8, rounds=3).collect()
    assert len(rows) == 3 and all(len(r["vector"]) == 8 and max(map(abs, r["vector"])) == 127 for r in rows)


@pytest.mark.parametrize("pairs", [[], [(1, 1)]])
def test_without_two_nodes_there_is_nothing(spark, pairs):
    assert subspace_embedding(table(spark, pairs), 8).count() == 0


def test_a_star_has_rank_two(spark):
    rows = subspace_embedding(table(spark, [(0, i) for i in range(1, 30)]), 8, rounds=4)
    assert rows.count() == 30 and rows.where(F.size("vector") != 8).count() == 0
