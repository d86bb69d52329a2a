"""Hard negatives against a plain version."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sequora.llm import hard_negatives
from sequora.llm.queries import QUERIES

from . import brute
from .test_operators import rows_of

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<double>, label int"


def vectors():
    """Clusters with a hot label, copies of one vector, ties, ids in no order, and rows of every kind that takes no part."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 20)) + 0.4
    ids = rng.permutation(2600)[:900]
    rows = [(int(i), (centre[i % 6] + rng.normal(size=20) * 0.6).round(2).tolist(), int(i % 6 if i % 3 else 1)) for i in ids]
    rows += [(int(i), rows[0][1], int(i % 4)) for i in range(5000, 5060)]
    rows += [(300, rows[1][1], 1), (300, rows[1][1], 1), (None, rows[2][1], 1), (None, rows[3][1], 2), (2**63 - 1, rows[4][1], 2), (-100, rows[5][1], 3)]
    rows += [(6000, None, 1), (6100, rows[0][1], None), (6200, [1.0, None] * 10, 1), (6300, [float("nan")] * 20, 1), (6400, [float("inf")] * 20, 1), (6500, [1e300] * 20, 1)]
    rows += [(7000, [], 1), (7001, [], 1), (7002, [], 2), (8000, [1.0, -2.0, 3.0], 1), (8001, [1.0, -2.5, 3.0], 1), (8002, [0.5, -1.0, 2.0], 2), (8100, [0.0] * 20, 1), (8200, [9000.0] * 20, 9), (8201, [8000.5] * 20, 9)]
    return rows


def plain(rows):
    return sorted(brute.hard_negatives(rows), key=repr)


@given(st.integers(0, 2**32 - 1), st.integers(1, 40), st.integers(1, 40), st.integers(0, 30), st.sampled_from([3, 300, 2_000_000]))
@settings(max_examples=80, deadline=None)
def test_pairs_at_least(seed, a, b, dim, size):
    """The index, the bounds and the way of following leave out no pair and change no product."""
    rng = np.random.default_rng(seed)
    x, y = (rng.integers(-size, size + 1, (n, dim)) // (1 + np.arange(dim)) for n in (a, b))
    whole = x @ y.T
    least = np.quantile(whole, rng.random(a)).astype(np.float64)
    least[rng.random(a) < 0.1] = -np.inf
    i, j, v = hard_negatives.pairs_at_least(x.astype(np.int32), y.astype(np.int32), least)
    want_i, want_j = np.nonzero(whole >= least[:, None])
    assert sorted(zip(i.tolist(), j.tolist(), v.tolist())) == sorted(zip(want_i.tolist(), want_j.tolist(), whole[want_i, want_j].tolist()))


def test_query(spark, tmp_path):
    spark.createDataFrame(vectors(), SCHEMA).withColumns({c: F.lit(1) for c in ("key", "q", "pos", "akey", "none")}).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = rows_of(QUERIES["op11_hard_negatives"](spark, str(tmp_path)), *COLUMNS)
    assert got == plain(vectors())


@pytest.mark.parametrize("block,share,ladder", [(64, 2, 1), (40, 8, 3)])
def test_small_blocks(spark, block, share, ladder):
    """Many blocks, small pilots and thresholds that begin too high give the same rows."""
    rows = spark.createDataFrame(vectors(), SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, label, block_rows=block, pilot_share=share, ladder=ladder)
    assert rows_of(got, *COLUMNS) == plain(vectors())


def test_empty_and_types(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.hard_negatives(none, F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    with pytest.raises(TypeError, match="whole number"):
        hard_negatives.hard_negatives(spark.createDataFrame([], "vec_id string, embedding array<float>, label int"), F.lit(True), F.col("label"))
