"""Nested-set labels against plain subtrees, in one piece and in many."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sequora.operators import intervals, trie


def plain(paths):
    """{path: (enter, leave, leaves, sum of values)} of {path: value}."""
    order = sorted(paths)
    below = {p: [q for q in order if q[: len(p)] == p] for p in order}
    leaf = {p: len(below[p]) == 1 for p in order}
    return {p: (i, i + len(below[p]) - 1, sum(leaf[q] for q in below[p]), sum(paths[q] or 0 for q in below[p])) for i, p in enumerate(order)}


def closed(paths):
    rng = random.Random(5)
    return {p[:i]: rng.choice([1, 2, 5, None]) for p in paths for i in range(len(p) + 1)}


@pytest.mark.parametrize("coalesce,top", [("true", 0), ("false", 0), ("false", 2)])
def test_labelled(spark, coalesce, top):
    rng = random.Random(2)
    paths = closed([tuple(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(150)] + [tuple("c" * 40)])
    paths = {p: v for p, v in paths.items() if len(p) >= top}  # a forest, if the top is cut off
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        rows = spark.createDataFrame([(list(p), len(p), v) for p, v in paths.items()], "path array<string>, depth int, v int")
        got = intervals.labelled(rows, s=F.col("v"))
        assert {tuple(r.path): (r.enter, r.leave, r.leaves, r.s) for r in got.collect()} == plain(paths)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    some = max((p for p in paths if len(p) == 2), key=lambda p: plain(paths)[p][1] - plain(paths)[p][0])
    under = intervals.descendants(got, list(some))
    assert sorted(tuple(r.path) for r in under.collect()) == sorted(p for p in paths if p[:2] == some)
    with pytest.raises(ValueError, match="no node"):
        intervals.descendants(got, ["z"])


def test_walk_in_batches():
    """Batches and gaps in the places are borders of frames or pieces, and nothing else."""
    rows = [(0, 0, 1), (1, 1, 2), (2, 2, 3), (3, 1, 4), (10, 2, 5), (11, 0, 6)]
    frame = pd.DataFrame(rows, columns=["_at", "depth", "_v0"])
    whole = pd.concat(intervals._walk(iter([frame]), 1))
    parts = pd.concat(intervals._walk(iter([frame[:2], frame[2:5], frame[5:]]), 1))
    assert sorted(map(tuple, whole.to_numpy().tolist())) == sorted(map(tuple, parts.to_numpy().tolist()))
    assert sorted(whole[whole.kind == 3].piece) == [0, 10]


def test_no_rows_and_one(spark):
    schema = "path array<string>, depth int, total long"
    assert intervals.labelled(spark.createDataFrame([], schema)).count() == 0
    one = intervals.labelled(spark.createDataFrame([([], 0, 3)], schema), w=F.col("total")).first()
    assert (one.enter, one.leave, one.leaves, one.w) == (0, 0, 1, 3)
    assert trie.subtree_weights(spark.createDataFrame([([], 0, 3), (["a"], 1, 2)], schema)).orderBy("depth").first().weight == 5
