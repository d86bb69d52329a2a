"""Keyed prefixes: long sequences, hot keys, and no path mistaken for another."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sequora.operators import contrast, paths, trie


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def events():
    """A key with a third of all rows, small ones, a null key, null items."""
    rng = random.Random(1)
    keys = ["hot"] * 700 + [f"u{i % 60}" for i in range(1300)] + [None] * 50
    rows = [(k, t, rng.choice(["a", "b", None])) for t, k in enumerate(rng.sample(keys, len(keys)))]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(events(), "key string, t int, item string").repartition(5)


def by_key():
    out = {}
    for k, t, item in sorted(events(), key=lambda r: r[1]):
        out.setdefault(k, []).append((t, item))
    return out


def test_numbered(spark, table):
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a small table would be one task
    try:
        got = paths.numbered(table, ["key"], ["t"])
        parts = got.where("key = 'hot'").select("_part").distinct().count()
        want = [(k, t, i, i == len(own)) for k, own in by_key().items() for i, (t, _) in enumerate(own, 1)]
        assert rows_of(got, "key", "t", "pos", "last") == sorted(want, key=repr)
        assert parts >= 3  # the hot key is several tasks
        sums = paths.keyed_counts(paths.row_prefixes(table, ["key"], "item", ["t"]))
        assert rows_of(sums, "depth", "token", "cnt", "term") == prefix_counts()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def prefix_counts():
    seen, ends = Counter(), Counter()
    for own in by_key().values():
        items = tuple(item for _, item in own)
        ends[items] += 1
        for i in range(1, len(items) + 1):
            seen[items[:i]] += 1
    return sorted(((len(p), p[-1], n, ends[p]) for p, n in seen.items()), key=repr)


def test_row_prefixes(spark, table):
    counts = paths.keyed_counts(paths.row_prefixes(table, ["key"], "item", ["t"]))
    assert rows_of(counts, "depth", "token", "cnt", "term") == prefix_counts()
    assert paths.collisions(paths.keyed_nodes(counts)).count() == 0


def test_arrays_and_nodes(spark):
    rng = random.Random(3)
    rows = [(rng.choice("gh"), [rng.choice(["x", "y", "xy", None, ""]) for _ in range(rng.randint(0, 6))], rng.randint(1, 3)) for _ in range(200)]
    seqs = spark.createDataFrame(rows, "grp string, tokens array<string>, n long")
    sids = paths.with_sids(seqs)
    counts = paths.keyed_counts(paths.array_prefixes(sids), F.min("sid").alias("sid"))
    named = counts.join(sids.select("sid", "tokens"), "sid").withColumn("path", F.slice("tokens", 1, F.col("depth")))
    want = trie.prefix_counts(seqs).where("depth > 0")
    columns = ["path", "depth", "grp", "cnt", "term"]
    assert rows_of(named, *columns) == rows_of(want, *columns)
    assert len({(r.k1, r.k2) for r in counts.select("k1", "k2").collect()}) == want.select("path").distinct().count()
    plain = contrast.contrasting_pairs(contrast.templates(seqs.where("NOT exists(tokens, t -> t IS NULL)")))
    keyed = contrast.contrasting_pairs(contrast.blank_keys(seqs.where("NOT exists(tokens, t -> t IS NULL)")))
    assert rows_of(keyed, "grp", "a", "b") == rows_of(plain, "grp", "a", "b") != []


def test_long_paths(spark):
    """Two sequences of 5,000 items that part after 4,000 are 6,000 nodes of one size."""
    a = [f"t{i % 7}" for i in range(5000)]
    b = a[:4000] + ["other"] + a[4001:]
    seqs = paths.with_sids(spark.createDataFrame([("g", a), ("g", b), ("g", b)], "grp string, tokens array<string>"))
    prefixes = paths.array_prefixes(seqs)
    assert not [t for _, t in prefixes.dtypes if t.startswith(("array", "map"))] and prefixes.count() == 10_000
    nodes = paths.keyed_nodes(paths.keyed_counts(prefixes))
    assert nodes.count() == 6000 and nodes.where("total = 3").count() == 4000
    assert nodes.where("terminal > 0").select(F.sum("terminal")).first()[0] == 3
    probs = paths.keyed_probs(nodes).where("p < 1")
    assert sorted(round(r.p, 6) for r in probs.collect()) == [0.333333, 0.666667]
    assert rows_of(contrast.contrasting_pairs(contrast.blank_keys(seqs)), "grp", "a", "b") == [("g", "other", "t3")]
    blanks = contrast.blank_keys(spark.createDataFrame([("g", a), ("g", a[:4000] + ["z"] + a[4001:])], "grp string, tokens array<string>"))
    assert rows_of(contrast.contrasting_pairs(blanks), "grp", "a", "b") == [("g", "t3", "z")]


def test_variants(spark):
    rows = [(1, ["a", "b"], ["A", "b"]), (2, ["a", "c"], ["Ä", "C"]), (3, [], [])]
    aligned = spark.createDataFrame(rows, "sid long, norm array<string>, surface array<string>")
    named = paths.keyed_variants(aligned).join(aligned.select("sid", "norm"), "sid").select(F.array_join(F.slice("norm", 1, F.col("depth")), "").alias("path"), "surface")
    assert rows_of(named, "path", "surface") == [("a", "A"), ("a", "Ä"), ("ac", "C")]


def test_no_rows(spark):
    none = spark.createDataFrame([], "key string, t int, item string")
    assert paths.numbered(none, ["key"], ["t"]).count() == paths.row_prefixes(none, ["key"], "item", ["t"]).count() == 0
    assert paths.with_sids(spark.createDataFrame([], "grp string, tokens array<string>")).count() == 0
