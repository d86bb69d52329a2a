"""Stored node tables: the same answers as scans, from few files."""

import pytest
from pyspark.sql import functions as F

from sequora.operators import lookup, stored_nodes, trie


@pytest.fixture(scope="module")
def nodes(spark):
    seqs = spark.createDataFrame([("g", [f"t{i % 7}", f"u{i % 50}", f"v{i}"]) for i in range(300)] + [("h", ["abcd", "bc", "x'y", "😀é"])], "grp string, tokens array<string>")
    return trie.prefix_nodes(trie.prefix_counts(seqs)).cache()


def folders(df):
    return {f.rsplit("/", 2)[1] for f in df.inputFiles()}


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_pages(spark, tmp_path, nodes):
    path = str(tmp_path / "p")
    stored_nodes.write_pages(nodes.limit(5), path, 3)
    stored_nodes.write_pages(nodes, path, 100)  # takes the place of the first
    for args in ((0, 9), (1, 2, 5, 20), (3, 3, 150, 100), (2, 3, -4, 0), (3, 4, 10_000, 10), (7, 9)):
        want = lookup.nodes_by_depth(nodes, *args)
        assert rows(stored_nodes.page(spark, path, *args), "path", "total", "total_count", "has_more") == rows(want, "path", "total", "total_count", "has_more")
    deep = stored_nodes.page(spark, path, 3, 3, 250, 20)
    assert deep.count() == 20 and len(folders(deep)) <= 2  # page 13 of its depth reads a block or two


def test_search(spark, tmp_path, nodes):
    path = str(tmp_path / "s")
    stored_nodes.write_index(nodes, path)
    for text in ("abcd", "bc", "b", "cd", "t3", "1", "v29", "x'y", "é", "😀", "none", "v2999", "", "abcde"):
        for limit in (50, 3):
            got = rows(stored_nodes.search(spark, path, text, limit), "path", "total", "total_matches")
            assert sorted(got) == sorted(rows(lookup.search(nodes, text, limit), "path", "total", "total_matches")), text
    nothing = stored_nodes.search(spark, path, "zzz")
    assert nothing.count() == 0 and not [f for f in nothing.inputFiles() if "/nodes/" in f]  # no node is read
    one = stored_nodes.search(spark, path, "abcd")
    assert len([f for f in folders(one.select(F.col("path"))) if f.startswith("slot=")]) <= 2


def test_empty(spark, tmp_path, nodes):
    none = nodes.limit(0)
    stored_nodes.write_pages(none, str(tmp_path / "p"))
    stored_nodes.write_index(none, str(tmp_path / "s"))
    assert stored_nodes.page(spark, str(tmp_path / "p"), 0, 5).count() == stored_nodes.search(spark, str(tmp_path / "s"), "a").count() == 0
