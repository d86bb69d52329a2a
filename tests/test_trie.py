"""Prefix tries: cases, invariants, modes."""

import math

import pytest
from pyspark.sql import functions as F

from sequora.operators import lookup, ngrams, trie


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [("en", "pat", list("pat"), 1), ("en", "pats", list("pats"), 1), ("de", "pat", list("pat"), 1), ("de", "kat", list("kat"), 2), ("de", "", [], 1)]
    seqs = spark.createDataFrame(rows, "grp string, key string, tokens array<string>, n long")
    return trie.prefix_nodes(trie.prefix_counts(seqs)).cache()


def by_path(df):
    return {"".join(r.path): r for r in df.collect()}


def test_counts(nodes):
    at = by_path(nodes)
    assert {k: v.total for k, v in at.items()} == {"": 6, "p": 3, "pa": 3, "pat": 3, "pats": 1, "k": 2, "ka": 2, "kat": 2}
    assert at["pat"].counts == {"de": 1, "en": 2} and at["pat"].terminal_counts == {"de": 1, "en": 1}
    assert at[""].terminal == 1 and sum(v.terminal for v in at.values()) == at[""].total


def test_skip_empty_and_depth(spark):
    seqs = spark.createDataFrame([("a", ["x", "y", "z"]), ("a", [])], "grp string, tokens array<string>")
    assert {("".join(r.path), r.cnt) for r in trie.prefix_counts(seqs, max_depth=1, skip_empty=True).collect()} == {("", 1), ("x", 1)}


def test_prune_is_subtree_prune(nodes):
    assert set(by_path(trie.prune(nodes, 3))) == {"", "p", "pa", "pat"}
    assert trie.prune(nodes, 1).count() == nodes.count()
    assert set(by_path(trie.prune(nodes, 100))) == {""}


@pytest.mark.parametrize(("order", "want"), [("preorder", ["", "k", "ka", "kat", "p", "pa", "pat", "pats"]), ("bfs", ["", "k", "p", "ka", "pa", "kat", "pat", "pats"])])
def test_ids(nodes, order, want):
    rows = trie.node_ids(nodes, order).orderBy("node_id").collect()
    assert ["".join(r.path) for r in rows] == want and [r.node_id for r in rows] == list(range(len(want)))


def test_probabilities_and_entropy(nodes):
    p = by_path(trie.transition_probs(nodes))
    assert p["p"].p == pytest.approx(0.6) and p["k"].p == pytest.approx(0.4)
    e = by_path(trie.entropy(nodes))
    assert e[""].entropy == pytest.approx(-(0.6 * math.log2(0.6) + 0.4 * math.log2(0.4))) and e["p"].entropy == 0
    inc = by_path(trie.incoming_prob(nodes, trie.transition_probs(nodes).where("p < 0.5").select("source", F.col("path").alias("target"), "p")))
    assert (inc[""].p_in, inc["k"].p_in, inc["p"].p_in, inc["pa"].p_in) == (1.0, pytest.approx(0.4), 0.05, 0.5)


def test_subtrees(nodes):
    w = by_path(trie.subtree_weights(nodes))
    assert w[""].weight == sum(r.total for r in nodes.collect()) and w["kat"].weight == 2
    assert by_path(trie.leaf_counts(nodes))[""].leaves == 2


def test_roles(nodes):
    r = {k: v.role for k, v in by_path(trie.roles(nodes)).items()}
    assert r == {"": "mixed", "p": "onset", "pa": "nucleus", "pat": "coda", "pats": "coda", "k": "onset", "ka": "nucleus", "kat": "coda"}
    old = {k: v.role for k, v in by_path(trie.roles(nodes, mode="legacy")).items()}
    assert old["pat"] == "coda" and old["pats"] == "coda" and old["p"] == "onset"


def test_stats(nodes):
    d = {r.depth: r for r in trie.depth_stats(nodes).collect()}
    assert (d[0].nodes, d[0].terminals, d[0].avg_branch) == (1, 1, 2.0) and d[4].avg_entropy == 0
    g = {(r.grp, r.depth): r.nodes for r in trie.group_depth_stats(trie.shared_counts(nodes)).collect()}
    assert g["en", 1] == 1 and g["de", 1] == 2 and ("de", 4) not in g


def test_motifs_and_tags(nodes):
    m = ngrams.motifs(nodes, 2, 10)
    top = {r.label: r.cnt for r in m.collect()}
    assert top == {"pa": 3, "at": 5, "pat": 3, "ka": 2, "kat": 2}
    tags = by_path(ngrams.tag_motifs(nodes, m))
    assert tags["pat"].labels == ["at", "pat"] and "pats" not in tags and tags["p"].labels == ["pa", "pat"]


def test_lookups(nodes):
    page = lookup.nodes_by_depth(nodes, 1, 2, -5, 3).collect()
    assert len(page) == 3 and page[0].total_count == 4 and page[0].has_more
    assert [r.token for r in lookup.children_of(nodes, ["p"]).collect()] == ["a"]
    with pytest.raises(ValueError):
        lookup.children_of(nodes, ["q"])
    assert {"".join(r.path) for r in lookup.search(nodes, "s").collect()} == {"pats"}
    assert lookup.search(nodes, "none").count() == 0
    assert lookup.edges_by_depth(trie.edges(nodes), 1, 2).count() == 2


def test_variants(spark):
    rows = spark.createDataFrame([(["a", "b"], ["A", "b"]), (["a", "c"], ["Ä", "c"])], "norm array<string>, surface array<string>")
    assert {"".join(r.path): r.variants for r in trie.variants(rows).collect()} == {"a": ["A", "Ä"]}


def test_sample_words_are_smallest(spark):
    rows = spark.createDataFrame([("g", w, ["x"]) for w in "fedcbaa"], "grp string, key string, tokens array<string>")
    assert trie.sample_words(rows).first().words == ["a", "b", "c", "d", "e"]
