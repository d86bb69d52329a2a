"""Steps whose cost grew faster than it need: what is read or made once, and the results."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sequora.operators import contrast, ngrams, stored_nodes, trie
from sequora.sources import writers


def test_summary_is_one_pass(spark, tmp_path):
    rows = [("a", list("abca"), 2), ("b", list("abca"), 1), ("a", [], 5), ("a", None, 7), ("a", ["b", None], 1), ("b", ["z"], 1)]
    spark.createDataFrame(rows, "grp string, tokens array<string>, n long").write.parquet(str(tmp_path / "t"))
    seqs = spark.read.parquet(str(tmp_path / "t"))
    got = ngrams.summary_counts(seqs)
    assert tuple(got.first()) == (17, 5, 4, 2, 3, 3)
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert tuple(ngrams.summary_counts(seqs.limit(0)).first()) == (None, 0, 0, 0, 0, 0)


def test_index_makes_nodes_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        made.add(1)
        return x

    seqs = spark.createDataFrame([("a", list("pat")), ("a", list("pit"))], "grp string, tokens array<string>")
    nodes = trie.prefix_nodes(trie.prefix_counts(seqs)).withColumn("total", counted("total"))
    stored_nodes.write_index(nodes, str(tmp_path / "index"))
    assert made.value == nodes.where("depth > 0").count() == 5
    assert stored_nodes.search(spark, str(tmp_path / "index"), "t").count() == 2


def test_pairs_by_bits(spark, monkeypatch):
    tokens = [f"t{i:02d}" for i in range(70)]
    rows = [("a", [t, "x"]) for t in tokens] + [("a", ["x", t]) for t in tokens[60:]] + [("b", ["x", None]), ("b", ["x", "t01"]), ("b", ["x", "t02"]), ("b", ["x", "t02"])]
    seqs = spark.createDataFrame(rows, "grp string, tokens array<string>")
    for blanks in (contrast.blank_keys(seqs), contrast.templates(seqs)):
        found = contrast.contrasting_pairs(blanks)
        assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = {tuple(r) for r in found.collect()}
        assert len(got) == 70 * 69 // 2 + 1 and ("b", "t01", "t02") in got and all(a < b for _, a, b in got)
        with monkeypatch.context() as m:
            m.setattr(contrast, "MOST_BITS", 3)
            assert {tuple(r) for r in contrast.contrasting_pairs(blanks).collect()} == got
    assert contrast.contrasting_pairs(contrast.blank_keys(seqs.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["src1_lexicon_to_json", "src7_read_export", "snk6_export_edges"])
def test_exported_nodes_are_stored_first(spark, monkeypatch, name):
    plans, export = [], writers.export_trie
    monkeypatch.setattr(writers, "export_trie", lambda nodes, *rest: (plans.append(nodes._jdf.queryExecution().optimizedPlan().toString()), export(nodes, *rest)))
    entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert "Aggregate" not in plans[0]
