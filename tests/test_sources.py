"""Readers, writers and the stream."""

import gzip
import hashlib
import random

from pyspark.sql import functions as F

from sequora.functions import dims
from sequora.operators import trie
from sequora.sources import readers, writers
from sequora.streaming import lexicon as stream


def test_lexicon_and_routing(spark, tmp_path):
    (tmp_path / "spa_latn_ca_broad.tsv").write_text("# note\n\n casa\t k a s a \textra\none field\n", encoding="utf-8")
    (tmp_path / "other.tsv").write_text("x\ty\n", encoding="utf-8")
    rows = readers.route_by_name(readers.read_lexicon(spark, str(tmp_path / "*.tsv")), dims.prefix_dim(spark)).collect()
    assert [(r.grp, r.word, r.transcription) for r in rows] == [("es_ES", "casa", "k a s a")]


def test_dictionary(spark, tmp_path):
    (tmp_path / "d").write_text(";;; note\nCAT\tK AE T\textra\nCAT(2)\tK A T\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_dictionary(spark, str(tmp_path / "d"), "en").collect()] == [("en", "cat", "K AE T\textra")]


def test_multi(spark, tmp_path):
    (tmp_path / "m").write_text("a\t/aɾ/, /b/, //\n", encoding="utf-8")
    rows = readers.read_multi(spark, str(tmp_path / "m"), "en_US", dims.TOKEN_MAPS).collect()
    assert [(r.norm, r.surface) for r in rows] == [(["a", "t"], ["a", "ɾ"]), (["b"], ["b"])]


def test_inventory(spark, tmp_path):
    (tmp_path / "i.csv").write_text("InventoryID,X,ISO6393,Phoneme\n2,,eng,q\n1,,eng,p\n1,,eng,\n3,,zzz,t\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_inventory(spark, str(tmp_path / "i.csv"), {"eng": "en_US"}).collect()] == [("en_US", "p", False)]


def test_checksums(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    want = hashlib.sha256(b"abc").hexdigest()
    manifest = spark.createDataFrame([("a.bin", want.upper())], "file string, expected string")
    assert readers.checksums(spark, str(tmp_path / "a.bin"), manifest).first().ok


def test_checksums_of_large_files(spark, tmp_path):
    """Files over the bound are read in splits and hashed in steps; their bytes come through as they are."""
    rng, bom = random.Random(3), b"\xef\xbb\xbf"
    noise = bytes(rng.choices(range(256), k=40_000))
    cases = {
        "noise": noise, "ended": noise + b"\n", "marked": bom + noise, "marked and ended": bom + b"a\r\n" * 9000 + b"\n\n", "newlines": b"\n" * 20_000,
        "zeros": bytes(70_000), "long.parquet": b"x" * 30_000 + b"\n" + noise, "packed.gz": gzip.compress(noise), "edge": b"e" * 1000, "more": b"e" * 1001, "small": b"s",
        "a b%20é": noise[:9000],
    }
    for name, content in cases.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = readers.checksums(spark, str(tmp_path), whole=1000, step=10_000)
        assert sorted(map(tuple, got.collect())) == sorted((k, hashlib.sha256(v).hexdigest()) for k, v in cases.items())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_reload_insert_and_replace(spark, tmp_path):
    facts, dim = str(tmp_path / "facts"), str(tmp_path / "dim")
    rows = lambda *x: spark.createDataFrame(list(x), "grp string, v int")
    writers.replace_partitions(rows(("a", 1), ("b", 2)), facts, ["grp"])
    writers.replace_partitions(rows(("a", 3)), facts, ["grp"])
    assert {(r.grp, r.v) for r in writers.read_rows(spark, facts).collect()} == {("a", 3), ("b", 2)}
    writers.insert_absent(rows(("a", 1), ("a", 2)), dim, ["grp"])
    writers.insert_absent(rows(("a", 5), ("c", 6)), dim, ["grp"])
    assert sorted(r.grp for r in writers.read_rows(spark, dim).collect()) == ["a", "c"]


def test_exports_read_back(spark, tmp_path):
    seqs = spark.createDataFrame([("g", ["a", "b"])], "grp string, tokens array<string>")
    nodes = trie.prefix_nodes(trie.prefix_counts(seqs))
    writers.export_trie(nodes, trie.edges(nodes), trie.metadata(nodes), str(tmp_path / "out"))
    back = readers.read_export(spark, str(tmp_path / "out"))
    assert back["nodes"].count() == 3 and back["edges"].count() == 2 and back["metadata"].first().node_count == 3
    (tmp_path / "one.json").write_text('{"metadata": {"n": 1},\n "nodes": [{"id": 0}, {"id": 1}], "edges": [{"source": 0, "target": 1}]}')
    one = readers.read_export(spark, str(tmp_path / "one.json"))
    assert one["nodes"].count() == 2 and one["metadata"].first().n == 1
    writers.export_stats(trie.group_depth_stats(trie.prefix_counts(seqs)), str(tmp_path / "stats"))
    assert spark.read.json(str(tmp_path / "stats")).count() == 1
    rows = trie.roles(nodes).withColumns({"transition_probs": F.create_map(F.lit("a"), F.lit(1.0)), "words": F.array(*map(F.lit, "abcdefg"))})
    writers.export_compact(rows, str(tmp_path / "compact"), 1)
    assert spark.read.json(str(tmp_path / "compact")).select(F.size("words").alias("n")).first().n == 5


def test_report_csv_resume_and_outcomes(spark, tmp_path):
    rep = spark.createDataFrame([("e", 1, 3, 3, 1.0, 0, 0, 3, 0.0, 0)], "experiment string, size int, total int, distinct_outcomes int, ratio double, divergent int, explosive int, new_motifs int, avg_steps double, max_steps int")
    writers.export_report(rep, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["size", "total", "distinct", "ratio", "divergent", "explosive", "motifs", "avg", "max"]
    sizes = spark.createDataFrame([("e", 1), ("e", 2)], "experiment string, size int")
    assert [r.size for r in writers.to_do(sizes, rep).collect()] == [2]
    out = spark.createDataFrame([("e", 1, "a", "normal"), ("e", 1, "a", "normal"), ("e", 1, None, "divergent")], "experiment string, size int, outcome string, status string")
    for batch in ("a", "b", "a"):
        writers.append_outcomes(out, str(tmp_path / "out"), batch)
    stored = writers.read_rows(spark, str(tmp_path / "out"))
    assert stored.count() == 6 and writers.seen_outcomes(stored).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("x\ty\n# no\n", encoding="utf-8")
    go = lambda: stream.load_stream(stream.stream_lexicon(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
    go()
    (tmp_path / "in" / "b.tsv").write_text("z\tw\n", encoding="utf-8")
    go()
    assert {(r.word, r.transcription) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("x", "y"), ("z", "w")}
