"""Tokens, normalisation, rewriting, validation."""

import pytest
from pyspark.sql import functions as F

from sequora.functions import dims, prep


def tokens(spark, texts, mode="default"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", prep.tokenize(F.col("t"), mode).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("/ˈɪŋɡlɪʃ/", "ˈ ɪ ŋ ɡ l ɪ ʃ"), ("pʰæt", "pʰ æ t"), ("biːt", "b iː t"), ("t͡ʃæt", "t͡ʃ æ t"), ("bʌtn̩", "b ʌ t n̩"), ("p æ t", "p æ t"),
        ("", ""), ("ˈsɪl.ə.bəl", "ˈ s ɪ l . ə . b ə l"), ("pʼa", "pʼ a"), ("n̥a", "n̥ a"), ("[kæt]", "k æ t"), ("  /a/  ", "a"), ("d͡ʒʌd͡ʒ", "d͡ʒ ʌ d͡ʒ"),
    ],
)
def test_tokens(spark, text, want):
    assert tokens(spark, [text]) == [want.split()]


def test_composes(spark):
    assert tokens(spark, ["ãb"]) == [["ã", "b"]]


def test_legacy_attaches_stress_and_strips_outer_signs(spark):
    assert tokens(spark, ["//aˈb//"], "legacy") == [["aˈ", "b"]]
    assert tokens(spark, ["ã"], "legacy") == [["ã"]]


@pytest.mark.parametrize(
    ("token", "grp", "want"),
    [
        ("ˈ", "en_US", []), ("ɫ", "en_US", ["l"]), ("ɾ", "en_US", ["t"]), ("ɾ", "de", ["ɾ"]), ("β", "es_ES", ["b"]), ("n̩", "en_US", ["n"]),
        ("iː", "de", ["iː"]), ("pʰ", "de", ["pʰ"]), ("õ", "fr_FR", ["õ"]), ("ˈa", "de", ["a"]), ("ɫ̩", "en_US", ["l"]), (".", "de", []),
    ],
)
def test_normalized(spark, token, grp, want):
    df = spark.createDataFrame([([token], grp)], "t array<string>, g string")
    assert df.select(prep.normalized(F.col("t"), prep.map_of(dims.TOKEN_MAPS, F.col("g"))).alias("x")).first().x == want


def test_legacy_keeps_other_prosody_inside(spark):
    df = spark.createDataFrame([(["a.", "aˈ", "."],)], "t array<string>")
    assert df.select(prep.normalized(F.col("t"), prep.map_of({}, F.lit("x")), "legacy").alias("x")).first().x == ["a.", "a"]


@pytest.mark.parametrize("rounds", [2, 8, 50])
def test_rewrite_statuses(spark, rounds):
    df = spark.createDataFrame([("aaab",), ("b",), ("aaaaab",), ("c" * 20,), ("aaaab",)], "t string")
    rows = {r.t: (r.outcome, r.steps, r.status) for r in prep.rewrite(df, "t", "^aa", "a", fuel=3, max_size=10, round_steps=rounds).collect()}
    assert rows["aaab"] == ("ab", 2, "normal")
    assert rows["b"] == ("b", 0, "normal")
    assert rows["aaaaab"] == (None, 3, "divergent")
    assert rows["aaaab"] == (None, 3, "divergent")  # normal form reached at the last step, fuel is tested first
    assert rows["c" * 20] == (None, 0, "explosive")


def test_validation(spark):
    seqs = spark.createDataFrame([("a", "k1", ["x", "y"], 2), ("a", "k2", ["x", "z", "z"], 1), ("b", "k3", ["x"], 1)], "grp string, key string, tokens array<string>, n long")
    inv = spark.createDataFrame([("a", "x", False), ("a", "y", True)], "grp string, token string, marginal boolean")
    checked = prep.validate(seqs, inv)
    rows = {r.key: (r.issues, r.valid) for r in checked.collect()}
    assert rows == {"k1": ([], True), "k2": (["Unknown phoneme: z"] * 2, False), "k3": (["No inventory for language: b"], False)}
    assert [(r.token, r.cnt) for r in prep.unknown_tokens(checked).collect()] == [("z", 2)]
    assert {r.grp: (r.valid, r.total) for r in prep.validation_report(checked).collect()} == {"a": (2, 3), "b": (0, 1), None: (2, 4)}
    assert {r.grp: r.invalid for r in prep.invalid_totals(checked).collect()} == {"a": 1, "b": 1, None: 2}
