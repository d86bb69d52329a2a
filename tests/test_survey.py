"""Outcome reports: golden rows and small cases."""

import pytest

from sequora.operators import contrast, outcomes

# Published baseline report (size, total, distinct, ratio, divergent, explosive).
BASELINE = [(1, 3, 3, 1.0, 0, 0), (2, 9, 9, 1.0, 0, 0), (3, 54, 30, 0.555556, 0, 0), (4, 405, 108, 0.266667, 0, 0), (5, 3402, 438, 0.128748, 0, 0), (6, 30618, 1920, 0.062708, 5, 0), (7, 288684, 8706, 0.030158, 128, 44)]


@pytest.fixture(scope="module")
def reports(spark):
    rows = [("baseline", *r) for r in BASELINE]
    rows += [("S(SS)", 6, 172032, 18174, 0.1056, 0, 0), ("SS", 6, 172032, 17346, 0.1008, 0, 0), ("SS, S(SS)", 6, 656250, 80252, 0.1223, 0, 0)]
    return spark.createDataFrame(rows, "experiment string, size int, total long, distinct_outcomes long, ratio double, divergent long, explosive long")


def test_decay(reports):
    r = outcomes.decay_fit(reports.where("experiment = 'baseline'")).first()
    assert r.rate == pytest.approx(-0.727, abs=1e-3) and r.r2 == pytest.approx(1.0, abs=1e-3) and r.half_life == pytest.approx(0.95, abs=0.01)


def test_growth(reports):
    assert outcomes.growth_factors(reports.where("size >= 2 and experiment = 'baseline'")).first().avg_growth == pytest.approx(3.82, abs=0.2)


def test_ranking(reports):
    rows = outcomes.advantage_ranking(reports, "baseline", [6]).collect()
    adv = {r.experiment: r.advantage for r in rows}
    assert adv["S(SS)"] == pytest.approx(1.685, abs=2e-3) and adv["SS"] == pytest.approx(1.608, abs=2e-3)
    assert [r.experiment for r in sorted(rows, key=lambda r: r.rank)][0] == "SS, S(SS)"


def test_interaction(spark, reports):
    combos = spark.createDataFrame([("SS, S(SS)", ["SS", "S(SS)"])], "combination string, components array<string>")
    r = outcomes.interactions(reports, reports, combos, "baseline", 6).first()
    assert r.expected == pytest.approx(2.71, abs=0.01) and r.actual_over_expected == pytest.approx(0.72, abs=0.01) and not r.synergistic


def test_report_and_motifs(spark):
    rows = [("e", 1, "a", "a", 0, "normal"), ("e", 1, "b", "a", 2, "normal"), ("e", 2, "c", "ab", 1, "normal"), ("e", 2, "d", None, 4, "divergent")]
    df = spark.createDataFrame(rows, "experiment string, size int, input string, outcome string, steps int, status string")
    r = {x.size: x for x in outcomes.size_report(df).collect()}
    assert (r[1].distinct_outcomes, r[1].ratio, r[1].avg_steps, r[1].max_steps) == (1, 0.5, 1.0, 2)
    assert (r[2].total, r[2].normal, r[2].divergent) == (2, 1, 1)
    assert {x.size: x.new_motifs for x in outcomes.new_motifs(df).collect()} == {1: 1, 2: 2}
    assert outcomes.reuse_values(df).collect()[0].sub == "ab"
    assert outcomes.decay_fit(outcomes.size_report(df)).count() == 1


def test_minimal_pairs(spark):
    seqs = spark.createDataFrame([("g", list("pat"), 60), ("g", list("bat"), 60), ("g", list("pam"), 60)], "grp string, tokens array<string>, n long")
    pairs = contrast.contrasting_pairs(contrast.templates(seqs))
    assert {(r.a, r.b) for r in pairs.collect()} == {("b", "p"), ("m", "t")}
    comp = contrast.similarity(contrast.complementary_pairs(seqs, pairs))
    assert {(r.a, r.b): r.sim for r in comp.collect()}["p", "t"] == 0.5
    assert {(r.token, r.target) for r in contrast.suggested_map(comp).collect()} == {("b", "t"), ("t", "p")}
