"""Queries over outcome surveys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outcomes as O
from ..sources import writers
from . import fixtures as fx
from .registry import OUT, REPORT, query

KEYS = "experiment, size"
DONE = f"{OUT}, d AS (SELECT experiment, size, outcome, count(*) AS times FROM outcomes WHERE status = 'normal' GROUP BY ALL)"
SUBS = f"""{DONE}, sub AS (SELECT experiment, size, outcome, times, substr(outcome, i, l) AS sub, l FROM (SELECT *, unnest(range(1, length(outcome) - i + 2)) AS l FROM (SELECT *, unnest(range(1, length(outcome) + 1)) AS i FROM d)))"""
ADV = f"{REPORT}, adv AS (SELECT r.*, b.ratio AS base_ratio, round(CASE WHEN b.ratio > 0 THEN r.ratio / b.ratio ELSE 1.0 END, 6) AS advantage FROM reports r JOIN reports b ON b.experiment = 'en' AND b.size = r.size)"


def reports(spark, sf):
    return O.size_report(fx.outcomes(spark, sf))


def ranked(source, order, k):
    return f"WITH {source}, r AS (SELECT *, row_number() OVER (PARTITION BY experiment, size ORDER BY {order}) AS rank FROM x) SELECT * FROM r WHERE rank <= {k}"


@query("out1_size_report", f"WITH {REPORT} SELECT * FROM reports")
def _(spark, sf):
    return reports(spark, sf)


@query("out2_substructures", ranked(f"{SUBS}, x AS (SELECT experiment, size, sub, sum(times)::BIGINT AS cnt FROM sub GROUP BY ALL)", "cnt DESC, sub", 10))
def _(spark, sf):
    return O.frequent_substructures(fx.outcomes(spark, sf))


@query("out3_new_motifs", f"WITH {SUBS}, f AS (SELECT experiment, sub, min(size) AS size FROM sub GROUP BY ALL) SELECT experiment, size, count(*) AS new_motifs FROM f GROUP BY ALL")
def _(spark, sf):
    return O.new_motifs(fx.outcomes(spark, sf))


REUSE = f"{SUBS}, x AS (SELECT experiment, size, sub, count(*) AS frequency, count(DISTINCT outcome) AS outcomes, count(*) * (length(sub) - 1) AS savings FROM sub WHERE l >= 2 GROUP BY experiment, size, sub)"


@query("out4_reuse_values", ranked(REUSE, "savings DESC, sub", 50))
def _(spark, sf):
    return O.reuse_values(fx.outcomes(spark, sf), 50)


@query("out5_attractors", ranked(f"{DONE}, x AS (SELECT *, round(100 * times / sum(times) OVER (PARTITION BY experiment, size), 6) AS pct FROM d)", "times DESC, outcome", 15))
def _(spark, sf):
    return O.attractors(fx.outcomes(spark, sf))


@query("out6_rank_frequency", f"""WITH {DONE}, r AS (SELECT *, row_number() OVER (PARTITION BY experiment, size ORDER BY times DESC, outcome) AS rank FROM d),
f AS (SELECT experiment, size, count(*) AS points, regr_slope(ln(times), ln(rank)) AS s, regr_r2(ln(times), ln(rank)) AS r2 FROM r WHERE rank <= 500 GROUP BY ALL)
SELECT experiment, size, points, round(-s, 6) + 0.0 AS exponent, round(r2, 6) AS r2 FROM f WHERE points >= 2""")
def _(spark, sf):
    return O.rank_frequency_fit(fx.outcomes(spark, sf))


@query("out7_steps_histogram", f"WITH {OUT} SELECT experiment, size, steps, count(*) AS cnt FROM outcomes WHERE status = 'normal' GROUP BY ALL")
def _(spark, sf):
    return O.steps_histogram(fx.outcomes(spark, sf))


@query("out8_decay_fit", f"""WITH {REPORT}, f AS (SELECT experiment, count(*) AS points, regr_slope(ln(ratio), size) AS b, regr_intercept(ln(ratio), size) AS a, regr_r2(ln(ratio), size) AS r FROM reports WHERE ratio < 0.99 AND ratio > 0 GROUP BY experiment)
SELECT experiment, points, round(b, 6) AS rate, round(exp(a), 6) AS intercept, round(r, 6) AS r2, CASE WHEN b < 0 THEN round(-ln(2) / b, 6) ELSE 'inf'::DOUBLE END AS half_life, round(exp(b), 6) AS factor FROM f WHERE points >= 2""")
def _(spark, sf):
    return O.decay_fit(reports(spark, sf))


@query("out9_growth_factors", f"""WITH {REPORT}, g AS (SELECT experiment, distinct_outcomes AS d, lag(distinct_outcomes) OVER (PARTITION BY experiment ORDER BY size) AS b FROM reports)
SELECT experiment, round(avg(d / b), 6) AS avg_growth, round(min(d / b), 6) AS min_growth, round(max(d / b), 6) AS max_growth FROM g WHERE b > 0 GROUP BY experiment""")
def _(spark, sf):
    return O.growth_factors(reports(spark, sf))


@query("out10_onsets", f"""WITH {REPORT}, v AS (SELECT experiment, min(size) AS first_divergent, min_by(round(100 * divergent / total, 6), size) AS divergent_pct FROM reports WHERE divergent > 0 GROUP BY 1),
e AS (SELECT experiment, min(size) AS first_explosive, min_by(round(100 * explosive / total, 6), size) AS explosive_pct FROM reports WHERE explosive > 0 GROUP BY 1) SELECT * FROM v FULL JOIN e USING (experiment)""")
def _(spark, sf):
    return O.onsets(reports(spark, sf))


@query("out11_advantage_ranking", f"""WITH {ADV} SELECT size, experiment, distinct_outcomes, ratio, advantage, round(100 * divergent / total, 6) AS divergent_pct, round(100 * explosive / total, 6) AS explosive_pct,
row_number() OVER (PARTITION BY size ORDER BY advantage DESC, experiment) AS rank FROM adv WHERE size IN (5, 6, 8) AND experiment <> 'en' AND base_ratio > 0""")
def _(spark, sf):
    return O.advantage_ranking(reports(spark, sf), "en", [5, 6, 8])


@query("out12_advantages", f"WITH {ADV} SELECT experiment, size, ratio, base_ratio, advantage FROM adv")
def _(spark, sf):
    return O.advantages(reports(spark, sf), "en").select("experiment", "size", "ratio", "base_ratio", "advantage")


@query("out13_interactions", f"""WITH {ADV}, c(combination, component) AS (VALUES ('de', 'de'), ('fr', 'fr'), ('fr', 'es'), ('es', 'es'), ('es', 'xx')),
e AS (SELECT combination, round(exp(sum(ln(coalesce(advantage, 1.0)))), 6) AS expected FROM c LEFT JOIN adv ON adv.experiment = component AND adv.size = 8 AND base_ratio > 0 GROUP BY combination)
SELECT combination, size, advantage, expected, round(advantage / expected, 6) AS actual_over_expected, advantage > expected AS synergistic FROM adv JOIN e ON e.combination = experiment WHERE size = 8 AND base_ratio > 0""")
def _(spark, sf):
    rows = reports(spark, sf)
    return O.interactions(rows, rows, spark.createDataFrame(fx.COMBOS, "combination string, components array<string>"), "en", 8)


@query("out14_latest", f"WITH {ADV} SELECT experiment, size, distinct_outcomes, ratio, base_ratio, advantage FROM adv JOIN (SELECT experiment, max(size) AS size FROM reports GROUP BY 1) USING (experiment, size)")
def _(spark, sf):
    return O.latest(reports(spark, sf), "en")


@query("out15_non_normal_share", f"WITH {REPORT} SELECT experiment, size, round(100 * (divergent + explosive) / total, 6) AS non_normal_pct FROM reports")
def _(spark, sf):
    return O.non_normal_share(reports(spark, sf))


@query("out16_normalized_metrics", f"""WITH {REPORT}, m AS (SELECT experiment, ratio, avg_steps FROM reports WHERE size = 8)
SELECT experiment, ratio, avg_steps, round((ratio - min(ratio) OVER ()) / CASE WHEN max(ratio) OVER () = min(ratio) OVER () THEN 1 ELSE max(ratio) OVER () - min(ratio) OVER () END, 6) AS ratio_norm,
round((avg_steps - min(avg_steps) OVER ()) / CASE WHEN max(avg_steps) OVER () = min(avg_steps) OVER () THEN 1 ELSE max(avg_steps) OVER () - min(avg_steps) OVER () END, 6) AS avg_steps_norm FROM m""")
def _(spark, sf):
    return O.normalized_metrics(reports(spark, sf).where("size = 8").select("experiment", "ratio", "avg_steps"), ["ratio", "avg_steps"], ["experiment"])


@query("out17_top_reuse", ranked(REUSE, "savings DESC, sub", 5))
def _(spark, sf):
    return O.reuse_values(fx.outcomes(spark, sf), 5)


@query("out18_gap_table", f"WITH {REPORT} SELECT experiment, size, total, distinct_outcomes, total - distinct_outcomes AS gap FROM reports")
def _(spark, sf):
    return O.gap_table(reports(spark, sf))


@query("out19_classes", f"WITH {REPORT}, c(experiment, class) AS (VALUES ('en', 'base'), ('de', 'single'), ('fr', 'pair')) SELECT experiment, size, ratio, class FROM reports LEFT JOIN c USING (experiment)")
def _(spark, sf):
    classes = spark.createDataFrame([("en", "base"), ("de", "single"), ("fr", "pair")], "experiment string, class string")
    return O.with_classes(reports(spark, sf).select("experiment", "size", "ratio"), classes)


@query("snk5_to_do", f"WITH {REPORT} SELECT DISTINCT experiment, size FROM outcomes WHERE (experiment, size) NOT IN (SELECT (experiment, size) FROM reports WHERE size <= 10)")
def _(spark, sf):
    rows = fx.outcomes(spark, sf)
    return writers.to_do(rows.select("experiment", "size").distinct(), O.size_report(rows).where("size <= 10"))


@query("snk5_seen_outcomes", f"WITH {OUT} SELECT DISTINCT experiment, outcome FROM outcomes WHERE status = 'normal'")
def _(spark, sf):
    return writers.seen_outcomes(fx.outcomes(spark, sf)).select("experiment", F.col("outcome"))
