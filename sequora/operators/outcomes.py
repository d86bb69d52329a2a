"""Outcome surveys: ``outcomes(experiment, size, input, outcome, steps, status)`` and reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import parts

KEY = ["experiment", "size"]


def size_report(outcomes: DataFrame, approximate: bool = False) -> DataFrame:
    """Per experiment and size: totals by status, distinct normal outcomes, ratio, mean and most steps of normal rows.

    ``approximate`` counts distinct outcomes by a sketch, without shuffling them.
    """
    normal = F.col("status") == "normal"
    distinct = (F.approx_count_distinct if approximate else F.count_distinct)(F.when(normal, F.col("outcome")))
    return outcomes.groupBy(*KEY).agg(
        F.count("*").alias("total"), F.count_if(normal).alias("normal"), F.count_if(F.col("status") == "divergent").alias("divergent"),
        F.count_if(F.col("status") == "explosive").alias("explosive"), distinct.alias("distinct_outcomes"),
        F.round(F.coalesce(F.avg(F.when(normal, F.col("steps"))), F.lit(0.0)), 6).alias("avg_steps"),
        F.coalesce(F.max(F.when(normal, F.col("steps"))), F.lit(0)).alias("max_steps"),
    ).withColumn("ratio", F.round(F.col("distinct_outcomes") / F.col("total"), 6))


def _normal(outcomes: DataFrame) -> DataFrame:
    """Normal outcomes with their multiplicity: what is exploded is distinct."""
    return outcomes.where("status = 'normal'").groupBy(*KEY, "outcome").agg(F.count("*").alias("times"))


def _ranked(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def _texts(outcomes: DataFrame) -> DataFrame:
    return _normal(outcomes).withColumn("text", F.col("outcome"))


def frequent_substructures(outcomes: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent parts, of any length, of normal outcomes per experiment and size, with multiplicity."""
    top = parts.top_parts(_texts(outcomes), KEY, k)
    return top.select(*KEY, F.col("part").alias("sub"), F.col("weight").alias("cnt"), "rank")


def new_motifs(outcomes: DataFrame) -> DataFrame:
    """Per experiment and size: parts, of any length, that no smaller size of the experiment has."""
    least = outcomes.where("status = 'normal'").groupBy("experiment", F.col("outcome").alias("text")).agg(F.min("size").alias("size"), F.lit(1).alias("times"))
    return parts.first_sizes(least, ["experiment"]).withColumnRenamed("parts", "new_motifs")


def reuse_values(outcomes: DataFrame, k: int = 5) -> DataFrame:
    """Top parts of two characters or more, of any length, over distinct outcomes: occurrences, outcomes that hold them, and savings."""
    top = parts.top_parts(_texts(outcomes), KEY, k, savings=True, least_len=2)
    return top.select(*KEY, F.col("part").alias("sub"), F.col("occurrences").alias("frequency"), F.col("texts").alias("outcomes"), F.col("value").alias("savings"), "rank")


def attractors(outcomes: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most frequent normal outcomes per experiment and size, with their share in percent."""
    counts = _normal(outcomes)
    total = counts.groupBy(*KEY).agg(F.sum("times").alias("_all"))
    share = counts.join(total, KEY).withColumn("pct", F.round(100 * F.col("times") / F.col("_all"), 6)).drop("_all")
    return _ranked(share, KEY, [F.desc("times"), F.col("outcome")], k)


def rank_frequency_fit(outcomes: DataFrame, top: int = 500) -> DataFrame:
    """Per experiment and size: power law of count against rank over the first ``top`` ranks: exponent, R² and points."""
    counts = _ranked(_normal(outcomes), KEY, [F.desc("times"), F.col("outcome")], top)
    x, y = F.log(F.col("rank").cast("double")), F.log(F.col("times").cast("double"))
    fit = counts.groupBy(*KEY).agg(F.count("*").alias("points"), F.regr_slope(y, x).alias("_s"), F.regr_r2(y, x).alias("_r"))
    return fit.where("points >= 2").select(*KEY, "points", F.round(-F.col("_s"), 6).alias("exponent"), F.round("_r", 6).alias("r2"))


def steps_histogram(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("status = 'normal'").groupBy(*KEY, "steps").agg(F.count("*").alias("cnt"))


def decay_fit(reports: DataFrame, below: float = 0.99) -> DataFrame:
    """Per experiment: ln(ratio) against size where ratio < ``below``: rate, intercept, R², half-life, factor a size."""
    rows = reports.where((F.col("ratio") < below) & (F.col("ratio") > 0))
    y, x = F.log("ratio"), F.col("size").cast("double")
    fit = rows.groupBy("experiment").agg(F.count("*").alias("points"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.regr_r2(y, x).alias("r"))
    half = F.when(F.col("b") < 0, -F.log(F.lit(2.0)) / F.col("b")).otherwise(F.lit(float("inf")))
    return fit.where("points >= 2").select(
        "experiment", "points", F.round("b", 6).alias("rate"), F.round(F.exp("a"), 6).alias("intercept"), F.round("r", 6).alias("r2"),
        F.round(half, 6).alias("half_life"), F.round(F.exp("b"), 6).alias("factor"),
    )


def growth_factors(reports: DataFrame) -> DataFrame:
    """Per experiment: mean, least and largest factor of distinct outcomes from a size to the next one."""
    before = F.lag("distinct_outcomes").over(Window.partitionBy("experiment").orderBy("size"))
    rows = reports.withColumn("_b", before).where("_b > 0").withColumn("g", F.col("distinct_outcomes") / F.col("_b"))
    return rows.groupBy("experiment").agg(*[F.round(f("g"), 6).alias(f"{name}_growth") for name, f in (("avg", F.avg), ("min", F.min), ("max", F.max))])


def onsets(reports: DataFrame) -> DataFrame:
    """Per experiment: the first size with divergent rows and with explosive rows, and their percent there."""
    out = None
    for kind in ("divergent", "explosive"):
        rows = reports.where(F.col(kind) > 0).withColumn("_pct", F.round(100 * F.col(kind) / F.col("total"), 6))
        part = rows.groupBy("experiment").agg(F.min("size").alias(f"first_{kind}"), F.min_by("_pct", "size").alias(f"{kind}_pct"))
        out = part if out is None else out.join(part, "experiment", "full")
    return out


def advantages(reports: DataFrame, baseline: str, when_zero: float | None = 1.0) -> DataFrame:
    """Each report beside the baseline's of its size: ``advantage`` is ratio / baseline ratio.

    ``when_zero`` stands where the baseline's ratio isn't positive; None leaves such sizes out.
    """
    base = reports.where(F.col("experiment") == baseline).select("size", F.col("ratio").alias("base_ratio"))
    rows = reports.join(base, "size")
    if when_zero is None:
        rows = rows.where("base_ratio > 0")
    adv = F.when(F.col("base_ratio") > 0, F.col("ratio") / F.col("base_ratio")).otherwise(F.lit(when_zero))
    return rows.withColumn("advantage", F.round(adv, 6))


def advantage_ranking(reports: DataFrame, baseline: str, sizes: list[int]) -> DataFrame:
    """Experiments other than the baseline ranked by advantage at the given sizes, with percent of non-normal rows."""
    pct = lambda c: F.round(100 * F.col(c) / F.col("total"), 6).alias(f"{c}_pct")
    rows = advantages(reports, baseline, None).where(F.col("size").isin(sizes) & (F.col("experiment") != baseline))
    rank = F.row_number().over(Window.partitionBy("size").orderBy(F.desc("advantage"), "experiment"))
    return rows.select("size", "experiment", "distinct_outcomes", "ratio", "advantage", pct("divergent"), pct("explosive"), rank.alias("rank"))


def interactions(reports: DataFrame, singles: DataFrame, combos: DataFrame, baseline: str, size: int, single_size: int | None = None) -> DataFrame:
    """Combinations at ``size``: advantage, the product of their components' advantages, and the ratio of the two.

    ``combos(combination, components)``; components without an advantage count as 1. ``single_size``:
    where the components' advantages are taken (default: ``size``).
    """
    comp = advantages(singles, baseline, None).where(F.col("size") == (single_size or size)).select(F.col("experiment").alias("component"), F.col("advantage").alias("_a"))
    parts = combos.select("combination", F.explode("components").alias("component")).join(comp, "component", "left")
    expected = parts.groupBy("combination").agg(F.round(F.exp(F.sum(F.log(F.coalesce("_a", F.lit(1.0))))), 6).alias("expected"))
    own = advantages(reports, baseline, None).where(F.col("size") == size).select(F.col("experiment").alias("combination"), "size", "advantage")
    return own.join(expected, "combination").withColumns(
        {"actual_over_expected": F.round(F.col("advantage") / F.col("expected"), 6), "synergistic": F.col("advantage") > F.col("expected")}
    )


def latest(reports: DataFrame, baseline: str) -> DataFrame:
    """Each experiment at its largest size, beside the baseline at that size."""
    top = reports.groupBy("experiment").agg(F.max("size").alias("size"))
    return advantages(reports, baseline).join(top, KEY).select(*KEY, "distinct_outcomes", "ratio", "base_ratio", "advantage")


def non_normal_share(reports: DataFrame) -> DataFrame:
    return reports.select(*KEY, F.round(100 * (F.col("divergent") + F.col("explosive")) / F.col("total"), 6).alias("non_normal_pct"))


def normalized_metrics(metrics: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Min–max of each column across experiments (a zero range counts as 1), sorted by ``order``."""
    ends = metrics.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    rows = metrics.join(ends)
    for c in columns:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        rows = rows.withColumn(f"{c}_norm", F.round((F.col(c) - F.col(f"_lo_{c}")) / F.when(span == 0, 1).otherwise(span), 6))
    return rows.drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")]).orderBy(*order)


def gap_table(reports: DataFrame) -> DataFrame:
    """Totals beside distinct outcomes per experiment and size, and the gap."""
    return reports.select(*KEY, "total", "distinct_outcomes", (F.col("total") - F.col("distinct_outcomes")).alias("gap"))


def with_classes(metrics: DataFrame, classes: DataFrame) -> DataFrame:
    """Metrics with the class attributes of their experiment; one without attributes keeps nulls."""
    return metrics.join(classes, "experiment", "left")
