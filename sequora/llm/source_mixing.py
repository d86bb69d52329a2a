"""Mixing sources to target weights by temperature, with DataFrame functions only.

Token shares of the sources are raised to an exponent between 0 (all equal) and 1 (as they are).
The exponent is bisected to meet a target entropy and a limit on repetition. Each source's quota of
tokens is then met by whole passes over it and, for the rest, by blocks in a permuted order: whole
blocks while they fit, and documents in a permuted order inside the block that no longer fits.
A source has about the square root of its documents as blocks, so neither the blocks of a source
nor the documents of a block become a large group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

LEVELS, ROUNDS = 5, 8  # halvings in one pass over the sources, passes


def word_count(text: Column) -> Column:
    """Words of the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(*parts: Column) -> Column:
    """A permutation key: the same in every run and on every executor."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))


def source_totals(docs: DataFrame, source_col: str, tokens_col: str) -> DataFrame:
    return docs.groupBy(F.col(source_col).alias("_sq_source")).agg(F.sum(tokens_col).alias("tokens"), F.count("*").alias("n_docs"))


def solve_exponent(totals: DataFrame, entropy_share: float, max_repeats: float, budget: float | None) -> tuple[float, dict]:
    """The exponent for a table of ``tokens`` per source, rounded to 9 places, and corpus figures.

    ``entropy_share``: the target entropy, as a share of the way from that of the token shares as
    they are to that of equal shares. The exponent is the flattest one that doesn't pass the target and draws no source
    more than ``max_repeats`` times. Both conditions are monotone in the exponent, so each is
    bisected; one pass over the sources tries all points of some halvings. Sources without tokens don't count.
    """
    used = totals.where("tokens > 0")
    top = used.agg(F.sum("tokens").alias("total"), F.max("tokens").alias("most"), F.count("*").alias("n")).first()
    if not top.n:
        return 1.0, {"total": 0, "most": 0, "n": 0}
    share = F.col("tokens") / F.lit(float(top.total))
    p_most = top.most / top.total

    def at(points: list[float]) -> dict[float, tuple[float, float]]:
        """Entropy and largest number of repeats at each exponent."""
        grid = used.select(share.alias("p"), F.explode(F.array(*map(F.lit, points))).alias("a"))
        power = F.pow("p", "a")
        rows = grid.groupBy("a").agg(
            F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("s"), F.max(F.pow(F.col("p"), F.col("a") - 1)).alias("r")
        ).collect()  # one row for each point
        scale = lambda r: r.r / p_most ** (r.a - 1) if budget is None else r.r / r.z * budget / top.total
        return {r.a: (math.log(r.z) - r.a * r.s / r.z, scale(r)) for r in rows}

    natural = at([1.0])[1.0][0]
    target = natural + entropy_share * (math.log(top.n) - natural)
    low_h, high_h, low_r, high_r = 0.0, 1.0, 0.0, 1.0
    steps = 2**LEVELS
    for _ in range(ROUNDS):
        inner = lambda lo, hi: [lo + (hi - lo) * k / steps for k in range(1, steps)]
        hs, rs = inner(low_h, high_h), inner(low_r, high_r)
        got = at(sorted({*hs, *rs}))
        low_h = max([low_h, *(a for a in hs if got[a][0] >= target)])
        high_h = min([high_h, *(a for a in hs if got[a][0] < target)])
        low_r = max([low_r, *(a for a in rs if got[a][1] > max_repeats)])
        high_r = min([high_r, *(a for a in rs if got[a][1] <= max_repeats)])
    exponent = round(max(high_h if low_h > 0 else 0.0, high_r if low_r > 0 else 0.0), 9)
    return exponent, {"total": top.total, "most": top.most, "n": top.n}


def mixture(
    docs: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    tokens_col: str = "n_tokens",
    entropy_share: float = 0.5,
    max_repeats: float = 4.0,
    budget: float | None = None,
    seed: str = "mix",
) -> DataFrame:
    """Add ``weight``, ``block`` and ``copies`` (how often the row is drawn) to every row.

    ``budget``: tokens to draw in all; None draws the largest source once, so that no source is
    drawn less than once. A null source is a source; a null count of tokens is zero; a source
    without tokens has weight 0 and no copies. Rows with the same id and source are drawn together. Ids
    order nothing but the permutation; an empty table gives an empty one. Columns of the input
    named like a new one are replaced.
    """
    docs = docs.drop("weight", "block", "copies").withColumn("_sq_tokens", F.coalesce(F.col(tokens_col), F.lit(0)).cast("long"))
    rows = docs.select(F.col(source_col).alias("_sq_source"), F.col(id_col).alias("_sq_id"), "_sq_tokens")
    totals = materialize(source_totals(rows, "_sq_source", "_sq_tokens"))
    exponent, top = solve_exponent(totals, entropy_share, max_repeats, budget)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(top["total"] or 1)), F.lit(exponent))).otherwise(0.0)
    sums = totals.agg(F.sum(power).alias("z"), F.max(power).alias("most")).first()
    weight = power / F.lit(sums.z or 1.0)
    drawn = budget if budget is not None else top["most"] * (sums.z or 1.0) / (sums.most or 1.0)
    quota = F.floor(weight * F.lit(float(drawn)) + 0.5)
    sources = materialize(
        totals.withColumn("weight", F.round(weight, 9))
        .withColumn("_sq_full", F.when(F.col("tokens") > 0, F.floor(quota / F.col("tokens"))).otherwise(0).cast("long"))
        .withColumn("_sq_rest", F.when(F.col("tokens") > 0, quota - F.col("_sq_full") * F.col("tokens")).otherwise(0).cast("long"))
        .withColumn("_sq_blocks", F.ceil(F.sqrt("n_docs")).cast("long"))
        .drop("tokens", "n_docs")
    )

    def blocked(df: DataFrame, source: Column, ident: Column, table: DataFrame) -> DataFrame:
        joined = df.join(table.withColumnRenamed("_sq_source", "_sq_s"), source.eqNullSafe(F.col("_sq_s")), "left").drop("_sq_s")
        own = F.conv(F.substring(_key(F.lit(seed), ident), 1, 8), 16, 10).cast("long")
        joined = joined.withColumn("block", own % F.col("_sq_blocks"))
        return joined.withColumn("_sq_key", _key(F.lit(seed), source, F.col("_sq_full") + 1, F.col("block"))).withColumn("_sq_own", _key(F.lit(seed), F.lit("row"), ident))

    placed = blocked(rows, F.col("_sq_source"), F.col("_sq_id"), sources)
    blocks = placed.groupBy("_sq_source", "block", "_sq_key").agg(F.sum("_sq_tokens").alias("n"), F.first("_sq_rest").alias("rest"))
    order = Window.partitionBy("_sq_source").orderBy("_sq_key")
    first_over = (
        blocks.withColumn("end", F.sum("n").over(order))
        .where("end > rest")
        .groupBy("_sq_source")
        .agg(F.min(F.struct("_sq_key", "block", (F.col("rest") - F.col("end") + F.col("n")).alias("left"))).alias("b"))
        .select("_sq_source", F.col("b._sq_key").alias("_sq_cut"), F.col("b.left").alias("_sq_left"))
    )
    sources = materialize(
        sources.join(first_over.withColumnRenamed("_sq_source", "_sq_s2"), F.col("_sq_source").eqNullSafe(F.col("_sq_s2")), "left").drop("_sq_s2")
    )
    inside = blocked(rows, F.col("_sq_source"), F.col("_sq_id"), sources).where("_sq_key = _sq_cut")
    in_order = Window.partitionBy("_sq_source").orderBy("_sq_own").rangeBetween(Window.unboundedPreceding, 0)
    last = (
        inside.withColumn("upto", F.sum("_sq_tokens").over(in_order))
        .where("upto <= _sq_left")
        .groupBy(F.col("_sq_source").alias("_sq_s3"))
        .agg(F.max("_sq_own").alias("_sq_last"))
    )
    sources = materialize(sources.join(last, F.col("_sq_source").eqNullSafe(F.col("_sq_s3")), "left").drop("_sq_s3"))
    out = blocked(docs, F.col(source_col), F.col(id_col), sources)
    partly = F.col("_sq_cut").isNull() | (F.col("_sq_key") < F.col("_sq_cut")) | ((F.col("_sq_key") == F.col("_sq_cut")) & (F.col("_sq_own") <= F.col("_sq_last")))
    copies = F.col("_sq_full") + F.when(F.coalesce(partly, F.lit(False)) & (F.col("_sq_rest") > 0), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("long")).drop(*[c for c in out.columns if c.startswith("_sq_")])


def draw(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of a mixture, each as often as it is drawn."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_sq_copy")).drop("_sq_copy")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("n_tokens")))
    total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    return mixture(counted, budget=float(total)).select("doc_id", "source", "n_tokens", "weight", "block", "copies")


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents
), t AS (
  SELECT source, sum(n_tokens)::DOUBLE AS tokens, count(*) AS n_docs FROM d GROUP BY source
), l AS (
  SELECT list(tokens / (SELECT sum(tokens) FROM t)) AS ps, count(*) AS n FROM t WHERE tokens > 0
), goal AS (
  SELECT ps, h + 0.5 * (ln(n) - h) AS target FROM (SELECT ps, n, -list_sum(list_transform(ps, lambda p: p * ln(p))) AS h FROM l)
), bis AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lh, 1.0::DOUBLE AS hh, 0.0::DOUBLE AS lr, 1.0::DOUBLE AS hr
  UNION ALL
  SELECT i + 1, CASE WHEN e >= target THEN (lh + hh) / 2 ELSE lh END, CASE WHEN e >= target THEN hh ELSE (lh + hh) / 2 END,
    CASE WHEN r > 4 THEN (lr + hr) / 2 ELSE lr END, CASE WHEN r > 4 THEN hr ELSE (lr + hr) / 2 END
  FROM (
    SELECT bis.*, target, ln(list_sum(list_transform(ps, lambda p: pow(p, (lh + hh) / 2))))
      - (lh + hh) / 2 * list_sum(list_transform(ps, lambda p: pow(p, (lh + hh) / 2) * ln(p))) / list_sum(list_transform(ps, lambda p: pow(p, (lh + hh) / 2))) AS e,
      list_max(list_transform(ps, lambda p: pow(p, (lr + hr) / 2 - 1))) / list_sum(list_transform(ps, lambda p: pow(p, (lr + hr) / 2))) AS r
    FROM bis, goal WHERE i < 40)
), a AS (
  SELECT round(greatest(CASE WHEN lh > 0 THEN hh ELSE 0 END, CASE WHEN lr > 0 THEN hr ELSE 0 END), 9) AS a FROM bis WHERE i = 40
), w AS (
  SELECT source, tokens, n_docs, CASE WHEN tokens > 0 THEN pow(tokens / (SELECT sum(tokens) FROM t), a) ELSE 0 END AS pw FROM t, a
), q AS (
  SELECT *, pw / (SELECT sum(pw) FROM w) AS weight, floor(pw / (SELECT sum(pw) FROM w) * (SELECT sum(tokens) FROM t) + 0.5) AS quota FROM w
), s AS (
  SELECT source, round(weight, 9) AS weight, CASE WHEN tokens > 0 THEN floor(quota / tokens) ELSE 0 END::BIGINT AS f,
    CASE WHEN tokens > 0 THEN quota - floor(quota / tokens) * tokens ELSE 0 END::BIGINT AS rest, ceil(sqrt(n_docs))::BIGINT AS nb FROM q
), p AS (
  SELECT d.*, weight, f, rest, ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '~')), 1, 8))::BIGINT % nb AS block,
    md5('mix|row|' || coalesce(doc_id::VARCHAR, '~')) AS own
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), k AS (
  SELECT *, md5('mix|' || coalesce(source, '~') || '|' || (f + 1) || '|' || block) AS key FROM p
), b AS (
  SELECT source, key, n, rest, sum(n) OVER (PARTITION BY source ORDER BY key) AS e
  FROM (SELECT source, key, sum(n_tokens) AS n, min(rest) AS rest FROM k GROUP BY source, key)
), cut AS (
  SELECT source, min(key) AS cut, min_by(rest - e + n, key) AS rem FROM b WHERE e > rest GROUP BY source
), inn AS (
  SELECT k.source, own, rem, sum(n_tokens) OVER (PARTITION BY k.source ORDER BY own) AS upto
  FROM k JOIN cut ON k.source IS NOT DISTINCT FROM cut.source AND key = cut
), lst AS (
  SELECT source, max(own) AS last FROM inn WHERE upto <= rem GROUP BY source
)
SELECT k.doc_id, k.source, n_tokens, weight, block,
  f + CASE WHEN rest > 0 AND (cut IS NULL OR key < cut OR (key = cut AND coalesce(own <= last, false))) THEN 1 ELSE 0 END AS copies
FROM k LEFT JOIN cut ON k.source IS NOT DISTINCT FROM cut.source LEFT JOIN lst ON k.source IS NOT DISTINCT FROM lst.source
"""
