"""Quality rules per document and verdicts per host, with DataFrame functions only.

Each document's counts are computed inside its row. Failures are then summed by host (the
``source`` column), the failure rate of each host is shrunk towards the corpus by a beta prior
fitted to all hosts, and the host's verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize

WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: Column, width: int = 8) -> Column:
    """Words inside windows of ``width`` words that occur twice or more, each word counted once."""
    starts = F.sequence(F.lit(1), F.size(words) - (width - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, width)))

    def covered(windows: Column) -> Column:
        same = lambda x, k: F.coalesce(x["w"] == F.get(windows, k)["w"], F.lit(False))
        twice = F.filter(windows, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return let(
            F.array_sort(F.transform(twice, lambda x: x["i"])),
            lambda at: F.aggregate(
                F.transform(at, lambda i, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - i, F.lit(width)))),
                F.lit(0).cast("long"),
                lambda total, n: total + n,
            ),
        )

    # Equal windows have equal hashes, so the strings are compared only where two hashes agree.
    exact = let(
        F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, width), " ").alias("w"), i.alias("i")))),
        covered,
    )
    repeated = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) > width, F.when(repeated, exact).otherwise(F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))


def rule_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the five counts, ``n_lines`` and ``n_upper`` of each text; null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(
        text,
        lambda t: F.struct(
            let(
                F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
                lambda w: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                    repeat_words(w).alias("n_repeat_words"),
                ),
            ).alias("w"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        ),
    )
    per_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    got = docs.withColumns({"_sq_c": counts, "_sq_l": per_line})
    return got.withColumns(
        {
            "n_words": F.col("_sq_c.w.n_words"),
            "word_chars": F.col("_sq_c.w.word_chars"),
            "n_symbols": F.col("_sq_c.n_symbols"),
            "n_dup_lines": F.col("_sq_l.dup"),
            "n_repeat_words": F.col("_sq_c.w.n_repeat_words"),
            "n_lines": F.col("_sq_l.n"),
            "n_upper": F.col("_sq_c.n_upper"),
        }
    ).drop("_sq_c", "_sq_l")


def rule_failures(counted: DataFrame) -> DataFrame:
    """Add ``base_failed`` and ``n_failed``: the rules a document fails, the base counted as one.

    Beside the base: more than one symbol in ten words, more than half of the lines repeated,
    more than half of the characters of words upper-case A-Z.
    """
    c = F.col
    base = (c("n_words") < 20) | (100 * c("n_repeat_words") > 30 * c("n_words"))
    more = [10 * c("n_symbols") > c("n_words"), 2 * c("n_dup_lines") > c("n_lines"), 2 * c("n_upper") > c("word_chars")]
    return counted.withColumn("base_failed", base).withColumn("n_failed", sum((x.cast("int") for x in more), base.cast("int")))


def host_verdicts(failures: DataFrame, host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """One row per host (null is a host): ``n_docs``, ``n_bad``, ``host_rate``, ``host_failed``.

    The prior's mean is the corpus rate; its strength follows from how much the hosts' rates vary
    beyond what their sizes explain. ``host_rate`` is the posterior mean, rounded to 6 places.
    """
    hosts = materialize(
        failures.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n_docs"), F.sum((F.col("n_failed") > 0).cast("long")).alias("n_bad"))
    )
    rate = F.col("n_bad") / F.col("n_docs")
    s = hosts.agg(F.count("*").alias("k"), F.sum("n_docs").alias("n"), F.sum("n_bad").alias("bad"), F.sum(rate * F.col("n_bad")).alias("sq")).first()
    n, mean = s.n or 0, (s.bad or 0) / max(s.n or 0, 1)
    noise, within = mean * (1 - mean), 1.0
    if noise > 0 and n > s.k:
        within = (s.sq / n - mean * mean - noise * s.k / n) / (noise * (1 - s.k / n))
    within = min(max(within, 1e-6), 1.0)
    strength = 1 / within - 1
    return hosts.withColumn("host_rate", F.round((F.col("n_bad") + mean * strength) / (F.col("n_docs") + strength), 6)).withColumn(
        "host_failed", F.col("host_rate") > max_rate
    )


def apply_quality_rules(failures: DataFrame, host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Add ``host_rate``, ``host_failed`` and ``kept`` to a table with rule failures.

    A document is kept if it fails no rule and its host is not rejected. All rows stay, repeated
    ones too; a null host is a host of its own; an empty table gives an empty one.
    """
    hosts = materialize(host_verdicts(failures, host_col, max_rate)).select(F.col("host").alias("_sq_host"), "host_rate", "host_failed")
    rest = failures.drop("host_rate", "host_failed", "kept")
    return (
        rest.join(hosts, rest[host_col].eqNullSafe(hosts["_sq_host"]), "left")
        .drop("_sq_host")
        .withColumn("kept", (F.col("n_failed") == 0) & ~F.col("host_failed"))
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    failures = materialize(rule_failures(rule_counts(docs)).drop("text"))
    return apply_quality_rules(failures).select("doc_id", *COUNTS, "base_failed", "kept", "n_failed", "host_rate", "host_failed")


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), win AS (
  SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT rid, count(DISTINCT i + j) AS n FROM rep, range(0, 8) AS r(j) GROUP BY rid
), ln AS (
  SELECT rid, l FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), dl AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM ln GROUP BY rid
), c AS (
  SELECT d.rid, doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper
  FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN dl USING (rid)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    (CASE WHEN n_words < 20 OR 100 * n_repeat_words > 30 * n_words THEN 1 ELSE 0 END
     + CASE WHEN 10 * n_symbols > n_words THEN 1 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 1 ELSE 0 END
     + CASE WHEN 2 * n_upper > word_chars THEN 1 ELSE 0 END)::INTEGER AS n_failed
  FROM c
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (n_failed > 0) AS bad FROM f GROUP BY source
), s AS (
  SELECT count(*) AS k, sum(n) AS n, sum(bad) / sum(n) AS m, sum(bad::DOUBLE / n * bad) AS sq FROM h
), p AS (
  SELECT m, 1 / least(1.0::DOUBLE, greatest(1e-6::DOUBLE, CASE WHEN m * (1 - m) > 0 AND n > k
    THEN (sq / n - m * m - m * (1 - m) * k / n) / (m * (1 - m) * (1 - k / n)) ELSE 1 END)) - 1 AS strength FROM s
), v AS (
  SELECT source, round((bad + m * strength) / (n + strength), 6) AS host_rate FROM h, p
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  n_failed = 0 AND NOT host_rate > 0.5 AS kept, n_failed, host_rate, host_rate > 0.5 AS host_failed
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
