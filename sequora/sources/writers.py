"""Writers: idempotent reloads, inserts of what is absent, replacement by key, resuming, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store

ROWS = "rows"  # the table of a store that has only one


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that the functions below write, as its last version has them."""
    rows = Store(spark, path).read(ROWS)
    if rows is None:
        raise FileNotFoundError(f"nothing was written to {path} yet")
    return rows


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace the partitions that ``df`` has rows for and no others (facts of a group, reports and motifs of a size), all at once."""
    Store(df.sparkSession, path).replace(ROWS, df, keys)


def reload_groups(df: DataFrame, path: str, key: str, groups: list[str]) -> None:
    """Replace the rows of ``groups`` by those that ``df`` has for them; a group without new rows is emptied. Readers see all of it or nothing."""
    Store(df.sparkSession, path).replace(ROWS, df.where(F.col(key).isin(groups)), [key], [{key: g} for g in groups])


def insert_absent(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose key the table doesn't have yet, each key once, whoever else inserts; null is a key like any other."""
    Store(df.sparkSession, path).insert_absent(ROWS, df, keys)


def append_outcomes(df: DataFrame, path: str, batch: str) -> None:
    """Add outcomes of some (experiment, size) pairs, all or none. ``batch`` names them, so that a retry adds nothing twice."""
    Store(df.sparkSession, path).append(ROWS, df, ["experiment", "size"], batch)


def to_do(sizes: DataFrame, reports: DataFrame) -> DataFrame:
    """The (experiment, size) pairs without a report."""
    return sizes.join(reports, ["experiment", "size"], "left_anti")


def seen_outcomes(outcomes: DataFrame) -> DataFrame:
    """Distinct outcomes that are stored, to seed what counts as already seen."""
    return outcomes.where("status = 'normal'").select("experiment", "outcome").distinct()


def _without_empty(df: DataFrame) -> DataFrame:
    kinds = ("map", "array")
    return df.select(*[F.when(F.size(c) > 0, F.col(c)).alias(c) if t.startswith(kinds) else F.col(c) for c, t in df.dtypes])


def export_trie(nodes: DataFrame, edges: DataFrame, metadata: DataFrame, path: str) -> None:
    """Nodes, edges and metadata as JSON lines; empty maps and lists and nulls are left out."""
    for name, part in (("nodes", nodes), ("edges", edges), ("metadata", metadata)):
        _without_empty(part).write.mode("overwrite").json(f"{path}/{name}")


def compact_nodes(nodes: DataFrame, max_depth: int, transitions: int = 5, words: int = 5) -> DataFrame:
    """Nodes up to a depth with the role's letter, the likeliest transitions and at most five words.

    ``nodes`` has ``role_code``, ``transition_probs MAP`` and ``words ARRAY``.
    """
    best = F.array_sort(F.transform(F.map_entries("transition_probs"), lambda x: F.struct((-x["value"]).alias("p"), x["key"].alias("token"))))
    top = F.transform(F.slice(best, 1, transitions), lambda x: F.struct(x["token"].alias("token"), (-x["p"]).alias("p")))
    return nodes.where(F.col("depth") <= max_depth).select("path", "depth", "total", "role_code", top.alias("transitions"), F.slice("words", 1, words).alias("words"))


def export_compact(nodes: DataFrame, path: str, max_depth: int) -> None:
    _without_empty(compact_nodes(nodes, max_depth)).write.mode("overwrite").json(path)


def nested_stats(stats: DataFrame) -> DataFrame:
    """One row a group with its depth statistics as an array; a group has as many as its depths."""
    fields = [c for c in stats.columns if c not in ("grp", "depth")]
    return stats.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("depth", *fields))).alias("stats"))


def export_stats(stats: DataFrame, path: str) -> None:
    nested_stats(stats).write.mode("overwrite").json(path)


def export_report(reports: DataFrame, path: str, by: str | None = None) -> None:
    """Reports as CSV with the columns size, total, distinct, ratio, divergent, explosive, motifs, avg, max; a folder for each value of ``by``."""
    names = {"size": "size", "total": "total", "distinct_outcomes": "distinct", "ratio": "ratio", "divergent": "divergent", "explosive": "explosive", "new_motifs": "motifs", "avg_steps": "avg", "max_steps": "max"}
    out = reports.select(*[F.col(a).alias(b) for a, b in names.items()], *[by] * (by is not None)).write.mode("overwrite")
    (out.partitionBy(by) if by else out).csv(path, header=True)
