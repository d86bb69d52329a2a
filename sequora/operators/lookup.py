"""Lookups over stored node tables, statistics and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trie import _children, parent


def valid_facts(checked: DataFrame, grp: str) -> DataFrame:
    """Keys and tokens of the valid sequences of one group, by key; a partitioned table reads that group only."""
    return checked.where(F.col("valid") & (F.col("grp") == grp)).select("key", "tokens").orderBy("key")


def select_groups(df: DataFrame, wanted: str, groups: DataFrame) -> DataFrame:
    """Rows of the groups of a comma list (``all``: of every known group); unknown codes are dropped."""
    known = groups.select(F.col("code").alias("grp"))
    if wanted.strip() != "all":
        known = known.where(F.col("grp").isin([x.strip() for x in wanted.split(",")]))
    return df.join(known, "grp", "left_semi")


def node_by_id(nodes: DataFrame, node_id: int) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id)


def nodes_by_depth(nodes: DataFrame, low: int, high: int, offset: int = 0, limit: int = 5000) -> DataFrame:
    """A page of nodes in a depth range, by depth and path, with ``total_count`` and ``has_more``.

    A negative offset counts as 0, a limit under 1 as 1. The count is a one-row aggregate.
    """
    offset, limit = max(offset, 0), max(limit, 1)
    rows = nodes.where(F.col("depth").between(low, high))
    page = rows.orderBy("depth", "path").offset(offset).limit(limit)
    return page.join(rows.agg(F.count("*").alias("total_count"))).withColumn("has_more", F.col("total_count") > offset + limit)


def children_of(nodes: DataFrame, path: list[str]) -> DataFrame:
    """Children of a node in sibling order; ValueError if the node isn't there."""
    here = F.array(*map(F.lit, path)) if path else F.array().cast("array<string>")
    if nodes.where(F.col("path") == here).isEmpty():
        raise ValueError(f"no node at {path}")
    return nodes.where((F.col("depth") == len(path) + 1) & (parent() == here)).orderBy("path")


def with_parent(nodes: DataFrame) -> DataFrame:
    """Each node but the root with its parent's total."""
    up = nodes.select(F.col("path").alias("parent_path"), F.col("total").alias("parent_total"))
    return _children(nodes).withColumnRenamed("_p", "parent_path").join(up, "parent_path")


def edges_by_depth(edges: DataFrame, low: int, high: int) -> DataFrame:
    """Edges with both ends in a depth range."""
    return edges.where(F.size("target").between(low + 1, high))


def search(nodes: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Nodes whose token is ``text``; only if there are none, those whose token contains it. With ``total_matches`` after the limit."""
    rows = nodes.where("depth > 0")
    exact = rows.where(F.col("token") == text)
    none = exact.agg((F.count("*") == 0).alias("_none"))
    loose = rows.where(F.contains("token", F.lit(text))).join(none).where("_none").drop("_none")
    found = exact.unionByName(loose).orderBy("token", "path").limit(max(limit, 1))
    return found.join(found.agg(F.count("*").alias("total_matches")))


def visible(nodes_with_roles: DataFrame, max_depth: int, terminals_only: bool = False, roles: list[str] | None = None, min_freq: int = 1) -> DataFrame:
    """Nodes that pass the display filter; the root never does."""
    c = F.col
    rows = nodes_with_roles.where((c("depth") > 0) & (c("depth") <= max_depth) & (c("total") >= min_freq) & (c("total") != 0))
    if terminals_only:
        rows = rows.where("terminal > 0")
    return rows.where(c("role").isin(roles)) if roles else rows


def present_groups(groups: DataFrame, facts: DataFrame) -> DataFrame:
    """Groups of the dimension that the data have."""
    return groups.join(facts.select(F.col("grp").alias("code")).distinct(), "code", "left_semi")


def stats_of(stats: DataFrame, wanted: list[str] | None) -> DataFrame:
    return stats.where(F.col("grp").isin(wanted)) if wanted else stats


def ad_hoc(tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """Run SQL over result tables, named in the statement. The names go again once the statement is resolved; a view of the session with such a name goes too."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(sql)
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
