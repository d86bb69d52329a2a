"""Comparisons across groups over depth statistics, and display tables over nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import FAMILY_ORDER
from .trie import _children, entropy, transition_probs, with_child_count


def group_figures(stats: DataFrame) -> DataFrame:
    """Per group: peak shell (the first of equals), convergence depth, totals, peaks, and mean entropy over depths."""
    return stats.groupBy("grp").agg(
        F.max_by("depth", F.struct("nodes", -F.col("depth"))).alias("peak_depth"), F.max("nodes").alias("peak_nodes"),
        F.min(F.when((F.col("depth") > 1) & (F.col("avg_branch") < 2), F.col("depth"))).alias("convergence_depth"),
        F.sum("nodes").alias("nodes"), F.sum("terminals").alias("terminals"), F.max("depth").alias("max_depth"),
        F.max("avg_branch").alias("peak_branch"), F.round(F.avg("avg_entropy"), 6).alias("mean_entropy"),
    )


def family_sections(figures: DataFrame, groups: DataFrame, order: list[str] = FAMILY_ORDER) -> DataFrame:
    """Per family: its place in the fixed order (unknown ones last) and its groups, sorted."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("family"))
    rows = figures.join(groups.withColumnRenamed("code", "grp"), "grp")
    return rows.groupBy("family").agg(F.array_join(F.array_sort(F.collect_set("grp")), ",").alias("groups"), F.sum("nodes").alias("nodes")).withColumn(
        "place", F.when(place > 0, place).otherwise(len(order) + 1).cast("int")
    )


def shell_dimension(stats: DataFrame, deepest: int = 14) -> DataFrame:
    """log2(nodes) per group and depth 1 to ``deepest``; missing depths repeat the last value, which starts at 0."""
    grid = stats.select("grp").distinct().select("grp", F.explode(F.sequence(F.lit(1), F.lit(deepest))).alias("depth"))
    rows = grid.join(stats.select("grp", "depth", F.log2(F.col("nodes").cast("double")).alias("v")), ["grp", "depth"], "left")
    last = F.last("v", ignorenulls=True).over(Window.partitionBy("grp").orderBy("depth"))
    return rows.select("grp", "depth", F.round(F.coalesce(last, F.lit(0.0)), 6).alias("dimension"))


def shell_stats(nodes: DataFrame, cluster_col: str) -> DataFrame:
    """Per depth: nodes, ends, ratio to the shell before, distinct clusters among ends, log2(nodes)."""
    ends = F.col("terminal") > 0
    per = nodes.groupBy("depth").agg(F.count("*").alias("nodes"), F.count_if(ends).alias("words"), F.count_distinct(F.when(ends, F.col(cluster_col))).alias("clusters"))
    before = F.lag("nodes").over(Window.orderBy("depth"))  # one row a depth
    return per.withColumns({"ratio": F.round(F.coalesce(F.col("nodes") / before, F.lit(0.0)), 6), "entropy": F.round(F.log2(F.col("nodes").cast("double")), 6)})


def chart_slice(stats: DataFrame, deepest: int = 30) -> DataFrame:
    return stats.where(F.col("depth").between(1, deepest))


def feature_chart(tokens: DataFrame, features: DataFrame, row: str = "manner", col: str = "place") -> DataFrame:
    """Per cell of the chart: the inventory's tokens and their frequency. ``tokens(token, freq)``."""
    hits = features.join(tokens, "token", "left")
    return hits.groupBy(row, col).agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("freq").isNotNull(), F.col("token")))), ",").alias("tokens"),
        F.coalesce(F.sum("freq"), F.lit(0)).cast("long").alias("freq"),
    )


def feature_pivot(chart: DataFrame, columns: list[str], row: str = "manner", col: str = "place") -> DataFrame:
    """The same chart with one column a place."""
    return chart.groupBy(row).pivot(col, columns).agg(F.first("tokens"))


def token_class(inventories: DataFrame, vowels: DataFrame) -> DataFrame:
    """Token → nucleus if a vowel, coda if in the coda and not the onset inventory, else onset."""
    flag = lambda kind: F.max(F.when(F.col("kind") == kind, 1).otherwise(0)) == 1
    rows = inventories.groupBy("token").agg(flag("onset").alias("on"), flag("coda").alias("co"))
    rows = rows.join(vowels.select("token", F.lit(True).alias("v")), "token", "left")
    return rows.select("token", F.when(F.col("v"), "nucleus").when(F.col("co") & ~F.col("on"), "coda").otherwise("onset").alias("class"))


def hubs(nodes: DataFrame, k: int = 80, min_entropy: float = 2.5, min_children: int = 5, motif_paths: DataFrame | None = None) -> DataFrame:
    """The ``k`` nodes to label first: ends, and hubs (entropy over 2.5, five children or more), by priority."""
    at = nodes.where("depth > 0").join(entropy(nodes), "path", "left")
    hub = (F.col("entropy") > min_entropy) & (F.col("branch") >= min_children)
    priority = F.when(F.col("terminal") > 0, F.lit(1_000_000) + F.col("total")).when(hub, F.lit(500_000) + F.col("total"))
    if motif_paths is not None:
        at = at.join(motif_paths.select("path", F.lit(True).alias("_m")), "path", "left")
        priority = priority + F.when(F.col("_m"), 100_000).otherwise(0)
    return at.withColumn("priority", priority).where("priority IS NOT NULL").select(F.array_join("path", "").alias("label"), "path", "depth", "total", "priority").orderBy(F.desc("priority"), "label").limit(k)


def node_words(sample_words: DataFrame, path: list[str]) -> DataFrame:
    """``(grp, words)``: the sample words of one node by group, of ``sample_words(path, grp, words)``, joined as text."""
    here = F.array(*map(F.lit, path)) if path else F.array().cast("array<string>")
    return sample_words.where(F.col("path") == here).select("grp", F.array_join("words", ",").alias("words"))


def node_detail(nodes: DataFrame, path: list[str], k_transitions: int = 12, k_children: int = 30) -> DataFrame:
    """One node: its totals by group, number of children, likeliest transitions with their shares, and first children, joined as text.

    Only the node and its children are read, and a node's children are bounded by the inventory.
    """
    here = F.array(*map(F.lit, path)) if path else F.array().cast("array<string>")
    by_group = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    own = nodes.where(F.col("path") == here).select(F.array_join("path", "").alias("label"), "total", "terminal", by_group("counts").alias("by_group"), by_group("terminal_counts").alias("ends_by_group"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("t"), "token", "p"))), 1, k_transitions)
    kids = transition_probs(_children(nodes).where(F.col("_p") == here).drop("_p"))
    return own.join(
        kids.agg(
            F.count("*").alias("n_children"),
            F.array_join(F.transform(top, lambda x: x["token"]), ",").alias("transitions"),
            F.array_join(F.transform(top, lambda x: F.format_number(100 * x["p"], 2)), ",").alias("shares"),
            F.array_join(F.slice(F.array_sort(F.collect_list("token")), 1, k_children), ",").alias("children"),
        )
    )


def merged_edges(pages: list[DataFrame]) -> DataFrame:
    """Pages of edges in one table, each (source, target) once."""
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out.dropDuplicates(["source", "target"])


def merged_nodes(pages: list[DataFrame], key: str = "path") -> DataFrame:
    """Pages of nodes in one table; the last page with a key wins."""
    out = None
    for i, page in enumerate(pages):
        page = page.withColumn("_page", F.lit(i))
        out = page if out is None else out.unionByName(page)
    columns = [c for c in out.columns if c not in (key, "_page")]
    return out.groupBy(key).agg(F.max_by(F.struct(*columns), "_page").alias("_r")).select(key, "_r.*")


def convergence(nodes: DataFrame) -> DataFrame:
    """Nodes with one child a depth: how far paths no longer branch."""
    return with_child_count(nodes).groupBy("depth").agg(F.count_if(F.col("child_count") == 1).alias("single"), F.count("*").alias("nodes"))
