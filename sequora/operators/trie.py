"""Prefix-trie aggregation without a tree: a node is a row with its path, an ancestor an array prefix.

``prefix_counts`` gives ``(path, depth, grp, cnt, term)``: sequences of a group through a path and
ending at it. ``prefix_nodes`` folds the groups into maps. All later operators take node tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import VOWELS
from ..functions.scratch import materialize
from .intervals import labelled


def parent(path: str | Column = "path") -> Column:
    """The path one token shorter; null for the root."""
    path = F.col(path) if isinstance(path, str) else path
    return F.when(F.size(path) > 0, F.slice(path, 1, F.size(path) - 1))


def label(path: str = "path") -> Column:
    """Tokens from the root, joined."""
    return F.array_join(path, "")


def prefix_counts(seqs: DataFrame, max_depth: int | None = None, skip_empty: bool = False) -> DataFrame:
    """Counts of every prefix by group. Equal sequences are summed before they are taken apart.

    An empty sequence ends at the root (``skip_empty``: is left out). ``max_depth`` bounds the
    paths and with them the rows that leave this step; ends below it are not seen.
    """
    n = F.col("n") if "n" in seqs.columns else F.lit(1)
    whole = seqs.groupBy("grp", "tokens").agg(F.sum(n).alias("n"))
    if skip_empty:
        whole = whole.where(F.size("tokens") > 0)
    return prefix_rows(whole, max_depth).groupBy("path", "depth", "grp").agg(F.sum("cnt").cast("long").alias("cnt"), F.sum("term").cast("long").alias("term"))


def prefix_rows(seqs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The prefixes of ``seqs(grp, tokens, n)``, one row for each sequence and depth: what ``prefix_counts`` sums."""
    size = F.size("tokens")
    deepest = size if max_depth is None else F.least(size, F.lit(max_depth))
    rows = seqs.select("grp", "tokens", "n", F.explode(F.sequence(F.lit(0), deepest)).alias("depth"))
    return rows.select(F.slice("tokens", 1, F.col("depth")).alias("path"), "depth", "grp", F.col("n").alias("cnt"), F.when(F.col("depth") == size, F.col("n")).otherwise(0).alias("term"))


def prefix_nodes(counts: DataFrame) -> DataFrame:
    """One row per path: token, total, terminal, and both counts by group as maps."""
    entry = lambda c: F.map_from_entries(F.filter(F.array_sort(F.collect_list(F.struct("grp", c))), lambda x: x[c] > 0))
    return (
        counts.groupBy("path", "depth")
        .agg(F.sum("cnt").alias("total"), F.sum("term").alias("terminal"), entry("cnt").alias("counts"), entry("term").alias("terminal_counts"))
        .withColumn("token", F.when(F.col("depth") > 0, F.element_at("path", -1)))
    )


def prune(nodes: DataFrame, min_count: int) -> DataFrame:
    """Drop nodes below ``min_count``; the root stays.

    A child's total never exceeds its parent's, so a filter drops whole subtrees.
    """
    return nodes if min_count <= 1 else nodes.where((F.col("total") >= min_count) | (F.col("depth") == 0))


def _children(nodes: DataFrame) -> DataFrame:
    return nodes.where("depth > 0").withColumn("_p", parent())


def with_child_count(nodes: DataFrame) -> DataFrame:
    """Add ``child_count`` and ``is_terminal``."""
    kids = _children(nodes).groupBy("_p").agg(F.count("*").alias("child_count"))
    return nodes.join(kids, nodes["path"] == kids["_p"], "left").drop("_p").withColumns(
        {"child_count": F.coalesce("child_count", F.lit(0)).cast("long"), "is_terminal": F.col("terminal") > 0}
    )


def node_ids(nodes: DataFrame, order: str = "preorder") -> DataFrame:
    """Add ``node_id``, from 0 at the root: depth-first over ordered children, or ``bfs`` by depth and path.

    Rows are range-partitioned and sorted, and each partition's offset is the size of those before
    it; no task sees more than its partition.
    """
    keys = ["path"] if order == "preorder" else ["depth", "path"]
    nodes = materialize(nodes)  # ranges are found by a job of their own, which would make the nodes a second time
    sorted_rows = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(sorted_rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("size"), F.min("_at").alias("first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("_part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), "first")
    return placed.join(F.broadcast(offsets), "_part").withColumn("node_id", F.col("offset") + F.col("_at") - F.col("first")).drop("_part", "_at", "offset", "first")


def edges(nodes: DataFrame) -> DataFrame:
    """``(source, target, token)``: each node but the root below its parent, both present."""
    kids = _children(nodes).select(F.col("_p").alias("source"), F.col("path").alias("target"), "token")
    return kids.join(nodes.select(F.col("path").alias("source")), "source")


def transition_probs(nodes: DataFrame, digits: int | None = None) -> DataFrame:
    """Add to each child ``source`` (its parent) and ``p``, its share of its siblings' totals."""
    kids = _children(nodes).withColumnRenamed("_p", "source")
    sums = kids.groupBy("source").agg(F.sum("total").alias("_all"))
    p = F.col("total") / F.col("_all")
    return kids.join(sums, "source").withColumn("p", p if digits is None else F.round(p, digits)).drop("_all")


def entropy(nodes: DataFrame) -> DataFrame:
    """Per node with children: ``branch`` (how many) and ``entropy`` in bits, 0 for one child."""
    # sum(-p log2 p) = log2(T) - sum(t log2 t) / T: one combinable aggregate, no join
    t = F.col("total").cast("double")
    return (
        _children(nodes).groupBy(F.col("_p").alias("path")).agg(F.count("*").alias("branch"), F.sum(t).alias("_t"), F.sum(t * F.log2(t)).alias("_s"))
        .withColumn("entropy", F.when(F.col("branch") > 1, F.log2("_t") - F.col("_s") / F.col("_t")).otherwise(0.0)).drop("_t", "_s")
    )


def incoming_prob(nodes: DataFrame, probs: DataFrame) -> DataFrame:
    """Add ``p_in``: 1 at the root; ``p`` of ``probs(source, target, p)``; 0.5 if the parent has none there, 0.05 if only the entry is missing."""
    some = probs.select(F.col("source").alias("_s")).distinct()
    own = probs.select(F.col("target").alias("_t"), "p")
    rows = nodes.withColumn("_p", parent())
    joined = rows.join(some, F.col("_p") == F.col("_s"), "left").join(own, F.col("path") == F.col("_t"), "left")
    p = F.when(F.col("depth") == 0, 1.0).when(F.col("_s").isNull(), 0.5).otherwise(F.coalesce("p", F.lit(0.05)))
    return joined.withColumn("p_in", p).drop("_p", "_s", "_t", "p")


def subtree_weights(nodes: DataFrame, mode: str = "default") -> DataFrame:
    """Add ``weight``: totals summed over the subtree (``legacy``: at least 1 a node)."""
    own = F.col("total") if mode == "default" else F.greatest("total", F.lit(1))
    return labelled(nodes, weight=own).drop("enter", "leave", "leaves")


def leaf_counts(nodes: DataFrame) -> DataFrame:
    """Add ``leaves``: nodes without children in the subtree (a leaf has itself)."""
    return labelled(nodes).drop("enter", "leave")


def is_vowel(token: Column, vowels: str = VOWELS) -> Column:
    return F.coalesce(F.substring(token, 1, 1).isin(*vowels), F.lit(False))


def roles(nodes: DataFrame, vowels: str = VOWELS, mode: str = "default") -> DataFrame:
    """Add ``role`` (onset, nucleus, coda, mixed) and its first letter ``role_code``.

    ``default``: the root is mixed, vowels are nuclei, else depth 1 is onset, an end is coda.
    ``legacy`` looks for vowels above and right below instead of ends.
    """
    vowel = is_vowel(F.col("token"), vowels)
    if mode == "default":
        role = F.when(F.col("depth") == 0, "mixed").when(vowel, "nucleus").when(F.col("depth") <= 1, "onset").when(F.col("terminal") > 0, "coda").otherwise("mixed")
        out = nodes.withColumn("role", role)
    else:
        kids = _children(nodes).groupBy("_p").agg(F.max(vowel).alias("_below"))
        above = F.exists(F.slice("path", 1, F.greatest(F.col("depth") - 1, F.lit(0))), lambda t: is_vowel(t, vowels))
        below = F.coalesce("_below", F.lit(False))
        role = (
            F.when(F.col("depth") == 0, "mixed").when(vowel, "nucleus").when(F.col("depth") == 1, "onset")
            .when(~above & below, "onset").when(above & ~below, "coda").when(above & below, "mixed")
            .when(F.col("depth") <= 3, "onset").otherwise("coda")
        )
        out = nodes.join(kids, nodes["path"] == kids["_p"], "left").withColumn("role", role).drop("_p", "_below")
    return out.withColumn("role_code", F.substring("role", 1, 1))


def sample_words(seqs: DataFrame, k: int = 5) -> DataFrame:
    """``(path, grp, words)``: the ``k`` smallest distinct keys that end at each path.

    The rank bounds what is collected.
    """
    words = seqs.select(F.col("tokens").alias("path"), "grp", F.col("key").alias("word")).distinct()
    rank = F.row_number().over(Window.partitionBy("path", "grp").orderBy("word"))
    top = words.withColumn("_k", rank).where(F.col("_k") <= k)
    return top.groupBy("path", "grp").agg(F.array_sort(F.collect_list("word")).alias("words"))


def variants(aligned: DataFrame) -> DataFrame:
    """``(path, variants)``: surface tokens that became the node's token, without the token itself, sorted.

    ``aligned`` has ``norm`` and ``surface`` arrays of one length; only nodes with a variant are returned.
    """
    i = F.explode(F.sequence(F.lit(1), F.size("norm")))
    rows = aligned.where(F.size("norm") > 0).select("norm", "surface", i.alias("i"))
    rows = rows.select(F.slice("norm", 1, F.col("i")).alias("path"), F.element_at("norm", F.col("i")).alias("t"), F.element_at("surface", F.col("i")).alias("s"))
    rows = rows.where("s <> t").distinct()
    return rows.groupBy("path").agg(F.array_sort(F.collect_set("s")).alias("variants"))


def depth_stats(nodes: DataFrame, digits: int = 6) -> DataFrame:
    """Per depth: nodes, terminals, and branching and entropy of the nodes with children (0 if there are none)."""
    at = nodes.join(entropy(nodes), "path", "left")
    zero = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), digits).alias(name)
    return at.groupBy("depth").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("terminal") > 0).alias("terminals"),
        zero(F.avg("branch"), "avg_branch"), zero(F.avg("entropy"), "avg_entropy"), zero(F.max("entropy"), "max_entropy"),
    )


def group_depth_stats(counts: DataFrame, digits: int = 6) -> DataFrame:
    """Depth statistics per group from ``(path, depth, grp, cnt, term)``, with that group's counts only.

    For a shared pruned trie, pass the counts of its nodes (``shared_counts``); for separate
    tries, those of ``prefix_counts``. Depths without nodes have no row.
    """
    rows = counts.where("cnt > 0")
    t = F.col("cnt").cast("double")
    ent = (
        rows.where("depth > 0").groupBy("grp", parent().alias("path"))
        .agg(F.count("*").alias("branch"), F.sum(t).alias("_t"), F.sum(t * F.log2(t)).alias("_s"))
        .withColumn("entropy", F.when(F.col("branch") > 1, F.log2("_t") - F.col("_s") / F.col("_t")).otherwise(0.0))
    )
    zero = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), digits).alias(name)
    return rows.join(ent, ["grp", "path"], "left").groupBy("grp", "depth").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("term") > 0).alias("terminals"),
        zero(F.avg("branch"), "avg_branch"), zero(F.avg("entropy"), "avg_entropy"), zero(F.max("entropy"), "max_entropy"),
    )


def shared_counts(nodes: DataFrame) -> DataFrame:
    """The counts by group of a node table, as rows again."""
    rows = nodes.select("path", "depth", "terminal_counts", F.explode("counts").alias("grp", "cnt"))
    return rows.select("path", "depth", "grp", "cnt", F.coalesce(F.element_at("terminal_counts", F.col("grp")), F.lit(0)).cast("long").alias("term"))


def inventories(nodes_with_roles: DataFrame, mode: str = "default", vowels: str = VOWELS) -> DataFrame:
    """``(kind, token)``: all tokens, those of onsets and those of codas.

    ``legacy``: tokens at depth 1; of these the consonants; consonants that end a sequence.
    """
    rows = nodes_with_roles.where("depth > 0")
    consonant = ~is_vowel(F.col("token"), vowels)
    if mode == "default":
        parts = {"all": rows, "onset": rows.where("role = 'onset'"), "coda": rows.where("role = 'coda'")}
    else:
        first = rows.where("depth = 1")
        parts = {"initial": first, "onset": first.where(consonant), "coda": rows.where(consonant & (F.col("terminal") > 0))}
    out = None
    for kind, part in parts.items():
        part = part.select(F.lit(kind).alias("kind"), "token").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def metadata(nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, depth, sequences, ends, and how many groups there are."""
    groups = nodes.where("depth = 0").select(F.size("counts").alias("languages"))
    return nodes.agg(
        F.count("*").alias("node_count"), F.count_if(F.col("depth") > 0).alias("edge_count"), F.max("depth").alias("max_depth"),
        F.sum("terminal").alias("total_words"), F.count_if(F.col("terminal") > 0).alias("terminal_nodes"),
    ).join(groups)


def metadata_lists(nodes: DataFrame, inventories: DataFrame) -> DataFrame:
    """One row: ``languages`` (groups that the root counts, sorted) and a sorted list of tokens for each kind of ``inventories(kind, token)``: all, onset, coda.

    Groups and inventories are small sets by nature.
    """
    groups = nodes.where("depth = 0").select(F.array_sort(F.map_keys("counts")).alias("languages"))
    lists = inventories.groupBy().agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("token")))).alias(f"{k}_tokens") for k in ("all", "onset", "coda")])
    return groups.join(lists)


def variant_nodes(nodes: DataFrame, variants: DataFrame) -> DataFrame:
    """Nodes with surface variants per depth: ``(depth, nodes, with_variants)``. ``variants(path, variants)`` as above."""
    marked = nodes.join(variants.select("path", F.lit(True).alias("_v")), "path", "left")
    return marked.groupBy("depth").agg(F.count("*").alias("nodes"), F.count_if(F.coalesce("_v", F.lit(False))).alias("with_variants"))


def limited_summary(nodes: DataFrame, max_depth: int) -> DataFrame:
    """One row: kept nodes, edges and sequences up to ``max_depth``, beside the figures of the whole trie."""
    near = F.col("depth") <= max_depth
    return nodes.agg(
        F.count_if(near).alias("kept_nodes"), F.count_if(near & (F.col("depth") > 0)).alias("kept_edges"),
        F.sum(F.when(near, F.col("terminal")).otherwise(0)).alias("total_words"), F.count("*").alias("total_nodes"),
        F.count_if(F.col("terminal") > 0).alias("terminal_nodes"), F.max("depth").alias("max_depth"),
    )


def sharing_saving(seqs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: tokens plus words of the distinct keys stored apart, nodes of the trie, and what it saves."""
    naive = seqs.select("tokens").distinct().agg((F.sum(F.size("tokens")) + F.count("*")).cast("long").alias("naive"))
    return naive.join(nodes.agg(F.count("*").alias("nodes"))).withColumn("saved", F.col("naive") - F.col("nodes"))


def role_distribution(nodes_with_roles: DataFrame) -> DataFrame:
    """Nodes per role and depth, and per role alone (``depth`` null)."""
    return nodes_with_roles.groupBy("role", "depth").count().unionByName(
        nodes_with_roles.groupBy("role").count().select("role", F.lit(None).cast("int").alias("depth"), "count")
    ).withColumnRenamed("count", "nodes")
