"""Prefixes of long sequences by keys of fixed size, from arrays or straight from ordered rows.

A prefix is keyed by its depth and two sums (exclusive or) of 64-bit hashes of (place, token); the parent's key is the same without the last
token, so a row a token is enough, and a sequence of L tokens costs L rows of one size instead of L arrays. Nodes are grouped by key, parent's
key, token and depth: two paths are one node only if they agree in all of these, and ``collisions`` finds keys that stand for more than one.

Ordered rows (events of a user) are never gathered: they are range-partitioned by key and order, and each partition takes over from those
before it where its first key began, one row a partition. A key with a third of all rows is as many tasks as its rows need.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import materialize

NODE = ["k1", "k2", "p1", "p2", "depth", "token"]


def _keys(rows: DataFrame) -> DataFrame:
    """Add the keys of a prefix and its parent to rows with ``pos``, ``token``, their hashes and running sums ``s1`` and ``s2``."""
    key = lambda a, b, n, salt: F.xxhash64(a, b, n, F.lit(salt))
    s1, s2, pos = F.col("s1"), F.col("s2"), F.col("pos").cast("long")
    p1, p2 = s1.bitwiseXOR(F.col("h1")), s2.bitwiseXOR(F.col("h2"))
    return rows.withColumns({
        "k1": key(s1, s2, pos, 1), "k2": key(s2, s1, pos, 2), "p1": key(p1, p2, pos - 1, 1), "p2": key(p2, p1, pos - 1, 2), "depth": pos.cast("int"),
    }).drop("s1", "s2", "h1", "h2", "pos")


def token_hash(pos: Column, token: Column, salt: int) -> Column:
    """A hash of a token at a place, from 1."""
    return F.xxhash64(pos.cast("long"), token, F.lit(salt))


def _running(rows: DataFrame, *by: str, order: str) -> DataFrame:
    """Add the hashes of ``token`` at ``pos`` and their running sums."""
    run = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"h{k}": token_hash(F.col("pos"), F.col("token"), k) for k in (1, 2)})
    return rows.withColumns({f"s{k}": F.bit_xor(f"h{k}").over(run) for k in (1, 2)})


def array_prefixes(seqs: DataFrame) -> DataFrame:
    """``(grp, sid, n, k1, k2, p1, p2, depth, token, last)``: a row for each prefix but the empty one of ``seqs(grp, sid, tokens, n)``."""
    rows = seqs.select("grp", "sid", "n", F.size("tokens").alias("size"), F.posexplode("tokens").alias("pos", "token")).withColumn("pos", F.col("pos") + 1)
    return _keys(_running(rows.withColumn("last", F.col("pos") == F.col("size")).drop("size"), "sid", order="pos"))


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``pos``, from 1 by ``order`` within each key, and ``last``; no task holds a key, and equal orders are numbered as they come.

    Null keys are keys. ``_part`` and ``_at`` stay: parts of the order, and places in it.
    """
    placed = materialize(
        rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    )
    spans = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    by_key = Window.partitionBy(*keys).orderBy("_part")
    spans = spans.withColumns({"_off": F.sum("_n").over(by_key) - F.col("_n"), "_more": F.lead("_part").over(by_key).isNotNull()})
    edges = materialize(spans.where("_off > 0 OR _more"))  # keys that cross a partition's edge: two rows a partition at most
    own = Window.partitionBy(*keys, "_part").orderBy("_at")
    rows = placed.withColumns({"pos": F.row_number().over(own).cast("long"), "_end": F.lead("_at").over(own).isNull()})
    rows = _at_edges(rows, edges.select(*keys, "_part", "_off", "_more"), keys)
    return rows.withColumns({"pos": F.col("pos") + F.coalesce("_off", F.lit(0)), "last": F.col("_end") & ~F.coalesce("_more", F.lit(False))}).drop("_off", "_more", "_end")


def _at_edges(rows: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of ``edges``, a table of two rows a partition, where they are at one."""
    some = edges.select(*[F.col(f"`{k}`").alias(f"_e_{i}") for i, k in enumerate(keys)], F.col("_part").alias("_e_part"), *[c for c in edges.columns if c not in (*keys, "_part")])
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_e_{i}")) for i, k in enumerate(keys)]
    return rows.join(F.broadcast(some), reduce(and_, same, F.col("_part") == F.col("_e_part")), "left").drop(*[f"_e_{i}" for i in range(len(keys))], "_e_part")


def row_prefixes(rows: DataFrame, keys: list[str], item: str, order: list[str], grp: Column | None = None) -> DataFrame:
    """``(*keys, grp, n, k1, k2, p1, p2, depth, token, last)``: a row for each prefix but the empty one of each key's items in order.

    ``grp``, of the columns of ``rows``, is the sequence's group (default: all are one) and has one value a key.
    """
    own = rows.select(*keys, *[c for c in order if c not in keys], F.col(f"`{item}`").alias("token"), (F.lit("all") if grp is None else grp).alias("grp"))
    rows = _running(materialize(numbered(own, keys, order)), *keys, "_part", order="_at")
    total = rows.groupBy(*keys, "_part").agg(F.bit_xor("h1").alias("_t1"), F.bit_xor("h2").alias("_t2"), F.min("pos").alias("_first"))
    by_key = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = total.select(*keys, "_part", "_first", F.bit_xor("_t1").over(by_key).alias("_b1"), F.bit_xor("_t2").over(by_key).alias("_b2"))
    rows = _at_edges(rows, materialize(before.where("_first > 1").drop("_first")), keys)  # a row a partition at most
    rows = rows.withColumns({f"s{k}": F.col(f"s{k}").bitwiseXOR(F.coalesce(f"_b{k}", F.lit(0))) for k in (1, 2)}).withColumn("n", F.lit(1).cast("long"))
    return _keys(rows).select(*keys, "grp", "n", *NODE, "last")


def keyed_counts(prefixes: DataFrame, *more: Column) -> DataFrame:
    """``(*NODE, grp, cnt, term)`` of prefix rows: sequences of a group through a node and ending there; ``more`` are further aggregates. Without the root."""
    ends = F.sum(F.when(F.col("last"), F.col("n")).otherwise(0)).cast("long").alias("term")
    return prefixes.groupBy(*NODE, "grp").agg(F.sum("n").cast("long").alias("cnt"), ends, *more)


def keyed_nodes(counts: DataFrame, *more: Column) -> DataFrame:
    """``(*NODE, total, terminal)`` over all groups."""
    return counts.groupBy(*NODE).agg(F.sum("cnt").alias("total"), F.sum("term").alias("terminal"), *more)


def collisions(nodes: DataFrame) -> DataFrame:
    """Keys of nodes that stand for more than one (parent, token, depth). None: by induction over the depth, no two paths share a key."""
    return nodes.groupBy("k1", "k2").agg(F.count_distinct("p1", "p2", "depth", F.coalesce("token", F.lit("\0null"))).alias("n")).where("n > 1")


def keyed_probs(nodes: DataFrame) -> DataFrame:
    """Add ``p``, a node's share of its siblings' totals; siblings meet by the parent's key."""
    return nodes.withColumn("p", F.col("total") / F.sum("total").over(Window.partitionBy("p1", "p2")))


def keyed_edges(nodes: DataFrame) -> DataFrame:
    """``(p1, p2, k1, k2, token)``: of a pruned table too no parent is missing, so nothing is joined. The root's key is in no row of ``nodes``."""
    return nodes.select("p1", "p2", "k1", "k2", "token")


def keyed_variants(aligned: DataFrame) -> DataFrame:
    """``(k1, k2, depth, sid, surface)``: surface tokens that became a node's token, other than itself, each once with one of the sequences of ``aligned(sid, norm, surface)``."""
    seqs = aligned.select(F.lit("all").alias("grp"), "sid", F.arrays_zip("norm", "surface").alias("t"), F.lit(1).alias("n"))
    rows = seqs.select("sid", F.posexplode("t").alias("pos", "t")).select("sid", (F.col("pos") + 1).alias("pos"), F.col("t.norm").alias("token"), F.col("t.surface").alias("surface"))
    rows = _keys(_running(rows, "sid", order="pos").where("surface <> token"))
    return rows.groupBy("k1", "k2", "depth", "surface").agg(F.min("sid").alias("sid"))


def with_sids(seqs: DataFrame) -> DataFrame:
    """Distinct sequences ``(grp, tokens, n)`` with a number ``sid``."""
    n = F.col("n") if "n" in seqs.columns else F.lit(1)
    return materialize(seqs.groupBy("grp", "tokens").agg(F.sum(n).cast("long").alias("n")).withColumn("sid", F.monotonically_increasing_id()))
