"""A prefix trie that follows its groups: a reloaded, changed or deleted group moves counts, and only where it differs.

The state is a store: sequences by group, and counts of prefixes ``(path, depth, grp, cnt, term)`` in slots by group and the first tokens of a
path. What a group had and what it now has are summed with opposite signs before they are taken apart, so sequences that stay cost nothing; the prefixes of the
rest are added to the counts in their slots, and slots without such prefixes, other groups' among them, aren't read or rewritten. Sequences and counts change
in one commit. Pruning is a filter on the counts' sums, so nodes go and come back with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import materialize
from ..sources.store import Store
from .trie import prefix_nodes, prefix_rows, prune

SLOTS, LEAD = 64, 2  # slots of a group, and the first tokens that choose one
GROUPS = 16  # groups are dealt to as many sets of slots
_FIRST = SLOTS  # the least slot: those below are of stores whose slots were shared by all groups


def slot_of(path: str | Column = "path", grp: str | Column = "grp") -> Column:
    path, grp = (F.col(c) if isinstance(c, str) else c for c in (path, grp))
    lead = F.pmod(F.xxhash64(F.slice(path, 1, LEAD)), F.lit(SLOTS))
    return (_FIRST + SLOTS * F.pmod(F.xxhash64(grp), F.lit(GROUPS)) + lead).cast("int")


def _touched(signed: DataFrame) -> list[int]:
    """The slots with a prefix whose counts change, if ``signed(grp, tokens, n)`` has each sequence once and n is never 0.

    A sequence's own path changes, as its ends do, and with it the slot of all its prefixes but the shortest, whose sums are looked at.
    """
    leads = signed.groupBy("grp", F.slice("tokens", 1, LEAD).alias("lead")).agg(F.sum("n").alias("n"))
    rows = leads.select("grp", "lead", "n", F.explode(F.sequence(F.lit(0), F.size("lead"))).alias("depth"))
    paths = rows.groupBy("grp", F.slice("lead", 1, F.col("depth")).alias("path")).agg(F.sum("n").alias("n"), F.max(F.col("depth") == F.size("lead")).alias("own"))
    return sorted(r.slot for r in paths.where("n <> 0 OR own").select(slot_of().alias("slot")).distinct().collect())  # SLOTS * GROUPS at most


def reload_groups(seqs: DataFrame, path: str, groups: list[str]) -> list[int]:
    """Make ``groups`` have the sequences that ``seqs(grp, tokens[, n])`` has for them (none: they go); returns the slots that were rewritten.

    Rows of other groups are left out. Equal sequences are summed; a null group can't be reloaded.
    """
    spark = seqs.sparkSession
    n = F.col("n") if "n" in seqs.columns else F.lit(1)
    new = materialize(seqs.where(F.col("grp").isin(groups)).groupBy("grp", "tokens").agg(F.sum(n).cast("long").alias("n")))
    store, touched = Store(spark, path), []

    def changes(base: dict) -> list[tuple]:
        if any(int(f.rpartition("=")[2]) < _FIRST for f in base["tables"].get("counts", {"folders": []})["folders"]):
            raise ValueError(f"{path} has slots that groups share, as an earlier version made them: load all groups into a new store")
        old_seqs, old_counts = store.read("seqs", base), store.read("counts", base)
        signed = new.where("n <> 0")
        if old_seqs is not None:
            gone = old_seqs.where(F.col("grp").isin(groups)).select("grp", "tokens", (-F.col("n")).alias("n"))
            signed = materialize(new.unionByName(gone).groupBy("grp", "tokens").agg(F.sum("n").alias("n")).where("n <> 0"))
        touched[:] = _touched(signed)
        rows = prefix_rows(signed)
        if old_counts is not None:
            rows = old_counts.where(F.col("slot").isin(touched)).drop("slot").unionByName(rows)
        counts = rows.groupBy("path", "depth", "grp").agg(F.sum("cnt").alias("cnt"), F.sum("term").alias("term")).where("cnt <> 0 OR term <> 0")
        counts = counts.withColumn("slot", slot_of()).hint("rebalance", "slot")  # a file or few a slot, not one for each task
        return [
            ("seqs", new, ["grp"], "replace", [store.folder(["grp"], {"grp": g}) for g in groups]),
            ("counts", counts, ["slot"], "replace", [store.folder(["slot"], {"slot": s}) for s in touched]),
        ]

    store.commit(changes)
    return touched


def counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts of prefixes by group, as ``prefix_counts`` gives them for all stored sequences."""
    rows = Store(spark, path).read("counts")
    if rows is None:
        raise FileNotFoundError(f"no group was loaded at {path} yet")
    return rows.drop("slot")


def nodes(spark: SparkSession, path: str, min_count: int = 1) -> DataFrame:
    """The node table of all stored sequences, pruned."""
    return prune(prefix_nodes(counts(spark, path)), min_count)
