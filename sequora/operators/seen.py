"""New motifs kept up to date as outcomes arrive, without going back to the older outcomes.

The state is a store: distinct short parts and the suffixes of longer ones with the least size that has them, in slots by their first
characters, and the numbers of parts by least size. A batch is made into parts and suffixes; of the state only the slots
that these fall into are read, the numbers of the parts there are counted with and without the batch, and the difference is added. So sizes may come in any
order, and one commit changes parts, suffixes and numbers together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import materialize
from ..sources.store import Store
from . import parts

SLOTS = 64


def _slot(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SLOTS)).cast("int")


def _numbered(df: DataFrame, start: int) -> DataFrame:
    """``doc``: consecutive numbers from ``start``; each partition's offset is the size of those before it."""
    placed = materialize(df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = {r._part: (r.n, r.first) for r in placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first")).collect()}  # a row a partition
    offsets, at = [], start
    for part in sorted(sizes):
        offsets.append((part, at - sizes[part][1]))
        at += sizes[part][0]
    known = df.sparkSession.createDataFrame(offsets, "_part int, _off long")
    return placed.join(F.broadcast(known), "_part").withColumn("doc", F.col("_at") + F.col("_off")).drop("_part", "_at", "_off")


def add_outcomes(outcomes: DataFrame, path: str, batch: str) -> None:
    """Take the normal outcomes of a batch into the state at ``path``; a batch of a known name changes nothing."""
    spark = outcomes.sparkSession
    store = Store(spark, path)
    normal = outcomes.where("status = 'normal' AND outcome IS NOT NULL")
    texts = materialize(normal.groupBy(F.to_json(F.struct("experiment")).alias("g"), F.col("outcome").alias("text")).agg(F.min("size").cast("int").alias("size")))

    def changes(base: dict) -> list[tuple]:
        old = {name: store.read(name, base) for name in ("texts", "short", "suffixes", "motifs")}
        start = 0 if old["texts"] is None else (old["texts"].agg(F.max("doc")).first()[0] or 0) + 1
        fresh = materialize(_numbered(texts, start).withColumn("times", F.lit(1).cast("long")))
        short = parts.listed(fresh, 1, parts.SHORT).groupBy("g", "part").agg(F.min("size").alias("size"))
        short = materialize(short.withColumn("slot", _slot("part")))
        # Of suffixes that end within their window and are equal the least size is enough.
        rows = parts.suffixes_of(fresh)
        whole = F.col("rest") <= parts.WINDOW
        ended = rows.where(whole).groupBy("g", "window", "rest").agg(F.min(F.struct("size", "doc", "pos")).alias("m")).select("g", "window", "rest", "m.size", "m.doc", "m.pos")
        rows = ended.unionByName(rows.where(~whole).select("g", "window", "rest", "size", "doc", "pos"))
        rows = materialize(rows.withColumn("slot", _slot(F.substring("window", 1, parts.SHORT + 1))))
        near = {"short": None, "suffixes": None}
        for name, new, key in (("short", short, ["g", "part", "slot"]), ("suffixes", rows, ["g", "slot", "head"])):
            if old[name] is not None:
                slots = [r.slot for r in new.select("slot").distinct().collect()]  # SLOTS at most
                kept, head = old[name].where(F.col("slot").isin(slots)), F.substring("window", 1, parts.SHORT + 1)
                if name == "suffixes":
                    kept, new = kept.withColumn("head", head), new.withColumn("head", head)
                near[name] = materialize(kept.join(new.select(*key).distinct(), key, "left_semi").drop("head"))
        both = fresh.select("doc", "text") if old["texts"] is None else fresh.select("doc", "text").unionByName(old["texts"].select("doc", "text"))
        ones = lambda df: df.drop("slot").withColumn("times", F.lit(1).cast("long"))
        after = [_counts(_with(short, near["short"])), parts.sums(ones(_with(rows, near["suffixes"])), both)]
        before = [] if near["short"] is None else [_counts(near["short"])]
        before += [] if near["suffixes"] is None else [parts.sums(ones(near["suffixes"]), both)]
        signed = [df.select("g", "least", F.col("parts")) for df in after] + [df.select("g", "least", -F.col("parts")) for df in before]
        if old["motifs"] is not None:
            signed.append(old["motifs"].select("g", "least", "parts"))
        total = signed[0].toDF("g", "least", "parts")
        for df in signed[1:]:
            total = total.union(df)
        total = materialize(total.groupBy("g", "least").agg(F.sum("parts").cast("long").alias("parts")).where("parts <> 0"))
        return [
            ("texts", fresh.select("g", "doc", "text", "size"), [], "append", ()),
            ("short", short, ["slot"], "append", ()),
            ("suffixes", rows, ["slot"], "append", ()),
            ("motifs", total, [], "replace", ()),
        ]

    store.commit(changes, batch)


def _with(new: DataFrame, old: DataFrame | None) -> DataFrame:
    return new if old is None else new.unionByName(old)


def _counts(short: DataFrame) -> DataFrame:
    least = short.groupBy("g", "part").agg(F.min("size").alias("least"))
    return least.groupBy("g", "least").agg(F.count("*").alias("parts"))


def new_motifs(spark: SparkSession, path: str) -> DataFrame:
    """Per experiment and size: parts of stored outcomes that no smaller size of the experiment has."""
    rows = Store(spark, path).read("motifs")
    if rows is None:
        raise FileNotFoundError(f"no batch was added at {path} yet")
    return rows.select(F.from_json("g", "experiment string")["experiment"].alias("experiment"), F.col("least").alias("size"), F.col("parts").alias("new_motifs"))
