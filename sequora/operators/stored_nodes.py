"""Node tables that are stored for look-ups: pages by depth, and search by token, without scanning nodes.

Pages: nodes are numbered by depth and path and stored in blocks of consecutive numbers; a row a depth tells where each begins. So any page
of a depth range is a range of numbers, and a block or two.

Search: nodes are stored in slots by token, beside a dictionary of tokens and an inverted index of their grams (up to three
characters). A search goes gram, token, nodes: it reads the slots of a few grams and tokens, and no nodes at all for a text that no token holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import materialize
from ..sources.store import Store
from .trie import node_ids

SLOTS, GRAM = 64, 3


def write_pages(nodes: DataFrame, path: str, block: int = 5000) -> None:
    """Store a node table for ``page``, in blocks of ``block`` rows; what was stored there before is replaced at once."""
    ids = materialize(node_ids(nodes, "bfs"))
    depths = ids.groupBy("depth").agg(F.min("node_id").alias("first"), F.count("*").alias("n")).withColumn("block_rows", F.lit(block))
    blocks = ids.withColumn("block", F.floor(F.col("node_id") / block).cast("long")).repartition("block")
    Store(nodes.sparkSession, path).commit(lambda _: [("nodes", blocks, ["block"], "overwrite", ()), ("depths", depths, [], "overwrite", ())])


def page(spark: SparkSession, path: str, low: int, high: int, offset: int = 0, limit: int = 5000) -> DataFrame:
    """A page of the nodes of a depth range, by depth and path, with ``total_count`` and ``has_more``.

    A negative offset counts as 0, a limit under 1 as 1. Only the blocks that hold the page are read.
    """
    store, offset, limit = Store(spark, path), max(offset, 0), max(limit, 1)
    base = store.snapshot()
    depths = [r for r in store.read("depths", base).collect() if low <= r.depth <= high]  # a row a depth
    total = sum(r.n for r in depths)
    first = min((r.first for r in depths), default=0) + offset
    last = min(first - offset + total, first + limit) - 1
    size = depths[0].block_rows if depths else 1
    rows = store.read("nodes", base, [{"block": b} for b in range(first // size, last // size + 1)] if first <= last else [])
    found = rows.where(F.col("node_id").between(first, last)).drop("block")
    return found.withColumns({"total_count": F.lit(total).cast("long"), "has_more": F.lit(total > offset + limit)}).orderBy("node_id")


def _slot(token: str | Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(SLOTS)).cast("int")


def _grams(token: Column, n: int) -> Column:
    last = F.length(token) - n + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(token, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def write_index(nodes: DataFrame, path: str) -> None:
    """Store a node table for ``search``; the root isn't found by it."""
    rows = materialize(nodes.where("depth > 0").withColumn("slot", _slot("token")))  # three tables are made of them
    tokens = rows.groupBy("token", "slot").agg(F.count("*").alias("n"))
    every = F.concat(*[_grams(F.col("token"), n) for n in range(1, GRAM + 1)])
    grams = tokens.select("token", F.explode(every).alias("gram")).withColumn("slot", _slot("gram"))
    Store(nodes.sparkSession, path).commit(lambda _: [
        ("nodes", rows.repartition("slot"), ["slot"], "overwrite", ()), ("tokens", tokens, ["slot"], "overwrite", ()), ("grams", grams, ["slot"], "overwrite", ()),
    ])


def search(spark: SparkSession, path: str, text: str, limit: int = 50) -> DataFrame:
    """Nodes whose token is ``text``; only if there are none, those whose token contains it. With ``total_matches`` after the limit."""
    store = Store(spark, path)
    base = store.snapshot()
    slot_of = lambda names: [r.s for r in spark.createDataFrame([(n,) for n in names], "t string").select(_slot("t").alias("s")).distinct().collect()]  # noqa: E731 - the slots of a few names
    slots = slot_of([text])
    found = store.read("tokens", base, [{"slot": s} for s in slots]).where(F.col("token") == text).select("token")
    if found.isEmpty() and text:
        size = min(len(text), GRAM)
        wanted = sorted({text[i : i + size] for i in range(len(text) - size + 1)})
        hits = store.read("grams", base, [{"slot": s} for s in slot_of(wanted)]).where(F.col("gram").isin(wanted))
        with_all = hits.groupBy("token").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted))
        found = materialize(with_all.where(F.contains("token", F.lit(text))).select("token"))
        slots = [r.s for r in found.select(_slot("token").alias("s")).distinct().collect()]  # SLOTS at most
    elif not text:
        slots, found = list(range(SLOTS)), store.read("tokens", base).select("token")  # every token contains the empty text
    rows = store.read("nodes", base, [{"slot": s} for s in slots]).drop("slot").join(found, "token", "left_semi").orderBy("token", "path").limit(max(limit, 1))
    return rows.join(rows.agg(F.count("*").alias("total_matches")))
