"""Nested-set labels of a trie: where a node's subtree begins and ends in depth-first order, and sums over it.

Nodes are range-partitioned and sorted by path once. A walk down each piece of that order keeps a stack of open nodes; a node closes when
one of its depth or less comes. What is open at a piece's end closes in a later piece: of each piece the driver gets
the places where its depth falls below all before, as many as a path has tokens at most, and the last of them tell each open node its end. A sum over a
subtree is then the difference of two prefix sums, a leaf count too, and descendants are a range: no row is made for an ancestor.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import materialize


def _walk(frames: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """For pieces of consecutive ``_at``: closed nodes (kind 0), nodes open at the end (1), falls of the depth (2) and a piece's size (3).

    ``upto`` is how many nodes of the piece come before the end (0, 2) or the node (1), ``v*`` are sums over them: of leaves (``v0``; a piece's last node isn't
    counted, as the next piece tells whether it is one) and of values; those before a closed node are taken off. A piece's ``depth`` is its last node's.
    """
    columns = ["kind", "piece", "at", "depth", "upto", *[f"v{k}" for k in range(n + 1)]]
    out: list[tuple] = []
    piece = last = low = None
    stack: list[tuple] = []
    count, sums = 0, [0] * (n + 1)

    def end() -> list[tuple]:
        if piece is None:
            return []
        opened = [(1, piece, at, depth, start, *before) for at, depth, start, before in stack]
        return [*opened, (3, piece, piece, stack[-1][1], count, *sums)]

    for frame in frames:
        for at, depth, *values in zip(*(frame[c].tolist() for c in ["_at", "depth", *[f"_v{k}" for k in range(n)]])):
            if at - 1 != last:
                out += end()
                piece, low, stack, count, sums = at, None, [], 0, [0] * (n + 1)
            if stack and depth <= stack[-1][1]:
                sums[0] += 1  # the node before was a leaf
            if low is None or depth < low:
                out.append((2, piece, at, depth, count, *sums))
                low = depth
            while stack and stack[-1][1] >= depth:
                at_, depth_, start, before = stack.pop()
                out.append((0, piece, at_, depth_, count, *[a - b for a, b in zip(sums, before)]))
            stack.append((at, depth, count, tuple(sums)))
            count += 1
            sums = [a + b for a, b in zip(sums, [0, *values])]
            last = at
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=columns)
            out = []
    out += end()
    if out:
        yield pd.DataFrame(out, columns=columns)


def labelled(nodes: DataFrame, **values: Column) -> DataFrame:
    """Add ``enter`` (its place in depth-first order, from 0), ``leave`` (the last place of its subtree), ``leaves`` and, for each value, its sum over the subtree.

    ``nodes`` has ``path`` and ``depth``, each path once and with all its ancestors, as a trie has them, pruned or not (the top of it may be cut off).
    Values are whole numbers, null counts as 0.
    """
    names = ["leaves", *values]
    own = nodes.withColumns({f"_v{k}": F.coalesce(v.cast("long"), F.lit(0)) for k, v in enumerate(values.values())})
    own = materialize(own)  # ranges are found by a job of their own, which would make the nodes a second time
    placed = materialize(own.repartitionByRange("path").sortWithinPartitions("path").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    n, sums = len(values), [f"v{k}" for k in range(len(names))]
    schema = "kind int, piece long, at long, depth int, upto long" + "".join(f", {v} long" for v in sums)
    walked = materialize(placed.select("_at", "depth", *[f"_v{k}" for k in range(n)]).mapInPandas(lambda it: _walk(it, n), schema))
    # A row a piece, and of each piece as many falls as a path has tokens at most.
    pieces = {r.piece: r for r in walked.where("kind = 3").collect()}
    order = sorted(pieces)
    falls = sorted((r.piece, r.at, r.depth, r.upto, *[r[v] for v in sums]) for r in walked.where("kind = 2").collect())
    first = {}
    for f in falls:
        first.setdefault(f[0], f[2])
    before, total = {}, [0] * (n + 2)
    for p, after in zip(order, [*order[1:], None]):
        before[p] = tuple(total)
        total = [a + b for a, b in zip(total, [pieces[p].upto, *[pieces[p][v] for v in sums]])]
        total[1] += after is None or first[after] <= pieces[p].depth  # the piece's last node is a leaf
    # From the last piece back: where does a node of each depth that is open at a piece's end close?
    closes: dict[int, list[tuple]] = {}
    known: list[tuple] = []  # (depth, place and sums before it) by falling depth, the nearest first
    for p in reversed(order):
        closes[p] = known
        mine = [(f[2], tuple(a + b for a, b in zip(before[p], f[3:]))) for f in falls if f[0] == p]
        known = [*mine, *[x for x in known if x[0] < mine[-1][0]]]
    spark = nodes.sparkSession
    ends = [(p, high, low, *place) for p in order for high, low, place in _ranges(closes[p], tuple(total))]
    fields = ["e_n", *[f"e_{v}" for v in sums]]
    edge = F.broadcast(spark.createDataFrame(ends, "e_piece long, high int, low int, " + ", ".join(f"{c} long" for c in fields)))
    starts = [(p, *before[p]) for p in order]
    start = F.broadcast(spark.createDataFrame(starts, "s_piece long, s_n long" + "".join(f", s_{v} long" for v in sums)))
    closed = walked.where("kind = 0").join(start, F.col("piece") == F.col("s_piece")).select("at", (F.col("upto") + F.col("s_n") - 1).alias("leave"), *sums)
    open_ = walked.where("kind = 1").join(start, F.col("piece") == F.col("s_piece")).join(edge, (F.col("piece") == F.col("e_piece")) & F.col("depth").between(F.col("low"), F.col("high")))
    open_ = open_.select("at", (F.col("e_n") - 1).alias("leave"), *[(F.col(f"e_{v}") - F.col(f"s_{v}") - F.col(v)).alias(v) for v in sums])
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    offsets = sizes.select("_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_off"))  # a row a partition
    out = placed.join(closed.unionByName(open_), F.col("_at") == F.col("at")).join(F.broadcast(offsets), "_part")
    columns = [F.col(f"`{c}`") for c in nodes.columns if c not in ("enter", "leave", *names)]
    return out.select(*columns, (F.col("_at") + F.col("_off")).alias("enter"), "leave", *[F.col(v).alias(name) for v, name in zip(sums, names)])


def _ranges(closing: list[tuple], total: tuple) -> list[tuple]:
    """(highest depth, lowest depth, place): nodes whose depth is in the range close there; what nothing closes ends with the table."""
    out, high = [], 2**31 - 1
    for depth, place in closing:
        out.append((high, depth, place))
        high = depth - 1
    return [*out, (high, -1, total)] if high >= 0 else out


def descendants(nodes: DataFrame, path: list[str]) -> DataFrame:
    """A node of a labelled table and all below it: a range of ``enter``, which a table sorted by it reads in one go. ValueError if it isn't there."""
    here = F.array(*map(F.lit, path)) if path else F.array().cast("array<string>")
    own = nodes.where(F.col("path") == here).select("enter", "leave").first()
    if own is None:
        raise ValueError(f"no node at {path}")
    return nodes.where(F.col("enter").between(own.enter, own.leave))
