"""All contiguous parts of many texts at once, of any length, as intervals of a suffix order.

Listing a text's parts is quadratic in its length, so only the shortest ones (``SHORT`` characters) are listed. For longer ones Spark sorts
the suffixes, of which a window of characters travels, within buckets of equal beginnings; a walk down the order, with the longest common
prefix of neighbours and a stack, meets each set of parts that stand at exactly the same places once, as an interval of lengths
``(low, high]`` with one number of occurrences, of texts and one least size. Texts are counted once an interval by taking off, where two
suffixes of a text meet, one of the two. Suffixes that agree in a whole window go on to a round with longer windows, from where the first
one ended. A bucket that is too large for one task is split: its next lengths are listed, which combine well as they are frequent, and its suffixes get longer beginnings.

What leaves a task is what was asked for: sums of numbers of parts by least size, or the first parts of each group.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import materialize

SHORT = 4  # parts up to this length are listed
WINDOW = 64  # characters of a suffix that travel first; sixteen times as many in each later round
BUCKET = 250_000  # suffixes of one beginning that one task may walk


def listed(texts: DataFrame, low: int, high: int) -> DataFrame:
    """Explode the parts of ``low`` to ``high`` characters of ``text`` as ``part``, with repeats."""
    text = F.col("text")
    starts = texts.where(F.length(text) >= low).withColumn("_i", F.explode(F.sequence(F.lit(1), F.length(text) - low + 1)))
    ends = starts.withColumn("_n", F.explode(F.sequence(F.lit(low), F.least(F.lit(high), F.length(text) - F.col("_i") + 1))))
    return ends.withColumn("part", F.substring(text, F.col("_i"), F.col("_n"))).drop("_i", "_n", "text")


def _counted(parts: DataFrame, groups: list[str]) -> DataFrame:
    """``(part, occurrences, weight, texts, least)`` by group: one row a text first, so no distinct count is needed."""
    per = parts.groupBy(*groups, "part", "doc").agg(F.count("*").alias("n"), F.first("times").alias("times"), F.first("size").alias("size"))
    return per.groupBy(*groups, "part").agg(
        F.sum("n").alias("occurrences"), F.sum(F.col("n") * F.col("times")).alias("weight"), F.count("*").alias("texts"), F.min("size").alias("least")
    )


class _Walk:
    """The intervals of suffixes of one bucket that come in order; ``emit(left, low, high, occurrences, weight, texts, least, doc, pos)``.

    ``start`` is the number of the first suffix; ``left`` the number of an interval's first one, so (left, length) orders parts as texts.
    """

    def __init__(self, base: int, start: int, emit: Callable) -> None:
        self.base, self.emit = base, emit
        self.depth, self.lefts, self.nodes = [], [], []  # of the open intervals
        self.last: dict[int, int] = {}  # where a text's suffix came last
        self.count, self.leaf, self.before = start, None, base

    def add(self, common: int, high: int, times: int, size: int, doc: int, pos: int) -> None:
        """A suffix that ends at length ``high`` and whose first ``common`` characters the one before it has."""
        if self.leaf is not None:
            self._close(common)
        seen = self.last.get(doc)
        if seen is not None:
            k = bisect_right(self.lefts, seen) - 1
            if k >= 0:
                self.nodes[k][2] += 1
        self.last[doc] = self.count
        self.leaf, self.before = (high, times, size, doc, pos), common
        self.count += 1

    def elsewhere(self) -> None:
        """What the last suffix has beyond the one before and the next one is walked in another round."""
        self.leaf = (0, *self.leaf[1:])

    def _close(self, common: int) -> None:
        high, times, size, doc, pos = self.leaf
        low, left = max(self.before, common), self.count - 1
        if high > low:
            self.emit(left, low, high, 1, times, 1, size, doc, pos)
        item = [1, times, 0, size, doc, pos]
        while self.depth and self.depth[-1] > common:
            deep, left = self.depth.pop(), self.lefts.pop()
            item = _joined(self.nodes.pop(), item)
            low = max(self.depth[-1] if self.depth else self.base, common)
            self.emit(left, low, deep, item[0], item[1], item[0] - item[2], *item[3:])
        if self.depth and self.depth[-1] == common:
            self.nodes[-1] = _joined(self.nodes[-1], item)
        elif common > self.base:
            self.depth.append(common)
            self.nodes.append(item)
            self.lefts.append(left)

    def end(self) -> int:
        if self.leaf is not None:
            self._close(self.base)
        return self.count


def _joined(a: list, b: list) -> list:
    return [a[0] + b[0], a[1] + b[1], a[2] + b[2], min(a[3], b[3]), a[4], a[5]]


def _common(a: str, b: str) -> int:
    """How many first characters two strings share."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, step = 0, 8
    while a[low : low + step] == b[low : low + step]:
        low, step = low + step, step * 2
    while step > 1:
        step = (step + 1) // 2
        if a[low : low + step] == b[low : low + step]:
            low += step
    return low


class Sums:
    """Numbers of parts by least size."""

    fields = {"least": "int", "parts": "long"}

    def __init__(self) -> None:
        self.found: dict[int, int] = {}

    def add(self, left: int, low: int, high: int, occurrences: int, weight: int, texts: int, least: int, doc: int, pos: int) -> None:
        self.found[least] = self.found.get(least, 0) + high - low

    def rows(self) -> list[tuple]:
        return list(self.found.items())


class Tops:
    """The first ``k`` parts by weight, or by savings (occurrences times characters less one), of equals the first in the order of texts."""

    fields = {"value": "long", "occurrences": "long", "weight": "long", "texts": "long", "doc": "long", "pos": "int", "len": "int"}

    def __init__(self, k: int, savings: bool) -> None:
        self.k, self.savings, self.heap = k, savings, []

    def add(self, left: int, low: int, high: int, occurrences: int, weight: int, texts: int, least: int, doc: int, pos: int) -> None:
        lengths = range(high, max(low, high - self.k), -1) if self.savings else range(low + 1, min(high, low + self.k) + 1)
        for n in lengths:
            item = (occurrences * (n - 1) if self.savings else weight, -left, -n, occurrences, weight, texts, doc, pos)
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, item)
            elif item > self.heap[0]:
                heapq.heapreplace(self.heap, item)
            else:
                break  # the interval's other lengths come later still

    def rows(self) -> list[tuple]:
        return [(value, occurrences, weight, texts, doc, pos, -n) for value, _, n, occurrences, weight, texts, doc, pos in self.heap]


SUFFIX = ["g", "bucket", "window", "base", "depth", "rest", "times", "size", "doc", "pos"]


def _walked(window: int, make: Callable) -> Callable:
    """A function over sorted suffixes: what ``make()`` gathers a group (``on`` false), and the suffixes that go on (``on`` true)."""
    fields = list(make().fields)
    columns = ["on", "g", *fields, "m_prefix", "m_doc", "m_pos", "m_rest", "m_times", "m_size"]
    none = (0,) * len(fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        group = bucket = walk = sink = alone = None
        text, start = "", 0

        def gathered() -> list[tuple]:
            return [] if sink is None else [(False, group, *v, "", 0, 0, 0, 0, 0) for v in sink.rows()]

        for frame in frames:
            for g, b, w, base, depth, rest, times, size, doc, pos in zip(*(frame[c].tolist() for c in SUFFIX)):
                if g != group or b != bucket:
                    start = walk.end() if walk else 0
                    if g != group:
                        out += gathered()
                        sink = make()
                    group, bucket, alone, common = g, b, None, base
                    walk = _Walk(base, start, sink.add)
                else:
                    common = depth + _common(text, w)
                goes_on = rest > depth + window  # more characters than the window has; such suffixes come first of those with one window
                tied = goes_on and alone is not None and w == text
                if tied:
                    walk.elsewhere()
                walk.add(common, rest, times, size, doc, pos)
                if goes_on:
                    me = (True, g, *none, (b if depth else "") + w, doc, pos, rest, times, size)
                    if tied:
                        walk.elsewhere()
                        out += [me] if alone == () else [alone, me]
                    alone = () if tied else me
                else:
                    alone = None
                text = w
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if walk:
            walk.end()
        out += gathered()
        if out:
            yield pd.DataFrame(out, columns=columns)

    return run


def suffixes_of(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(g, doc, pos, times, size, rest, window)``: the suffixes of more than ``SHORT`` characters of ``texts(g, doc, text, times, size)``."""
    some = texts.where(F.length("text") > SHORT).withColumn("pos", F.explode(F.sequence(F.lit(1), F.length("text") - SHORT)))
    return some.select("g", "doc", "pos", "times", "size", (F.length("text") - F.col("pos") + 1).alias("rest"), F.substring("text", F.col("pos"), F.lit(window)).alias("window"))


def gather(suffixes: DataFrame, texts: DataFrame, make: Callable, window: int = WINDOW, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame | None]:
    """Over all parts that suffixes begin with and that have more than ``SHORT`` characters: what ``make()`` gathers from parts as intervals, by ``g``,
    and the rest of the parts, those of large buckets, as rows ``(g, doc, times, size, part)`` with repeats (None: there are none).

    ``make`` is ``Sums`` or ``Tops`` with its arguments; ``texts(doc, text)`` is read for suffixes that agree in a whole window. Beginnings are made longer
    while two fit in a window.
    """
    if window <= SHORT:
        raise ValueError(f"gather: a window has more than {SHORT} characters")
    length, rest, parts = SHORT + 1, None, None
    while True:  # beginnings of more than ``bucket`` suffixes are made longer
        keyed = suffixes.withColumn("bucket", F.substring("window", 1, length))
        large = materialize(keyed.groupBy("g", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("g", "bucket"))
        if 2 * length > window or large.isEmpty():
            keyed = keyed.withColumn("base", F.lit(length - 1))
            parts = keyed if parts is None else parts.unionByName(keyed)
            break
        small = keyed.join(large, ["g", "bucket"], "left_anti").withColumn("base", F.lit(length - 1))
        parts = small if parts is None else parts.unionByName(small)
        suffixes = materialize(keyed.join(large, ["g", "bucket"]).drop("bucket"))
        n = F.explode(F.sequence(F.lit(length), F.least(F.lit(2 * length - 1), F.col("rest"))))
        more = suffixes.withColumn("n", n).select("g", "doc", "times", "size", F.substring("window", F.lit(1), F.col("n")).alias("part"))
        rest, suffixes, length = more if rest is None else rest.unionByName(more), suffixes.where(F.col("rest") >= 2 * length), 2 * length
    rows, found = parts.withColumn("depth", F.lit(0)), None
    fields = make().fields
    schema = "on boolean, g string, " + ", ".join(f"{c} {t}" for c, t in fields.items()) + ", m_prefix string, m_doc long, m_pos int, m_rest int, m_times long, m_size int"
    while True:
        order = rows.select(*SUFFIX).repartition("g", "bucket").sortWithinPartitions("g", "bucket", "window", F.desc("rest"))
        step = materialize(order.mapInPandas(_walked(window, make), schema))
        own = step.where("NOT on").select("g", *fields)
        found = own if found is None else found.unionByName(own)
        more = step.where("on")
        if more.isEmpty():
            return found, rest
        depth, window = F.length("m_prefix"), 16 * window
        rows = more.join(texts.select(F.col("doc").alias("m_doc"), "text"), "m_doc").select(
            "g", F.col("m_prefix").alias("bucket"), F.substring("text", F.col("m_pos") + depth, F.lit(window)).alias("window"), depth.alias("base"), depth.alias("depth"),
            *[F.col(f"m_{c}").alias(c) for c in ("rest", "times", "size", "doc", "pos")],
        )


def _keyed(texts: DataFrame, groups: list[str]) -> DataFrame:
    """Texts with a number, and their group as one string that the columns can be read from again."""
    g = F.to_json(F.struct(*groups)) if groups else F.lit("{}")
    return materialize(texts.where(F.col("text").isNotNull()).select(g.alias("g"), F.monotonically_increasing_id().alias("doc"), "text", F.col("times").cast("long").alias("times"), F.col("size").cast("int").alias("size")))


def _groups_of(df: DataFrame, texts: DataFrame, groups: list[str]) -> list[Column]:
    kind = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in groups)
    return [F.from_json("g", kind)[c].alias(c) for c in groups]


def top_parts(texts: DataFrame, groups: list[str], k: int, savings: bool = False, least_len: int = 1, window: int = WINDOW, bucket: int = BUCKET) -> DataFrame:
    """The ``k`` first parts of each group of ``texts(*groups, text, times, size)``, whose rows count ``times`` each: ``part``, ``value``, ``occurrences`` in distinct
    rows, ``weight`` (with ``times``), ``texts`` (rows that have it) and ``rank``.

    The value is the weight, or with ``savings`` the occurrences times the part's characters less one. Of equals the first in
    code-point order. Null texts and empty ones have no parts; an empty table gives an empty one.
    """
    keyed = _keyed(texts, groups)
    found, more = gather(suffixes_of(keyed, window), keyed, lambda: Tops(k, savings), window, bucket)
    value = F.col("occurrences") * (F.length("part") - 1) if savings else F.col("weight")
    rest = listed(keyed, least_len, SHORT).select("g", "doc", "times", "size", "part")
    short = _counted(rest if more is None else rest.unionByName(more), ["g"]).withColumn("value", value)
    columns = ["g", "part", "value", "occurrences", "weight", "texts"]
    long = found.join(keyed.select("doc", "text"), "doc").withColumn("part", F.substring("text", F.col("pos"), F.col("len"))).where(F.length("part") >= least_len)
    every = short.select(*columns).unionByName(long.select(*columns))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value"), "part"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select(*_groups_of(every, texts, groups), *columns[1:], "rank")


def first_sizes(texts: DataFrame, groups: list[str], window: int = WINDOW, bucket: int = BUCKET) -> DataFrame:
    """``(*groups, size, parts)``: how many distinct parts of a group have ``size`` as the least size of the texts that have them."""
    keyed = _keyed(texts, groups)
    both = sums(suffixes_of(keyed, window), keyed, window, bucket).unionByName(_least_counts(listed(keyed, 1, SHORT)))
    both = both.groupBy("g", F.col("least").alias("size")).agg(F.sum("parts").alias("parts"))
    return both.select(*_groups_of(both, texts, groups), "size", "parts")


def _least_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("g", "part").agg(F.min("size").alias("least")).groupBy("g", "least").agg(F.count("*").alias("parts"))


def sums(suffixes: DataFrame, texts: DataFrame, window: int = WINDOW, bucket: int = BUCKET) -> DataFrame:
    """``(g, least, parts)`` in some rows each: numbers of parts of more than ``SHORT`` characters by the least size of a suffix that begins with them."""
    found, more = gather(suffixes, texts, Sums, window, bucket)
    return found if more is None else found.unionByName(_least_counts(more))
