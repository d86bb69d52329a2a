"""Hard negatives by threshold joins over an inverted index, in the manner of L2AP.

Every row is scored against every anchor by an integer inner product, but only pairs that can reach an anchor's threshold are
followed to the end. Rows and anchors lie in blocks, and a pair of blocks is a task. For a tile the dimensions are ordered by their
energy. A row is indexed in its first dimensions only: the rest is left out as soon as the norm of what is left, times the largest such
norm of the anchors, is below all thresholds, for then a pair that shares no indexed dimension can't reach one. Rows are ordered by
how many dimensions they have in the index, so a posting list is the beginning of a column. Partial scores are accumulated list after list; a pair is
dropped when its partial score and the product of both remaining norms stay below the anchor's threshold.

Thresholds come from a pilot, a fixed share of the blocks, which is scored in full. An anchor's window asks for so many rows below an
upper bound; its threshold begins where the pilot makes enough rows in all likely, and is lowered, for the windows that aren't
filled, to where the pilot has enough rows itself, or to the window's lower bound. A window is complete if it is filled, or if its threshold is its lower bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import materialize, ship

SEGMENT = 8  # dimensions that are accumulated at once
SLICE = (256, 8192)  # anchors and rows of a tile that are scored at once
FEW = 0.1  # share of pairs left from which on they are followed one by one
LARGEST = 2.0**50  # squared norms up to here have exact scores
NONE = np.iinfo(np.int64).min  # a threshold that every score reaches


def pairs_at_least(x: np.ndarray, y: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) with an inner product of ``least[row of x]`` or more, and their products.

    Both hold whole numbers; products are exact while squared norms are up to 2^50. Thresholds of ``-inf`` are reached by all.
    """
    order = np.argsort(-((x.astype(np.float64) ** 2).sum(axis=0) * (y.astype(np.float64) ** 2).sum(axis=0)), kind="stable")
    x, y = np.ascontiguousarray(x[:, order]), y[:, order]
    most = x.shape[1] * float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0))
    kind = np.float32 if most < 2**24 else np.float64  # exact in either
    cuts = [*range(0, x.shape[1], SEGMENT), x.shape[1]]
    last = len(cuts) - 1
    rest_x, rest_y = _rest_norms(x, cuts), _rest_norms(y, cuts)
    # The index: a row's segments up to the first one from which on no anchor's threshold is in reach.
    reach = rest_y * rest_x.max(axis=0, initial=0.0) >= least.min(initial=np.inf)
    indexed = np.minimum(reach.sum(axis=1), last)
    rows = np.argsort(-indexed, kind="stable")
    rows = rows[indexed[rows] > 0] if last else rows  # a product of no dimensions is 0
    x, y, rest_y, indexed = x.astype(kind), np.ascontiguousarray(y[rows].astype(kind)), rest_y[rows], indexed[rows]
    least = least.astype(np.float64)
    score = np.zeros((len(x), len(rows)), kind)
    at = 0
    while at < last:
        posted = int(np.searchsorted(-indexed, -at, side="left"))  # rows with more than ``at`` segments in the index come first
        if not posted:
            break
        part = slice(cuts[at], cuts[at + 1])
        score[:, :posted] += x[:, part] @ y[:posted, part].T
        at += 1
        if at < last and at % 2 == 0 and np.isfinite(least).any():
            done = np.minimum(indexed, at)
            alive = score >= least[:, None] - rest_x[:, done] * rest_y[np.arange(len(done)), done]
            if np.count_nonzero(alive) <= FEW * alive.size:
                return _follow(x, y, rest_x, rest_y, least, score, alive, done, cuts, rows)
    done = np.minimum(indexed, at)
    alive = score >= least[:, None] - rest_x[:, done] * rest_y[np.arange(len(done)), done]
    return _follow(x, y, rest_x, rest_y, least, score, alive, done, cuts, rows)


def _rest_norms(x: np.ndarray, cuts: list[int]) -> np.ndarray:
    """The norm of each row from each cut on, rounded up."""
    squares = np.add.reduceat(np.c_[x.astype(np.float64) ** 2, np.zeros(len(x))], cuts, axis=1) if len(cuts) > 1 else np.zeros((len(x), 1))
    return np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]) * (1 + 1e-9)


def _follow(x, y, rest_x, rest_y, least, score, alive, done, cuts, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001 - arrays of ``pairs_at_least``
    """Complete the scores of the pairs that are left, segment by segment, dropping those that fall out of reach."""
    i, j = np.nonzero(alive)
    value, at = score[i, j].astype(np.float64), done[j]
    for k in range(len(cuts) - 1):
        now = np.flatnonzero(at <= k)
        part = slice(cuts[k], cuts[k + 1])
        for lo in range(0, len(now), 1 << 17):
            some = now[lo : lo + (1 << 17)]
            value[some] += np.einsum("ij,ij->i", x[i[some], part], y[j[some], part], dtype=np.float64)
        if len(now):
            keep = value >= least[i] - np.where(at <= k, rest_x[i, k + 1] * rest_y[j, k + 1], rest_x[i, at] * rest_y[j, at])
            i, j, value, at = i[keep], j[keep], value[keep], at[keep]
    return i, rows[j], value


def best_of_windows(i: np.ndarray, score: np.ndarray, tie: tuple[np.ndarray, ...], win: dict[str, np.ndarray], n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window (``of`` an anchor, ``lo`` to ``hi``) the first ``k`` pairs: (window, pair). ``i`` is a pair's anchor of ``n``."""
    order = np.lexsort((*tie[::-1], -score, i))
    i, score = i[order], score[order]
    begin = np.searchsorted(i, np.arange(n + 1))
    lo, hi = begin[win["of"]], begin[win["of"] + 1]
    start = lo.copy()  # the first pair of the anchor that isn't above the window: a binary search of all windows at once
    end = hi.copy()
    while (open_ := start < end).any():
        mid = (start + end) // 2
        above = np.zeros(len(mid), bool)
        above[open_] = score[mid[open_]] > win["hi"][open_]
        start = np.where(open_ & above, mid + 1, start)
        end = np.where(open_ & ~above, mid, end)
    place = start[:, None] + np.arange(k)
    ok = place < hi[:, None]
    ok[ok] = score[place[ok]] >= np.broadcast_to(win["lo"][:, None], place.shape)[ok]
    w, c = np.nonzero(ok)
    return w, order[place[w, c]]


def _packed(rows: DataFrame) -> DataFrame:
    """Blocks of ``rows(dim, block, key, none, id, label, q)``, arrays as bytes."""
    fields = ["key", "id", "label"]

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        small, q = _matrix(g)
        return pd.DataFrame([[g["dim"].iloc[0], g["block"].iloc[0], len(g), small, g["none"].to_numpy(bool).tobytes(), q, *[g[c].to_numpy(np.int64).tobytes() for c in fields]]])

    schema = "dim int, block long, n long, small boolean, none binary, q binary, key binary, id binary, label binary"
    return rows.select("dim", "block", "none", "q", *fields).groupBy("dim", "block").applyInPandas(pack, schema)


def _matrix(g: pd.DataFrame) -> tuple[bool, bytes]:
    """Whether two bytes hold each component, and the components."""
    q = np.stack(g["q"].to_numpy()).astype(np.int32) if g["dim"].iloc[0] else np.zeros((len(g), 0), np.int32)
    small = bool(np.abs(q).max(initial=0) < 1 << 15)
    return small, q.astype(np.int16 if small else np.int32).tobytes()


def _arrays(r: dict, prefix: str, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    q = np.frombuffer(r[f"{prefix}q"], np.int16 if r[f"{prefix}small"] else np.int32).reshape(r[f"{prefix}n"], r["dim"])
    return {"q": q} | {c: np.frombuffer(r[prefix + c], bool if c == "none" else np.int64) for c in names}


def _tile(r: dict, k: int, same: bool) -> pd.DataFrame:
    """The first ``k`` rows of a block for each window of the anchors of another: rows of the same label, or of another one."""
    a, b = _arrays(r, "", ("key", "label")), _arrays(r, "b_", ("key", "none", "id", "label"))
    win = {c: np.frombuffer(r[f"w_{c}"], np.int64) for c in ("of", "pos", "lo", "hi")}
    found = []
    for lo in range(0, len(a["key"]), SLICE[0]):
        n = min(SLICE[0], len(a["key"]) - lo)
        some = (win["of"] >= lo) & (win["of"] < lo + n)
        own = {c: v[some] for c, v in win.items()}
        own["of"] = own["of"] - lo
        least = np.full(n, np.inf)
        np.minimum.at(least, own["of"], np.where(own["lo"] == NONE, -np.inf, own["lo"].astype(np.float64)))
        for at in range(0, len(b["key"]), SLICE[1]):
            part = {c: v[at : at + SLICE[1]] for c, v in b.items()}
            i, j, score = pairs_at_least(a["q"][lo : lo + n], part["q"], least)
            fits = (a["label"][lo + i] == part["label"][j]) == same
            if same:
                fits &= a["key"][lo + i] != part["key"][j]
            i, j, score = i[fits], j[fits], score[fits].astype(np.int64)
            w, c = best_of_windows(i, score, (part["none"][j], part["id"][j]), own, n, k)
            found.append((a["key"][lo + own["of"][w]], own["pos"][w], part["none"][j[c]], part["id"][j[c]], score[c]))
    akey, pos, none, ids, score = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 5
    return pd.DataFrame({"akey": akey, "pos": pos, "id": pd.arrays.IntegerArray(ids.copy(), none.astype(bool)), "score": score})


def _search(blocks: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, same: bool, wanted: str) -> DataFrame:
    """``(akey, pos, id, score, rank)``: the first ``k`` rows in each window ``(akey, pos, lo, hi)``, of the blocks that ``wanted`` names.

    Each block of anchors meets each wanted block of rows under a key of its own, so no task gets more than its pairs of blocks.
    """
    per = windows.groupBy("akey").agg(F.collect_list(F.struct("pos", "lo", "hi")).alias("w"))  # as many as an anchor has positives
    open_ = anchors.join(per.withColumnRenamed("akey", "key"), "key")

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        w = [(i, x["pos"], x["lo"], x["hi"]) for i, own in enumerate(g["w"]) for x in own]
        of = [np.array([x[c] for x in w], np.int64).tobytes() for c in range(4)]
        first = g.iloc[0]
        return pd.DataFrame([[first["dim"], first["a_block"], first["blocks"], len(g), *_matrix(g), g["key"].to_numpy(np.int64).tobytes(), g["label"].to_numpy(np.int64).tobytes(), *of]])

    schema = "dim int, a_block long, blocks long, n long, small boolean, q binary, key binary, label binary, w_of binary, w_pos binary, w_lo binary, w_hi binary"
    packed = open_.groupBy("dim", "a_block").applyInPandas(pack, schema)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = packed.withColumn("b_block", each("blocks")).where(wanted)
    right = blocks.select("dim", F.col("block").alias("b_block"), "a_blocks", *[F.col(c).alias(f"b_{c}") for c in ("n", "small", "none", "q", "key", "id", "label")])
    tiles = left.join(right.where(wanted).withColumn("a_block", each("a_blocks")), ["dim", "a_block", "b_block"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.to_dict("records"):
                yield _tile(r, k, same)

    return _first(tiles.mapInPandas(run, "akey long, pos long, id long, score long"), k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
    positives: int = 5, negatives: int = 10, low_pct: int = 30, high_pct: int = 90, block_rows: int = 16_384, pilot_share: int = 16, ladder: int = 2,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``, a row a hard negative.

    Components are floored after multiplication by ``scale``; a score is the integer inner product with the anchor. An anchor's
    positives are its first ``positives`` other rows of its label, its hard negatives for a positive the first ``negatives`` rows of another label with a score
    between ``low_pct`` and ``high_pct`` percent of the positive's, both included. First is the higher score, of equal ones the
    smaller id, null ids last; fewer rows are returned where there are fewer. A negative positive score leaves no range, hence no row.

    Rows take no part if label, vector or a component is null, a component isn't finite, or the squared norm after scaling is over 2^50 (scores
    stay exact up to there). Vectors of different lengths have no score; empty ones have 0. Repeated rows are rows of their
    own, as anchors too. An empty table gives an empty one; other columns are left out. Ids and labels are whole numbers; another type is
    refused with a ``TypeError``.

    ``block_rows`` rows are a block and ``block_rows / 8`` anchors (about 2 and 0.25 MB of 64 components). ``pilot_share``: one block of so many, and one
    at least, is scored without thresholds; thresholds begin at the pilot's ``ladder``-th row of a window.
    """
    base = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"), label.alias("label"), is_anchor.alias("anchor"))
    for name, what in (("id", id_col), ("label", "the label")):
        if not isinstance(base.schema[name].dataType, IntegralType):
            raise TypeError(f"hard_negatives: {what} must be a whole number, not {base.schema[name].dataType.simpleString()}")
    ship(vectors.sparkSession)
    q = F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("double"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    norm = F.aggregate("q", F.lit(0.0), lambda t, c: t + c * c)
    rows = materialize(
        base.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).withColumn("q", q).where(norm <= LARGEST)
        .select(
            F.monotonically_increasing_id().alias("key"), F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).cast("long").alias("id"),
            F.col("label").cast("long").alias("label"), F.transform("q", lambda c: c.cast("int")).alias("q"), F.size("q").alias("dim"),
            F.coalesce("anchor", F.lit(False)).alias("anchor"),
        )
    )
    n = F.count("*")
    sizes = materialize(
        rows.groupBy("dim").agg(
            F.greatest(F.ceil(n / block_rows), F.least(F.lit(8), F.ceil(n / 256))).cast("long").alias("blocks"),
            F.greatest(F.lit(1), F.ceil(F.count_if("anchor") * 8 / block_rows)).cast("long").alias("a_blocks"),
        )
    )
    placed = rows.join(sizes, "dim").withColumns({"block": F.pmod(F.xxhash64("key"), "blocks"), "a_block": F.pmod(F.xxhash64("key"), "a_blocks")})
    blocks = materialize(_packed(placed).join(sizes.select("dim", "a_blocks"), "dim"))
    anchors = materialize(placed.where("anchor").select("key", "none", "id", "label", "q", "dim", "a_block", "blocks"))
    pilot, others = (f"b_block % {pilot_share} {sign} 0" for sign in ("=", "<>"))
    search = lambda part, windows, k, same: materialize(_search(blocks, anchors, windows, k, same, part))
    top = lambda parts, k: _first(parts[0].unionByName(parts[1]), k)

    everything = anchors.select(F.col("key").alias("akey"), F.lit(0).cast("long").alias("pos"), F.lit(int(NONE)).alias("lo"), F.lit(2**62).alias("hi"))
    seen = search(pilot, everything, positives, True)
    enough = seen.where(F.col("rank") == positives).select("akey", F.col("score").alias("least"))
    windows = everything.join(enough, "akey", "left").select("akey", "pos", F.coalesce("least", "lo").alias("lo"), "hi")
    found = materialize(top([seen, search(others, windows, positives, True)], positives))

    ranges = found.where("score >= 0").select("akey", F.col("rank").cast("long").alias("pos"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    ranges = ranges.select("*", F.expr(f"(positive_score * {low_pct} + 99) div 100").alias("lo"), F.expr(f"(positive_score * {high_pct}) div 100").alias("hi"))
    ranges = materialize(ranges.where("lo <= hi"))
    key = ["akey", "pos"]
    seen = search(pilot, ranges.select(*key, "lo", "hi"), negatives, False)
    steps = seen.groupBy(*key).agg(F.max(F.when(F.col("rank") == ladder, F.col("score"))).alias("high"), F.max(F.when(F.col("rank") == negatives, F.col("score"))).alias("sure"))
    plan = materialize(ranges.select(*key, F.col("lo").alias("low"), "hi").join(steps, key, "left"))
    first = plan.select(*key, F.coalesce("high", "low").alias("lo"), "hi")
    got = search(others, first, negatives, False)
    best = materialize(top([seen, got], negatives))
    filled = best.groupBy(*key).agg(F.max(F.when(F.col("rank") == negatives, F.col("score"))).alias("nth"))
    # A window is complete if its n-th row reaches the threshold that it was searched with; else the threshold is lowered once more.
    again = plan.join(filled, key, "left").where(F.col("high").isNotNull() & ~F.coalesce(F.col("nth") >= F.col("high"), F.lit(False)))
    again = materialize(again.select(*key, F.coalesce("sure", "low").alias("lo"), "hi"))
    more = search(others, again, negatives, False)
    rest = top([seen.join(again.select(*key), key, "left_semi"), more], negatives)
    whole = best.join(again.select(*key), key, "left_anti").unionByName(rest)
    return (
        whole.join(ranges.select(*key, "positive_id", "positive_score"), key).join(anchors.select(F.col("key").alias("akey"), F.when(~F.col("none"), F.col("id")).alias("anchor_id")), "akey")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("akey", "pos").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    return found.select("akey", "pos", "id", "score").withColumn("rank", rank).where(F.col("rank") <= k)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, label)


OP11_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.rid AS aid, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CASE WHEN len(a.q) = 0 THEN 0 ELSE list_dot_product(a.q, b.q) END::BIGINT AS score
  FROM e a JOIN e b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT aid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY aid ORDER BY score DESC, vec_id NULLS LAST) AS pos
  FROM s WHERE same QUALIFY pos <= 5
), n AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.aid, pos ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank
  FROM p JOIN s USING (aid, anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n
"""
