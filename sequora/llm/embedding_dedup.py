"""Near-duplicate embeddings: all pairs by int8 tile products with rigorous error bounds.

Equal vectors are one row with a multiplicity. The rest is dealt out in blocks by a hash, and each
pair of blocks is a tile, a task of bounded size. A tile quantises its two blocks once and multiplies them slice by slice; for each
pair the two vectors' quantisation errors bound how far the true cosine can be. Pairs surely above
or below the threshold are settled; the others are computed again in double precision. A tile
returns a row per linked vector (how many links, and a forest of them), never its pairs.

A block travels once for each other block, so what is shuffled grows with the square of the number of vectors divided by
the size of a block. The doubles travel with it, because the pairs to recheck are known only in the tile and can be as many as
all pairs of a group of near copies, too many to send.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import components, materialize, ship

SLACK = 1e-9  # more than the rounding of double sums of unit vectors
ROWS, COLUMNS = 512, 4096  # a slice of a tile


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 values, scale and error norm of each unit vector (a row)."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    return q.astype(np.int8), scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def linked(x: np.ndarray, y: np.ndarray, threshold: float, of_x: tuple | None = None, of_y: tuple | None = None) -> np.ndarray:
    """Which pairs of rows of x and y (unit vectors, double) have a cosine of ``threshold`` or more.

    ``of_x`` and ``of_y`` are what ``quantise`` gives for them, where that is known.
    """
    (qx, sx, ex), (qy, sy, ey) = of_x or quantise(x), of_y or quantise(y)
    # Sums of int8 products are exact in float32 up to 2^24, so slices of 1,000 components are.
    near = np.zeros((len(x), len(y)))
    for lo in range(0, x.shape[1], 1000):
        near += qx[:, lo : lo + 1000].astype(np.float32) @ qy[:, lo : lo + 1000].astype(np.float32).T
    near *= sx[:, None]
    near *= sy[None, :]
    # |x.y - near| <= |ex| |y| + |x - ex| |ey|, which is most for the largest |ey|; few pairs pass that test.
    i, j = np.nonzero(near >= (threshold - ex - (1 + ex) * ey.max(initial=0.0) - SLACK)[:, None])
    bound = ex[i] + (1 + ex[i]) * ey[j] + SLACK
    value = near[i, j]
    sure = value - bound >= threshold
    yes = np.zeros(near.shape, bool)
    yes[i[sure], j[sure]] = True
    rest = np.flatnonzero((value + bound >= threshold) & ~sure)
    for at in range(0, len(rest), 65_536):
        a, b = i[rest[at : at + 65_536]], j[rest[at : at + 65_536]]
        yes[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
    return yes


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of i and j in place; ``label`` holds the root of each node, the least of its tree."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def tile_links(xs: list[np.ndarray], ms: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector and its root, within one block or between two.

    ``ms`` says how many rows a vector stands for. Slices of 512 by 4,096 pairs bound the memory.
    """
    of = [quantise(x) for x in xs]
    x, y, m = xs[0], xs[-1], np.concatenate(ms)
    offset = len(m) - len(y)
    links, label = np.zeros(len(m), np.int64), np.arange(len(m))
    for r in range(0, len(x), ROWS):
        rows = slice(r, r + ROWS)
        for c in range(0 if offset else r, len(y), COLUMNS):
            columns = slice(c, c + COLUMNS)
            i, j = np.nonzero(linked(x[rows], y[columns], threshold, tuple(v[rows] for v in of[0]), tuple(v[columns] for v in of[-1])))
            i, j = i + r, j + c + offset
            if not offset:  # each pair of a block once, no vector with itself
                i, j = i[i < j], j[i < j]
            if len(i):
                links += (np.bincount(i, m[j], len(m)) + np.bincount(j, m[i], len(m))).astype(np.int64)
                _join(label, i, j)
    return links, label


def embedding_components(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, block_bytes: int = 1 << 24
) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id`` and ``kept``.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing,
    and vectors of different lengths do not link. ``component_id`` is the least id reachable,
    ``kept`` is true for it. Ids are whole numbers; another type is refused with a ``TypeError``. Repeated rows are vectors of their own; an empty table gives an empty one; other columns
    are left out. Blocks hold ``block_bytes`` of vectors; where that gives few blocks there are eight, of 256 vectors or more, so
    that small tables are shared out too.
    """
    if not isinstance(vectors.schema[id_col].dataType, IntegralType):
        raise TypeError(f"embedding_components: ids must be whole numbers; {id_col} is {vectors.schema[id_col].dataType.simpleString()}")
    ship(vectors.sparkSession)
    v = F.col(vector_col)
    big = float("inf")
    valid = F.coalesce(
        F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(big))) & F.exists(v, lambda c: c != 0), F.lit(False)
    )
    rows = vectors.select(F.col(id_col).alias("id"), F.when(valid, F.transform(v, lambda c: c.cast("double"))).alias("v"))
    reps = materialize(
        rows.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("m"))
        .withColumns({"key": F.monotonically_increasing_id(), "dim": F.size("v")})
    )
    per_block = F.greatest(F.lit(64), F.floor(F.lit(block_bytes) / (8 * F.col("dim")))).cast("long")
    n_blocks = F.greatest(F.ceil(F.col("n") / per_block), F.least(F.lit(8), F.ceil(F.col("n") / 256)))
    dims = reps.groupBy("dim").agg(F.count("*").alias("n")).select("dim", n_blocks.cast("long").alias("blocks"))
    placed = reps.join(dims, "dim").withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(g["v"].to_numpy()).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        first = g.iloc[0]
        return pd.DataFrame([[first["dim"], first["blocks"], first["block"], g["key"].to_numpy().tobytes(), g["m"].to_numpy().tobytes(), x.tobytes()]], columns=list(packed))

    packed = ["dim", "blocks", "block", "keys", "ms", "xs"]
    blocks = materialize(
        placed.groupBy("dim", "block").applyInPandas(pack, "dim int, blocks long, block long, keys binary, ms binary, xs binary")
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    tiles = blocks.select("*", other).select(
        "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "keys", "ms", "xs"
    )

    def tile(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block")
        dim = int(g["dim"].iloc[0])
        keys = [np.frombuffer(k, np.int64) for k in g["keys"]]
        ms = [np.frombuffer(m, np.int64) for m in g["ms"]]
        xs = [np.frombuffer(x, np.float64).reshape(-1, dim) for x in g["xs"]]
        links, label = tile_links(xs, ms, threshold)
        key, some = np.concatenate(keys), np.flatnonzero(links)
        return pd.DataFrame({"key": key[some], "n": links[some], "to": key[label[some]]})

    found = materialize(tiles.groupBy("dim", "i", "j").applyInPandas(tile, "key long, n long, to long"))
    comp = components(found.where("key <> to").select(F.col("key").alias("a"), F.col("to").alias("b")))
    direct = found.groupBy("key").agg(F.sum("n").alias("n"))
    rooted = materialize(
        reps.select("key", "v", "low", "m")
        .join(direct, "key", "left")
        .join(comp.withColumnRenamed("node", "key"), "key", "left")
        .select("v", "low", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root"))
    )
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    answer = rooted.join(least, "root").select(F.col("v").alias("_v"), "n_links", "component_id")
    out = rows.join(answer, F.col("v") == F.col("_v"), "left")
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP7_SQL = """
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS v,
    embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
      AND len(list_filter(embedding, lambda c: c <> 0)) > 0 AS ok
  FROM embeddings
), u AS (
  SELECT rid, v, sqrt(list_dot_product(v, v)) AS n FROM e WHERE ok
), p AS (
  SELECT a.rid AS a, b.rid AS b FROM u a JOIN u b ON a.rid <> b.rid AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95
), r AS (
  SELECT rid AS a, rid AS b FROM e
  UNION
  SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), c AS (
  SELECT r.a AS rid, min(e.vec_id) AS component_id FROM r JOIN e ON e.rid = r.b GROUP BY r.a
), n AS (
  SELECT a AS rid, count(*) AS n_links FROM p GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN c USING (rid) LEFT JOIN n USING (rid)
"""
