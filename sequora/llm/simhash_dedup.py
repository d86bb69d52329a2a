"""Near-duplicate documents by SimHash fingerprints and multi-index hashing.

A fingerprint has two segments of 32 bits. Two fingerprints that differ in four bits or fewer
differ in at most two bits of the first segment or at most one of the second. Balls of radius 1
around both values of the first segment meet in the first case (33 keys each), values with one bit
masked out agree in the second (32 keys each); so one table of 65 keys for each distinct
fingerprint holds every link, and matches are verified on all 64 bits. A key that many
fingerprints share is dealt out in tiles, and a tile returns a forest of its links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SlotFilter, components, map_texts, materialize, ship
from .xxh import xxh64

BITS = 4
TILE = 512


def shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' word shingles, text after text, and how many each has; a shorter text is one shingle."""
    joined = [b" ".join(t.encode().lower().split()) for t in texts]
    data = b" ".join(joined)
    sizes = np.fromiter(map(len, joined), np.int64, len(joined))
    begin = np.cumsum(sizes + 1) - sizes - 1
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    bounds = np.concatenate([[-1], gaps, [len(data)]])
    starts, ends = bounds[:-1] + 1, bounds[1:]
    first = np.searchsorted(starts, begin)  # the first word of each text; empty ones have an empty word
    words = np.diff(np.concatenate([first, [len(starts)]]))
    n = np.where(sizes > 0, np.maximum(words - width + 1, 1), 0)
    text_of = np.repeat(np.arange(len(texts)), n)
    at = first[text_of] + np.arange(len(text_of)) - np.repeat(np.cumsum(n) - n, n)
    last = np.minimum(at + width, first[text_of] + words[text_of]) - 1
    return xxh64(data, starts[at], ends[last] - starts[at]), n


def fingerprints(texts: list[str], shingle: int = 4) -> np.ndarray:
    """The 64-bit fingerprint of each text as a signed integer; a text without words has zero."""
    h, n = shingles(texts, shingle)
    text_of = np.repeat(np.arange(len(texts)), n)
    out = np.zeros(len(texts), np.uint64)
    if not len(h):
        return out.view(np.int64)
    # Eight counters of a byte each are summed in one 64-bit integer, over 255 shingles at most.
    within = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    cuts = np.flatnonzero(within % 255 == 0)
    owner = text_of[cuts]
    some = np.flatnonzero(n > 0)
    firsts = np.searchsorted(owner, some)
    for bit in range(8):
        lanes = h >> np.uint64(bit) & np.uint64(0x0101010101010101)
        counts = np.add.reduceat(lanes, cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts = np.add.reduceat(counts, firsts, axis=0)
        for byte in range(8):
            out[some] |= (2 * counts[:, byte] > n[some]).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out.view(np.int64)


def add_fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``fp`` (signed 64-bit) to each row; null text has no words."""
    return map_texts(docs, lambda texts: [pa.array(fingerprints(texts), pa.int64())], "fp long", text_col, keep)


def ball_keys(fps: np.ndarray) -> np.ndarray:
    """The 65 keys of each fingerprint, a row each: 33 of the first segment, 32 of the second."""
    bits = fps.view(np.uint64)
    first, second = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    flips = np.uint64(1) << np.arange(32, dtype=np.uint64)
    centres = np.concatenate([first[:, None], first[:, None] ^ flips], axis=1)
    masked = second[:, None] & ~flips | np.arange(1, 33, dtype=np.uint64) << np.uint64(32)
    return np.concatenate([centres, masked], axis=1).view(np.int64)


def _keyed(distinct: DataFrame, wanted: SlotFilter | None = None) -> DataFrame:
    """``(fp, key)`` for each key of a fingerprint, or for those that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            key, fp = ball_keys(fps).reshape(-1), np.repeat(fps, 65)
            if wanted is not None:
                some = wanted(key)
                key, fp = key[some], fp[some]
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(key, pa.int64())], names=["fp", "key"])

    return distinct.select("fp").mapInArrow(run, "fp long, key long")


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked fingerprint but the least of its group, and that least one."""
    bits = fps.view(np.uint64)  # bitwise_count takes the absolute value of signed integers
    i, j = np.nonzero(np.triu(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= BITS, 1))
    other, root = forest(i, j, len(fps))
    return fps[other], fps[root]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``n`` places that pairs link but the least of its group, and that least one."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (before == label).all():
            break
    other = np.flatnonzero(label != np.arange(n))
    return other, label[other]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of rows with one (key, tile); rows come sorted, a run is bounded."""
    rest = None
    for last, batch in _with_last(batches):
        part = None if batch is None else np.array([batch.column(i).to_numpy() for i in range(4)]).reshape(4, -1)
        rest = part if rest is None else rest if part is None else np.concatenate([rest, part], axis=1)
        if rest is None or not rest.shape[1]:
            continue
        change = np.flatnonzero((rest[:3, 1:] != rest[:3, :-1]).any(axis=0)) + 1
        cuts = [0, *change.tolist(), *([rest.shape[1]] if last else [])]
        found = [_forest(np.sort(rest[3, lo:hi])) for lo, hi in zip(cuts, cuts[1:])]
        rest = rest[:, cuts[-1] :]
        a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _with_last(batches):
    for batch in batches:
        yield False, batch
    yield True, None


def links(distinct: DataFrame) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints whose transitive closure is that of all links."""
    ship(distinct.sparkSession)
    # A small table becomes 65 times as many rows, so it is dealt to as many tasks as any shuffle.
    distinct = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    counts = _keyed(distinct).groupBy("key").agg(F.count("*").alias("n"))
    many = materialize(counts.where("n > 1").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("blocks")))
    keyed = _keyed(distinct, SlotFilter(many, "key"))
    own = F.pmod(F.xxhash64("fp"), "blocks")
    members = keyed.join(many, "key").select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = members.select("key", F.least("own", "other").cast("long").alias("x"), F.greatest("own", "other").cast("long").alias("y"), "fp")
    return tiles.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_tiles, "a long, b long").distinct()


def groups(hashed: DataFrame, id_col: str = "doc_id", links_of: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """``(fp, root, component_id)`` for each distinct fingerprint of a table with ``fp``.

    ``component_id`` is the least id among all documents that are reachable by links (null only
    if all of them are null); ``root`` is a fingerprint that stands for the component.
    """
    per_fp = materialize(hashed.groupBy("fp").agg(F.min(id_col).alias("low")))
    comp = components(materialize(links_of(per_fp.select("fp"))))
    rooted = per_fp.join(comp, per_fp["fp"] == comp["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted)
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return materialize(rooted.select("fp", "root").join(least, "root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``fingerprint`` and ``component_id``.

    Null and empty texts have fingerprint zero and link like any other; repeated rows each get a
    row; an empty table gives an empty one; other columns of the input are left out.
    """
    hashed = materialize(add_fingerprints(docs, text_col, keep=[id_col]))
    found = groups(hashed, id_col).select(F.col("fp").alias("_sq_fp"), "component_id")
    return hashed.join(found, hashed["fp"] == found["_sq_fp"]).select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the least id of each component, whole (of equal ids the one with the least hash of its text).

    A component whose ids are all null keeps one of its rows.
    """
    hashed = docs.select(F.col(f"`{id_col}`").alias("_sq_own_id"), F.col(f"`{text_col}`").alias("_sq_own_text"), F.xxhash64(f"`{text_col}`").alias("_sq_h"))
    signed = materialize(add_fingerprints(hashed, "_sq_own_text", keep=["_sq_own_id", "_sq_h"]))
    ids = signed.select(F.col("_sq_own_id").alias(id_col), "fp", "_sq_h")
    return keep_one(docs, ids, groups(ids, id_col), id_col, text_col)


def keep_one(docs: DataFrame, ids: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that stay; ``ids`` has the id, ``fp`` and ``_sq_h`` (hash of the text) of each, ``found`` the groups.

    Rows are chosen in the small table; texts are shuffled once, by a key of id and text that no
    group of copies makes hot. Only rows that are repeated whole are then made distinct.
    """
    found = found.select(F.col("fp").alias("_sq_fp"), "root")
    one = ids.groupBy(id_col, "_sq_h", "fp").agg(F.count("*").alias("m"))
    chosen = materialize(
        one.join(found, F.col("fp") == F.col("_sq_fp"))
        .groupBy("root")
        .agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_sq_h").alias("h"), F.col("m").alias("m"))).alias("k"))
        .select(F.xxhash64("k.id", "k.h").alias("_sq_k"), F.col("k.id").alias("_sq_id"), F.col("k.h").alias("_sq_h"), F.col("k.m").alias("_sq_m"))
    )
    keyed = docs.withColumn("_sq_own_h", F.xxhash64(f"`{text_col}`")).withColumn("_sq_k", F.xxhash64(f"`{id_col}`", "_sq_own_h"))
    kept = keyed.join(chosen, "_sq_k").where((F.col("_sq_own_h") == F.col("_sq_h")) & F.col(f"`{id_col}`").eqNullSafe(F.col("_sq_id")))
    own = [F.col(f"`{c}`") for c in docs.columns]
    once = kept.where("_sq_m = 1").select(*own)
    if chosen.where("_sq_m > 1").isEmpty():
        return once
    return once.union(kept.where("_sq_m > 1").dropDuplicates(["_sq_k"]).select(*own))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
