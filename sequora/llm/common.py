"""Pieces that several operators of this subpackage share.

Everything here is plain PySpark: the package on the executors, batches of texts for Arrow
functions, and connected components.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import let, materialize  # noqa: F401 - the operators take them from here

_SHIPPED: set[str] = set()
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors: it is added to the session's files once.

    Nothing is done where the executors find it anyway (it is on PYTHONPATH or in the working folder).
    Arrow batches of the session are bounded to 4 MB (or one row), unless a smaller bound is set:
    ten thousand texts of the default bound are too much beside an executor's heap.
    """
    if spark.conf.get(BATCH) in ("67108864b", "-1"):
        spark.conf.set(BATCH, "4194304")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    found = root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root
    if not found and spark.sparkContext.applicationId not in _SHIPPED and os.path.isdir(root):
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "sequora"), "zip", root, "sequora")
        spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(spark.sparkContext.applicationId)


def texts_of(column: pa.Array, most_chars: int = 250_000) -> Iterator[tuple[int, list[str]]]:
    """Slices (start, texts) of a string column, each of a bounded size; null counts as empty."""
    start, got, size = 0, [], 0
    for i, text in enumerate(column):
        text = text.as_py() or ""
        got.append(text)
        size += len(text)
        if size >= most_chars:
            yield start, got
            start, got, size = i + 1, [], 0
    if got:
        yield start, got


def map_texts(
    df: DataFrame, fn: Callable[[list[str]], list[pa.Array]], schema: str, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add columns that ``fn`` computes from the texts of a slice; all rows and the kept columns stay.

    ``fn`` gets a list of texts and returns one Arrow array for each field of ``schema``.
    Columns of the input that have the name of a new one are replaced.
    """
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    new = StructType.fromDDL(schema)
    names = {f.name.lower() for f in new}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("_sq_text"))
    out = StructType([*[f for f in source.schema if f.name != "_sq_text"], *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [batch.column(i) for i in range(batch.num_columns - 1)]
            for start, texts in texts_of(batch.column(batch.num_columns - 1)):
                arrays = [c.slice(start, len(texts)) for c in others] + fn(texts)
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in out])

    return source.mapInArrow(run, out)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, root)``, root the least node of its component.

    Alternates the large-star and small-star steps: each is a min per node and a join, so a hub
    with a third of all edges is aggregated on the map side first and split by AQE in the join.
    Each round is written to the shared folder. Roots, and nodes without an edge to another one, are not returned.
    """
    edges = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*").where("u <> v").distinct()
        )
        edges = materialize(small)
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


SLOTS = 1 << 27  # bits of a filter (16 MB) that spares most rows a shuffle; a join decides, so a full one only costs


class SlotFilter:
    """Bits of a fixed number for the values of a long column: false for most values that it lacks."""

    def __init__(self, rows: DataFrame, column: str) -> None:
        slot = F.pmod(column, F.lit(SLOTS))
        marked = rows.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("b"))
        bits = np.zeros((SLOTS // 32_768 + 1, 4096), np.uint8)
        for r in marked.toLocalIterator():  # at most SLOTS bits in all
            bits[r.k] = np.frombuffer(r.b, np.uint8)
        self.bits = rows.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def __call__(self, values: np.ndarray) -> np.ndarray:
        """Which values may be in the column; the first slot has a bucket of its own."""
        s = (values.view(np.uint64) & np.uint64(SLOTS - 1)).astype(np.int64)
        at = np.where(s > 0, s - 1 + 32_768, 0)
        return (self.bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
