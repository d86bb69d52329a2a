"""SHA-256 of files that are too large for a task: read in splits, hashed a step at a time.

Spark's text reader gives a file's splits to many tasks, as lines with their bytes as they are. Lines and the newlines between them become pieces of bounded size,
stored by step. A digest must see a file from its beginning to its end, so a step's task gets the digest's state where the step before left it, and leaves it for the next; files advance
side by side. A task reads a split or a step of a file, however large the file is, and each byte is read, stored and hashed once.

The state travels because OpenSSL, which Python's ``hashlib`` rests on, keeps it as a plain struct. The functions for tasks import what they need, so executors need not have this package.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import materialize

STEP, PIECE, BLOCK = 256 << 20, 64 << 10, 16 << 20  # bytes of a step, of a piece at most, and of a row group of stored pieces
MOST_TASKS = 4096  # of a step
BOM = b"\xef\xbb\xbf"  # text readers leave it out where a file begins with it
_ROWS = "no int, size long, at long, seq long, piece binary"


def _pieces(numbers: dict[str, tuple[int, int]], step: int, most: int) -> Callable:
    """``(no, size, at, seq, piece, step)`` from ``(path, at, line)``: the bytes of the splits that begin at ``at``, in order, a newline after each line."""

    def run(batches):  # noqa: ANN001, ANN202 - Arrow batches
        import itertools

        import pyarrow as pa

        fields = [("no", pa.int32()), ("size", pa.int64()), ("at", pa.int64()), ("seq", pa.int64()), ("piece", pa.binary()), ("step", pa.int32())]
        last, seq = None, 0
        for batch in batches:
            for key, lines in itertools.groupby(zip(*(c.to_pylist() for c in batch.columns)), key=lambda x: x[:2]):
                if key != last:
                    last, seq = key, 0
                (no, size), at = numbers[key[0]], key[1]
                body = b"\n".join([*(x[2] for x in lines), b""])
                for begin in range(0, len(body), 256 * most):
                    cut = [body[i : i + most] for i in range(begin, min(begin + 256 * most, len(body)), most)]
                    n = len(cut)
                    columns = [[no] * n, [size] * n, [at] * n, list(range(seq, seq + n)), cut, [at // step] * n]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [f for f, _ in fields])
                    seq += n

    return run


def _advance() -> Callable:
    """Carries digests on: of each file a row with its state (``at`` is -1, ``seq`` the bytes it has seen), then its next pieces; an empty state begins a digest.

    Returns the states, with the digest of a file that was seen to its end.
    """

    def run(batches):  # noqa: ANN001, ANN202 - Arrow batches
        import _hashlib
        import ctypes

        import pyarrow as pa

        lib = ctypes.CDLL(_hashlib.__file__)  # shows OpenSSL's functions too
        context, end = ctypes.create_string_buffer(112), ctypes.create_string_buffer(32)  # SHA256_CTX
        fields = [("no", pa.int32()), ("size", pa.int64()), ("at", pa.int64()), ("seq", pa.int64()), ("piece", pa.binary()), ("sha256", pa.string())]
        file, done = None, 0

        def row():  # noqa: ANN202
            state, digest = context.raw, None
            if done == file[1]:
                lib.SHA256_Final(end, context)
                digest = end.raw.hex()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip((*file, -1, done, state, digest), fields)], [f for f, _ in fields])

        for batch in batches:
            for no, size, at, seq, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if at < 0:
                    if file is not None:
                        yield row()
                    file, done = (no, size), seq
                    if len(piece) == 112:
                        context.raw = piece
                        continue
                    lib.SHA256_Init(context)
                elif file != (no, size):
                    raise RuntimeError(f"no state of file {no}")
                elif len(piece) > size - done:  # a file's last line may have no newline
                    if piece[size - done :] != b"\n":
                        raise RuntimeError(f"file {no} has more than {size} bytes")
                    piece = piece[: size - done]
                lib.SHA256_Update(context, piece, ctypes.c_size_t(len(piece)))
                done += len(piece) if at >= 0 else 0
        if file is not None:
            yield row()

    return run


def resumable() -> bool:
    """Whether digests can be carried on here, found by trying."""

    def batch(*rows: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["no", "size", "at", "seq", "piece"])

    try:
        (first,) = _advance()([batch((0, 150, -1, 0, b""), (0, 150, 0, 0, b"x" * 100))])
        (last,) = _advance()([batch((0, 150, -1, 100, first.column(4)[0].as_py()), (0, 150, 100, 0, b"x" * 50))])
    except (ImportError, AttributeError, OSError):
        return False
    return last.column(5)[0].as_py() == hashlib.sha256(b"x" * 150).hexdigest()


def _begins_with_bom(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(itertools.takewhile(lambda x: x >= 0, (stream.read() for _ in BOM))) == BOM
    finally:
        stream.close()


def stepwise(spark: SparkSession, path: str, sizes: dict[str, int], step: int = STEP) -> DataFrame:
    """``(path, sha256)`` of those files below ``path`` that ``sizes`` names, by ``_metadata.file_path``.

    They must not be packed (``.gz``): the text reader would unpack them. A stretch of 2 GB without a newline is an error.
    """
    numbers = {p: (no, size) for no, (p, size) in enumerate(sorted(sizes.items()))}
    lines = spark.read.option("lineSep", "\n").text(path).where(F.col("_metadata.file_path").isin(list(sizes)))
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("line"))
    pieces = materialize(lines.mapInArrow(_pieces(numbers, step, PIECE), f"{_ROWS}, step int"), ["step"], **{"parquet.block.size": BLOCK})
    steps = sorted(r.step for r in pieces.select("step").distinct().collect())  # as many as the largest file has
    names = spark.createDataFrame([(no, p) for p, (no, _) in numbers.items()], "no int, path string")
    states = [(no, size, -1, *((3, BOM) if _begins_with_bom(spark, p) else (0, b""))) for p, (no, size) in numbers.items()]
    states = spark.createDataFrame([(no, size, at, seq, bytearray(piece)) for no, size, at, seq, piece in states], _ROWS)
    tasks = min(len(numbers), MOST_TASKS)
    for k in steps:
        rows = states.select(*_columns()).unionByName(pieces.where(F.col("step") == k).select(*_columns()))
        dealt = rows.repartitionById(tasks, F.col("no") % tasks).sortWithinPartitions("no", "at", "seq")
        states = materialize(dealt.mapInArrow(_advance(), f"{_ROWS}, sha256 string"))
    whole = F.when(F.col("sha256").isNull(), F.raise_error(F.concat(F.lit("not read to its end: "), "path"))).otherwise(F.col("sha256"))
    return states.join(names, "no").select("path", whole.alias("sha256"))


def _columns() -> list[str]:
    return [c.split()[0] for c in _ROWS.split(", ")]
