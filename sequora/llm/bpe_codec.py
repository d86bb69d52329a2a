"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The ranks of a ``.tiktoken`` file become a vocabulary and merges of the library: every byte is
written as one printable character (the byte table), so a merge of byte strings is a merge of
character strings. Decoding goes back through the same table; characters that were split between
tokens come together again because bytes, not characters, are joined.
"""

from __future__ import annotations

import base64
import hashlib
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .chunks import ChunkCache
from .common import map_texts, ship

RANKS = "byte_bpe_50k.tiktoken"


def byte_table() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file (default: the public 50k vocabulary)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(RANKS)
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that each token of two bytes or more is merged from, in rank order.

    A token's bytes are merged by the ranks below its own until two parts are left.
    """
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class Codec:
    """Encoder and decoder of one vocabulary; one a worker process (see ``codec``)."""

    def __init__(self, path: str | None = None, pattern: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        if pattern is None:
            from public_tokenizers import PATTERN as pattern
        chars, ranks = byte_table(), read_ranks(path)
        text = lambda token: "".join(map(chars.__getitem__, token))
        model = models.BPE(
            vocab={text(t): r for t, r in ranks.items()},
            merges=[(text(a), text(b)) for a, b in merges_of(ranks)],
            ignore_merges=True,  # a whole piece that is a token stays one
        )
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        back = {c: b for b, c in enumerate(chars)}
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in self.tokenizer.get_vocab().items():
            self.token_bytes[rank] = bytes(map(back.__getitem__, token))
        self.cache = ChunkCache(self._new)
        self.sizes = np.array([*map(len, self.token_bytes)])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(self.token_bytes), np.uint8)

    def _new(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers in the machine's (little-endian) order."""
        return [b"".join(x) for x in self.cache.values_of(texts)]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for; an unknown id raises IndexError."""
        ids = np.frombuffer(ids, "<u4")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - ends + sizes, sizes)
        return self.pool[at + np.arange(len(at))].tobytes()

    def char_starts(self, text: str, ids: bytes) -> np.ndarray:
        """The code point in which each token starts; tokens of a split character share it."""
        sizes = self.sizes[np.frombuffer(ids, "<u4")]
        data = np.frombuffer(text.encode(), np.uint8)
        chars = np.cumsum((data & 0xC0) != 0x80) - 1
        return chars[np.cumsum(sizes) - sizes].astype(np.int32)


@lru_cache(maxsize=2)
def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    return Codec(path, pattern)


def _ids(blobs: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(b) // 4 for b in blobs)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(blobs), np.int32)))


def encode_texts(docs: DataFrame, text_col: str = "text", path: str | None = None, offsets: bool = False) -> DataFrame:
    """Add ``n_tokens`` and ``ids`` (and ``starts``: the code point where each token starts).

    Null or empty text: no ids. Repeated rows and long texts are encoded like any other; an empty
    table gives an empty one. Columns of the input named like a new one are replaced.
    """

    def run(texts: list[str]) -> list[pa.Array]:
        own = codec(path)
        blobs = own.encode(texts)
        arrays = [pa.array([len(b) // 4 for b in blobs], pa.int64()), _ids(blobs)]
        if offsets:
            starts = [own.char_starts(t, b).tobytes() for t, b in zip(texts, blobs)]
            arrays.append(_ids(starts))
        return arrays

    return map_texts(docs, run, "n_tokens long, ids array<int>" + ", starts array<int>" * offsets, text_col)


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Add ``decoded`` (binary) and ``decoded_text`` to a table with ``ids``.

    A null or empty list decodes to nothing. Ids that end inside a character leave its bytes in
    ``decoded``; ``decoded_text`` has U+FFFD for them.
    """
    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    ship(encoded.sparkSession)
    kept = [c for c in encoded.columns if c.lower() not in ("decoded", "decoded_text")]
    source = encoded.select(*kept)
    out = StructType([*source.schema, StructField("decoded", BinaryType()), StructField("decoded_text", StringType())])

    def run(batches):
        for batch in batches:
            lists = batch.column(kept.index("ids"))
            values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")  # nulls have no values
            ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()])
            data = [codec(path).decode(values[lo:hi].tobytes()) for lo, hi in zip(ends[:-1], ends[1:])]
            columns = [*batch.columns, pa.array(data, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in data])]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return source.mapInArrow(run, out)


def round_trip(docs: DataFrame, text_col: str = "text", path: str | None = None, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Encode each text and decode its ids: ``n_tokens`` and the digests of ids and decoded bytes (and ``ids``).

    Both directions run in one task, on slices of texts of a bounded size.
    """

    def run(texts: list[str]) -> list[pa.Array]:
        own = codec(path)
        blobs = own.encode(texts)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        arrays = [
            pa.array([len(b) // 4 for b in blobs], pa.int64()),
            pa.array([digest(b) for b in blobs]),
            pa.array([digest(own.decode(b)) for b in blobs]),
        ]
        return arrays + [_ids(blobs)] * with_ids

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_texts(docs, run, schema, text_col, keep)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, keep=["doc_id"])
