"""Repeated passages: Rabin-Karp hashes of every window of words, counted in Spark.

A window is ``width`` consecutive words of one text. Texts are packed into chunks, with one space between words, so the hash of a
window is a difference of two prefix sums over bytes. Three exchanges decide which windows go:

1. every distinct window hash of a chunk goes to its bucket in under four bytes; a bucket counts them and answers each chunk with
   one bit a hash (met elsewhere, or twice in the chunk);
2. windows with a counted hash, a few of all, go again with all 64 bits of the hash, 32 bits of another hash of their bytes (XXH64)
   and where they first stand in the chunk; the bucket finds the first of all and answers with one bit a window (not the first);
3. each chunk marks the words of all windows that aren't first, merges them into maximal intervals and cuts these out.

A hot passage is one entry a chunk in both exchanges, however often its texts repeat it. What is sent once more isn't text but bits,
because both sides can derive the same order of entries. Windows count as equal if both hashes agree (96 bits, of two unlike
functions): for 10^13 windows the odds of one wrong match are about one in a thousand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import materialize, ship, texts_of
from .xxh import xxh64

SLICE = 1 << 20  # bytes that are hashed at once, or one window
BASE = 0x9E3779B97F4A7C15
COUNTED, LATER = 1, 2  # what the bits say that a chunk gets back
CHUNK = "cid long, n long, none binary, ids binary, counts binary, words binary"


def mixed(h: np.ndarray) -> np.ndarray:
    """All bits of each number spread over the whole of it (a bijection)."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2^64; those of a slice are kept."""
    if n > SLICE + 1:
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]))
    if base not in _POWERS:
        _POWERS[base] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(SLICE, base, np.uint64)]))
    return _POWERS[base][:n]


def rabin_karp(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of ``data[start[i]:end[i]]`` for each i; both ascend. Equal bytes have equal hashes wherever they stand."""
    out = np.zeros(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        first = int(start[lo])
        hi = max(lo + 1, int(np.searchsorted(end, first + SLICE, side="right")))
        body = np.frombuffer(data, np.uint8, int(end[hi - 1]) - first, first)
        total = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(_BYTES[body] * _powers(BASE, len(body)), out=total[1:])
        s = start[lo:hi] - first
        out[lo:hi] = (total[end[lo:hi] - first] - total[s]) * _powers(pow(BASE, -1, 1 << 64), len(body))[s]
        lo = hi
    return mixed(out)


def _planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones: small numbers leave runs of zeros."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _of_planes(data: bytes, kind: type, n: int, at: int) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(-1), at + n * size


def _steps(x: np.ndarray) -> bytes:
    return _planes(np.diff(x, prepend=x[:0].sum(dtype=x.dtype)))


def _zip(*parts: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys are adjacent, sorted by the first key first, and where each run of equals begins."""
    order = np.lexsort(keys[::-1])
    change = np.ones(len(order), bool)
    change[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(change)


def _pack(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """Chunks of whole texts: ids, numbers of words, and all words with one space between them, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid = TaskContext.get().partitionId() << 32
        for batch in batches:
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy()
            for at, texts in texts_of(batch.column(1), chunk_bytes):
                words = [b" ".join(t.encode().split()) for t in texts]  # bytes are split at ASCII white space only
                counts = np.array([w.count(b" ") + 1 if w else 0 for w in words], np.int64)
                body = b" ".join([w for w in words if w])
                own = slice(at, at + len(texts))
                cid += 1
                row = [cid, len(body), none[own].tobytes(), ids[own].tobytes(), counts.tobytes(), _zip(body, level=6)]
                kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["cid", "n", "none", "ids", "counts", "words"])

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(run, CHUNK)


class Chunk:
    """The words of a chunk, its windows, and their hashes in an order that follows from the texts alone."""

    def __init__(self, none: bytes, ids: bytes, counts: bytes, words: bytes, width: int, bits: int) -> None:
        self.none, self.ids, self.counts = np.frombuffer(none, bool), np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int64)
        self.data, self.width, self.bits = _unzip(words), width, bits
        gaps = np.flatnonzero(np.frombuffer(self.data, np.uint8) == 32)
        self.begin = np.r_[0, gaps + 1][: self.counts.sum()]
        self.end = np.r_[gaps, len(self.data)][: self.counts.sum()]
        self.text_of = np.repeat(np.arange(len(self.counts)), self.counts)
        self.first_word = np.cumsum(self.counts) - self.counts
        at = np.arange(max(len(self.begin) - width + 1, 0))
        self.at = at[self.text_of[at] == self.text_of[at + width - 1]]  # the first word of each window
        self.h = rabin_karp(self.data, self.begin[self.at], self.end[self.at + width - 1])
        self.distinct, self.which, self.times = np.unique(self.h, return_inverse=True, return_counts=True)
        bucket = (self.distinct >> np.uint64(64 - bits)).astype(np.int64)
        self.cuts = {int(bucket[x]): (x, y) for x, y in zip(*_runs(bucket))}

    def counted(self, rows: pd.DataFrame) -> None:
        """Take the answers of the first exchange: the windows that may have an equal, in groups of equal ones.

        Of each group: hash, other hash, and the window that is first by (id, place), null ids last. Groups are ordered by
        bucket and by the place of that window.
        """
        yes = np.zeros(len(self.distinct), bool)
        for b, packed in zip(rows["bucket"], rows["answer"]):
            lo, hi = self.cuts[b]
            yes[lo:hi] = _flags(packed, hi - lo)
        self.live = np.flatnonzero(yes[self.which])
        at = self.at[self.live]
        h, start = self.h[self.live], self.begin[at]
        x = xxh64(self.data, start, self.end[at + self.width - 1] - start) & np.uint64(0xFFFFFFFF)
        text = self.text_of[at]
        order, begin = _grouped(self.none[text], self.ids[text])
        rank = np.empty(len(at), np.int64)  # of the texts' ids
        rank[order] = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(order)]))
        place = at - self.first_word[text]
        order, begin = _grouped(h, x, rank, place)
        group = _grouped(h[order], x[order])[1] if len(order) else begin  # rows are sorted by all four, so the first is the first of its group
        sizes = np.diff(np.r_[group, len(order)])
        lead = order[group]
        self.group = np.empty(len(at), np.int64)
        self.group[order] = np.repeat(np.arange(len(group)), sizes)
        self.behind = (rank != rank[lead][self.group]) | (place != place[lead][self.group])  # an earlier one is in the chunk
        bucket = (h[lead] >> np.uint64(64 - self.bits)).astype(np.int64)
        self.sent = np.lexsort((at[lead], bucket))
        lead = lead[self.sent]
        self.entries = {"h": h[lead], "x": x[lead].astype(np.uint32), "none": self.none[text[lead]], "id": self.ids[text[lead]], "place": place[lead]}
        self.sent_cuts = {int(bucket[self.sent[x]]): (x, y) for x, y in zip(*_runs(bucket[self.sent]))}

    def removed(self, rows: pd.DataFrame) -> np.ndarray:
        """Take the answers of the second exchange: which words go."""
        later = np.zeros(len(self.sent), bool)
        for b, packed in zip(rows["bucket"], rows["answer"]):
            lo, hi = self.sent_cuts[b]
            later[self.sent[lo:hi]] = _flags(packed, hi - lo)
        gone = self.at[self.live[self.behind | later[self.group]]]
        change = np.bincount(gone, minlength=len(self.begin) + 1) - np.bincount(gone + self.width, minlength=len(self.begin) + 1)[: len(self.begin) + 1]
        return np.cumsum(change)[: len(self.begin)] > 0


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins and ends."""
    begin = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]][: len(sorted_keys)])
    return begin, np.r_[begin[1:], len(sorted_keys)][: len(begin)]


def _hashes_of(batches: Iterator[pa.RecordBatch], width: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The distinct hashes of a chunk by bucket: 31 bits after those of the bucket, in order, as steps; and which the chunk has twice."""
    for batch in batches:
        for row in batch.to_pylist():
            c = Chunk(row["none"], row["ids"], row["counts"], row["words"], width, bits)
            value = (c.distinct << np.uint64(bits) >> np.uint64(33)).astype(np.uint32)
            rows = [(b, row["cid"], y - x, _zip(_steps(value[x:y]), _bits(c.times[x:y] > 1))) for b, (x, y) in c.cuts.items()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["bucket", "cid", "n", "packed"])


def _count(g: pd.DataFrame) -> pd.DataFrame:
    """For each chunk a bit a hash of the bucket: whether it was met before or again."""
    values, twice = [], []
    for n, packed in zip(g["n"], g["packed"]):
        raw = _unzip(packed)
        steps, at = _of_planes(raw, np.uint32, n, 0)
        values.append(np.cumsum(steps, dtype=np.uint32))
        twice.append(_flags(raw[at:], n))
    value = np.concatenate(values)
    order = np.argsort(value)
    begin, end = _runs(value[order])
    yes = np.concatenate(twice)
    yes[order] |= np.repeat(end - begin > 1, end - begin)
    cuts = np.cumsum(g["n"].to_numpy())[:-1]
    out = [(g["bucket"].iloc[0], cid, COUNTED, _bits(part)) for cid, part in zip(g["cid"], np.split(yes, cuts)) if part.any()]
    return pd.DataFrame(out, columns=["bucket", "cid", "kind", "answer"])


def _chunk(frame: pd.DataFrame, width: int, bits: int) -> Chunk:
    r = frame.iloc[0]
    return Chunk(r["none"], r["ids"], r["counts"], r["words"], width, bits)


def _entries_of(chunk: pd.DataFrame, answers: pd.DataFrame, width: int, bits: int) -> pd.DataFrame:
    """The groups of equal windows of a chunk that may have equals elsewhere, by bucket."""
    out = []
    if len(chunk) and len(answers):
        c = _chunk(chunk, width, bits)
        c.counted(answers)
        e = c.entries
        for b, (x, y) in c.sent_cuts.items():
            parts = [e["h"][x:y].tobytes(), e["x"][x:y].tobytes(), _bits(e["none"][x:y]), _steps(e["id"][x:y]), _steps(e["place"][x:y])]
            out.append((b, chunk["cid"].iloc[0], y - x, _zip(*parts)))
    return pd.DataFrame(out, columns=["bucket", "cid", "n", "packed"])


def _later(g: pd.DataFrame) -> pd.DataFrame:
    """For each chunk a bit an entry of the bucket: whether an equal window stands earlier, in a smaller id or before it in the same."""
    fields: list[list[np.ndarray]] = [[] for _ in range(5)]
    for n, packed in zip(g["n"], g["packed"]):
        raw = _unzip(packed)
        some, at = 12 * n, 12 * n + (n + 7) // 8
        got = [np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint32, n, 8 * n), _flags(raw[some:at], n)]
        for _ in range(2):
            steps, at = _of_planes(raw, np.int64, n, at)
            got.append(np.cumsum(steps))
        for field, part in zip(fields, got):
            field.append(part)
    h, x, none, own, place = map(np.concatenate, fields)
    order = np.lexsort((place, own, none, x, h))
    same = lambda *keys: np.all([k[order][1:] == k[order][:-1] for k in keys], axis=0)
    first = np.flatnonzero(np.r_[True, ~same(h, x)])
    sizes = np.diff(np.r_[first, len(order)])
    lead = np.repeat(order[first], sizes)
    later = np.empty(len(order), bool)
    later[order] = (none[order] != none[lead]) | (own[order] != own[lead]) | (place[order] != place[lead])
    cuts = np.cumsum(g["n"].to_numpy())[:-1]
    out = [(g["bucket"].iloc[0], cid, LATER, _bits(part)) for cid, part in zip(g["cid"], np.split(later, cuts)) if part.any()]
    return pd.DataFrame(out, columns=["bucket", "cid", "kind", "answer"])


def _cleaned(chunk: pd.DataFrame, answers: pd.DataFrame, width: int, bits: int, details: bool) -> pd.DataFrame:
    """The rows of a chunk's documents."""
    columns = ["id", "n_words", "n_removed", "kept_sha256", *["kept", "spans"] * details]
    if not len(chunk):
        return pd.DataFrame(columns=columns)
    c = _chunk(chunk, width, bits)
    gone = np.zeros(len(c.begin), bool)
    if len(answers):
        c.counted(answers[answers["kind"] == COUNTED])
        gone = c.removed(answers[answers["kind"] == LATER])
    total = np.r_[0, np.cumsum(gone)]
    out = []
    for lo, n in zip(c.first_word.tolist(), c.counts.tolist()):
        removed = int(total[lo + n] - total[lo])
        spans = _intervals(gone[lo : lo + n]) if removed else []
        if removed:
            edges = [0, *[x for first, size in spans for x in (first, first + size)], n]
            kept = b" ".join([c.data[c.begin[lo + a] : c.end[lo + b - 1]] for a, b in zip(edges[::2], edges[1::2]) if a < b])
        else:
            kept = c.data[c.begin[lo] : c.end[lo + n - 1]] if n else b""
        row = (n, removed, hashlib.sha256(kept).hexdigest())
        out.append(row + (kept.decode(), [{"first": a, "n": b} for a, b in spans]) if details else row)
    frame = pd.DataFrame(out, columns=columns[1:])
    frame.insert(0, "id", pd.arrays.IntegerArray(c.ids.copy(), c.none.copy()))
    return frame


def _intervals(gone: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of removed words: the first one and how many."""
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
    return list(zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist()))


def remove_repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, details: bool = False,
    chunk_bytes: int = 2_000_000, bucket_bytes: int = 16_000_000,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed``, ``kept_sha256`` of the kept words joined by one space.

    A word goes if a window of ``width`` words over it also starts earlier: in a row with a smaller id, or nearer the beginning
    of a row with the same id. So of a passage that one text repeats the first stays, and rows that are equal in id and text
    lose the same words and never each other's. Windows are judged on the input. Words are unchanged and parted by ASCII white
    space; they never cross rows. ``details`` adds ``kept`` (the text) and ``spans`` (``first`` word and ``n`` of each maximal removed run).

    Null text has no words; texts of fewer words than a window lose nothing; a null id counts as larger than all others; an empty
    table gives an empty one; other columns are left out. Ids are whole numbers; another type is refused with a ``TypeError``.
    A task holds a chunk of ``chunk_bytes`` characters, or one text: about 12 bytes of memory for each of its bytes and 30 a window of
    16 MB of words in a bucket. A bucket is a power of two of all, some ``bucket_bytes`` of text each.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"remove_repeated_windows: ids must be whole numbers; {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    ship(docs.sparkSession)
    chunks = materialize(_pack(docs, id_col, text_col, chunk_bytes))
    total = chunks.agg(F.sum("n")).first()[0] or 0
    bits = max(6, int(total // bucket_bytes).bit_length())
    back = "bucket long, cid long, kind int, answer binary"
    sent = "bucket long, cid long, n long, packed binary"
    hashes = chunks.mapInArrow(lambda it: _hashes_of(it, width, bits), sent)
    counted = materialize(hashes.groupBy("bucket").applyInPandas(_count, back))
    entries = chunks.groupBy("cid").cogroup(counted.groupBy("cid")).applyInPandas(lambda a, b: _entries_of(a, b, width, bits), sent)
    later = materialize(entries.groupBy("bucket").applyInPandas(_later, back))
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, spans array<struct<first:long,n:long>>" * details
    answers = counted.union(later)
    out = chunks.groupBy("cid").cogroup(answers.groupBy("cid")).applyInPandas(lambda a, b: _cleaned(a, b, width, bits, details), schema)
    return out.withColumnRenamed("id", id_col)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT rid, doc_id, i, array_to_string(ws[i:i+19], ' ') AS k FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)
), judged AS (
  SELECT rid, i, (doc_id IS NULL, coalesce(doc_id, 0), i) AS own, min((doc_id IS NULL, coalesce(doc_id, 0), i)) OVER (PARTITION BY k) AS low FROM win
), gone AS (
  SELECT DISTINCT rid, i + j AS i FROM judged, range(0, 20) AS r(j) WHERE own > low
), words AS (
  SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d
), kept AS (
  SELECT rid, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
