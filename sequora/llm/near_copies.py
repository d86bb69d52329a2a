"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash comes first: fingerprints of the shingles are linked by the Hamming balls of ``simhash_dedup``, and texts
that these links join are candidates. At that similarity fingerprints of 64 bits often differ in some ten bits, too many for Hamming balls (see the
README), so links between groups of fingerprints are looked for by the shingles themselves. No link is
missed: of two such sets with a and b shingles 9 * common >= 4 * (a + b), so both have one
of their first fifths (and one shingle) in common, in any order that all texts share. The order puts
shingles last that a sample of the texts has often; the sample changes the cost, not the result.
Texts of different groups that share such a key are compared by what can only overstate the common shingles: what is
left after the key, and bitmaps of the sets. The links of both kinds give components, and within these all
sets are compared in full. Keys and components that many texts share are dealt out in tiles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SlotFilter, components, map_texts, materialize, ship, texts_of
from .simhash_dedup import fingerprints, forest, groups, keep_one
from .xxh import xxh64

WIDTH, TILE, BITS = 5, 256, 1024
TILE_SHINGLES = 500_000  # what the sets of one side of a tile hold on average, at most, unless one text has more
FEW = 64  # rows of a key that isn't dealt in tiles
SAMPLE, OFTEN = 4_000, 4  # texts of the sample, and in how many of them a shingle comes last


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The hashes of each text's shingles, sorted; a shorter text is one shingle, one without words has none.

    A shingle's hash combines those of its words, so each word is hashed once.
    """
    words = [t.encode().lower().split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    data = b" ".join([b" ".join(w) for w in words if w])
    if not data:
        return [np.zeros(0, np.uint64) for _ in texts]
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    start = np.r_[0, gaps + 1]
    h = _word_hashes(data, start, np.r_[gaps, len(data)] - start)
    first = np.cumsum(n) - n
    at = np.arange(len(h)) - np.repeat(first, n)
    own = np.repeat(n, n)
    sums = np.zeros(len(h), np.uint64)
    for k in range(WIDTH):
        there = at + k < own
        sums[: len(h) - k] = np.where(there[: len(h) - k], sums[: len(h) - k] * MIX + h[k:], sums[: len(h) - k])
    sums = (sums ^ sums >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    sums ^= sums >> np.uint64(32)
    starts = (at == 0) | (at + WIDTH <= own)
    ends = np.cumsum(np.where(n > 0, np.maximum(n - WIDTH + 1, 1), 0))
    return [_distinct(x) for x in np.split(sums[starts], ends[:-1])]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([x[:1] == x[:1], x[1:] != x[:-1]])]


MIX = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def _word_hashes(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each word: one step if it has eight bytes or fewer."""
    eight = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    h = (eight[start] & _MASK[np.minimum(size, 8)] ^ size.astype(np.uint64) << np.uint64(56)) * MIX
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    long = np.flatnonzero(size > 8)
    if len(long):
        h[long] = xxh64(data, start[long], size[long])
    return h


def _signatures(sets: list[np.ndarray]) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]


def _bitmap(s: np.ndarray) -> bytes:
    """Four bits a shingle or more, a power of two; folding its halves gives the bitmap of half the size."""
    size = max(BITS, 1 << (4 * len(s) - 1).bit_length()) if len(s) else BITS
    bits = np.zeros(size, bool)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _folded(bits: bytes, size: int) -> np.ndarray:
    """The bitmap at a size in bytes that is no larger."""
    out = np.frombuffer(bits, np.uint64)
    while out.nbytes > size:
        out = out[: len(out) // 2] | out[len(out) // 2 :]
    return out


def add_signatures(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, with_sets: bool = False) -> DataFrame:
    """Add ``fp``, a hash of the set of shingles; also the set's size ``n`` and bitmap ``bits`` and the text's SimHash ``print`` if asked for."""

    def run(texts: list[str]) -> list[pa.Array]:
        sets = shingle_sets(texts)
        more = [pa.array([*map(len, sets)], pa.int64()), pa.array([*map(_bitmap, sets)], pa.binary()), pa.array(fingerprints(texts, WIDTH), pa.int64())] if with_sets else []
        return [pa.array(_signatures(sets), pa.int64()), *more]

    return map_texts(docs, run, "fp long" + ", n long, bits binary, print long" * with_sets, text_col, keep)


def _six(s: np.ndarray) -> bytes:
    """A set in six bytes a shingle."""
    return s.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _eight(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _of_texts(docs: DataFrame, text_col: str, fn: Callable[[list[np.ndarray]], pa.RecordBatch], schema: str) -> DataFrame:
    """Rows of another number than the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in texts_of(batch.column(0)):
                yield fn(shingle_sets(texts))

    return docs.select(F.col(f"`{text_col}`")).mapInArrow(run, schema)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _frequent(docs: DataFrame, text_col: str, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample have, sorted, and how many."""

    def count(sets: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(sets), return_counts=True)
        return pa.RecordBatch.from_arrays([_signed(h), pa.array(n, pa.int64())], names=["h", "n"])

    some = docs.where(F.pmod(F.xxhash64(f"`{text_col}`"), F.lit(max(1, total // SAMPLE))) == 0)
    found = _of_texts(some, text_col, count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    rows = found.orderBy(F.desc("n"), "h").limit(100_000).collect()
    h, n = np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(sets: list[np.ndarray], often: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """The first fifth and one more of each set's shingles, in the common order: by how often the sample has them, then by value."""
    if not len(often):
        return [s[: len(s) // 5 + 1] for s in sets]
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    at = np.minimum(np.searchsorted(often, flat), len(often) - 1)
    ranks = np.split(np.where(often[at] == flat, count[at], 0), np.cumsum([*map(len, sets)])[:-1]) if sets else []
    return [s[np.argsort(r, kind="stable")[: len(s) // 5 + 1]] for s, r in zip(sets, ranks)]


def _enough(a, b):
    """The least number of common shingles of sets of these sizes."""
    return (4 * (a + b) + 8) // 9


def _runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in runs that agree in the first columns, with the ends of the runs; rows come sorted, a run is bounded."""
    rest = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        rest = part if rest is None else pa.concat_tables([rest, part]).combine_chunks()
        keys = np.array([rest.column(i).to_numpy() for i in range(columns)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if len(cuts):
            yield rest.slice(0, cuts[-1]), cuts
            rest = rest.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest, np.array([rest.num_rows])


def _possible(rows: pa.Table, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of one run, as far as sizes and places allow them, and how many shingles they must share."""
    n, at = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "at"))
    left = n - at
    end = np.repeat(ends, np.diff(np.r_[0, ends]))
    i, step = np.arange(len(n)), 0
    while len(i):  # all pairs at one distance in the order of the rows
        step += 1
        i = i[i + step < end[i]]
        j = i + step
        need = _enough(n[i], n[j])
        some = np.minimum(left[i], left[j]) >= need  # the first common key has all others after it
        yield i[some], j[some], need[some]


def _candidates(rows: pa.Table, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one tile that are of different groups of fingerprints and whose bitmaps allow that they are similar."""
    n, own, low = (rows.column(c).to_numpy() for c in ("n", "own", "low"))
    bits = rows.column("bits").to_pylist()
    size = np.array([*map(len, bits)])
    folded = {}  # bitmaps at each size, of the rows that have this size or a larger one
    for one in np.unique(size).tolist():
        place = np.full(len(n), -1)
        place[size >= one] = np.arange((size >= one).sum())
        folded[one] = (place, np.array([_folded(b, one) for b in bits if len(b) >= one]))
    cross = rows.column("x").to_numpy() != rows.column("y").to_numpy()  # such a tile has the pairs between two blocks
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j, need in _possible(rows, ends):
        some = ~(cross[i] & (own[i] == own[j])) & (low[i] != low[j])
        i, j, need = i[some], j[some], need[some]
        least = np.minimum(size[i], size[j])
        for one, (place, table) in folded.items():
            which = np.flatnonzero(least == one)
            for part in np.array_split(which, len(which) * one // 4_000_000 + 1):
                a, b = i[part], j[part]
                x, y = table[place[a]], table[place[b]]
                yes = np.minimum(n[a] - np.bitwise_count(x & ~y).sum(axis=1), n[b] - np.bitwise_count(y & ~x).sum(axis=1)) >= need[part]
                found_i.append(a[yes])
                found_j.append(b[yes])
    return np.concatenate(found_i), np.concatenate(found_j)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Possible pairs of the rows of each key, every pair once a batch."""
    for rows, ends in _runs(batches, 1):
        fp = rows.column("fp").to_numpy()
        i, j = (np.concatenate(x) for x in zip(*((a, b) for a, b, _ in _possible(rows, ends))))
        low, high = np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j])
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(low[new], pa.int64()), pa.array(high[new], pa.int64())], names=["a", "b"])


def _allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that their bitmaps allow."""
    for batch in batches:
        some = []
        for k, (na, nb, x, y) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(2, 6)))):
            x, y = _folded(x, min(len(x), len(y))), _folded(y, min(len(x), len(y)))
            both = np.bitwise_count(x & y)
            common = min(na - int(np.bitwise_count(x).sum() - both.sum()), nb - int(np.bitwise_count(y).sum() - both.sum()))
            if common >= _enough(na, nb):
                some.append(k)
        yield batch.select(["a", "b"]).take(pa.array(some, pa.int64()))


def _similar(rows: pa.Table, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one run whose sets are similar."""
    found = [np.zeros((2, 0), np.int64)]
    for lo, hi in zip([0, *ends.tolist()], ends.tolist()):
        if hi - lo > 1:
            found.append(np.array(_similar_sets([_eight(x) for x in rows.column("shingles").slice(lo, hi - lo).to_pylist()])) + lo)
    i, j = np.concatenate(found, axis=1)
    return i, j


def _similar_sets(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([*map(len, sets)])
    h, of = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    several = np.bincount(of)[of] > 1
    h, of = np.unique(of[several], return_inverse=True)
    owner, common = owner[several], np.zeros((len(sets), len(sets)), np.int64)
    order = np.argsort(of, kind="stable")
    of, owner = of[order], owner[order]
    for low in range(0, len(h), 4096):
        lo, hi = np.searchsorted(of, (low, low + 4096))
        has = np.zeros((len(sets), min(4096, len(h) - low)), np.float32)
        has[owner[lo:hi], of[lo:hi] - low] = 1
        common += (has @ has.T).astype(np.int64)
    return np.nonzero(np.triu(common >= _enough(n[:, None], n), 1))


def _blocks(rows: DataFrame, key: str, weight: Column | None = None) -> DataFrame:
    """How many blocks each key with two rows or more is dealt in."""
    sizes = F.count("*") / TILE if weight is None else F.greatest(F.count("*") / TILE, F.sum(weight) / TILE_SHINGLES)
    return materialize(rows.groupBy(key).agg(F.count("*").alias("rows"), F.ceil(sizes).cast("int").alias("blocks")).where("rows > 1").select(key, "blocks"))


def _tiled(rows: DataFrame, key: str, pairs: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``(a, b)``: forests of the pairs among the rows (with ``fp`` and ``blocks``) of each key, in tiles of a bounded size."""
    others = [c for c in rows.columns if c not in (key, "blocks")]
    own = F.pmod(F.xxhash64("fp"), "blocks")
    dealt = rows.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = dealt.select(key, F.least("own", "other").cast("long").alias("x"), F.greatest("own", "other").cast("long").alias("y"), "own", *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ends in _runs(batches, 3):
            i, j = pairs(part, ends)
            fps, place = np.unique(part.column("fp").to_numpy()[np.r_[i, j]], return_inverse=True)
            a, b = forest(place[: len(i)], place[len(i) :], len(fps))
            yield pa.RecordBatch.from_arrays([pa.array(fps[a], pa.int64()), pa.array(fps[b], pa.int64())], names=["a", "b"])

    return tiles.repartition(key, "x", "y").sortWithinPartitions(key, "x", "y").mapInArrow(run, "a long, b long").distinct()


def print_groups(signed: DataFrame) -> DataFrame:
    """``(fp, low)``: the sets of each group of linked SimHash fingerprints with the least of them; a set of several fingerprints has a row each."""
    own = materialize(signed.select("fp", "print").distinct())
    found = groups(own.select(F.col("fp").alias("set"), F.col("print").alias("fp")), "set").select(F.col("fp").alias("print"), F.col("component_id").alias("low"))
    return materialize(own.join(found, "print").select("fp", "low").distinct())


def links(docs: DataFrame, signed: DataFrame, text_col: str = "text") -> DataFrame:
    """``(a, b)``: links between sets (``fp``) whose transitive closure is that of all links.

    ``signed`` has ``fp``, ``n``, ``bits`` and ``print`` of all rows of ``docs``.
    """
    ship(docs.sparkSession)
    near = print_groups(signed)
    often, count = _frequent(docs, text_col, signed.count())

    def keys(sets: list[np.ndarray]) -> pa.RecordBatch:
        first = prefixes(sets, often, count)
        n = np.array([*map(len, first)], np.int64)
        fp = np.repeat(np.array(_signatures(sets), np.int64), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        size = np.repeat(np.array([*map(len, sets)], np.int64), n)
        arrays = [_signed(np.concatenate(first)), pa.array(fp, pa.int64()), pa.array(at, pa.int32()), pa.array(size, pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "fp", "at", "n"])

    schema = "key long, fp long, at int, n int"
    seen = _of_texts(docs, text_col, keys, schema).groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count("*").alias("m"))
    shared = materialize(seen.where("low < high").select("key", (F.col("m") > FEW).alias("hot")))
    known = SlotFilter(shared, "key")

    def shared_keys(sets: list[np.ndarray]) -> pa.RecordBatch:
        batch = keys(sets)
        return batch.filter(pa.array(known(batch.column(0).to_numpy())))

    keyed = _of_texts(docs, text_col, shared_keys, schema)
    members = materialize(keyed.join(shared, "key").groupBy("key", "fp", "n", "hot").agg(F.min("at").alias("at")))  # copies of a text are one row
    lows = near.groupBy("fp").agg(F.min("low").alias("low"))  # sets of one ``low`` are candidates already
    sizes = materialize(signed.groupBy("fp").agg(F.min("n").alias("n"), F.min("bits").alias("bits")).join(lows, "fp"))
    # A key of few texts gives its pairs, a bounded number a row; one of many is dealt in tiles, which give forests.
    few = members.where("NOT hot").select("key", "fp", "at", "n")
    pairs = materialize(few.repartition("key").sortWithinPartitions("key").mapInArrow(_pairs, "a long, b long").distinct())
    side = lambda k: sizes.select(F.col("fp").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}"), F.col("low").alias(f"low{k}"))
    few = pairs.join(side("a"), "a").join(side("b"), "b").where("lowa <> lowb").select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(_allowed, "a long, b long")
    hot = members.where("hot").select("key", "fp", "at")
    many = _tiled(hot.join(_blocks(hot, "key"), "key").join(sizes, "fp"), "key", _candidates)
    found = materialize(few.union(many).union(near.where("fp <> low").select("fp", "low")))
    comp = components(found)
    comp = comp.select(F.col("node").alias("fp"), "root").union(comp.select("root", "root")).distinct()
    comp = materialize(comp.join(sizes.select("fp", "n"), "fp"))
    comp = materialize(comp.join(_blocks(comp, "root", F.col("n")), "root"))
    wanted = SlotFilter(comp, "fp")

    def whole(sets: list[np.ndarray]) -> pa.RecordBatch:
        fps = np.array(_signatures(sets), np.int64)
        some = np.flatnonzero(wanted(fps))
        return pa.RecordBatch.from_arrays([pa.array(fps[some], pa.int64()), pa.array([_six(sets[i]) for i in some], pa.binary())], names=["fp", "shingles"])

    sets = _of_texts(docs, text_col, whole, "fp long, shingles binary").dropDuplicates(["fp"]).join(comp.select("root", "fp", "blocks"), "fp")
    return _tiled(sets, "root", _similar)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the least id of each component of links, whole.

    Texts without words are copies of each other. A component whose ids are all null keeps one of its rows.
    """
    hashed = docs.select(F.col(f"`{id_col}`").alias("_sq_own_id"), F.col(f"`{text_col}`").alias("_sq_own_text"), F.xxhash64(f"`{text_col}`").alias("_sq_h"))
    signed = materialize(add_signatures(hashed, "_sq_own_text", keep=["_sq_own_id", "_sq_h"], with_sets=True))  # sets are made anew rather than stored
    ids = signed.select(F.col("_sq_own_id").alias(id_col), "fp", "_sq_h")
    return keep_one(docs, ids, groups(ids, id_col, lambda _: links(docs, signed, text_col)), id_col, text_col)
