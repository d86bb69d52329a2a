"""Byte strings of 50 that an earlier document has: removal by partitioned suffix sorting.

Texts are packed into chunks. In each run of 35 grams of 16 bytes the gram with the least hash is
an anchor, so equal 50-byte strings have equal anchors at equal places, and consecutive strings
with one anchor, cut in two at most, form a piece; 32 bytes around its anchor are its key. Keys that two documents
have are found from their hashes alone; only their pieces travel, each once a chunk. The pieces of
a key meet in one bucket, where the suffixes of each piece are sorted to a depth of 50: multikey quicksort by 8-byte characters to a
shallow depth, then a blind trie for each group that still has a long common prefix and isn't one
string. Each class of equal strings takes its least document, and the chunks get back which strings of each piece to remove.

A key that very many pieces have, such as a line that stands in ever-new contexts, doesn't gather them in one bucket: its pieces
are split into their single strings, which go to the buckets of their own hashes. Equal strings still meet, and no bucket gets the whole key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

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

WIDTH, GRAM, KEY, SHALLOW = 50, 16, 32, 32
REST = 31  # bits of a key that its bucket's rows hold
SET, ROW = 8, 16_384  # chunks that share rows: so many at most, and so many that a row is of that many bytes of text
FEW = 64  # pieces of a key in a chunk that count as one
MASKS, STRINGS, HOT = range(3)  # what a chunk gets back: places in pieces, single strings, the keys whose pieces are split
LAST = np.iinfo(np.int64).max  # what a null id counts as


def _zip(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def anchors(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of concatenated texts: key, anchor, first and last string start, text number.

    A string that reaches 32 bytes past the start of its anchor is keyed by these bytes, any other
    by the gram and the 16 bytes before it; so the key of a piece hashes 32 bytes that all its strings share.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WIDTH:
        return none.astype(np.uint64), none, none, none, none
    eight = np.ndarray((n - 7,), "<u8", data, strides=(1,))
    h = eight[: n - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15) ^ eight[8 : n - GRAM + 9] * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64)
    span, size = WIDTH - GRAM + 1, 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if span > size:
        low = np.minimum(low[: -(span - size)], low[span - size :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(lengths)
    starts = np.flatnonzero(np.repeat(ends, lengths)[: len(at)] - np.arange(len(at)) >= WIDTH)
    if not len(starts):
        return none.astype(np.uint64), none, none, none, none
    at = at[starts]
    cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (np.diff(starts) != 1)])
    first, last, at = starts[cut], starts[np.r_[cut[1:], len(starts)] - 1], at[cut]
    turn = WIDTH - KEY  # strings that begin this far before their anchor, or less, hold the whole key after it
    right, left = np.flatnonzero(at - last <= turn), np.flatnonzero(at - first > turn)
    key = np.concatenate([_key(eight, at[right], 1), _key(eight, at[left] - (KEY - GRAM), 2)])
    first, last = np.r_[np.maximum(first, at - turn)[right], first[left]], np.r_[last[right], np.minimum(last, at - turn - 1)[left]]
    return key, np.r_[at[right], at[left]], first, last, np.searchsorted(ends, first, side="right")


def _key(eight: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the 32 bytes at each place."""
    h = np.full(len(at), seed, np.uint64)
    for off in range(0, KEY, 8):
        h = (h ^ eight[at + off]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def _pack(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """Chunks of whole texts: ``cid``, ``n``, ids, lengths and bytes, compressed, and which ids are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, none = batch.column(0).fill_null(LAST).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for start, texts in texts_of(batch.column(1), chunk_bytes):
                blobs = [t.encode() for t in texts]
                sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
                own, gone = ids[start : start + len(texts)], none[start : start + len(texts)]
                cid += max(1, int(sizes.sum()) // chunk_bytes)  # a long text takes more numbers, so a set of chunks is of bounded size
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([cid], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), pa.array([own.tobytes()], pa.binary()),
                        pa.array([sizes.tobytes()], pa.binary()), pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(blobs))], pa.binary()),
                        pa.array([gone.tobytes()], pa.binary()),
                    ],
                    names=["cid", "n", "ids", "sizes", "blob", "none"],
                )

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return source.mapInArrow(run, "cid long, n long, ids binary, sizes binary, blob binary, none binary")


def _unpack(ids: bytes, sizes: bytes, blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    return np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), zstandard.ZstdDecompressor().decompress(blob)


def _opened(chunks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bytes, list[np.ndarray]]:
    """Ids, lengths, bytes and pieces of a set of chunks as if it were one chunk; anchors are found a chunk at a time, which bounds the memory."""
    texts, pieces, place, number = [], [], 0, 0
    for packed in zip(chunks["ids"], chunks["sizes"], chunks["blob"]):
        ids, sizes, data = _unpack(*packed)
        h, at, first, last, text = anchors(data, sizes)
        texts.append((ids, sizes, data))
        pieces.append((h, at + place, first + place, last + place, text + number))
        place, number = place + len(data), number + len(sizes)
    ids, sizes, data = zip(*texts)
    return np.concatenate(ids), np.concatenate(sizes), b"".join(data), [np.concatenate(x) for x in zip(*pieces)]


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys are adjacent, and where each run of equals begins."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(change)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else []
    for rows in np.split(order, cuts[1:]) if len(order) else []:
        yield int(bucket[rows[0]]), rows


def _short(h: np.ndarray, buckets: int) -> np.ndarray:
    """What stands for a key: its bucket, then ``REST`` bits.

    Keys of one bucket are told apart by these bits alone, and a bucket is of ``bucket_bytes`` of text at any size of the table,
    so 4 bytes do at any size; two keys that agree only make pieces travel in vain.
    """
    return h % np.uint64(buckets) << np.uint64(REST) | h >> np.uint64(64 - REST)


def _hashes_of(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Each distinct key of a chunk by bucket, in 4 bytes, the lowest bit set if two texts of the chunk have it. Chunks of one set share their rows.

    A key with 64 pieces or more is sent once more for each 64, so that the number of rows tells how many pieces it has.
    """
    for cid, group in groupby((row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(5)))), key=lambda row: row[0]):
        values, places = [], []
        for _, _, *packed in group:
            ids, sizes, data = _unpack(*packed)
            h, _, _, _, text = anchors(data, sizes)
            order, begin = _grouped(h)
            low, high = (f.reduceat(ids[text[order]], begin) if len(begin) else ids[:0] for f in (np.minimum, np.maximum))
            short, times = _short(h[order][begin], buckets), 1 + np.diff(np.r_[begin, len(order)]) // FEW
            values.append(np.repeat((short << np.uint64(1) | (low < high).astype(np.uint64)).astype("<u4"), times))
            places.append(np.repeat((short >> np.uint64(REST)).astype(np.int64), times))
        value = np.concatenate(values)
        rows = [(b, cid, value[r].tobytes()) for b, r in _by_bucket(np.concatenate(places))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
            names=["bucket", "cid", "hashes"],
        )


def _shared(g: pd.DataFrame, split: int) -> pd.DataFrame:
    """For each chunk the hashes of a bucket that two documents have, and in full those that have more than ``split`` rows."""
    bucket, parts = int(g["bucket"].iloc[0]), [np.frombuffer(x, "<u4") for x in g["hashes"]]
    value = np.concatenate(parts)
    order, begin = _grouped(value >> 1)
    counts = np.diff(np.r_[begin, len(order)])
    many = counts > 1
    many |= np.add.reduceat((value[order] & 1).astype(np.int64), begin) > 0
    yes, hot = np.zeros(len(value), bool), np.zeros(len(value), bool)
    yes[order], hot[order] = np.repeat(many, counts), np.repeat(many & (counts > split), counts)
    out, cuts = [], np.cumsum([*map(len, parts)])[:-1]
    for cid, part, keep, top in zip(g["cid"], parts, np.split(yes, cuts), np.split(hot, cuts)):
        if keep.any():
            rest, most = (np.unique(part[x] >> 1) for x in (keep, top))
            out.append((cid, bucket, rest.tobytes(), _in_full(bucket, most).tobytes()))
    return pd.DataFrame(out, columns=["cid", "bucket", "hashes", "hot"])


def _in_full(bucket: int, rest: np.ndarray) -> np.ndarray:
    """Hashes of one bucket as ``_short`` gives them."""
    return np.uint64(bucket << REST) | rest.astype("<u8")


def _strings(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The piece of each single string of some pieces, and where it starts."""
    count = last - first + 1
    piece = np.repeat(np.arange(len(count)), count)
    return piece, first[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)


def _pieces_of(chunk: pd.DataFrame, shared: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """The distinct pieces of a chunk whose keys are shared, by bucket; single strings instead where the key is hot."""
    out = []
    if len(chunk) and len(shared):
        ids, _, data, pieces = _opened(chunk)
        short = _short(pieces[0], buckets)
        hot = np.isin(short, np.frombuffer(b"".join(shared["hot"]), "<u8"))
        some = np.isin(short, np.concatenate([_in_full(b, np.frombuffer(x, "<u4")) for b, x in zip(shared["bucket"], shared["hashes"])])) & ~hot
        for split, chosen in ((False, some), (True, hot)):
            h, at, first, last, text = (x[chosen] for x in pieces)
            if split:
                piece, first = _strings(first, last)
                h, at, last, text = h[piece], at[piece], first, text[piece]
            ph = xxh64(data, first, last - first + WIDTH)
            order, begin = _grouped(h, ph)
            low = np.minimum.reduceat(ids[text[order]], begin) if len(begin) else ids[:0]
            pick = order[begin]
            for b, r in _by_bucket(((ph if split else h)[pick] % np.uint64(buckets)).astype(np.int64)):
                p = pick[r]
                rel, count = (at[p] - first[p]).astype(np.uint8), (last[p] - first[p] + 1).astype(np.uint8)
                body = np.frombuffer(b"".join([data[i : j + WIDTH] for i, j in zip(first[p].tolist(), last[p].tolist())]), np.uint8)
                out.append((b, chunk["cid"].iloc[0], split, len(p), _zip(low[r], rel, count, body)))  # keys follow from the bytes
    return pd.DataFrame(out, columns=["bucket", "cid", "split", "n", "pieces"])


class BlindTrie:
    """A trie of strings of one length that keeps branching places only; finds which strings are equal."""

    def __init__(self) -> None:
        self.root = None  # a leaf: (string, class); a node: [depth, {byte: child}]
        self.classes = 0

    def add(self, s: bytes) -> int:
        """The class of ``s``: strings of one class are equal."""
        node = self.root
        if node is None:
            self.root = (s, 0)
            self.classes = 1
            return 0
        path = []
        while isinstance(node, list):  # blind: only branching bytes are looked at
            path.append(node)
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == s:
            return node[1]
        depth = next(i for i, (a, b) in enumerate(zip(s, other)) if a != b)
        leaf = (s, self.classes)
        self.classes += 1
        above = [x for x in path if x[0] <= depth]
        if above and above[-1][0] == depth:
            above[-1][1][s[depth]] = leaf
            return leaf[1]
        below = path[len(above)] if len(above) < len(path) else node
        fresh = [depth, {other[depth]: below, s[depth]: leaf}]
        if above:
            above[-1][1][other[above[-1][0]]] = fresh
        else:
            self.root = fresh
        return leaf[1]


def equal_strings(data: bytes, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Classes of equal strings of 50 bytes that begin at ``start``, among those of one ``group``."""
    eight = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    label = np.unique(group, return_inverse=True)[1]
    live = np.arange(len(start))
    top = int(label.max()) + 1 if len(label) else 0
    for depth in range(0, SHALLOW, 8):  # multikey quicksort: one 8-byte character of the groups that are left
        order, begin = _grouped(label[live], eight[start[live] + depth])
        counts = np.diff(np.r_[begin, len(order)])
        label[live[order]] = top + np.repeat(np.arange(len(begin)), counts)
        top += len(begin)
        live = live[order[np.repeat(counts > 1, counts)]]
        if not len(live):
            return label
    order, begin = _grouped(label[live])
    live = live[order]
    counts = np.diff(np.r_[begin, len(live)])
    lead = np.repeat(live[begin], counts)
    differs = np.zeros(len(live), bool)
    for depth in (SHALLOW, SHALLOW + 8, WIDTH - 8):
        differs |= eight[start[live] + depth] != eight[start[lead] + depth]
    for k in np.flatnonzero(np.add.reduceat(differs.astype(np.int64), begin)):
        rows, trie = live[begin[k] : begin[k] + counts[k]], BlindTrie()
        label[rows] = [top + trie.add(data[i + SHALLOW : i + WIDTH]) for i in start[rows].tolist()]
        top += trie.classes
    return label


def _removals(g: pd.DataFrame) -> pd.DataFrame:
    """For each chunk the pieces of a bucket with strings that an earlier document has, as a mask of places."""
    fields = [np.int64, np.uint8, np.uint8]
    parts, bodies = [[] for _ in fields], []
    for n, packed in zip(g["n"], g["pieces"]):
        raw = zstandard.ZstdDecompressor().decompress(packed)
        at = 0
        for k, kind in enumerate(fields):
            parts[k].append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        bodies.append(raw[at:])
    own, rel, count = map(np.concatenate, parts)
    size = count.astype(np.int64) + WIDTH - 1
    place = np.cumsum(size) - size
    data = b"".join(bodies) + bytes(8)
    ph = xxh64(data, place, size)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    right = rel <= WIDTH - KEY
    h = np.where(right, _key(eight, np.where(right, place + rel, 0), 1), _key(eight, np.where(right, 0, place + rel - (KEY - GRAM)), 2))
    order, begin = _grouped(h, ph)
    low = np.minimum.reduceat(own[order], begin)
    piece = np.empty(len(h), np.int64)  # which distinct piece a row is
    piece[order] = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(order)]))
    pick = order[begin]
    _, anchor = np.unique(h[pick], return_inverse=True)
    several = np.flatnonzero(np.bincount(anchor)[anchor] > 1)  # distinct pieces that share their anchor
    counts = count[pick].astype(np.int64)
    strings = np.cumsum(counts) - counts
    least = np.repeat(low, counts)
    if len(several):
        step = np.arange(counts[several].sum()) - np.repeat(np.cumsum(counts[several]) - counts[several], counts[several])
        which = np.repeat(several, counts[several])
        group = anchor[which] * 64 + (rel[pick[which]] - step)
        label = equal_strings(data, place[pick[which]] + step, group)
        srt, cut = _grouped(label)
        best = np.minimum.reduceat(low[which][srt], cut)
        least[(strings[which] + step)[srt]] = np.repeat(best, np.diff(np.r_[cut, len(srt)]))
    rows = count.astype(np.int64)
    step = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
    gone = least[np.repeat(strings[piece], rows) + step] < np.repeat(own, rows)
    mask = np.add.reduceat(gone.astype(np.uint64) << step.astype(np.uint64), np.cumsum(rows) - rows)
    out, at = [], 0
    for cid, split, n in zip(g["cid"], g["split"], g["n"]):
        some = np.flatnonzero(mask[at : at + n]) + at
        if len(some):
            out.append((cid, STRINGS if split else MASKS, _zip(ph[some], mask[some])))
        at += n
    return pd.DataFrame(out, columns=["cid", "kind", "found"])


def _known(found: pd.DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order, each with its mask."""
    raw = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint64).reshape(2, -1) for x in found["found"][found["kind"] == kind]]
    known, value = np.concatenate([np.zeros((2, 0), np.uint64), *raw], axis=1)
    order = np.argsort(known)
    return known[order], value[order]


def _gone(h: np.ndarray, ph: np.ndarray, owner: np.ndarray, known: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The mask of each piece: what came back for it, and all of it where an earlier document of the chunk has the same piece."""
    mask = np.zeros(len(h), np.uint64)
    if len(known):
        at = np.minimum(np.searchsorted(known, ph), len(known) - 1)
        mask = np.where(known[at] == ph, value[at], mask)
    if len(h):
        order, begin = _grouped(h, ph)
        runs = np.diff(np.r_[begin, len(order)])
        later = np.zeros(len(h), bool)
        later[order] = owner[order] > np.repeat(np.minimum.reduceat(owner[order], begin), runs)
        mask = np.where(later, np.uint64(2**64 - 1), mask)
    return mask


def _rows(data: bytes, sizes: np.ndarray, first: np.ndarray, last: np.ndarray, mask: np.ndarray, with_bytes: bool) -> list[tuple]:
    """What is left of each text of a chunk without the strings that the masks of its pieces name."""
    string = np.zeros(len(data) + 1, np.int64)
    piece, place = _strings(first, last)
    string[place[(mask[piece] >> (place - first[piece]).astype(np.uint64) & np.uint64(1)) > 0]] = 1
    total = np.cumsum(string)
    covered = total.copy()
    covered[WIDTH:] -= total[:-WIDTH]
    covered = covered[: len(data)] > 0
    ends = np.cumsum(sizes)
    opens = covered.copy()
    opens[1:] &= ~covered[:-1]
    starts = (ends - sizes)[sizes > 0]
    opens[starts] = covered[starts]
    n_gone, n_open = np.r_[0, np.cumsum(covered)], np.r_[0, np.cumsum(opens)]
    body = np.frombuffer(data, np.uint8)
    out = []
    for lo, hi in zip((ends - sizes).tolist(), ends.tolist()):
        removed = int(n_gone[hi] - n_gone[lo])
        kept = data[lo:hi] if not removed else body[lo:hi][~covered[lo:hi]].tobytes()
        row = (hi - lo, removed, int(n_open[hi] - n_open[lo]), hashlib.sha256(kept).hexdigest())
        out.append(row + (kept,) * with_bytes)
    return out


def _cleaned(chunk: pd.DataFrame, found: pd.DataFrame, buckets: int, with_bytes: bool) -> pd.DataFrame:
    """The rows of the documents of a set of chunks."""
    columns = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_bytes]
    if not len(chunk):
        return pd.DataFrame(columns=columns)
    ids, sizes, data, (h, _, first, last, text) = _opened(chunk)
    hot = np.isin(_short(h, buckets), np.frombuffer(b"".join(found["found"][found["kind"] == HOT]), "<u8"))
    gone = []
    for split, chosen in ((False, ~hot), (True, hot)):
        key, f, t, owner = h[chosen], first[chosen], last[chosen], ids[text[chosen]]
        if split:
            piece, f = _strings(f, t)
            key, t, owner = key[piece], f, owner[piece]
        mask = _gone(key, xxh64(data, f, t - f + WIDTH), owner, *_known(found, STRINGS if split else MASKS))
        some = mask > 0
        gone.append((f[some], t[some], mask[some]))
    first, last, mask = map(np.concatenate, zip(*gone))
    out, at, text = [], 0, 0
    for n, own in zip(chunk["n"].tolist(), chunk["ids"]):
        here = (first >= at) & (first < at + n)
        until = text + len(own) // 8
        out += _rows(data[at : at + n], sizes[text:until], first[here] - at, last[here] - at, mask[here], with_bytes)
        at, text = at + n, until
    frame = pd.DataFrame(out, columns=columns[1:])
    frame.insert(0, "id", pd.arrays.IntegerArray(ids.copy(), np.frombuffer(b"".join(chunk["none"]), bool).copy()))
    return frame


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False, chunk_bytes: int = 1_000_000,
    bucket_bytes: int = 8_000_000, split: int = 2000,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` (and ``kept``, the bytes).

    A byte goes if a string of 50 bytes over it also begins in a document with a smaller id.
    Null text counts as empty; texts under 50 bytes lose nothing; rows with one id never remove
    from each other; a null id counts as the largest long and stays null. Ids are whole numbers; another type is refused with a
    ``TypeError``. An empty table gives an empty one; other columns are left out. A text takes some 60 bytes of memory for each of its bytes.

    Texts are worked on in chunks of ``chunk_bytes`` (or one text), and there is a bucket for each ``bucket_bytes`` of text. As buckets get
    more, up to 8 chunks share the rows that go to a bucket, lest rows get so short that they cost more than what they hold. Pieces of a
    key that more than ``split`` chunks have (64 pieces of one chunk count as another chunk) are compared string by string.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"remove_repeats: ids must be whole numbers; {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    ship(docs.sparkSession)
    chunks = materialize(_pack(docs, id_col, text_col, chunk_bytes))
    total = chunks.agg(F.sum("n")).first()[0] or 0
    buckets = max(64, total // bucket_bytes)
    together = min(SET, max(1, ROW * total // (chunk_bytes * bucket_bytes)))
    chunks = chunks.withColumn("cid", F.expr(f"cid - cid % {together}"))  # its set; chunks of a set stand one after the other
    hashes = chunks.mapInArrow(lambda it: _hashes_of(it, buckets), "bucket long, cid long, hashes binary")
    shared = materialize(hashes.groupBy("bucket").applyInPandas(lambda g: _shared(g, split), "cid long, bucket long, hashes binary, hot binary"))
    pieces = (
        chunks.groupBy("cid").cogroup(shared.groupBy("cid"))
        .applyInPandas(lambda a, b: _pieces_of(a, b, buckets), "bucket long, cid long, split boolean, n long, pieces binary")
    )
    masks = pieces.groupBy("bucket").applyInPandas(_removals, "cid long, kind int, found binary")
    found = masks.union(shared.where("length(hot) > 0").select("cid", F.lit(HOT).alias("kind"), "hot"))
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    out = chunks.groupBy("cid").cogroup(found.groupBy("cid")).applyInPandas(lambda a, b: _cleaned(a, b, buckets, with_bytes), schema)
    return materialize(out).withColumnRenamed("id", id_col)  # one plan from the stored chunks on, so both cogroups read one exchange of them


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
