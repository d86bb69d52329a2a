"""Groups of spelling variants: Bloom-guided neighbourhoods over the vocabulary of all texts.

The vocabulary is counted in compiled code. Of two words that differ by one code point one follows from the other by a deletion,
or by a replacement with a larger code point; so only these edits are generated. An edit's hash follows from the word's prefix sums, without making the string.
Edits are tested against Bloom filters of the vocabulary, a shard for each length, whose blocks are words of 64 bits: one
look-up an edit. What passes is sent as two hashes and joined to the vocabulary's hashes, which removes false positives; the strings
themselves are then compared, which removes equal hashes of unequal words.

The filters are broadcast in passes of a fixed size, so a larger vocabulary means more passes, each over the words whose edits can
fall into its shards, and not a larger broadcast or a fuller filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, ship
from .substring_dedup import BASE, mixed

LETTER = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_A_WORD, PROBES = 16, 4
LONGEST = 64  # words of this length or more share a shard
INVERSE = np.uint64(pow(BASE, -1, 1 << 64))


def noisy_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, least_len: int = 1) -> DataFrame:
    """``(word)``: each run of letters in lower case (A-Z only), a code point less where ``every`` divides the CRC of ``<id>:<run>``.

    Runs of fewer than ``least_len`` letters are left out. A null id counts as an empty string, null text has no runs.
    """
    runs = F.regexp_extract_all(F.translate(F.col(f"`{text_col}`"), UPPER, LOWER), F.lit(f"{LETTER}{{{least_len},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_len: int = 5, least_n: int = 3) -> DataFrame:
    """``(word, n)``: distinct words of ``least_len`` code points and ``least_n`` occurrences or more."""
    return words.where(F.length("word") >= least_len).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


class Shards:
    """Where the Bloom filter of each (length, part) lies: a pass, and blocks within it."""

    def __init__(self, counts: dict[int, int], most_bytes: int) -> None:
        most = most_bytes // 8  # blocks
        lengths = max(LONGEST, *counts, 0) + 1
        self.parts, self.base = np.ones(lengths, np.uint64), np.zeros(lengths, np.int64)
        offsets, blocks, passes, used = [], [], [[]], 0
        for length in range(lengths):
            n = counts.get(length, 0)
            need = -(-n * BITS_A_WORD // 64)
            parts = max(1, -(-need // most))
            self.parts[length], self.base[length] = parts, len(offsets)
            for _ in range(parts):
                size = -(-need // parts) if n else 0
                if used + size > most:
                    passes.append([])
                    used = 0
                offsets.append(used)
                blocks.append(size)
                passes[-1].append(len(offsets) - 1)
                used += size
        self.offsets, self.blocks, self.passes = np.array(offsets), np.array(blocks, np.uint64), passes

    def of_pass(self, number: int) -> Probe:
        here = np.zeros(len(self.offsets), bool)
        here[self.passes[number]] = True
        here &= self.blocks > 0
        lengths = [k for k in range(len(self.base)) if here[self.base[k] : self.base[k] + int(self.parts[k])].any()]
        size = max((int(self.offsets[s] + self.blocks[s]) for s in np.flatnonzero(here)), default=0)
        return Probe(self.parts, self.base, self.offsets, self.blocks, here, lengths, size)


class Probe:
    """The filters of a pass: which block a hash falls into, and which bits it sets there."""

    def __init__(self, parts, base, offsets, blocks, here, lengths: list[int], size: int) -> None:  # noqa: ANN001 - arrays of ``Shards``
        self.parts, self.base, self.offsets, self.blocks, self.here, self.lengths, self.size = parts, base, offsets, blocks, here, lengths, size

    def place(self, h: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block of each hash (-1: in none of this pass), and its bits."""
        length = np.minimum(length, LONGEST)
        low = h & np.uint64(0xFFFFFFFF)
        shard = self.base[length] + ((low * self.parts[length]) >> np.uint64(32)).astype(np.int64)
        spread = mixed(h ^ np.uint64(BASE))
        block = self.offsets[shard] + (((spread >> np.uint64(32)) * self.blocks[shard]) >> np.uint64(32)).astype(np.int64)
        bits = np.zeros(len(h), np.uint64)
        for k in range(PROBES):
            bits |= np.uint64(1) << (spread >> np.uint64(6 * k) & np.uint64(63))
        return np.where(self.here[shard], block, -1), bits


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all words, the lengths, and where each word begins."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return points, sizes, np.cumsum(sizes) - sizes


_POWERS = [np.ones(1, np.uint64)]


def _power(exponent: np.ndarray) -> np.ndarray:
    most = int(exponent.max(initial=0)) + 1
    if most > len(_POWERS[0]):
        _POWERS[0] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * most, BASE, np.uint64)]))
    return _POWERS[0][exponent]


class Hashed:
    """Words as code points with the terms and prefix sums that hashes of their edits follow from."""

    def __init__(self, words: list[str]) -> None:
        self.points, self.sizes, begin = _points(words)
        self.word = np.repeat(np.arange(len(words)), self.sizes)
        at = np.arange(len(self.points)) - begin[self.word]
        self.power = _power(self.sizes[self.word] - 1 - at)
        self.first = at == 0
        self.before = np.zeros(len(self.points) + 1, np.uint64)
        np.cumsum(value(self.points) * self.power, out=self.before[1:])
        self.start = self.before[begin]
        self.raw = self.before[begin + self.sizes] - self.start

    def hashes(self) -> np.ndarray:
        return mixed(self.raw)

    def deletions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, hash, length) of each word less a code point; one of equal neighbours is enough."""
        p = np.flatnonzero(self.first | np.r_[True, self.points[1:] != self.points[:-1]][: len(self.points)])
        w = self.word[p]
        h = (self.before[p] - self.start[w]) * INVERSE + self.start[w] + self.raw[w] - self.before[p + 1]
        return w, mixed(h), self.sizes[w] - 1

    def replacements(self, alphabet: np.ndarray, at_once: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, hash, length) of each word with a code point replaced by a larger one of ``alphabet`` (sorted)."""
        values, own = value(alphabet), value(self.points)
        rank = np.searchsorted(alphabet, self.points, side="right")
        step = max(1, at_once // max(len(alphabet), 1))
        for lo in range(0, len(self.points), step):
            p = np.arange(lo, min(lo + step, len(self.points)))
            times = len(alphabet) - rank[p]
            q = np.repeat(p, times)
            c = rank[q] + np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
            w = self.word[q]
            yield w, mixed(self.raw[w] + (values[c] - own[q]) * self.power[q]), self.sizes[w]


def value(points: np.ndarray) -> np.ndarray:
    """A number for each code point."""
    return mixed((points.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))


def _slices(column: pa.Array, most: int = 200_000) -> Iterator[tuple[int, list[str]]]:
    """Slices (start, words) of a bounded number of code points."""
    start, got, size = 0, [], 0
    for i, word in enumerate(column.to_pylist()):
        got.append(word)
        size += len(word)
        if size >= most:
            yield start, got
            start, got, size = i + 1, [], 0
    if got:
        yield start, got


def _hash_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, words in _slices(batch.column(0)):
            h = Hashed(words).hashes().view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(words)), batch.column(1).slice(at, len(words)), pa.array(h)], names=["word", "n", "h"])


def _filter(words: DataFrame, probe: Probe) -> np.ndarray:
    """The blocks of a pass. Its words set their bits in tasks, bits are combined by blocks of 32,768, and at most the size of the pass is fetched."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            block, bits = probe.place(h, batch.column(1).to_numpy())
            block, bits = block[block >= 0], bits[block >= 0]
            b, k = np.nonzero(bits[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(block[b] * 64 + k + 1, pa.int64())], names=["slot"])  # buckets of slots begin at 1

    rows = words.select("h", F.length("word").cast("long").alias("len")).mapInArrow(slots, "slot long")
    marked = rows.groupBy(F.bitmap_bucket_number("slot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("b"))
    bits = np.zeros((probe.size * 64 // 32_768 + 1, 4096), np.uint8)
    for r in marked.toLocalIterator():
        bits[r.k - 1] = np.frombuffer(r.b, np.uint8)
    return bits.reshape(-1).view("<u8")


def _candidates(words: DataFrame, probe: Probe, alphabet: np.ndarray) -> DataFrame:
    """``(h, edit)``: edits of words that pass the filters of a pass."""
    spark = words.sparkSession
    bits = spark.sparkContext.broadcast(_filter(words, probe))
    letters = spark.sparkContext.broadcast(alphabet)

    def passing(w: np.ndarray, h: np.ndarray, length: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block, mask = probe.place(h, length)
        some = np.flatnonzero(block >= 0)
        some = some[(bits.value[block[some]] & mask[some]) == mask[some]]
        return own[w[some]], h[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in _slices(batch.column(0)):
                x = Hashed(part)
                own, found = x.hashes(), []
                if any(k in reached for k in set((x.sizes - 1).tolist())):
                    found.append(passing(*x.deletions(), own))
                if any(k in reached for k in set(x.sizes.tolist())):
                    found += [passing(*r, own) for r in x.replacements(letters.value)]
                for a, b in found:
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["h", "edit"])

    longest = LONGEST in probe.lengths
    reached = _Lengths(frozenset(probe.lengths), longest)
    length = F.length("word")
    near = length.isin([*probe.lengths, *[k + 1 for k in probe.lengths]]) | (F.lit(longest) & (length >= LONGEST))
    return words.select("word").where(near).mapInArrow(run, "h long, edit long")


class _Lengths:
    """Lengths that have a filter in a pass; all from ``LONGEST`` on are one."""

    def __init__(self, some: frozenset[int], longest: bool) -> None:
        self.some, self.longest = some, longest

    def __contains__(self, length: int) -> bool:
        return length in self.some or self.longest and length >= LONGEST


def near_pairs(words: DataFrame, filter_bytes: int = 1 << 24) -> DataFrame:
    """``(word, n, other, other_n)``: words of ``words(word, n, h)`` one code point apart, each pair in both directions."""
    spark = words.sparkSession
    size = F.least(F.length("word"), F.lit(LONGEST)).cast("int")
    counts = {r.size: r.n for r in words.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()}  # LONGEST rows at most
    points = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()  # as many as there are code points
    alphabet = np.array(sorted(ord(r.c) for r in points), np.uint32)
    shards, found = Shards(counts, filter_bytes), None
    for number in range(len(shards.passes)):
        part = materialize(_candidates(words, shards.of_pass(number), alphabet))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "h long, edit long")
    side = lambda name, key: words.select(F.col("word").alias(name), F.col("n").alias(f"{name}_n"), F.col("h").alias(key))
    known = materialize(found.join(words.select(F.col("h").alias("edit")).distinct(), "edit", "left_semi").distinct())
    both = known.join(side("a", "h"), "h").join(side("b", "edit"), "edit")
    pairs = materialize(both.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n"))
    turned = pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    return pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(turned)


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for each word of ``forms(word, form)``, following forms to the last one.

    A form has at least twice the count, so a chain is as long as a count has bits at most; each round doubles how far a word has come.
    """
    state = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = materialize(state.join(ahead, "root", "left"))
        if moved.where("_next IS NOT NULL").isEmpty():
            return state
        state = moved.select("word", F.coalesce("_next", "root").alias("root"))


def variant_groups(words: DataFrame, factor: int = 2, filter_bytes: int = 1 << 24) -> DataFrame:
    """One row per row of the vocabulary ``words(word, n)``: ``form``, ``root``, ``n_near`` and ``form_n`` beside them.

    Words are near if one inserted, deleted or replaced code point turns one into the other. A word's form is its near word of
    largest ``n``, of equals the first in code-point order, if that ``n`` is ``factor`` times the word's or more (``factor`` is over 1, so forms
    end); else null. ``root`` is the last of the forms of forms, the word itself if it has none. ``words`` has each word once; words of any length and
    script are taken, null ones are left out. An empty vocabulary gives an empty table.
    ``filter_bytes`` bounds what is broadcast at a time.
    """
    if factor <= 1:
        raise ValueError("variant_groups: factor must be over 1, or forms could follow each other without end")
    ship(words.sparkSession)
    # A small table has some hundred edits a word, so it is dealt to as many tasks as any shuffle.
    dealt = words.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")).repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    hashed = materialize(dealt.mapInArrow(_hash_column, "word string, n long, h long"))
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("w"))).alias("best")
    near = near_pairs(hashed, filter_bytes).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    enough = -F.col("best.n") >= factor * F.col("n")
    near = materialize(near.select("word", "n_near", F.when(enough, F.col("best.w")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")))
    last = roots(near.where("form IS NOT NULL"))
    return (
        hashed.join(near, "word", "left").join(last, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variant_groups(materialize(vocabulary(noisy_runs(docs, least_len=5))))
