"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch of texts that were not seen before are held as ragged numpy arrays,
one block for each current length. In a step every sequence of the longest block applies its
lowest-rank pair (the leftmost of equals) at once and so moves to the block below; a sequence
without a pair that merges has its count. Counts by chunk are kept, and a text's count is the sum.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_codec import byte_table
from .chunks import ChunkCache
from .common import map_texts

VOCABULARY = "byte_bpe_50k.json"
NONE = np.int32(2**31 - 1)


class PairTable:
    """Rank and result of each merge in an open-addressing hash table of numpy arrays."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], bits: int = 19) -> None:
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        self.key = np.full(1 << bits, -1, np.int64)
        self.rank, self.result = np.full(1 << bits, NONE), np.zeros(1 << bits, np.int32)
        for key, at, (rank, result) in zip(keys.tolist(), self._home(keys).tolist(), pairs.values()):
            while self.key[at] >= 0:
                at = at + 1 & self.mask
            self.key[at], self.rank[at], self.result[at] = key, rank, result

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair; a free one if it doesn't merge."""
        keys = a.astype(np.int64) << 32 | b
        at = self._home(keys)
        held = self.key[at]
        lost = np.nonzero((held != keys) & (held >= 0))
        while len(lost[0]):
            at[lost] = at[lost] + 1 & self.mask
            held = self.key[at[lost]]
            lost = tuple(x[(held != keys[lost]) & (held >= 0)] for x in lost)
        return at

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.rank[self._find(a, b)]

    def results(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.result[self._find(a, b)]


class Counter:
    """Counts tokens as the tokenizers library does for a byte-level BPE file of its own format."""

    def __init__(self, path: str | None = None, pattern: str | None = None, longest_block: int = 64) -> None:
        import public_tokenizers

        with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.table = PairTable(pairs)
        self.of_byte = np.array([vocab[c] for c in byte_table()], np.int32)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.splits = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(pattern or public_tokenizers.PATTERN)
        self.longest_block = longest_block
        self.cache = ChunkCache(self._new, most=400_000)

    def pieces(self, sequences: list[bytes]) -> np.ndarray:
        """The number of symbols that survive in each sequence."""
        counts = np.zeros(len(sequences), np.int64)
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        for i in np.flatnonzero(lengths > self.longest_block):
            counts[i] = self._long(self.of_byte[np.frombuffer(sequences[i], np.uint8)])
        short = np.flatnonzero(lengths <= self.longest_block)
        short = short[np.argsort(lengths[short], kind="stable")]
        flat = self.of_byte[np.frombuffer(b"".join([sequences[i] for i in short]), np.uint8)]
        ends = np.cumsum(lengths[short])
        own = np.searchsorted(lengths[short], np.arange(self.longest_block + 2))
        ids, block, ranks = np.zeros(0, np.int64), np.zeros((0, 0), np.int32), np.zeros((0, 0), np.int32)
        for n in range(self.longest_block, 0, -1):
            lo, hi = own[n], own[n + 1]
            if hi > lo:
                fresh = flat[ends[lo] - n : ends[hi - 1]].reshape(hi - lo, n)
                ranks = np.concatenate([ranks.reshape(len(ids), n - 1), self.table.ranks(fresh[:, :-1], fresh[:, 1:])])
                block = np.concatenate([block.reshape(len(ids), n), fresh])
                ids = np.concatenate([ids, short[lo:hi]])
            if not len(ids):
                continue
            if n == 1:
                counts[ids] = 1
                break
            at = ranks.argmin(axis=1)
            row = np.arange(len(ids))
            going = ranks[row, at] < NONE
            counts[ids[~going]] = n
            ids, block, ranks, at = ids[going], block[going], ranks[going], at[going]
            row = np.arange(len(ids))
            block[row, at] = self.table.results(block[row, at], block[row, at + 1])
            stay = np.ones(block.shape, bool)
            stay[row, at + 1] = False
            block = block[stay].reshape(len(ids), n - 1)
            stay = np.ones(ranks.shape, bool)
            stay[row, at] = False
            ranks = ranks[stay].reshape(len(ids), n - 2)
            for off in (-1, 0):  # the pairs on either side of the new symbol
                there = (at + off >= 0) & (at + off < n - 2)
                r, p = row[there], at[there] + off
                ranks[r, p] = self.table.ranks(block[r, p], block[r, p + 1])
        return counts

    def _long(self, symbols: np.ndarray) -> int:
        """The same for one long sequence: all places of the lowest-rank pair merge in one step.

        No merge makes a pair of a lower rank than its own, so the order among them is free;
        of overlapping places every second one merges, from the left.
        """
        ranks = self.table.ranks(symbols[:-1], symbols[1:])
        while len(symbols) > 1 and (low := ranks.min()) < NONE:
            at = np.flatnonzero(ranks == low)
            run = np.r_[0, np.flatnonzero(np.diff(at) != 1) + 1]
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[place % 2 == 0]
            symbols[at] = self.table.results(symbols[at], symbols[at + 1])
            symbols = np.delete(symbols, at + 1)
            ranks = np.delete(ranks, at)
            new = at - np.arange(len(at))
            new = np.unique(np.concatenate([new - 1, new]))
            new = new[(new >= 0) & (new < len(ranks))]
            ranks[new] = self.table.ranks(symbols[new], symbols[new + 1])
        return len(symbols)

    def _new(self, chunks: list[str]) -> list[int]:
        found = [self.pattern.findall(x) for x in chunks]
        flat = [x.encode() for xs in found for x in xs]
        total = np.concatenate([[0], np.cumsum(self.pieces(flat))])
        ends = np.cumsum([0, *map(len, found)])
        return (total[ends[1:]] - total[ends[:-1]]).tolist()

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a special token's string in a text is one token."""
        if not self.splits or not any(s in t for s in self.special for t in texts):
            return [sum(x) for x in self.cache.values_of(texts)]
        parts = [self.splits.split(t) for t in texts]
        sums = iter([sum(x) for x in self.cache.values_of([p for ps in parts for p in ps])])
        return [sum(next(sums) for _ in ps) + len(ps) - 1 for ps in parts]


@lru_cache(maxsize=2)
def counter(path: str | None = None, pattern: str | None = None) -> Counter:
    return Counter(path, pattern)


def count_tokens(docs: DataFrame, text_col: str = "text", limit: int = 512, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to each row.

    Null text counts as empty: zero bytes, zero tokens. Repeated rows are counted each; an empty
    table gives an empty one; columns of the input named like a new one are replaced. Texts of any
    length are counted whole.
    """

    def run(texts: list[str]) -> list[pa.Array]:
        sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
        return [pa.array(sizes, pa.int64()), pa.array(counter(path).count(texts), pa.int64())]

    return map_texts(docs, run, "n_bytes long, n_tokens long", text_col, keep).withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, keep=["doc_id"])
