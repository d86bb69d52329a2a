"""Minimal pairs and complementary distribution."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import SOUND_CLASSES
from ..functions.scratch import materialize
from .paths import token_hash

MOST_BITS = 512  # tokens of an inventory whose sets are kept as bits


def templates(seqs: DataFrame) -> DataFrame:
    """``(grp, before, after, token)``: each position of each distinct sequence blanked, with the token that fills it.

    Two arrays are the key, so no token can be taken for the blank. Sequences are made
    distinct before they are taken apart.
    """
    rows = seqs.select("grp", "tokens").distinct().select("grp", "tokens", F.posexplode("tokens").alias("i", "token"))
    return rows.select("grp", F.slice("tokens", F.lit(1), F.col("i")).alias("before"), F.expr("slice(tokens, i + 2, size(tokens))").alias("after"), "token")


def blank_keys(seqs: DataFrame) -> DataFrame:
    """``(grp, pos, k1, k2, token)``: the same with keys of fixed size in place of the arrays, so a sequence of L tokens costs L such rows.

    A blank is its place and two sums (exclusive or) of 64-bit hashes of all other (place, token); the sums of a sequence are made once,
    and each blank takes its own token off. Both agree for different surroundings once in 2^128.
    """
    rows = seqs.select("grp", "tokens").distinct()
    total = lambda k: F.aggregate(F.transform("tokens", lambda t, i: token_hash(i + 1, t, k)), F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h))
    rows = rows.select("grp", total(1).alias("t1"), total(2).alias("t2"), F.posexplode("tokens").alias("i", "token"))
    own = lambda k: F.col(f"t{k}").bitwiseXOR(token_hash(F.col("i") + 1, F.col("token"), k)).alias(f"k{k}")
    return rows.select("grp", (F.col("i") + 1).alias("pos"), own(1), own(2), "token")


def contrasting_pairs(blanks: DataFrame) -> DataFrame:
    """``(grp, a, b)``: tokens a < b that fill one blank, of ``templates`` or ``blank_keys``.

    A blank's fillers are a set of inventory tokens, so the pairs of a blank are bounded by the inventory. An inventory of up to ``MOST_BITS``
    tokens is numbered, and a set is bits of a few integers, which combine in place; larger ones are collected.
    """
    keys = [c for c in blanks.columns if c != "token"]
    tokens = blanks.select("token").where("token IS NOT NULL").distinct()
    numbered = materialize(tokens.withColumn("id", F.row_number().over(Window.orderBy("token")) - 1))  # a row a token
    size = numbered.count()
    if size > MOST_BITS:
        sets = blanks.groupBy(*keys).agg(F.array_sort(F.collect_set("token")).alias("s")).where(F.size("s") > 1).select("grp", "s").distinct()
        return _pairs_of(sets)
    words = range(0, max(size, 1), 64)
    bit = lambda w: F.when(F.col("id").between(w, w + 63), F.expr(f"shiftleft(1L, id - {w})")).otherwise(F.lit(0).cast("long"))
    sets = blanks.join(numbered, "token").groupBy(*keys).agg(*[F.bit_or(bit(w)).alias(f"b{w}") for w in words])
    sets = sets.where(reduce(add, [F.bit_count(f"b{w}") for w in words]) > 1).select("grp", *[f"b{w}" for w in words]).distinct()
    some = lambda w: F.filter(F.sequence(F.lit(w), F.lit(min(w + 64, size) - 1)), lambda i: F.getbit(f"b{w}", i - w) == 1)
    ids = [some(w) for w in words if size]
    pairs = _pairs_of(sets.select("grp", (F.concat(*ids) if ids else F.array().cast("array<int>")).alias("s")))
    names = lambda c: numbered.select(F.col("token").alias(c), F.col("id").alias(f"_{c}"))
    return pairs.toDF("grp", "_a", "_b").join(names("a"), "_a").join(names("b"), "_b").select("grp", "a", "b")


def _pairs_of(sets: DataFrame) -> DataFrame:
    """The pairs of the sorted sets ``s``."""
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select("grp", F.explode(pairs).alias("p")).select("grp", "p.a", "p.b").distinct()


def complementary_pairs(seqs: DataFrame, contrasting: DataFrame, min_freq: int = 50) -> DataFrame:
    """``(grp, a, b, fa, fb)``: frequent tokens a < b of a group that never contrast.

    The pairs are of frequent inventory tokens, a small table by nature.
    """
    n = F.col("n") if "n" in seqs.columns else F.lit(1)
    freq = seqs.select("grp", n.alias("n"), F.explode("tokens").alias("t")).groupBy("grp", "t").agg(F.sum("n").cast("long").alias("f")).where(F.col("f") >= min_freq)
    a, b = freq.select("grp", F.col("t").alias("a"), F.col("f").alias("fa")), freq.select("grp", F.col("t").alias("b"), F.col("f").alias("fb"))
    return a.join(b, "grp").where("a < b").join(contrasting, ["grp", "a", "b"], "left_anti")


def similarity(pairs: DataFrame) -> DataFrame:
    """Add ``sim``: 0.9 same first letter, 0.7 one inside the other, 0.5 first letters of one sound class, else 0."""
    a, b = F.col("a"), F.col("b")
    first = lambda c: F.substring(c, 1, 1)
    same_class = F.lit(False)
    for members in SOUND_CLASSES.values():
        same_class = same_class | (first(a).isin(*members) & first(b).isin(*members))
    sim = F.when(first(a) == first(b), 0.9).when(F.contains(a, b) | F.contains(b, a), 0.7).when(same_class, 0.5).otherwise(0.0)
    return pairs.withColumn("sim", sim)


def suggested_map(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """``(grp, token, target, sim)``: the rarer of two similar tokens becomes the commoner (of equals, b becomes a)."""
    up = F.col("fa") >= F.col("fb")
    return scored.where(F.col("sim") >= least).select("grp", F.when(up, F.col("b")).otherwise(F.col("a")).alias("token"), F.when(up, F.col("a")).otherwise(F.col("b")).alias("target"), "sim")
