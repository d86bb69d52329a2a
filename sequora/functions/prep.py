"""Sequence preparation: tokens from text, normalisation, bounded rewriting, validation, counts.

Sequence tables have ``grp``, ``key``, ``tokens ARRAY<STRING>`` and, where rows stand for several
equal ones, ``n``.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .dims import PREDICTABLE_MARKS, PROSODIC
from .scratch import materialize

_MODIFIERS = "ːˑʰʷʲˠˤⁿˡʼ˞"
_TIE = r"[\x{0361}\x{035C}](?s:.)?"
_TOKEN = rf"[{PROSODIC}]|[^\p{{IsWhite_Space}}](?:{_TIE}|[\p{{M}}{_MODIFIERS}])*+"
_LEGACY_TOKEN = rf"[{PROSODIC}]|[^ \t](?:{_TIE}|[\p{{M}}{_MODIFIERS}ˈˌ])*+"


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition, which Spark has no built-in for."""
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def tokenize(transcription: Column, mode: str = "default") -> Column:
    """Grapheme-cluster tokens of a transcription.

    A base character takes the combining marks, modifiers and tie bars (with what they tie) that
    follow; signs of prosody are tokens of their own. ``legacy`` skips composition, strips all outer
    slashes and brackets, and lets stress marks attach to the base before them.
    """
    if mode == "legacy":
        text = F.trim(transcription)
        for sign in ("/", r"\[", r"\]"):
            text = F.regexp_replace(text, rf"^{sign}+|{sign}+\z", "")
        return F.regexp_extract_all(F.trim(text), F.lit(_LEGACY_TOKEN), F.lit(0))
    text = F.regexp_replace(F.regexp_replace(nfc(transcription), r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", ""), r"^[/\[]", "")
    return F.regexp_extract_all(F.regexp_replace(text, r"[/\]]\z", ""), F.lit(_TOKEN), F.lit(0))


def letters(word: Column) -> Column:
    """The characters of a word as tokens."""
    return F.filter(F.split(word, ""), lambda c: c != "")


def ordered_items(df: DataFrame, keys: list[str], item: str, order: list[str]) -> DataFrame:
    """``tokens`` of each key: the items in order (time, then tie-breakers)."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("_item"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda x: x["_item"]).alias("tokens"))


def _stripped(token: Column, signs: str) -> Column:
    return F.regexp_replace(token, "[" + "".join(f"\\x{{{ord(c):04X}}}" for c in signs) + "]", "")


def normalized(tokens: Column, token_map: Column, mode: str = "default") -> Column:
    """Tokens mapped by ``token_map`` (MAP), exactly first, then without prosody and predictable marks; empty ones go.

    ``legacy`` takes only stress marks out of a token.
    """
    return F.transform(normalized_pairs(tokens, token_map, mode), lambda x: x["norm"])


def normalized_pairs(tokens: Column, token_map: Column, mode: str = "default") -> Column:
    """The same with the surface token kept beside its norm."""
    signs = (PROSODIC if mode == "default" else "ˈˌ") + PREDICTABLE_MARKS

    def norm(t: Column) -> Column:
        bare = _stripped(t, signs)
        alone = F.length(_stripped(t, PROSODIC)) == 0
        return F.when(alone, F.lit("")).otherwise(F.coalesce(F.element_at(token_map, t), F.element_at(token_map, bare), bare))

    return F.filter(F.transform(tokens, lambda t: F.struct(norm(t).alias("norm"), t.alias("surface"))), lambda x: x["norm"] != "")


def map_of(maps: dict[str, dict[str, str]], grp: Column) -> Column:
    """The token map of a group as a literal; groups without one get an empty map."""
    out = F.create_map().cast("map<string,string>")
    for name, pairs in maps.items():
        if pairs:
            out = F.when(grp == name, F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])).otherwise(out)
    return out


def collapsed(aligned: DataFrame) -> DataFrame:
    """Per group: positions whose norm differs from the surface, weighted by ``n``."""
    differ = F.size(F.filter(F.arrays_zip("norm", "surface"), lambda x: x["norm"] != x["surface"]))
    return aligned.groupBy("grp").agg(F.sum(differ * F.col("n")).cast("long").alias("collapses"))


def rewrite(df: DataFrame, text_col: str, pattern: str, replacement: str, fuel: int, max_size: int, round_steps: int = 8) -> DataFrame:
    """Add ``outcome``, ``steps`` and ``status``: rewrite the first match until nothing changes.

    The result is written: a predicate on it that reached the plan below would run the steps again for
    each place where it stands. Before each step: out of fuel is ``divergent``, longer than ``max_size`` is ``explosive``; a text
    that no longer changes is ``normal``. ``outcome`` is null unless normal. Large fuel runs in rounds of ``round_steps``, and
    only rows that are not done go on to the next round.
    """

    def step(state: Column, _: Column) -> Column:
        spent = state["steps"] >= fuel
        long = F.length(state["t"]) > max_size
        new = F.regexp_replace(state["t"], pattern, replacement)  # the pattern is anchored: one match
        still = new == state["t"]
        return F.when(state["status"].isNotNull(), state).otherwise(
            F.struct(
                F.when(spent | long | still, state["t"]).otherwise(new).alias("t"),
                F.when(spent | long | still, state["steps"]).otherwise(state["steps"] + 1).alias("steps"),
                F.when(spent, "divergent").when(long, "explosive").when(still, "normal").alias("status"),
            )
        )

    start = F.struct(F.col(text_col).alias("t"), F.lit(0).alias("steps"), F.lit(None).cast("string").alias("status"))
    left, done, spent = df.withColumn("_s", start), [], 0
    while True:
        some = min(round_steps, fuel - spent + 1)
        run = F.aggregate(F.sequence(F.lit(1), F.lit(some)), F.col("_s"), step)
        left, spent = materialize(left.withColumn("_s", run)), spent + some
        if spent > fuel:
            done.append(left)
            break
        done.append(left.where("_s.status IS NOT NULL"))
        left = left.where("_s.status IS NULL")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumns(
        {"outcome": F.when(F.col("_s.status") == "normal", F.col("_s.t")), "steps": F.col("_s.steps"), "status": F.col("_s.status")}
    ).drop("_s")


def validate(seqs: DataFrame, inventory: DataFrame) -> DataFrame:
    """Add ``issues`` and ``valid``: tokens that the group's inventory (``grp, token, marginal``) doesn't have.

    An inventory holds the distinct tokens of a group, which is a small set by nature; without one
    the only issue is that it is missing.
    """
    sets = inventory.groupBy("grp").agg(F.collect_set("token").alias("_inv"))
    unknown = F.filter("tokens", lambda t: ~F.array_contains("_inv", t))
    issues = F.when(F.col("_inv").isNull(), F.array(F.concat(F.lit("No inventory for language: "), "grp"))).otherwise(
        F.transform(unknown, lambda t: F.concat(F.lit("Unknown phoneme: "), t))
    )
    return seqs.join(sets, "grp", "left").withColumn("issues", issues).withColumn("valid", F.size("issues") == 0).drop("_inv")


def validation_report(checked: DataFrame) -> DataFrame:
    """Per group and in all (``grp`` null): valid and total sequences and the share in percent, weighted by ``n``."""
    return (
        checked.rollup("grp").agg(F.sum(F.when(F.col("valid"), F.col("n")).otherwise(0)).cast("long").alias("valid"), F.sum("n").cast("long").alias("total"))
        .withColumn("pct", F.round(100 * F.col("valid") / F.col("total"), 6))
    )


def unknown_tokens(checked: DataFrame, k: int = 30) -> DataFrame:
    """The ``k`` most frequent unknown tokens."""
    return (
        checked.select("n", F.explode("issues").alias("issue")).where(F.col("issue").startswith("Unknown phoneme: "))
        .groupBy(F.expr("substring(issue, 18)").alias("token")).agg(F.sum("n").cast("long").alias("cnt"))
        .orderBy(F.desc("cnt"), "token").limit(k)
    )


def valid_counts(checked: DataFrame) -> DataFrame:
    """Valid sequences per group."""
    return checked.where("valid").groupBy("grp").agg(F.sum("n").cast("long").alias("cnt"))


def invalid_totals(checked: DataFrame) -> DataFrame:
    """Invalid sequences per group, with a line for all groups (``grp`` null)."""
    return checked.rollup("grp").agg(
        F.sum(F.when(F.col("valid"), 0).otherwise(F.col("n"))).cast("long").alias("invalid"), F.sum("n").cast("long").alias("total")
    )
