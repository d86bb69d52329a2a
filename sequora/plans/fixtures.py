"""Adapters that give the test tables the shapes of sequence and outcome tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prep import letters, ordered_items, rewrite

#: The rewriting rule of the outcome fixture: one vowel after the first letter goes in each step.
VOWEL_RULE = "^(.+?)[aeiouyäöüéèêàáíóúôîûâ]"
#: The letters that stand as vowels in the letter fixtures.
LETTER_VOWELS = "aeiouyäöüéèêàáíóúôîûâ"
SURFACE_MAP = {"de": {"ä": "a", "ö": "o", "ü": "u"}, "fr": {"é": "e", "è": "e", "ê": "e"}}
LANGS = [("en", "English", "Germanic", "Fusional", "eng"), ("de", "German", "Germanic", "Fusional", "deu"), ("fr", "French", "Romance", "Fusional", "fra"), ("es", "Spanish", "Romance", "Fusional", "spa")]
COMBOS = [("de", ["de"]), ("fr", ["fr", "es"]), ("es", ["es", "xx"])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(grp, key, tokens, n)``: each word of each language's documents, letters as tokens."""
    words = table(spark, sf_dir, "documents").select(F.col("lang").alias("grp"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("key"))
    return words.groupBy("grp", "key").agg(F.count("*").alias("n")).withColumn("tokens", letters(F.col("key")))


def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of a user's day in order, grouped by month."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "event_type")
    paths = ordered_items(events, ["user_id", "day"], "event_type", ["ts", "event_id"])
    return paths.select(F.date_format("day", "yyyy-MM").alias("grp"), F.concat_ws("/", "user_id", "day").alias("key"), "tokens", F.lit(1).cast("long").alias("n"))


def turn_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of a conversation by turn."""
    paths = ordered_items(table(spark, sf_dir, "conversations"), ["conv_id"], "role", ["turn"])
    return paths.select(F.lit("all").alias("grp"), F.col("conv_id").cast("string").alias("key"), "tokens", F.lit(1).cast("long").alias("n"))


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(grp, key, surface, norm, n)``: letters as written, and in lower case with the group's map."""
    words = table(spark, sf_dir, "documents").select(F.col("lang").alias("grp"), F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("key"))
    rows = words.groupBy("grp", "key").agg(F.count("*").alias("n")).withColumn("surface", letters(F.col("key")))
    plain = F.transform("surface", F.lower)
    norm = plain
    for grp, pairs in SURFACE_MAP.items():
        signs, plain_ones = "".join(pairs), "".join(pairs.values())
        norm = F.when(F.col("grp") == grp, F.transform(plain, lambda c: F.translate(c, signs, plain_ones))).otherwise(norm)
    return rows.withColumn("norm", norm)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(grp, token, marginal)``: letters that make up half a percent of their group's letters or more."""
    return inventory_of(lexicon(spark, sf_dir))


def inventory_of(words: DataFrame) -> DataFrame:
    """The same of a lexicon."""
    rows = words.select("grp", "n", F.explode("tokens").alias("token")).groupBy("grp", "token").agg(F.sum("n").alias("c"))
    total = rows.groupBy("grp").agg(F.sum("c").alias("all"))
    return rows.join(total, "grp").where(200 * F.col("c") >= F.col("all")).select("grp", "token", F.lit(False).alias("marginal"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words rewritten by ``VOWEL_RULE`` with fuel 4 and size 14; experiment is the language, size the length."""
    words = lexicon(spark, sf_dir).select(F.col("grp").alias("experiment"), F.length("key").alias("size"), F.col("key").alias("input"))
    return rewrite(words, "input", VOWEL_RULE, "$1", fuel=4, max_size=14)
