"""Readers of lexicons, dictionaries, inventories, manifests and exported results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prep import map_of, normalized_pairs, tokenize
from . import digests

WHOLE = 128 << 20  # bytes of a file that is hashed as one row


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_name").alias("file"))


def parse_lexicon(lines: DataFrame) -> DataFrame:
    """``(word, transcription)`` from tab-separated lines: blank and ``#`` lines and lines of one field are skipped, extra fields ignored."""
    rows = lines.where((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("f", F.split("line", "\t"))
    others = [c for c in lines.columns if c != "line"]
    return rows.where(F.size("f") >= 2).select(*others, F.trim(F.get("f", F.lit(0))).alias("word"), F.trim(F.get("f", F.lit(1))).alias("transcription"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``(file, word, transcription)``; quotes mean nothing."""
    return parse_lexicon(_lines(spark, path))


def read_dictionary(spark: SparkSession, path: str, grp: str) -> DataFrame:
    """``(grp, word, transcription)``: ``;;;`` comments, words in lower case, variants such as ``WORD(2)`` left out."""
    rows = _lines(spark, path).where((F.col("line") != "") & ~F.col("line").startswith(";;;")).withColumn("f", F.split("line", "\t", 2))
    word = F.lower(F.trim(F.get("f", F.lit(0))))
    return rows.where(F.size("f") == 2).select(F.lit(grp).alias("grp"), word.alias("word"), F.trim(F.get("f", F.lit(1))).alias("transcription")).where(~F.contains("word", F.lit("(")))


def read_multi(spark: SparkSession, path: str, grp: str, token_maps: dict, mode: str = "legacy") -> DataFrame:
    """``(grp, key, norm, surface)``: the second field may hold several transcriptions, parted by comma and space.

    Empty token lists, and lists that are empty after normalisation, are left out.
    """
    rows = read_lexicon(spark, path).select("word", F.explode(F.split("transcription", ", ")).alias("t"))
    pairs = normalized_pairs(tokenize(F.col("t"), mode), map_of(token_maps, F.lit(grp)), mode)
    rows = rows.withColumn("p", pairs).where(F.size("p") > 0)
    part = lambda name: F.transform("p", lambda x: x[name]).alias(name)
    return rows.select(F.lit(grp).alias("grp"), F.col("word").alias("key"), part("norm"), part("surface"))


def read_inventory(spark: SparkSession, path: str, groups: dict[str, str], inventory_col: str = "InventoryID", group_col: str = "ISO6393", token_col: str = "Phoneme") -> DataFrame:
    """``(grp, token, marginal)`` of the inventory with the least id of each group in ``groups`` (code in the file → group)."""
    raw = spark.read.csv(path, header=True)
    rows = raw.select(F.col(inventory_col).cast("long").alias("id"), F.col(group_col).alias("code"), F.col(token_col).alias("token")).where(F.col("code").isin(list(groups)))
    first = rows.groupBy("code").agg(F.min("id").alias("id"))
    names = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    return rows.join(first, ["code", "id"]).where(F.coalesce(F.col("token"), F.lit("")) != "").select(names[F.col("code")].alias("grp"), "token").distinct().withColumn("marginal", F.lit(False))


def route_by_name(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Add ``grp`` from the file name: its prefix before ``_broad.tsv`` or ``_narrow.tsv``; other files are left out."""
    prefix = F.regexp_extract("file", r"^(.*)_(?:broad|narrow)\.tsv$", 1)
    return rows.withColumn("prefix", prefix).join(prefixes, "prefix").drop("prefix")


def checksums(spark: SparkSession, path: str, manifest: DataFrame | None = None, whole: int = WHOLE, step: int = digests.STEP) -> DataFrame:
    """``(file, sha256)`` of each file, and with ``manifest(file, expected)`` whether it is as expected.

    A file of at most ``whole`` bytes is one row; larger ones are read in splits and hashed in steps, whatever their size. Packed files
    (``.gz``) over that, and all files where Python's OpenSSL doesn't show its functions, are rows as well, and may have 2 GB at most.
    """
    files = spark.read.format("binaryFile").load(path).withColumn("_path", F.col("_metadata.file_path"))
    large = {r._path: r.length for r in files.where(F.col("length") > whole).select("_path", "length").collect()}  # names only
    if large:
        jvm = spark.sparkContext._jvm
        codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration())
        large = {p: n for p, n in large.items() if codecs.getCodec(jvm.org.apache.hadoop.fs.Path(p)) is None} if digests.resumable() else {}
    name = lambda p: F.element_at(F.split(p, "/"), -1).alias("file")
    rows = files.where(~F.col("_metadata.file_path").isin(list(large))) if large else files
    rows = rows.select(name("path"), F.sha2("content", 256).alias("sha256"))
    if large:
        names = files.where(F.col("length") > whole).select("_path", name("path"))
        found = digests.stepwise(spark, path, large, step)
        rows = rows.unionByName(found.join(names, found["path"] == names["_path"]).select("file", "sha256"))
    return rows if manifest is None else rows.join(manifest, "file").withColumn("ok", F.col("sha256") == F.lower("expected"))


def read_export(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The nodes, edges and metadata of an exported result, as tables.

    A folder of JSON lines for each part, or one document with all three.
    """
    if path.endswith(".json"):
        doc = spark.read.json(path, multiLine=True)
        table = lambda c: doc.select(F.explode(c).alias("x")).select("x.*")
        return {"nodes": table("nodes"), "edges": table("edges"), "metadata": doc.select("metadata.*")}
    return {part: spark.read.json(f"{path}/{part}") for part in ("nodes", "edges", "metadata")}
