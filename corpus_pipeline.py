"""Corpus preparation: each stage takes the documents that the one before it kept.

Stages: quality rules (rejected documents go), near-dedup by SimHash and five-word shingles (one document of
each group stays), PII (findings are masked), mixing sources to target weights (documents are drawn as often
as their source's weight asks, at least once), byte-level BPE (the last: ids of each document).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sequora.llm import bpe_codec, pii, quality_rules, source_mixing
from sequora.llm import near_copies as shingle_copies
from sequora.llm.common import materialize


def shielded(docs: DataFrame, **own: Column) -> DataFrame:
    """The columns of ``docs`` under names that no operator uses, and those that a stage asks for."""
    return docs.select(*[F.col(f"`{c}`").alias(f"_in_{c}") for c in docs.columns], *[v.alias(k) for k, v in own.items()])


def restored(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them replaced."""
    return rows.select(*[new.get(c, F.col(f"`_in_{c}`")).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host isn't rejected; the columns stay as they are."""
    own = shielded(docs, text=F.col("text"), source=F.col("source"))
    failures = materialize(quality_rules.rule_failures(quality_rules.rule_counts(own)).drop("text"))
    return restored(quality_rules.apply_quality_rules(failures).where("kept"), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with links of Jaccard similarity 0.8 or more: the one with the least id.

    SimHash fingerprints give the first candidates, shared shingles those that fingerprints miss; sets are compared in full.
    """
    return restored(shingle_copies.drop_near_copies(shielded(docs), "_in_doc_id", "_in_text"), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, findings in their texts replaced by the kind; null texts stay null, ``n_chars`` is the new length."""
    found = pii.find_pii(shielded(docs), "_in_text", mask=True)
    text = F.when(F.col("_in_text").isNotNull(), F.col("masked"))
    return restored(found, docs, text=text, n_chars=F.length(text).cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The largest source once and every other one at least once, up to four times, by temperature weights."""
    counted = shielded(docs, doc_id=F.col("doc_id"), source=F.col("source"), n_tokens=source_mixing.word_count(F.col("text")))
    mixed = source_mixing.mixture(counted).withColumn("copies", F.greatest("copies", F.lit(1)))
    return restored(source_mixing.draw(mixed, [f"`{c}`" for c in counted.columns]), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document with the digests of its text, its ids and what they decode to."""
    rows = docs.select("doc_id", "source", "lang", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return bpe_codec.round_trip(rows, keep=["doc_id", "source", "lang", "text_sha256"], with_ids=True)


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_copies),
    ("pii", personal_data),
    ("source_mixing", mixing),
    ("byte_bpe", tokens),
]

#: SQL can express neither XXH64 fingerprints nor the field's labels nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
