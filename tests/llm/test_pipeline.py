"""The stages: what they keep, that decisions take effect, and awkward tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .test_operators import DOCS, awkward, prose


def run(spark, docs, upto):
    for _, stage in corpus_pipeline.STAGES[:upto]:
        docs = stage(spark, docs, None).cache()
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(100 + i, f"{prose(i, 60)} mail {i}@example.org .", "en", "a" if i % 3 else "b", 1) for i in range(30)]
    rows += [(200, prose(7, 60) + " mail 7@example.org .", "en", "a", 1), (201, "w " * 40, "en", "a", 1), (202, None, None, None, None)]
    return spark.createDataFrame(rows + awkward(), DOCS)


def test_stages(spark, docs):
    clean = run(spark, docs, 1)
    ids = {r.doc_id for r in clean.collect()}
    assert {100 + i for i in range(30)} <= ids and not ids & {201, 202, 4, 5, 8, 9}
    unique = run(spark, docs, 2)
    assert unique.count() == unique.select("doc_id").distinct().count() and unique.where("doc_id = 2").count() == 0
    masked = run(spark, docs, 3)
    assert masked.where("text LIKE '%@example.org%'").count() == 0 and masked.where("text LIKE '%<EMAIL>%'").count() >= 29
    assert masked.where("n_chars <> length(text)").count() == 0
    mixed = run(spark, docs, 4)
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in masked.collect()} and mixed.count() >= masked.count()
    for df in (clean, unique, masked, mixed):
        assert df.columns == docs.columns
    last = run(spark, docs, 5)
    assert last.count() == mixed.count() and last.where("text_sha256 <> decoded_sha256").count() == 0


def test_clashing_columns_and_empty_tables(spark, docs):
    names = ["n_words", "kept", "fp", "spans", "masked", "copies", "weight", "n_tokens", "root", "key"]
    wide = docs.withColumns({c: F.lit("mine") for c in names})
    out = run(spark, wide, 4)
    assert out.columns == wide.columns and out.where(" OR ".join(f"{c} <> 'mine'" for c in names)).count() == 0
    assert run(spark, docs.limit(0), 5).count() == 0


def test_fingerprints_give_candidates(spark, monkeypatch):
    from sequora.llm import near_copies

    base = [f"{prose(i, 300)} end{i}" for i in range(6)]
    texts = base + [t + " one more" for t in base]
    rows = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS)
    kept = lambda: sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, rows, None).collect())
    whole = kept()
    assert whole == [*range(6)]
    monkeypatch.setattr(near_copies, "prefixes", lambda sets, often, count: [s[:0] for s in sets])  # shared shingles find nothing
    signed = near_copies.add_signatures(rows, with_sets=True)
    assert near_copies.print_groups(signed).where("fp <> low").count() > 0
    found = kept()
    assert len(found) < len(texts) and set(whole) <= set(found)
