"""Repeated windows of words against a plain version."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sequora.llm import substring_dedup
from sequora.llm.queries import QUERIES

from . import brute
from .test_operators import DOCS, awkward, prose, rows_of

PASSAGE = prose(77, 60)


def shared_passages():
    """A passage in a third of all texts, at their start, end and middle, twice in some; ids in no order."""
    rng = random.Random(5)
    rows = []
    for i in rng.sample(range(1000, 1300), 300):
        text = prose(i, rng.randint(0, 90))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.choice([0, len(text), text.find(" ", len(text) // 2)])
            text = f"{text[:at]}\n{PASSAGE} \t{text[at:]}"
        rows.append((i, text, "en", "a", 1))
    return rows


ROWS = [*awkward(), *shared_passages(), (2**63 - 1, PASSAGE, "en", "a", 1), (-5, PASSAGE + " x", "en", "a", 1), (7, "a " * 400, None, None, 1), (None, "a " * 100, None, None, 1), (20, "w" * 70_000 + " " + PASSAGE, "en", "a", 1)]


@given(st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=20), st.integers(1, 64))
@settings(max_examples=50, deadline=None)
def test_rabin_karp(strings, size):
    """Equal byte strings have equal hashes and others don't, whatever the slices."""
    data, ends = b"".join(strings), np.cumsum([len(s) for s in strings])
    whole = substring_dedup.rabin_karp(data, ends - [len(s) for s in strings], ends)
    kept, substring_dedup.SLICE = substring_dedup.SLICE, size
    try:
        substring_dedup._POWERS.clear()
        sliced = substring_dedup.rabin_karp(data, ends - [len(s) for s in strings], ends)
    finally:
        substring_dedup.SLICE = kept
        substring_dedup._POWERS.clear()
    assert whole.tolist() == sliced.tolist()
    assert len(set(whole.tolist())) == len(set(strings))


@pytest.mark.parametrize("width,chunk,bucket", [(20, 2_000_000, 16_000_000), (20, 3000, 100), (1, 5000, 1000), (7, 100, 50)])
def test_against_plain(spark, width, chunk, bucket):
    """Chunks of few texts and many buckets give what one chunk gives."""
    docs = spark.createDataFrame(ROWS, DOCS).repartition(3)
    got = substring_dedup.remove_repeated_windows(docs, width=width, details=True, chunk_bytes=chunk, bucket_bytes=bucket)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept, [(s.first, s.n) for s in r.spans]) for r in got.collect()]
    assert sorted(got, key=repr) == sorted(brute.repeated_windows([r[:2] for r in ROWS], width), key=repr)


def test_query(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, DOCS).withColumns({c: F.lit("mine") for c in ("kept", "n_words", "cid", "bucket", "answer", "id")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(QUERIES["op13_substring_dedup"](spark, str(tmp_path)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted([r[:4] for r in brute.repeated_windows([r[:2] for r in ROWS])], key=repr)


def test_ids(spark):
    assert substring_dedup.remove_repeated_windows(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(TypeError, match="whole numbers"):
        substring_dedup.remove_repeated_windows(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
