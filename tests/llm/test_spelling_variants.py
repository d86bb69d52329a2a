"""Groups of spelling variants against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from sequora.llm import spelling_variants as sv
from sequora.llm.queries import QUERIES

from . import brute
from .test_operators import DOCS, awkward, rows_of

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def misspelt():
    """Words of a Zipf-like table with random edits, accents, hot words and runs long enough to lose letters."""
    rng = random.Random(11)
    base = ["".join(rng.choice("aeioubcdrstÉéñß") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "x" * 70, "x" * 71, "y" + "x" * 70]
    rows = []
    for i in range(260):
        words = []
        for _ in range(60):
            w = base[int(len(base) * rng.random() ** 3)]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aeéz") + w[k + 1 :], w[:k] + rng.choice("aeiz") + w[k:]])
            words.append(rng.choice([w, w, w.upper(), w.title()]))
        rows.append((i if i % 50 else None, rng.choice([" ", ", ", "-", "1"]).join(words), "en", "a", 1))
    return rows


ROWS = [*awkward(), *misspelt()]


def test_query(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, DOCS).withColumns({c: F.lit("mine") for c in ("word", "n", "h", "id", "run")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(QUERIES["op12_spelling_variants"](spark, str(tmp_path)), *COLUMNS)
    want = sorted(brute.spelling_variants([r[:2] for r in ROWS]), key=repr)
    assert got == want
    assert sum(1 for r in want if r[1]) > 100 and any(r[2] not in (r[0], r[1]) for r in want)  # forms, and chains of them


@pytest.mark.parametrize("size", [8, 64, 1 << 24])
def test_passes(spark, size):
    """Filters of one block, or of many passes, change nothing; other scripts and ties are taken too."""
    n = {w: c for w, _, _, c, _, _ in brute.spelling_variants([r[:2] for r in ROWS])}
    n |= {"спелинг": 9, "спеллинг": 3, "😀😀b": 7, "😀b": 7, "😀c": 7, "ab": 2, "b": 1, "a": 4, "": 5}
    words = spark.createDataFrame([*n.items(), (None, 3)], "word string, n long")
    got = rows_of(sv.variant_groups(words, filter_bytes=size), *COLUMNS)
    assert got == sorted(brute.variants_of(n), key=repr)


def test_chain(spark):
    n = {"bcdea"[:k] + "x" * (8 - k): 2**k for k in range(6)}
    got = rows_of(sv.variant_groups(spark.createDataFrame(list(n.items()), "word string, n long")), *COLUMNS)
    assert got == sorted(brute.variants_of(n), key=repr)
    with pytest.raises(ValueError, match="factor"):
        sv.variant_groups(spark.createDataFrame([("a", 1)], "word string, n long"), factor=1)
