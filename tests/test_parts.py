"""Parts of any length against plain listing."""

import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sequora.operators import outcomes as O
from sequora.operators import parts

SCHEMA = "experiment string, size int, text string, times long"


def listing(rows):
    """{group: {part: (occurrences, weight, texts, least size)}} of (group, size, text, times)."""
    out = {}
    for group, size, text, times in rows:
        own = out.setdefault(group, {})
        found = [text[i:j] for i in range(len(text or "")) for j in range(i + 1, len(text) + 1)]
        for p in set(found):
            n = found.count(p)
            a = own.get(p, (0, 0, 0, 1 << 30))
            own[p] = (a[0] + n, a[1] + n * times, a[2] + 1, min(a[3], size))
    return out


def tops(rows, k, savings=False):
    """(group, part, value, occurrences, weight, texts, rank) of each group's first k."""
    out = []
    for group, own in listing(rows).items():
        value = lambda p: own[p][0] * (len(p) - 1) if savings else own[p][1]  # noqa: E731, B023
        best = sorted((p for p in own if len(p) > savings), key=lambda p: (-value(p), p))[:k]
        out += [(group, p, value(p), *own[p][:3], r) for r, p in enumerate(best, 1)]
    return sorted(out, key=repr)


def firsts(rows):
    out = {}
    for group, own in listing(rows).items():
        for *_, least in own.values():
            out[group, least] = out.get((group, least), 0) + 1
    return [(*k, n) for k, n in out.items()]


@given(st.lists(st.tuples(st.sampled_from("pq"), st.text("ab", max_size=14), st.integers(1, 4)), min_size=1, max_size=12), st.integers(5, 9))
@settings(max_examples=150, deadline=None)
def test_walk(rows, window):
    """A walk over sorted suffixes of more than ``SHORT`` characters, in rounds, gives what listing gives."""
    texts = [(g, doc, text, times, 1 + doc % 3) for doc, (g, text, times) in enumerate(rows)]
    state = [
        (g, text[p : p + 5], text[p : p + window], 4, 0, len(text) - p, times, size, doc, p + 1) for g, doc, text, times, size in texts for p in range(len(text) - 4)
    ]
    whole = [(g, size, text, times) for g, _, text, times, size in texts]
    long = {g: {p: v for p, v in own.items() if len(p) > parts.SHORT} for g, own in listing(whole).items()}
    sums, best = {}, {}
    while state:
        frame = pd.DataFrame(sorted(state, key=lambda r: (*r[:3], -r[5])), columns=parts.SUFFIX)
        for make in (parts.Sums, lambda: parts.Tops(1000, False)):
            got = pd.concat(parts._walked(window, make)(iter([frame[:3], frame[3:]])))
            for r in got[~got["on"].astype(bool)].to_dict("records"):
                if make is parts.Sums:
                    sums[r["g"], r["least"]] = sums.get((r["g"], r["least"]), 0) + r["parts"]
                else:
                    text = texts[r["doc"]][2][r["pos"] - 1 :][: r["len"]]
                    assert (r["g"], text) not in best
                    best[r["g"], text] = (r["occurrences"], r["weight"], r["texts"])
        on = got[got["on"].astype(bool)].to_dict("records")
        state = [
            (r["g"], r["m_prefix"], texts[r["m_doc"]][2][r["m_pos"] - 1 + len(r["m_prefix"]) :][: 16 * window], len(r["m_prefix"]), len(r["m_prefix"]), r["m_rest"], r["m_times"], r["m_size"], r["m_doc"], r["m_pos"])
            for r in on
        ]
        window *= 16
    assert best == {(g, p): v[:3] for g, own in long.items() for p, v in own.items()}
    want = {}
    for g, own in long.items():
        for *_, least in own.values():
            want[g, least] = want.get((g, least), 0) + 1
    assert sums == want


def texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcé😀") for _ in range(rng.randint(0, 25))) for _ in range(120)] + ["ab" * 60, "ba" * 40, "a" * 90, "abcab" * 30]
    rows = [(rng.choice("pq"), rng.randint(1, 4), w, rng.randint(1, 5)) for w in words]
    return [*rows, ("p", 1, "", 3), ("p", 1, None, 3), ("r", 2, "xy", 1), (None, 2, "xyxyxyxy", 2)]


@pytest.mark.parametrize("window,bucket", [(64, 250_000), (10, 20)])
def test_top_parts(spark, window, bucket):
    """Short windows need rounds and small buckets are split; neither changes the parts or their order."""
    df = spark.createDataFrame(texts(), SCHEMA)
    for savings in (False, True):
        got = parts.top_parts(df, ["experiment"], 12, savings, 1 + savings, window, bucket)
        got = sorted(((r.experiment, r.part, r.value, r.occurrences, r.weight, r.texts, r["rank"]) for r in got.collect()), key=repr)
        assert got == tops(texts(), 12, savings)
    got = parts.first_sizes(df, ["experiment"], window, bucket)
    want = firsts(texts())
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_long_outcome(spark):
    """One outcome of 10,000 characters that repeat: as many distinct parts as theory says."""
    long = "ab" * 5000
    rows = spark.createDataFrame([("e", 1, long[:100], 1), ("e", 2, long, 1)], SCHEMA)
    assert sorted(map(tuple, parts.first_sizes(rows, ["experiment"]).collect())) == [("e", 1, 199), ("e", 2, 19_999 - 199)]
    top = parts.top_parts(rows, ["experiment"], 2, True, 2).first()
    n = max(range(2, 10_001), key=lambda n: (n - 1) * ((10_000 - n) // 2 + 1 + max((100 - n) // 2 + 1, 0)))
    assert top.value == (n - 1) * ((10_000 - n) // 2 + 1)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert parts.top_parts(none, ["experiment"], 3).count() == parts.first_sizes(none, ["experiment"]).count() == 0
    empty = spark.createDataFrame([], "experiment string, size int, input string, outcome string, steps int, status string")
    assert O.frequent_substructures(empty).count() == O.new_motifs(empty).count() == O.reuse_values(empty).count() == 0
