"""What the field adds to the base findings: measured on a made corpus, and its messages against enumeration."""

import itertools
import random

import numpy as np
import pytest

from sequora.llm import pii

from .test_operators import prose


def made(seed):
    """A text with a phone or card in a form that the base finds and two that it doesn't, beside numbers that are neither; and those two forms."""
    rng = random.Random(seed)
    if seed % 3:
        d = f"{rng.randint(200, 999)}{rng.randint(200, 999)}{rng.randint(1000, 9999)}"
        base = rng.choice(["+1 ({0}) {1}-{2}", "+1 {0} {1} {2}", "+1-{0}-{1}-{2}"])
        others = ["1{0}{1}{2}", "({0}) {1}-{2}", "{0}.{1}.{2}", "{0}-{1}-{2}", "1 {0} {1} {2}"]
        forms = [f.format(d[:3], d[3:6], d[6:]) for f in (base, *rng.sample(others, 2))]
    else:
        while not pii.luhn(d := str(rng.randint(4 * 10**15, 5 * 10**15))):
            pass
        four = [d[k : k + 4] for k in range(0, 16, 4)]
        forms = [rng.choice([" ", "-", ""]).join(four), "/".join(four), "_".join(four)]
    noise = [f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/2024", f"order {rng.randint(10**9, 10**10)}", f"{rng.randint(1, 900)} {rng.randint(1, 900)} boxes", f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}", f"1{rng.randint(10**9, 10**10 - 1)}"]
    parts = [*forms, *rng.sample(noise, 4)]
    rng.shuffle(parts)
    return " ".join(f"{prose(rng.randint(0, 10**6), rng.randint(3, 25))} {p}{rng.choice(['', '.', ','])}" for p in parts), forms[1:]


def test_added_spans():
    field = pii.Field([made(i)[0] for i in range(300)])
    added = right = wanted = 0
    for i in range(1000, 1400):
        text, forms = made(i)
        base = pii.base_spans(text)
        got = [text[a:b] for a, b, _ in field.more_spans(text, base)]
        missed = [f for f in forms if not any(text[a:b] == f for a, b, _ in base)]
        added, wanted = added + len(got), wanted + len(missed)
        right += sum(g in missed for g in got)
    assert wanted > 500 and right / wanted >= 0.9 and right / added >= 0.95, (right, wanted, added)


def test_four_forms():
    field = pii.Field([made(i)[0] for i in range(300)])
    text = "+1 415 555 2671 is mine; write 14155552671, (415) 555-2671 or 415.555.2671. Not 14155552672, nor 2024 12 31."
    assert [text[a:b] for a, b, _ in field.more_spans(text, pii.base_spans(text))] == ["14155552671", "(415) 555-2671", "415.555.2671"]


@pytest.mark.parametrize("seed", range(12))
def test_messages_on_trees(seed):
    """Where links make a tree, marginals are those of summing over all labellings."""
    rng = np.random.default_rng(seed)
    field, n = pii.Field([]), int(rng.integers(2, 7))
    field.node, field.chain, field.skip = rng.normal(size=field.node.shape), rng.normal(size=field.chain.shape), rng.normal(size=field.skip.shape)
    field.skip = (field.skip + field.skip.T) / 2
    nodes = pii.Nodes("1 " * n, [])
    nodes.x = rng.integers(0, 2, nodes.x.shape).astype(np.uint8)
    links = [(int(rng.integers(0, k)), k) for k in range(1, n)]
    skip = rng.random(n - 1) < 0.5
    pick = lambda yes: np.array([x for x, s in zip(links, skip) if s == yes], np.int32).reshape(-1, 2)
    nodes.chain, nodes.skip = pick(False), pick(True)
    score = nodes.x.astype(float) @ field.node
    want = np.zeros((n, pii.LABELS))
    for labels in itertools.product(range(pii.LABELS), repeat=n):
        total = sum(score[i, y] for i, y in enumerate(labels))
        total += sum(field.chain[labels[a], labels[b]] for a, b in nodes.chain) + sum(field.skip[labels[a], labels[b]] for a, b in nodes.skip)
        for i, y in enumerate(labels):
            want[i, y] += np.exp(total)
    assert np.allclose(field.marginals(nodes, rounds=80), want / want.sum(axis=1, keepdims=True), atol=1e-3)


def test_links_and_nodes():
    text = "a +1 415 555 2671 b 14155552671 12 13 c 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 x@y.zz (415) 555-2671"
    nodes = pii.Nodes(text, pii.base_spans(text))
    shown = [text[a:b] for a, b in nodes.places.tolist()]
    assert shown[0] == "+1 415 555 2671" and "(415) 555-2671" in shown and "x@y.zz" in shown and "14155552671" not in shown[0]
    hub = {tuple(p) for p in nodes.skip.tolist()}
    assert all(a == 0 for a, _ in hub if shown[a].startswith("+1"))
    assert len(pii.Nodes("", [])) == 0 and pii.Nodes("1", []).skip.shape == (0, 2)
