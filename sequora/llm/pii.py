"""Personal data: base patterns, and a skip-chain conditional random field that adds to them.

The tokens of a document that hold a digit or ``@`` are the nodes of a field with the labels
none, email, ip, card and phone; groups of digits with one space between them are one node if they have as many digits as a card or a phone.
Neighbours are linked by chain potentials; equal nodes, nodes with the same digits, and nodes with the same last ten digits
anywhere in the document by skip potentials. Loopy message passing
then makes the labels of such nodes agree, so that an item written again in a form that the base
patterns miss is found too. All weights are fitted together to base findings in a bounded sample of documents.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
RUN = re.compile(r"(?<!\S)[+(]?[0-9][0-9().-]*+(?: \(?[0-9][0-9().-]*+)++")  # groups of digits, one space between them
HINT = re.compile(r"[0-9@]")
EDGE = "\"'.,;:!?<>[]{}*#$%&|="
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
MAIL_LIKE = re.compile(r"[^@]+@[^@]+\.[^@]+")

WIDE, LABELS = 18, 5  # features of a node; none and the four kinds
CERTAIN = 30  # what a base finding adds to its label's score
Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (int(d) * 2 if int(d) < 5 else int(d) * 2 - 9) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Base findings by start, then kind; code points, end exclusive."""
    found: list[Span] = []
    if not HINT.search(text):
        return found
    end, at = 0, text.find("@")
    while at >= 0:  # from each @ back over the local part: linear, and the leftmost match
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), 0))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    found += [(*m.span(), 1) for m in IP.finditer(text) if all(len(p := q.lstrip("0")) <= 3 and int(p or "0") <= 255 for q in m[0].split("."))]
    for m in CARD.finditer(text):
        if len(m[0]) >= 14 and 14 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append((*m.span(), 2))
    if "+" in text:
        found += [(*m.span(), 3) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def _nodes(text: str) -> Iterator[Span]:
    """Where nodes begin and end: runs of groups of digits that may be one number, else tokens."""
    at = 0
    for m in RUN.finditer(text):
        if 10 <= sum(map(str.isdecimal, m[0])) <= 19:
            yield from (t.span() for t in TOKEN.finditer(text, at, m.start()))
            at = m.end()
            yield m.span()
    yield from (t.span() for t in TOKEN.finditer(text, at))


class Nodes:
    """The nodes of a text: places, features, the base's labels (0: none), and chain and skip links."""

    def __init__(self, text: str, base: list[Span]) -> None:
        places, rows, labels, ids = array("q"), bytearray(), bytearray(), array("q")
        k = 0
        for lo, hi in _nodes(text):
            core = text[lo:hi].strip(EDGE)
            digits = NOT_DIGIT.sub("", core)
            n = len(digits)
            while k < len(base) and base[k][1] <= lo:
                k += 1
            label = next((s[2] + 1 for s in base[k : k + 4] if s[0] < hi and s[1] > lo), 0)
            at = "@" in core
            rows += bytes(
                (1, at, at and MAIL_LIKE.fullmatch(core) is not None, DOTTED.fullmatch(core) is not None, 1 <= n <= 3, 4 <= n <= 9)
                + (10 <= n <= 13, 14 <= n <= 19, n > 19, core[:1] == "+", "(" in core, "-" in core, len(core) > 2 * n, any(map(str.isalpha, core)))
                + (label == 1, label == 2, label == 3, label == 4)
            )
            places.extend((lo, hi))
            labels.append(label)
            # Three keys of each node for skip links; short ones link with nothing (no hash is -1).
            ids.append(hash(core.lower()) if len(core) >= 4 else -1)
            ids.append(hash(digits) if n >= 7 else -1)
            ids.append(hash(digits[-10:]) if 10 <= n <= 15 else -1)
        self.places = np.frombuffer(places, np.int64).reshape(-1, 2)
        self.x = np.frombuffer(bytes(rows), np.uint8).reshape(-1, WIDE)
        self.y = np.frombuffer(bytes(labels), np.uint8).astype(np.int64)
        near = np.flatnonzero(self.places[1:, 0] - self.places[:-1, 1] <= 2)
        self.chain = np.stack([near, near + 1], axis=1).astype(np.int32)
        ids = np.frombuffer(ids, np.int64).reshape(-1, 3)
        pairs = []
        for column in ids.T:
            # A key's nodes are all linked to one of them, a base finding if there is any: one link a node, and no finding is far.
            order = np.lexsort((self.y == 0, column)).astype(np.int32)
            order = order[column[order] != -1]
            first = np.flatnonzero(np.r_[True, column[order[1:]] != column[order[:-1]]][: len(order)])
            hub = np.repeat(order[first], np.diff(np.r_[first, len(order)]))
            low, high = np.minimum(hub, order), np.maximum(hub, order)
            pairs.append((low.astype(np.int64) << 32 | high)[low < high])
        both = np.unique(np.concatenate(pairs))  # a pair with several keys in common is linked once
        self.skip = np.stack([both >> 32, both & 0xFFFFFFFF], axis=1).astype(np.int32)

    def __len__(self) -> int:
        return len(self.y)


class Field:
    """Node weights, chain potentials and skip potentials, fitted together by pseudo-likelihood.

    A node's label is predicted from its features and the labels of its neighbours in the chain and by
    skip links, so all three sets of weights share one convex loss. Each node counts twice: with what the base
    says of it and without, so the field also learns to do without the base's findings. A node that the base misses has the label of the finding that it is linked to, if there is one.
    """

    def __init__(self, texts: list[str], steps: int = 400) -> None:
        xs, ys, lefts, rights, skips = ([np.zeros((0, w))] for w in (WIDE, LABELS, LABELS, LABELS, LABELS))
        for text in texts:
            nodes = Nodes(text, base_spans(text))
            # What is linked to a finding is taken for the same item, also in a form that the base misses.
            labels = nodes.y.copy()
            for i, j in ((0, 1), (1, 0)):
                near = nodes.skip[nodes.y[nodes.skip[:, j]] > 0]
                same = near[nodes.y[near[:, i]] == 0]
                labels[same[:, i]] = nodes.y[same[:, j]]
            one = np.eye(LABELS)[labels]
            around = [np.zeros((len(nodes), LABELS)) for _ in range(3)]
            np.add.at(around[0], nodes.chain[:, 1], one[nodes.chain[:, 0]])
            np.add.at(around[1], nodes.chain[:, 0], one[nodes.chain[:, 1]])
            for i, j in ((0, 1), (1, 0)):
                np.add.at(around[2], nodes.skip[:, i], one[nodes.skip[:, j]])
            for rows, more in zip((xs, ys, lefts, rights, skips), (nodes.x, one, *around)):
                rows.append(more)
        x, y, left, right, skip = map(np.concatenate, (xs, ys, lefts, rights, skips))
        blind = x.copy()
        blind[:, -4:] = 0
        x, y, left, right, skip = (np.concatenate(p) for p in ((x, blind), (y, y), (left, left), (right, right), (skip, skip)))
        self.node, self.chain, self.skip = np.zeros((WIDE, LABELS)), np.zeros((LABELS, LABELS)), 8 * np.eye(LABELS)
        self.node[-4:, 1:] = 4 * np.eye(4)
        start = [w.copy() for w in (self.node, self.chain, self.skip)]
        mean, square = [np.zeros_like(w) for w in start], [np.zeros_like(w) for w in start]
        for step in range(1, steps + 1 if len(y) else 1):
            z = x @ self.node + left @ self.chain + right @ self.chain.T + skip @ self.skip
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p = (p / p.sum(axis=1, keepdims=True) - y) / len(y)
            skips = skip.T @ p
            for k, (w, grad) in enumerate(zip((self.node, self.chain, self.skip), (x.T @ p, left.T @ p + p.T @ right, (skips + skips.T) / 2))):
                grad = grad + 1e-4 * (w - start[k])
                mean[k] = 0.9 * mean[k] + 0.1 * grad
                square[k] = 0.99 * square[k] + 0.01 * grad**2
                w -= 0.05 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)

    def marginals(self, nodes: Nodes, rounds: int = 10, part: int = 65_536) -> np.ndarray:
        """Label probabilities of each node by loopy sum-product messages, damped by half. Base findings are given.

        Two messages of five numbers a link, sent in parts of a bounded size: memory is linear in the text.
        """
        score = nodes.x.astype(np.float32) @ self.node.astype(np.float32)
        score[nodes.y > 0, nodes.y[nodes.y > 0]] += CERTAIN
        kinds = [(pairs, np.exp(np.clip(table, -20, 20)).astype(np.float32)) for pairs, table in ((nodes.chain, self.chain), (nodes.skip, self.skip)) if len(pairs)]
        sent = [np.zeros((2, len(pairs), LABELS), np.float32) for pairs, _ in kinds]  # forth and back along each link

        def belief() -> np.ndarray:
            total = score.copy()
            for (pairs, _), messages in zip(kinds, sent):
                for way in (0, 1):
                    np.add.at(total, pairs[:, 1 - way], messages[way])
            return total

        for _ in range(rounds if kinds else 0):
            total, fresh = belief(), []
            for (pairs, table), messages in zip(kinds, sent):
                new = np.empty_like(messages)
                for way in (0, 1):
                    for lo in range(0, len(pairs), part):
                        own = slice(lo, lo + part)
                        out = total[pairs[own, way]] - messages[1 - way, own]
                        out = np.exp(out - out.max(axis=1, keepdims=True)) @ (table if way == 0 else table.T)
                        out = np.log(out + np.float32(1e-30))
                        new[way, own] = 0.5 * messages[way, own] + 0.5 * (out - out.max(axis=1, keepdims=True))
                fresh.append(new)
            sent = fresh
        total = belief()
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def more_spans(self, text: str, base: list[Span], least: float = 0.9) -> list[Span]:
        """Spans that the field adds: runs of nodes outside the base with one label, of a fitting size."""
        nodes = Nodes(text, base)
        if not len(nodes):
            return []
        p = self.marginals(nodes)
        label = np.where((p.max(axis=1) >= least) & ~_overlaps(nodes.places, base), p.argmax(axis=1), 0)
        out, last = [], -1
        for i in np.flatnonzero(label).tolist():
            if i <= last:
                continue
            last = i
            while last + 1 < len(label) and label[last + 1] == label[i] and nodes.places[last + 1, 0] - nodes.places[last, 1] <= 1 and text[nodes.places[last, 1] - 1] not in EDGE:
                last += 1
            lo = int(nodes.places[i, 0])
            raw = text[lo : int(nodes.places[last, 1])]
            core = raw.strip(EDGE)
            lo += len(raw) - len(raw.lstrip(EDGE))
            n, kind = len(NOT_DIGIT.sub("", core)), int(label[i]) - 1
            if [MAIL_LIKE.fullmatch(core) is not None, DOTTED.fullmatch(core) is not None, 14 <= n <= 19, 10 <= n <= 15][kind]:
                out.append((lo, lo + len(core), kind))
        return out


def _overlaps(places: np.ndarray, base: list[Span]) -> np.ndarray:
    """Which places overlap a span."""
    if not base:
        return np.zeros(len(places), bool)
    starts = np.array([s[0] for s in base], np.int64)
    reach = np.maximum.accumulate(np.array([s[1] for s in base], np.int64))
    at = np.searchsorted(starts, places[:, 1]) - 1
    return (at >= 0) & (reach[np.maximum(at, 0)] > places[:, 0])


def fit_field(docs: DataFrame, text_col: str = "text", sample: int = 512, longest: int = 20_000) -> Field:
    """Fit the field to base findings in ``sample`` documents, taken by the hash of their text.

    Only texts of ``longest`` characters or fewer with a digit or ``@`` are taken; that bounds
    what reaches the driver.
    """
    texts = docs.select(F.col(text_col).alias("t")).where((F.length("t") <= longest) & F.col("t").rlike("[0-9@]"))
    hashed = texts.withColumn("h", F.xxhash64("t"))
    chosen = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(sample).collect()]  # hashes travel, not texts
    rows = hashed.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("t").alias("t")).orderBy("h").collect() if chosen else []
    return Field([r.t for r in rows])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{lo}:{hi}" for lo, hi, k in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind."""
    out, at = [], 0
    for lo, hi, kind in spans:
        if lo >= at:
            out += [text[at:lo], f"<{KINDS[kind].upper()}>"]
        at = max(at, hi)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, text_col: str = "text", field: Field | None = None, mask: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_email, n_ip, n_card, n_phone`` (base findings), ``base_spans``, ``spans`` and, on demand, ``masked``.

    ``spans`` holds the base findings and those of the field. Null text counts as empty and has
    none (its ``masked`` is empty). Repeated rows are treated alike; an empty table gives an empty
    one; columns of the input named like a new one are replaced. A text is held whole by one task;
    beside it a token with a digit or ``@`` takes some 400 bytes (5 MB of numbers: under 500 MB).
    """
    field = field or fit_field(docs, text_col)

    def run(texts: list[str]) -> list[pa.Array]:
        base = [base_spans(t) for t in texts]
        full = [sorted(b + field.more_spans(t, b), key=lambda s: (s[0], s[2])) if HINT.search(t) else b for t, b in zip(texts, base)]
        counts = [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in range(4)]
        out = [*counts, pa.array(map(_joined, base), pa.string()), pa.array(map(_joined, full), pa.string())]
        return out + [pa.array(map(masked, texts, full), pa.string())] * mask

    schema = "n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string" + ", masked string" * mask
    return map_texts(docs, run, schema, text_col, keep)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs, keep=["doc_id"])
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
