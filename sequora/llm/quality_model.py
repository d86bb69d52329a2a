"""Quality classifier: random-indexing word vectors, pooled by document, and a small network.

Each word has a sparse random index vector that follows from a hash of the word. A word's vector
is its index vector plus the index vectors that stood beside it in a bounded sample of labelled
documents. Words that fewer than four of them have stand as their shape (runs of letters, digits and
signs), which has a vector like any word. Documents are the means of their words' vectors; a
two-layer network scores them, and its probabilities are calibrated by one temperature.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, materialize

RUNS = [(re.compile("[A-ZÀ-ÖØ-Þ]+"), "X"), (re.compile(r"[^\W\d_X]+"), "x"), (re.compile(r"\d+"), "9"), (re.compile(r"(.)\1+"), r"\1")]


def shape(word: str) -> str:
    """Runs of capitals, other letters and digits as X, x and 9; other signs once a run."""
    for pattern, sign in RUNS:
        word = pattern.sub(sign, word)
    return "\0" + word


def index_vector(word: str, dims: int, nonzero: int = 4) -> np.ndarray:
    """A sparse vector of +1 and -1 that depends on the word alone."""
    rng = np.random.default_rng(zlib.crc32(word.encode()))
    out = np.zeros(dims, np.float32)
    out[rng.choice(dims, nonzero, replace=False)] = rng.choice([-1.0, 1.0], nonzero)
    return out


class QualityModel:
    """Word vectors, network and temperature, fitted to labelled texts; the same rows give the same model."""

    def __init__(self, texts: list[str], labels: list[int], dims: int = 96, hidden: int = 24, min_docs: int = 4, epochs: int = 60) -> None:
        self.dims = dims
        lists = [t.split() for t in texts]
        seen: dict[str, int] = {}
        for words in lists:
            for w in set(words):
                seen[w] = seen.get(w, 0) + 1
        vocabulary = sorted((w for w, n in seen.items() if n >= min_docs), key=lambda w: (-seen[w], w))
        shapes = sorted({shape(w) for w in seen})
        self.ids = {w: i for i, w in enumerate([*vocabulary, *shapes, "\0"])}
        self.n_fixed = len(self.ids)
        index = np.array([index_vector(w, dims) for w in self.ids])
        context = np.zeros_like(index)
        rows = [np.array([self._id(w) for w in words], np.int64) for words in lists]
        for ids in rows:
            for off in (1, 2):
                np.add.at(context, ids[off:], index[ids[:-off]])
                np.add.at(context, ids[:-off], index[ids[off:]])
        norm = np.linalg.norm(context, axis=1, keepdims=True)
        self.vectors = index / 2 + context / np.where(norm > 0, norm, 1)
        x = np.array([self._pool(ids) for ids in rows], np.float32).reshape(-1, dims + 1)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(dims + 1), np.ones(dims + 1))
        self._fit((x - self.mean) / self.scale, np.array(labels, float), hidden, epochs)

    def _id(self, word: str) -> int:
        got = self.ids.get(word)
        if got is None:
            got = self.ids.get(shape(word), self.n_fixed - 1)
            if len(self.ids) < self.n_fixed + 300_000 and len(word) <= 40:
                self.ids[word] = got
        return got

    def _pool(self, ids: np.ndarray) -> np.ndarray:
        if not len(ids):
            return np.zeros(self.dims + 1, np.float32)
        at, counts = np.unique(ids, return_counts=True)
        return np.append(counts @ self.vectors[at] / len(ids), np.log1p(len(ids))).astype(np.float32)

    def _fit(self, x: np.ndarray, y: np.ndarray, hidden: int, epochs: int) -> None:
        rng = np.random.default_rng(7)
        d = x.shape[1]
        self.w1, self.b1 = rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden)
        self.w2, self.b2, self.temperature = rng.normal(0, hidden**-0.5, hidden), 0.0, 1.0
        if not len(y):
            self.w2 = np.zeros(hidden)
            return
        valid = np.arange(len(y)) % 5 == 4
        xt, yt = (x[~valid], y[~valid]) if valid.sum() >= 20 else (x, y)
        params = [self.w1, self.b1, self.w2, np.array([0.0])]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(yt)), max(1, len(yt) // 64)):
                step += 1
                h = np.tanh(xt[part] @ params[0] + params[1])
                g = (1 / (1 + np.exp(-(h @ params[2] + params[3][0]))) - yt[part]) / len(part)
                gh = g[:, None] * params[2] * (1 - h * h)
                for k, grad in enumerate([xt[part].T @ gh + 1e-3 * params[0], gh.sum(0), h.T @ g + 1e-3 * params[2], np.array([g.sum()])]):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    params[k] -= 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = params[0], params[1], params[2], float(params[3][0])
        xv, yv = (x[valid], y[valid]) if valid.sum() >= 20 else (x, y)
        logits = self._logits(xv)
        loss = lambda t: np.logaddexp(0, np.where(yv == 1, -logits, logits) / t).mean()
        self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, texts: list[str]) -> np.ndarray:
        """The calibrated probability of label 1 for each text."""
        x = np.array([self._pool(np.fromiter(map(self._id, t.split()), np.int64)) for t in texts]).reshape(-1, self.dims + 1)
        z = self._logits((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 3000, longest: int = 20_000) -> QualityModel:
    """Fit the model to ``sample`` labelled rows, taken by the hash of their ids.

    All words that ``min_docs`` (4) of the sample's texts have get a vector of their own, any other word that of its shape, or one for all shapes
    that the sample lacks; so the two bounds below also bound the vocabulary. Texts of over ``longest`` characters are not among them; the two bounds limit what reaches the
    driver. Only the rows of ``labels`` are used, and only their texts and labels. A document with two
    labels counts once for each. Without any label all scores are 0.5; with one label they lean to it.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_sq_id"), F.col(label_col).cast("int").alias("_sq_label")
    )
    texts = docs.where(F.length(text_col) <= longest).select(F.col(id_col).alias("_sq_own"), F.col(text_col).alias("_sq_text"))
    # Ids are joined first, so labels of other documents take no place in the sample; then its texts are fetched.
    order = [F.xxhash64("_sq_id"), F.col("_sq_id"), F.col("_sq_label")]
    chosen = marked.join(texts.select("_sq_own").distinct(), F.col("_sq_own") == F.col("_sq_id")).drop("_sq_own").orderBy(*order).limit(sample)
    rows = (
        texts.join(F.broadcast(materialize(chosen)), F.col("_sq_own") == F.col("_sq_id"))  # ``sample`` rows at most
        .select("_sq_text", "_sq_label", "_sq_id").orderBy(*order, "_sq_text").limit(sample).collect()
    )
    return QualityModel([r._sq_text for r in rows], [r._sq_label for r in rows])


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (probability of label 1) and ``predicted`` to each row.

    Null text counts as empty and is scored as such; whole texts are pooled; repeated rows get
    equal scores; an empty table gives an empty one; columns named like a new one are replaced.
    """
    out = map_texts(docs, lambda texts: [pa.array(model.score(texts), pa.float64())], "score double", text_col, keep)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = fit_quality(docs, labels.where(~held_out))
    return score_quality(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")
