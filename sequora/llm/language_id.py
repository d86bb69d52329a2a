"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its labelled text. A text
is cut into phrases, each the longest match that the automaton still follows, wherever it begins and
ends; the fewer phrases a character, the closer the text is to the sample, and the language with the
fewest wins. What is parsed is the running text in lower case, letters and their marks only, one space between words.
"""

from __future__ import annotations

import re
import warnings
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
MARK = regex.compile(r"\p{M}")
WITH_MARKS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str) -> list[str]:
    """Runs of letters with the marks on them (vowel signs, points, accents), in lower case."""
    if not text.isascii() and MARK.search(text):
        return WITH_MARKS.findall(text.lower())
    words = LETTERS.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    # The pattern also has numerals such as superscripts, which are no letters.
    return "".join(c if c.isalpha() else " " for w in words for c in (*w, " ")).split()


def suffix_automaton(text: str) -> dict:
    """The automaton of all substrings of ``text``: a state is a dictionary from characters to states; returns the start."""
    start: dict = {}
    nexts, link, length = [start], [-1], [0]
    last = 0
    for c in text:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    for state in nexts:
        for c, to in state.items():
            state[c] = nexts[to]
    return start


def phrases(start: dict, text: str) -> int:
    """How many phrases ``text`` has: each is the longest match from where the one before ended, or one unknown character."""
    count, state = 0, start
    for c in text:
        to = state.get(c)
        if to is None:
            if state is not start:
                count += 1
                to = start.get(c)
            if to is None:
                count += 1
                to = start
        state = to
    return count + (state is not start)


class Identifier:
    """The automata of all languages."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        self.starts = [suffix_automaton(samples[lang]) for lang in self.langs]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language and a score from 0 to 1 (1 less the share of the best in the next best's phrases)."""
        langs, scores = [], []
        for text in texts:
            words = words_of(text)
            if not self.langs or not words:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            running = f" {' '.join(words)} "
            best, *rest = sorted((phrases(start, running), lang) for start, lang in zip(self.starts, self.langs))
            langs.append(best[1])
            scores.append(1 - best[0] / rest[0][0] if rest else 1.0)
        return langs, scores


@lru_cache(maxsize=1)
def identifier(samples: tuple[tuple[str, str], ...]) -> Identifier:
    """One a worker process."""
    return Identifier(dict(samples))


def sample_texts(labelled: DataFrame, lang_col: str, text_col: str, docs_per_lang: int, chars_per_lang: int, most_langs: int = 200, total_chars: int = 640_000) -> dict[str, str]:
    """Up to ``docs_per_lang`` texts of each language, by the hash of the text, cut at ``chars_per_lang`` characters in all.

    All languages together have ``total_chars`` at most (some 700 bytes each in every worker); where that leaves a language fewer than
    ``chars_per_lang``, a warning says so. More than ``most_langs`` languages are an error.
    """
    named = [r[0] for r in labelled.where(F.col(lang_col).isNotNull()).select(lang_col).distinct().limit(most_langs + 1).collect()]
    if len(named) > most_langs:
        raise ValueError(f"more than {most_langs} languages are labelled; raise most_langs or clean the labels")
    share = total_chars // max(1, len(named))
    if share < chars_per_lang:
        warnings.warn(f"{len(named)} languages share {total_chars} characters of samples: {share} each, not {chars_per_lang}; raise total_chars for more", stacklevel=2)
        chars_per_lang = share
    short = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).alias("lang"), F.substring(text_col, 1, chars_per_lang).alias("t"), F.xxhash64(text_col).alias("h")
    )
    # The least hash of each of as many classes: a combinable aggregate, with no window over a hot language.
    chosen = short.groupBy("lang", F.pmod("h", F.lit(docs_per_lang)).alias("k")).agg(F.min("h").alias("h")).select("lang", "h")
    keys = chosen.sparkSession.createDataFrame(chosen.collect(), "lang string, h long")  # hashes travel, not texts
    rows = short.join(F.broadcast(keys), ["lang", "h"]).groupBy("lang", "h").agg(F.min("t").alias("t")).orderBy("lang", "h").collect()
    got: dict[str, str] = {}
    for r in rows:
        got[r.lang] = (got.get(r.lang, "") + " " + " ".join(words_of(r.t)))[:chars_per_lang]
    return got


def identify(
    docs: DataFrame,
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_lang: int = 48,
    chars_per_lang: int = 40_000,
    most_langs: int = 200,
    total_chars: int = 640_000,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to each row of ``docs``, learned from ``labelled`` alone.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing is
    labelled; ties go to the language that comes first by name. Repeated rows are treated alike,
    whole texts are parsed (a text and its lower-case copy are held at once), an empty table gives an empty one; columns of the input named like a
    new one are replaced. The sample (``docs_per_lang``, ``chars_per_lang`` and ``total_chars``
    of all languages, which share the latter evenly) is all that reaches the driver; more than ``most_langs`` languages raise a ``ValueError``.
    """
    samples = sample_texts(labelled, lang_col, text_col, docs_per_lang, chars_per_lang, most_langs, total_chars)
    pairs = tuple(sorted(samples.items()))

    def run(texts: list[str]) -> list[pa.Array]:
        langs, scores = identifier(pairs).predict(texts)
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return map_texts(docs, run, "lang_pred string, score double", text_col, keep)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = identify(docs.select("doc_id", "text"), docs.where(~held_out), keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
