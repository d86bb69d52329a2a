"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


# SQL of the shared fixtures, each a list of common table expressions.
LEX = r"""words AS (SELECT lang AS grp, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents),
lex AS (SELECT grp, word, count(*) AS n FROM words GROUP BY grp, word)"""

_PREFIXES = """pre AS (SELECT grp, n, substr(word, 1, i) AS path, i::INTEGER AS depth, i = length(word) AS last
  FROM (SELECT grp, word, n, unnest(range(0, length(word) + 1)) AS i FROM lex)),
gn AS (SELECT path, depth, grp, sum(n)::BIGINT AS cnt, coalesce(sum(n) FILTER (last), 0)::BIGINT AS term FROM pre GROUP BY path, depth, grp),
nodes AS (SELECT path, depth, substr(path, depth, 1) AS token, sum(cnt)::BIGINT AS total, sum(term)::BIGINT AS terminal FROM gn GROUP BY path, depth)"""

NODES = f"""{LEX},
{_PREFIXES},
kept AS (SELECT *, substr(path, 1, depth - 1) AS parent FROM nodes WHERE total >= 2 OR depth = 0)"""

ENT = """ent AS (SELECT parent AS path, count(*) AS branch,
  CASE WHEN count(*) > 1 THEN log2(sum(total)) - sum(total * log2(total)) / sum(total) ELSE 0.0 END AS entropy
  FROM kept WHERE depth > 0 GROUP BY parent)"""

VOWEL_LIST = "aeiouyäöüéèêàáíóúôîûâ"

OUT = rf"""{LEX},
o1 AS (SELECT grp AS experiment, length(word)::INTEGER AS size, word AS input,
  substr(word, 1, 1) || regexp_replace(substr(word, 2), '[{VOWEL_LIST}]', '', 'g') AS bare FROM lex),
outcomes AS (SELECT experiment, size, input,
  CASE WHEN size > 14 THEN 'explosive' WHEN size - length(bare) >= 4 THEN 'divergent' ELSE 'normal' END AS status,
  CASE WHEN size > 14 THEN 0 ELSE least(4, size - length(bare)) END::INTEGER AS steps,
  CASE WHEN size <= 14 AND size - length(bare) < 4 THEN bare END AS outcome FROM o1)"""

REPORT = f"""{OUT},
reports AS (SELECT experiment, size, count(*) AS total, count(*) FILTER (status = 'normal') AS normal,
  count(*) FILTER (status = 'divergent') AS divergent, count(*) FILTER (status = 'explosive') AS explosive,
  count(DISTINCT outcome) AS distinct_outcomes, round(coalesce(avg(steps) FILTER (status = 'normal'), 0), 6) AS avg_steps,
  coalesce(max(steps) FILTER (status = 'normal'), 0) AS max_steps, round(count(DISTINCT outcome) / count(*), 6) AS ratio
  FROM outcomes GROUP BY experiment, size)"""
