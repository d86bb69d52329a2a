"""All queries over the reference operators, with their SQL."""

from __future__ import annotations

from . import display_queries, ngram_queries, path_queries, prep_queries, storage_queries, survey_queries, trie_queries  # noqa: F401 - they register themselves
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

flagship = trie_queries.depth_stats
