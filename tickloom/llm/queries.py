"""All queries of the text operators and their SQL."""

from __future__ import annotations

from . import embedding_dedup, exact_dedup, filter_audit, imatch, licences, lm_score, mixing, ngram_join, packing, prefix_trie, secrets, toxicity, warc

MODULES = (warc, exact_dedup, secrets, toxicity, packing, licences, lm_score, imatch, mixing, ngram_join, prefix_trie, filter_audit, embedding_dedup)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in getattr(m, "SQL", {}).items()}
