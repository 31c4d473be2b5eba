"""Queries of this subpackage and their SQL."""

from quarry.llm import decontamination, mixing, neighbours, quality, sharding, simhash, substrings, tokens, toxicity, warc

_MODULES = (decontamination, quality, warc, simhash, neighbours, substrings, tokens, toxicity, mixing, sharding)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in getattr(m, "ORACLE_SQL", {}).items()}
