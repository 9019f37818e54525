"""All core queries and their SQL twins."""

from __future__ import annotations

from tessella.plans import corpus, records, retrieval, streams, study, texts

_MODULES = (records, corpus, study, retrieval, texts, streams)

QUERIES = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
