"""All queries of the toolkit and their SQL."""

from __future__ import annotations

from vigilark.plans import groups, learning, signals, similarity

_MODULES = (similarity, groups, signals, learning)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
