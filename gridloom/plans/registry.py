"""All queries of the numerical engine by name, with their oracle SQL where SQL can express them."""

from __future__ import annotations

from . import elementwise, features, matrices, texts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (elementwise, matrices, texts, features):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
