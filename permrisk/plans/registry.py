"""All registered queries: name -> (callable, SQL of the oracle or None)."""

from __future__ import annotations

from permrisk.plans import civic, documents, evaluation, extraction, features, features_history, fitted, geometry, ledger, models, monitor, quality, registry_queries, score, serving, text, upkeep
from permrisk.streaming import changes

QUERIES: dict[str, tuple] = {}
for _module in (features_history, features, evaluation, score, ledger, monitor, text, quality, registry_queries, models, serving, fitted, extraction, documents, upkeep, geometry, civic, changes):
    QUERIES |= _module.QUERIES
