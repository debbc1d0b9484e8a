"""All registered queries of the library and their DuckDB twins."""

from __future__ import annotations

from tessera.functions import answers, decoding, guardrails, text
from tessera.operators import analytics, evaluation, lifecycle, memo, reflection, reports, retrieval
from tessera.streaming import applied, events, keyed, state

MODULES = [retrieval, memo, reflection, text, decoding, guardrails, answers, analytics, lifecycle, evaluation, reports, events, state, keyed, applied]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
