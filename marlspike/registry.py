"""Queries of the core library and their oracle SQL."""

from __future__ import annotations

from functools import reduce

from .operators import bm25, chunking, filings, footnotes, fusion, irmetrics, records, screening, telemetry, units, vectors
from .plans import retrieval, serving
from .streaming import metrics

_MODULES = (bm25, vectors, fusion, irmetrics, telemetry, screening, filings, footnotes, records, chunking, retrieval, serving, metrics)
QUERIES = reduce(lambda a, m: a | m.QUERIES, _MODULES, {"p5_found": units.p5_found, "p5_by_unit": units.p5_by_unit})
ORACLE_SQL: dict[str, str] = reduce(lambda a, m: a | m.SQL, _MODULES, {})
FLAGSHIP = bm25.bm25_topk
