"""Named queries over the driver tables, each with its DuckDB twin."""

from __future__ import annotations

from quarry.plans import audits, corpus, evaluation, storage

QUERIES: dict = {**evaluation.QUERIES, **corpus.QUERIES, **storage.QUERIES, **audits.QUERIES}
ORACLES: dict[str, str] = {**evaluation.ORACLES, **corpus.ORACLES, **storage.ORACLES, **audits.ORACLES}
