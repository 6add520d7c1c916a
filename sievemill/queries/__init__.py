"""The queries of the library's own operators with the SQL that they are compared with."""

from __future__ import annotations

from . import balances, base, batches, corrections, distributions, estimators, joining, mathematics, projecting, reporting, rewarding, rolling, sampling, selecting, streams, texts, token_arrays, validation  # noqa: F401

QUERIES, ORACLE_SQL = base.QUERIES, base.ORACLE_SQL
