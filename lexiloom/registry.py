"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from lexiloom.plans import cases, catalogue, content, retrieval, streams

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (retrieval, catalogue, content, streams, cases):
    QUERIES.update(_part.QUERIES)
    ORACLES.update(_part.ORACLES)
