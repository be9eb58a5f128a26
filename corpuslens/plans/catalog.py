"""Registered queries over the reference tables and their SQL twins."""

from __future__ import annotations

from . import corpus, search

QUERIES: dict = {**corpus.QUERIES, **search.QUERIES}
ORACLES: dict = {**corpus.ORACLES, **search.ORACLES}
