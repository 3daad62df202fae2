"""The registered queries of this subpackage: one thin query for each operator."""

from __future__ import annotations

from tidemark.llm import q_native, q_pairs, q_text

QUERIES: dict = {**q_native.QUERIES, **q_text.QUERIES, **q_pairs.QUERIES}
ORACLES: dict = {**q_native.ORACLES, **q_text.ORACLES, **q_pairs.ORACLES}
