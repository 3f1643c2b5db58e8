"""All core queries and their SQL counterparts."""

from __future__ import annotations

from . import states, tokens

QUERIES = states.QUERIES | tokens.QUERIES
ORACLES = states.ORACLES | tokens.ORACLES
