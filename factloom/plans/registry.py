"""Named queries over the driver tables and the SQL each must agree with."""

from __future__ import annotations

from factloom.plans import changes, claims, facts, feed_scores, feeds, figures, goals, people, registered, rounds, shapes, streams, surfaces, texts
from factloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "changes", "claims", "facts", "feed_scores", "feeds", "figures", "goals", "people", "registered", "rounds", "shapes", "streams", "surfaces", "texts"]
