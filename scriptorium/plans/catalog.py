"""Imports every query module so that the registry is complete."""

from scriptorium.plans import q_archetypes, q_corpus, q_extraction, q_misc, q_reports, q_sinks, q_sources, q_stream, q_structure, q_vectors  # noqa: F401
from scriptorium.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
