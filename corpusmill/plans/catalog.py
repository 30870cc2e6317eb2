"""Imports every module of queries, so that the registry is complete."""

from corpusmill.plans import corpus_queries, dialogue_queries, experiment_queries, file_queries, generic_queries, page_queries, ranking_queries, stream_queries, surface_queries, time_queries  # noqa: F401
from corpusmill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
