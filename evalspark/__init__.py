"""Retrieval-based question answering and its evaluation as Spark DataFrame jobs."""

from evalspark.settings import Settings

__all__ = ["Settings"]
