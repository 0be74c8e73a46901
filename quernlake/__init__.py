"""Spark-first retrieval, consolidation and corpus-preparation engine."""
