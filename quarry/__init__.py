"""Quarry: corpus, retrieval and dataset analytics written as Spark jobs."""
