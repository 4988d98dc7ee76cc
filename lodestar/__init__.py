"""Lodestar: vector search and record analytics expressed as Spark jobs."""
