"""Spark jobs that build bicycle networks from map extracts and answer tables of route requests."""
