"""Temporal payment-network analytics as Spark jobs."""
