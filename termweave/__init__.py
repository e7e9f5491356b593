"""Termweave: document-set analytics on Spark: groups, metrics, term statistics."""
