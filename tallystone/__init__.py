"""Attestable dataset engine on Spark: versioned tables, pruning reads, profiles, integrity."""
