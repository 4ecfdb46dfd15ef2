"""Spark-first cohort analytics: typed sources, key normalisers, joins, windows, statistics and data contracts."""
