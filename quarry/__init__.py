"""Quarry: corpus and graph analytics as composable PySpark DataFrame operators."""
