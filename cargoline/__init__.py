"""Cargoline: clean, classify and evaluate trade declarations on Spark."""
