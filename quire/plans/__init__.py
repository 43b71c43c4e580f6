"""Whole runs, chained from the operators."""
