"""Relational operators on node, calibration, result and sample tables."""
