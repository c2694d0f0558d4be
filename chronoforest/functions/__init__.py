"""Scalar functions: names, taxonomy labels, constraints, distributions."""
