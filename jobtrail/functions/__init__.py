"""Scalar functions of the job-history domain as Column builders (no Python UDFs)."""
