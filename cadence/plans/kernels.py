"""Queries that run image kernels."""

QUERIES: dict = {}
