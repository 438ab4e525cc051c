"""Relational operators of record linkage: blocking, context, features, metrics, cascade, checks."""
