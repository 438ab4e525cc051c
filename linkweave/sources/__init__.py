"""Readers, writers and adapters of records."""
