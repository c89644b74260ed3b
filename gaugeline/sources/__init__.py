"""Readers, writers and adapters that produce observation tables."""
