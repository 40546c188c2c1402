"""Readers, writers and calls to services."""
