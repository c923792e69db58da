"""Readers, writers and table management."""
