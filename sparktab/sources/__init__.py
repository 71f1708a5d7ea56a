"""Readers, writers and contracts of tables, predictions and records."""
