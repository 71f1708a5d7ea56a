"""Structured Streaming forms of the stateless features and of the ledger watch."""
