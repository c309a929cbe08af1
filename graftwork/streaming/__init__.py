"""Structured Streaming forms of the journal fold, the windows and the ledger."""
