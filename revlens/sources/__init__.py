"""Readers (test-table adapter, CSV, folder ingest), schemas and sinks."""
