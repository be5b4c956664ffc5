"""Structured Streaming form of the monthly revenue rollup."""
